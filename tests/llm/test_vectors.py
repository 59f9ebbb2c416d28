"""Top-k search and hard negatives against plain versions, on odd rows, hot ids, ties and large numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.llm import hard_negatives, topk_search, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, _v string, score string, rank int, _q int, _key string, query_id int"


def odd_rows(seed=1, n=260, dim=20):
    """Clustered vectors with copies, ties, hot and null ids, odd components, unlike lengths and large numbers."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for k in range(n):
        label = rng.randrange(4)
        v = [c + rng.gauss(0, 0.6) for c in centres[label]]
        rows.append((k, [x / 3 for x in v], label))
    rows += [(1000 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(12)]  # copies: ties go to the smaller id
    rows += [(50, rows[7][1], 1), (50, rows[8][1], 2), (50, rows[8][1], 2), (-100, rows[9][1], 3)]  # an id that several rows have, one below zero
    rows += [(None, rows[5][1], 1), (None, None, 1), (300, None, 2), (350, [None] * dim, 1), (400, [math.nan] * dim, 1), (450, [math.inf, *[0.0] * (dim - 1)], 2), (500, rows[3][1], None)]
    rows += [(600, [], 1), (650, [0.5, -0.5], 2), (700, [0.1] * 40, 3), (750, [0.0] * dim, 0)]
    return rows


def takes_part(row, labelled):
    return row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1]) and not (labelled and row[2] is None)


def score(a, b):
    out = sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    return max(min(out, 2**63 - 1), 1 - 2**63)


def order(pair):
    return (-pair[0], pair[1] is None, pair[1] or 0)


def plain_top_k(rows, every, k):
    rows, out = [r for r in rows if takes_part(r, False)], []
    for i, v, _ in rows:
        if i is not None and i % every == 0:
            found = sorted(((score(v, w), j) for j, w, _ in rows if j != i), key=order)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(found)]
    return sorted(out, key=repr)


def plain_mine(rows, every):
    rows, out = [r for r in rows if takes_part(r, True)], []
    for i, v, label in rows:
        if i is not None and i % every == 0:
            own = sorted(((score(v, w), j) for j, w, m in rows if j != i and m == label), key=order)[:5]
            rest = sorted(((score(v, w), j) for j, w, m in rows if j != i and m != label), key=order)
            for p, positive in own:
                fit = [(s, j) for s, j in rest if 50 * p <= 100 * s <= 95 * p][:3]
                out += [(i, positive, r + 1, j, p, s) for r, (s, j) in enumerate(fit)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, m, "x", "y", 7, 8, "z", 9) for i, v, m in rows], SCHEMA).repartition(5)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("values", [1 << 21, 900])
def test_top_k_equals_a_plain_search(spark, values):
    rows = odd_rows()
    out = topk_search.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 5, block_values=values)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and got(out) == plain_top_k(rows, 10, 5)


@pytest.mark.parametrize("values", [1 << 21, 900])
def test_hard_negatives_equal_a_plain_search(spark, values):
    rows = odd_rows(2)
    out = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, block_values=values, fit_rows=100)
    want = plain_mine(rows, 10)
    assert len(want) > 100 and got(out) == want


def test_large_components_are_exact_and_held(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice((-1, 1)) * rng.random() * 10 ** rng.choice((0, 5, 6, 7, 8)) for _ in range(6)], k % 2) for k in range(40)]
    rows += [(100, [1e30, 1.0], 0), (150, [-1e30, 2.0], 1), (200, [1e300] * 3, 1)]
    assert got(topk_search.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 5)) == plain_top_k(rows, 10, 5)
    assert got(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain_mine(rows, 10)


def test_a_hot_id_and_copies_of_one_vector(spark):
    rng = random.Random(4)
    rows = [(k, [rng.random() for _ in range(8)], k % 3) for k in range(60)] + [(10, [0.5] * 8, 1)] * 40 + [(61 + k, [0.25] * 8, 2) for k in range(40)]
    assert got(topk_search.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 5, block_values=200)) == plain_top_k(rows, 10, 5)
    assert got(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, block_values=200)) == plain_mine(rows, 10)


def test_no_rows_no_queries_and_few_candidates(spark):
    never, every = F.lit(None).cast("boolean"), F.lit(True)
    for rows in ([], [(None, None, None)], [(5, [1.0], 1)]):
        assert got(topk_search.top_k(frame(spark, rows), every)) == [] and got(hard_negatives.mine(frame(spark, rows), every)) == []
    assert got(topk_search.top_k(frame(spark, [(1, [1.0], 1), (2, [2.0], 1)]), never)) == []
    assert got(topk_search.top_k(frame(spark, [(1, [1.0], 1), (2, [2.0], 1)]), every)) == [(1, 1, 2, 131072), (2, 1, 1, 131072)]


def test_bounds_never_discard_what_belongs(spark):
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(60, 33)))
    exact, n = x @ x.T, vectors.norms(x)
    stats = [topk_search.statistics(x, w) for w in topk_search.WIDTHS]
    for f in stats:
        assert (f @ f.T >= exact - 1e-6 * n[:, None] * n).all()
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    turned = hard_negatives.rotated(x, axes)
    assert np.allclose(turned @ turned.T, exact)
    need, most = np.sort(exact, 1)[:, -5], np.sort(exact, 1)[:, -2]
    kept = hard_negatives.survivors(turned, turned, need, most)
    assert kept[(exact >= need[:, None]) & (exact <= most[:, None])].all() and kept.mean() < 0.5
    alive = topk_search.survivors(stats, stats, n, n, need, np.ones(exact.shape, bool))
    assert alive[exact >= need[:, None]].all() and alive.mean() < 0.9
