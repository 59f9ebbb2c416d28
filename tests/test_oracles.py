"""Every query that has SQL gives what DuckDB gives for it."""

import hashlib
import math
import os
from statistics import NormalDist

import duckdb
import numpy as np
import pytest

from lagwise.plans import queries as plans
from lagwise.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    same = lambda x: None if x is None else round(float(x), 5) + 0.0 if isinstance(x, float) else x
    return sorted(columns), sorted((tuple(same(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = duck.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def gamma_share(shape, x, steps=4000):
    """P(shape, x) for a shape of 1 or more, by Simpson's rule over the density."""
    low = max(1e-9, shape - 14 * math.sqrt(shape))
    if x <= low:
        return 0.0
    f = lambda t: math.exp((shape - 1) * math.log(t) - t - math.lgamma(shape))
    h = (x - low) / steps
    return (f(low) + f(x) + sum((4 if k % 2 else 2) * f(low + k * h) for k in range(1, steps))) * h / 3


LARGER = os.path.join(os.path.dirname(DIR), "sf0.01")


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the smallest tables have too few values a month")
def test_gamma_index_against_a_plain_fit(spark):
    field = {}
    for r in plans.field(spark, LARGER).collect():
        field.setdefault(r.cell_id, {})[r.t] = r.value
    got = {(r.cell_id, r.t): r.value for r in QUERIES["q09_gamma_index"](spark, LARGER).collect()}
    compared = 0
    for cell in sorted(field)[:4]:
        x = {t: (field[cell][t] + field[cell][t - 1] + field[cell][t - 2]) / 3 if all(field[cell].get(t - k) is not None for k in range(3)) else None for t in field[cell]}
        for month in range(0, 12, 5):
            own = {t: v for t, v in x.items() if t % 12 == month and v is not None}
            if len(own) < 5:
                continue
            mean, log = np.mean(list(own.values())), np.mean(np.log(list(own.values())))
            score = lambda a: a * math.log(a / mean) - math.lgamma(a) + (a - 1) * log - a  # noqa: B023, E731  log likelihood of a value
            lo, hi = 1.0, 1e5
            for _ in range(120):  # golden section on a logarithmic scale
                a, b = lo * (hi / lo) ** 0.381966, lo * (hi / lo) ** 0.618034
                lo, hi = (lo, b) if score(a) > score(b) else (a, hi)
            shape = math.sqrt(lo * hi)
            assert shape > 1
            for t, v in own.items():
                p = min(max(gamma_share(shape, v * shape / mean), 1e-6), 1 - 1e-6)
                assert got[cell, t] == pytest.approx(NormalDist().inv_cdf(p), abs=2e-3), (cell, t)
                compared += 1
    assert compared > 10


def test_hinge_fit_against_plain_least_squares(spark):
    rows = plans.on_index(spark, DIR).where("value is not null and index is not null").select("cell_id", "t", "value", "index").collect()
    got = {r.cell_id: r for r in QUERIES["q29_hinge_fit"](spark, DIR).collect()}
    x, y = {r.t: r["index"] for r in rows}, {}
    for r in rows:
        y.setdefault(r.cell_id, {})[r.t] = r.value
    cover = {t: sum(t in c for c in y.values()) for t in x}
    items = sorted(t for t in x if cover[t] >= 0.5 * max(cover.values()))
    term = lambda t: [1, x[t], max(x[t] - 0.3, 0), min(x[t] + 0.3, 0)]
    draws = [[items[int(hashlib.md5(f"1:{i}:{s}".encode()).hexdigest()[:8], 16) % len(items)] for s in range(len(items))] for i in range(100)]
    draws = [d for d in draws if sum(x[t] > 0.3 for t in d) >= 3 and sum(x[t] < -0.3 for t in d) >= 3]
    for cell, values in y.items():
        own = [t for t in items if t in values]
        if len(own) < len(items) and len(own) < 24:
            assert got[cell].warm is None
            continue
        fit = lambda ts: np.linalg.lstsq(np.array([term(t) for t in ts]), np.array([values[t] for t in ts]), rcond=None)[0]  # noqa: B023, E731
        beta = fit(own)
        assert [got[cell][c] for c in ("b0", "slope", "warm", "cold")] == pytest.approx(list(beta), abs=2e-6)
        same = sum(np.sign(fit(d)[2]) == np.sign(beta[2]) for d in draws) if len(own) == len(items) else 0
        assert got[cell].p_value == pytest.approx(min(max(2 * (1 - same / max(len(draws), 1)), 0), 1), abs=2e-6) and got[cell].n_draws == len(draws)
        assert got[cell].steepening == bool(np.sign(beta[1]) == np.sign(beta[2]))
