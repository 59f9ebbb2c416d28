"""Exact top-k search by inner product, with bounds from segment statistics at several resolutions.

A score is (|q|^2 + |x|^2 - d^2) / 2, so a lower bound of the distance d is an upper bound of the score. Cut both vectors into segments of
w components; with each segment's mean m and deviation s, d^2 >= sum of w ((m_q - m_x)^2 + (s_q - s_x)^2). Bounds go from coarse to fine
(w = 16, 4, 2): a candidate whose bound cannot reach what a query's list of k needs is discarded, the next resolution looks at what is
left, and the survivors get their exact product. No candidate that belongs to a list is ever discarded: bounds carry slack for rounding.

At scale: queries and candidates are dealt into blocks, by place and not by value, and each pair of blocks is one task (see `vectors`), so
rows are exchanged (blocks of the other side) times and no task holds more than two blocks. Each query first learns from its own
block of queries, which are candidates too, what it needs at least; so the blocks that follow return few rows for it, k at most, and a
window with a group limit picks the k first. How much the bounds discard depends on the vectors: on isotropic ones of 64 components the
resolution of 2 discards three quarters, the coarser ones little.

Results: rows whose vector is null or holds a null or a component that is not finite take no part; vectors of unlike lengths count as
filled with zeros, an empty one scores 0. A row's id is its identity: rows that share a query's id are never its candidates, each
query row has its own list, and rows that share an id are candidates of others one by one. Ties go to the smaller id, a null id comes
last (it is a candidate, never a query). Products beyond a long are held at its ends. Fewer candidates than k: all. An empty table
or no query: no rows. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import discard, materialise
from lagwise.llm.vectors import NONE, TILE, Best, blocks, both, exact, ids, meet, norms, place, usable

#: Components of a segment, coarse to fine.
WIDTHS = (16, 4, 2)


def statistics(x: np.ndarray, width: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that a product of two rows bounds the product of the vectors from above."""
    n, d = x.shape
    parts = np.pad(x, ((0, 0), (0, -d % width))).reshape(n, -1, width)
    return np.concatenate([parts.mean(2), parts.std(2)], 1) * np.sqrt(width)


def survivors(q: list[np.ndarray], x: list[np.ndarray], nq: np.ndarray, nx: np.ndarray, need: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of the pairs alive, those whose distance bound lets the score reach need, at every resolution."""
    for a, b in zip(q, x, strict=True):
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return alive
        squares = (nq[rows] ** 2)[:, None] + nx[cols] ** 2
        distance = squares - 2 * (a[rows] @ b[cols].T)  # the lower bound of d^2
        reach = (squares - distance) / 2 + 1e-9 * nq[rows][:, None] * nx[cols] + 1e-6
        alive[np.ix_(rows, cols)] &= ~(reach < need[rows][:, None])
    return alive


def search(queries: pa.Table, rows: pa.Table, k: int, floor: np.ndarray) -> Best:
    """The k first of each query among one block of rows."""
    q, x = both(queries["_v"], rows["_v"])
    own, (id, null) = ids(queries["_id"])[0], ids(rows["_id"])
    nq, nx = norms(q), norms(x)
    fq, fx = [statistics(q, w) for w in WIDTHS], [statistics(x, w) for w in WIDTHS]
    best = Best(len(q), k, floor)
    for j in range(0, len(x), TILE):
        there = slice(j, j + TILE)
        for i in range(0, len(q), TILE):
            here = slice(i, i + TILE)
            need = best.need()[here]
            alive = (own[here, None] != id[there]) | null[there]
            alive = survivors([f[here] for f in fq], [f[there] for f in fx], nq[here], nx[there], need.astype(float), alive)
            a, b, score = exact(q[here], x[there], alive)
            best.add(a + i, score, id[there][b], null[there][b])
    return best


def top_k(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", block_values: int = 1 << 21) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest inner product with each row for which is_query holds, itself left out.

    block_values: components of the vectors that a block holds.
    """
    rows = df.select(F.col(id).cast("long").alias("_id"), F.col(vector).alias("_v"), (F.coalesce(is_query, F.lit(False)) & F.col(id).isNotNull()).alias("_is")).where(usable(F.col("_v")))
    _, nq, nc = blocks(rows, block_values)
    kind = dict(rows.dtypes)["_v"]

    def seed(table: pa.Table) -> pa.Table:
        best = search(table, table, k, np.full(len(table), NONE))
        return table.append_column("_floor", pa.array(best.score[:, -1]))

    keyed = rows.where("_is").select(F.monotonically_increasing_id().alias("_key"), "_id", "_v", place(nq).alias("_q"))
    queries = materialise(keyed.groupBy("_q").applyInArrow(lambda t: seed(t), f"_key long, _id long, _v {kind}, _q int, _floor long"), "queries")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"_key": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        row, score, found = search(left, right, k, left["_floor"].to_numpy()).rows()
        return pa.table({"_key": left["_key"].to_numpy()[row], "query_id": left["_id"].to_numpy()[row], "vec_id": found, "score": score})

    found = meet(queries, rows.select("_id", "_v"), nq, nc, work, "_key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialise(ranked.select("query_id", "rank", "vec_id", "score"), "topk")
    discard(queries)
    return out
