"""Hard-negative mining: rows of another label that score within a band below a positive, found behind an orthogonal PCA rotation.

Vectors are rotated onto the principal axes of a sample of them (of the second moments about 0, so that products stay what they were). A
product is then summed axis by axis, leading ones first: after each step the rest lies within the product of both residual norms, plus
slack for rounding. A pair that cannot reach what its list needs, or is bound to lie above its band, is discarded there; the survivors
get whole-number products of the vectors themselves, which alone decide. A rotation that fits badly costs time, never a result.

Two passes over blocks of rows (see `vectors`): the first finds each anchor's positives, the rows of its own label that score highest; the
second, with the positives' scores known, the highest rows of other labels within each positive's band. In a task a block is ordered by
label, so that the first pass compares only rows of one label and the second only rows of two; a hot label is dealt over all blocks
like any other. The rotation is fitted on `fit_rows` rows at most; nothing else is bounded.

Results: rows with a null label, a null vector, or a component that is null or not finite take no part; vectors of unlike lengths count as
filled with zeros. A row's id is its identity: rows that share an anchor's id are never its positives or negatives, rows that share an id
otherwise count one by one. Ties go to the smaller id, null ids last (they are candidates, never anchors). An anchor without positives
has no rows; nor has a positive whose score is below 0 (its band is empty). An empty table gives no rows. Only id, label and vector
are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import discard, materialise
from lagwise.llm.vectors import NONE, TILE, Best, blocks, both, exact, ids, matrix, meet, norms, place, usable

#: Shares of the axes after which pairs are looked at.
STEPS = (0.25, 0.5, 0.75, 0.875)


def rotation(rows: DataFrame, n: int, fit_rows: int) -> np.ndarray:
    """Orthogonal axes, leading first, from the second moments of about fit_rows of n rows; one row of moments for each pair of axes reaches the driver."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 1))
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(0)]), total.shape[0])
            scale = norms(x)
            x = x / np.where(scale > 0, scale, 1)[:, None]
            total = np.pad(total, (0, x.shape[1] - total.shape[0])) + x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    sample = rows.select("_v").sample(min(1.0, fit_rows / max(n, 1)), 1).repartition(8)
    found = sample.mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = 1 + max((r["i"] for r in found), default=0)
    total = np.zeros((size, size))
    for r in found:
        total[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


def rotated(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """x on the axes; components beyond them stay as they are, behind the others."""
    d = min(x.shape[1], len(axes))
    lead = np.zeros((len(x), len(axes)))
    lead[:, :d] = x[:, :d]
    return np.concatenate([lead @ axes, x[:, len(axes) :]], 1)


def survivors(q: np.ndarray, x: np.ndarray, need: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The pairs of rotated vectors whose product may lie between need and most, for all that the leading axes say."""
    rows, cols = np.arange(len(q)), np.arange(len(x))
    alive, partial, done = np.ones((len(q), len(x)), bool), np.zeros((len(q), len(x))), 0
    whole_q, whole_x = norms(q), norms(x)
    for share in STEPS:
        end = int(share * q.shape[1])
        if end <= done or not len(rows) or not len(cols):
            continue
        partial = partial + q[rows, done:end] @ x[cols, done:end].T
        rest = norms(q[rows, end:])[:, None] * norms(x[cols, end:]) + 1e-9 * whole_q[rows][:, None] * whole_x[cols] + 1e-6
        alive &= ~(partial + rest < need[rows][:, None]) & ~(partial - rest > most[rows][:, None])
        r, c = alive.any(1), alive.any(0)
        rows, cols, alive, partial, done = rows[r], cols[c], alive[r][:, c], partial[r][:, c], end
    out = np.zeros((len(q), len(x)), bool)
    out[np.ix_(rows, cols)] = alive
    return out


def _tiles(labels: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(label, rows) of rows that are ordered by label, TILE rows at most each."""
    ends = np.flatnonzero(np.r_[labels[1:] != labels[:-1], True]) + 1 if len(labels) else []
    begin = 0
    for end in ends:
        for k in range(begin, end, TILE):
            yield labels[begin], slice(k, min(k + TILE, end))
        begin = end


def _spans(labels: np.ndarray, label: int) -> Iterator[slice]:
    """The rows of other labels, among rows that are ordered by label, TILE rows at most each."""
    a, b = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
    for begin, end in ((0, a), (b, len(labels))):
        for k in range(begin, end, TILE):
            yield slice(k, min(k + TILE, end))


def positives(anchors: pa.Table, rows: pa.Table, axes: np.ndarray, n: int) -> pa.Table:
    """The n first rows of each anchor's label among one block."""
    anchors, rows = anchors.sort_by("_label"), rows.sort_by("_label")
    q, x = both(anchors["_v"], rows["_v"])
    rq, rx = rotated(q, axes), rotated(x, axes)
    own, (id, null) = ids(anchors["_id"])[0], ids(rows["_id"])
    labels, best = rows["_label"].to_numpy(), Best(len(q), n)
    for label, here in _tiles(anchors["_label"].to_numpy()):
        a, b = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
        for k in range(a, b, TILE):
            there = slice(k, min(k + TILE, b))
            alive = survivors(rq[here], rx[there], best.need()[here].astype(float), np.full(here.stop - here.start, np.inf))
            alive &= (own[here, None] != id[there]) | null[there]
            i, j, score = exact(q[here], x[there], alive)
            best.add(i + here.start, score, id[there][j], null[there][j])
    row, score, found = best.rows()
    return pa.table({"_key": anchors["_key"].to_numpy()[row], "_positive": found, "_score": score})


def negatives(anchors: pa.Table, rows: pa.Table, axes: np.ndarray, n: int, low: int, high: int) -> pa.Table:
    """The n first rows of other labels within the band of each anchor's positives, among one block."""
    anchors, rows = anchors.sort_by("_label"), rows.sort_by("_label")
    q, x = both(anchors["_v"], rows["_v"])
    rq, rx = rotated(q, axes), rotated(x, axes)
    own, (id, null) = ids(anchors["_id"])[0], ids(rows["_id"])
    labels, given = rows["_label"].to_numpy(), anchors["_positives"].to_pylist()
    width = max(map(len, given))
    bottom, top = np.full((len(q), width), NONE), np.full((len(q), width), NONE)
    for i, own_positives in enumerate(given):
        for k, p in enumerate(own_positives):  # Python's integers: no product here is too large
            bottom[i, k], top[i, k] = -(-low * p["score"] // 100), high * p["score"] // 100
    bottom[top == NONE] = np.iinfo(np.int64).max  # no positive there
    lists = Best(len(q) * width, n, bottom.ravel())
    for label, here in _tiles(anchors["_label"].to_numpy()):
        flat = slice(here.start * width, here.stop * width)
        most = top[here]
        for there in _spans(labels, label):
            need = lists.need()[flat].reshape(-1, width)
            need = np.where(need <= most, need, np.iinfo(np.int64).max)  # bands that nothing can enter any more
            alive = survivors(rq[here], rx[there], need.min(1).astype(float), most.max(1).astype(float))
            alive &= (own[here, None] != id[there]) | null[there]
            i, j, score = exact(q[here], x[there], alive)
            for k in range(width):
                ok = (score >= need[i, k]) & (score <= most[i, k])
                lists.add((i[ok] + here.start) * width + k, score[ok], id[there][j[ok]], null[there][j[ok]])
    row, score, found = lists.rows()
    i, k = row // width, row % width
    positive = [given[a][b] for a, b in zip(i, k, strict=True)]
    return pa.table({
        "_key": anchors["_key"].to_numpy()[i], "_slot": pa.array(k, pa.int32()), "anchor_id": own[i], "positive_id": pa.array([p["id"] for p in positive], pa.int64()),
        "negative_id": found, "positive_score": pa.array([p["score"] for p in positive], pa.int64()), "negative_score": score,
    })


def mine(
    df: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    block_values: int = 1 << 21, fit_rows: int = 100_000,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of an anchor's first n_positives rows of its label, the
    first n_negatives rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    block_values: components of the vectors that a block holds; fit_rows: rows, about, that the rotation is fitted on.
    """
    rows = df.select(F.col(id).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.col(vector).alias("_v"), (F.coalesce(is_anchor, F.lit(False)) & F.col(id).isNotNull()).alias("_is"))
    rows = rows.where(F.col("_label").isNotNull() & usable(F.col("_v")))
    n, nq, nc = blocks(rows, block_values)
    axes = rotation(rows, n, fit_rows)
    anchors = materialise(rows.where("_is").select(F.monotonically_increasing_id().alias("_key"), "_id", "_label", "_v", place(nq).alias("_q")), "anchors")
    rows = rows.select("_id", "_label", "_v")
    first, second = "_key long, _positive long, _score long", "_key long, _slot int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    nothing = lambda fields: pa.table({f.split()[0]: pa.array([], pa.int32() if f.endswith(" int") else pa.int64()) for f in fields.split(", ")})

    found = meet(anchors, rows, nq, nc, lambda a, b: positives(a, b, axes, n_positives) if len(a) and len(b) else nothing(first), first)
    order = Window.partitionBy("_key").orderBy(F.col("_score").desc(), F.col("_positive").asc_nulls_last())
    found = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_positives)
    lists = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_rank", F.col("_positive").alias("id"), F.col("_score").alias("score")))).alias("_positives"))
    paired = materialise(anchors.join(lists, "_key"), "positives")
    discard(anchors)

    found = meet(paired, rows, nq, nc, lambda a, b: negatives(a, b, axes, n_negatives, low, high) if len(a) and len(b) else nothing(second), second)
    order = Window.partitionBy("_key", "_slot").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    out = materialise(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(paired)
    return out
