"""What the vector operators share: rows in blocks, whole-number components, exact products, running top lists.

A vector's components x become floor(256 x), x as double. Rows without a vector, or with a component that is null or not finite, take
no part. A vector that is shorter than another counts as filled with zeros; an empty one scores 0 with all. Products are whole
numbers in doubles while |a| |b| is below 2^53, where every sum is exact whatever its order, and Python's integers beyond; a product
beyond a long is held at the long's end.

Queries and candidates are dealt into blocks by their place in the scan, so that neither an id nor equal vectors, however many rows share
them, meet in one block; each pair of blocks is one task's work. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores that stand for "none": below every product.
NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max

#: Tasks that pairs of blocks are dealt over; more would cost more to plan than they save.
MOST_TASKS = 20_000

#: Rows of a tile, in which a task compares a part of its queries with a part of its candidates.
TILE = 1024


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def blocks(rows: DataFrame, values: int) -> tuple[int, int, int]:
    """Of rows (_v, _is): their number, and how many blocks of queries and of candidates, of at most `values` components each; more candidate blocks where cores would idle."""
    n, asked, size = rows.agg(F.count(F.lit(1)), F.count_if("_is"), F.max(F.size("_v"))).first()
    size = max(size or 1, 1)
    idle = min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // TILE))
    return n, max(1, -(-asked * size // values)), max(1, -(-n * size // values), idle)


def place(n: int) -> Column:
    """One of n blocks, in turn, by the row's place in the scan."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")


def meet(queries: DataFrame, candidates: DataFrame, nq: int, nc: int, work, schema: str) -> DataFrame:
    """work(queries, candidates) for every block `_q` of queries with every block `_c` of candidates; a task takes its pairs of blocks one after another."""
    parts = min(2 * nq * nc, MOST_TASKS)
    q = queries.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).repartition(parts, "_q", "_c")
    c = candidates.withColumn("_c", place(nc)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).repartition(parts, "_q", "_c")
    return q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(lambda a, b: work(a, b), schema)


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """The whole-number components, a row for each vector, filled with zeros up to the longest vector or `width`."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(width, lengths.max(initial=0), 1)))
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=float)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(256 * values)
    return out


def both(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Two blocks' matrices of one width."""
    x, y = matrix(a), matrix(b)
    width = max(x.shape[1], y.shape[1])
    pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return pad(x), pad(y)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x)


def _held(x) -> int:
    return int(min(max(x, -_LAST), _LAST))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of rows of a with rows of b, as longs."""
    na, nb = norms(a), norms(b)
    if na.max(initial=0) * nb.max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    # Rows whose products could pass 2^53 are few: they alone go through Python's integers.
    big_a, big_b = na >= 2**26, nb >= 2**26
    out = (np.where(big_a[:, None], 0, a) @ np.where(big_b[:, None], 0, b).T).astype(np.int64)
    held = np.frompyfunc(_held, 1, 1)
    if big_a.any():
        out[big_a] = held(_whole(a[big_a]) @ _whole(b).T)
    if big_b.any():
        out[:, big_b] = held(_whole(a) @ _whole(b[big_b]).T)
    return out


def exact(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b) that are alive, and their products."""
    i, j = np.nonzero(alive)
    if 4 * len(i) > alive.size:
        return i, j, products(a, b)[i, j]
    big = norms(a).max(initial=0) * norms(b).max(initial=0) >= 2**53
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):  # so many pairs at once
        x, y = a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]]
        out[k : k + (1 << 16)] = [_held((_whole(p) * _whole(q)).sum()) for p, q in zip(x, y, strict=True)] if big else np.einsum("ij,ij->i", x, y)
    return i, j, out


class Best:
    """The k first candidates of each of n lists so far: higher scores first, ties by smaller id, null ids last."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.floor = k, np.full(n, NONE) if floor is None else floor
        self.score, self.id, self.null = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def need(self) -> np.ndarray:
        """The score that a candidate must reach to enter each list."""
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, row: np.ndarray, score: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.need()[row]
        row, score, id, null = row[keep], score[keep], id[keep], null[keep]
        if not len(row):
            return
        touched = np.unique(row)
        old = self.score[touched] > NONE
        row = np.concatenate([row, np.repeat(touched, old.sum(1))])
        score, id, null = (np.concatenate([new, have[touched][old]]) for new, have in ((score, self.score), (id, self.id), (null, self.null)))
        order = np.lexsort((id, null, -score, row))
        row, score, id, null = row[order], score[order], id[order], null[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        top = rank < self.k
        self.score[touched] = NONE
        self.score[row[top], rank[top]], self.id[row[top], rank[top]], self.null[row[top], rank[top]] = score[top], id[top], null[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(list, score, id) of all entries."""
        row, rank = np.nonzero(self.score > NONE)
        return row, self.score[row, rank], pa.array(self.id[row, rank], pa.int64(), mask=self.null[row, rank])


def ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, 0 for null, and where they are null."""
    column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
