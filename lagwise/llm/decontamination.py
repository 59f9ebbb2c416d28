"""Benchmark decontamination: Wu-Manber search for many test windows at once, over words.

Every `window` consecutive words of a benchmark item are a pattern (a shorter item is one pattern). Patterns of one
length m share a shift table over blocks of two words: how far the search may move on when it sees a block at the end of
its view. A block in no pattern moves it by m - 1 words, so clean text is looked at once in m - 1 words. Where the shift
is 0, the block is a pattern's end: the bucket of that suffix, told apart by the hash of the whole view, has the patterns that
may stand here, and comparing their words directly confirms them.

Words are 64-bit hashes in numpy arrays, and so are the tables: a sorted array of blocks with their shifts, and one of
patterns. The views of a batch of documents move on together, each through `STRIDE` words of a document, so a very long document
is as many views. Tables take some 15 bytes for each byte of the benchmark; it is sent to executors in slices of at
most `slice_bytes` of text. Each slice is a pass that reads the documents anew and writes only what it finds, by the digest of the
text that it stands in; in the end these rows join the documents by that digest. Texts are never written, and a slice's
tables leave the executors before the next one's come.

Defined results: a null text has no words; an item whose id is null marks words but is not listed; rows are searched one by one,
whatever their ids, and alike in one slice or several; an empty benchmark marks nothing. `clean` passes rows on as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm.common import bounded, discard, materialise, small_batches, text_of
from lagwise.llm.hashing import U, mix, run_hashes, slices, word_hashes

#: Words are runs of ASCII letters and digits, lower-cased, and of all bytes beyond ASCII.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE_BYTES = 8 << 20
STRIDE = 256


def text_bytes(text: str | None) -> bytes:
    """The words in lower case, parted by spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)


def _blocks(h: np.ndarray, b: int) -> np.ndarray:
    """The hash of each run of b words; the last b - 1 places have none."""
    return h if b == 1 else run_hashes(h, b)


class _Length:
    """The tables for the patterns of one length m, whose first words stand at `at` in the items' words."""

    def __init__(self, m: int, h: np.ndarray, at: np.ndarray) -> None:
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        blocks = _blocks(h, self.b)
        ends = np.arange(self.default - 1, -1, -1)  # the shift of the block that starts at each place of a pattern
        seen = blocks[(at[:, None] + np.arange(self.default)).reshape(-1)]
        order = np.lexsort((np.tile(ends, len(at)), seen))
        first = np.flatnonzero(np.append(True, seen[order][1:] != seen[order][:-1]))
        self.block, self.shift = seen[order][first], np.tile(ends, len(at))[order][first].astype(np.int32)
        views = run_hashes(h, m)[at]
        order = np.argsort(views, kind="stable")
        self.view, self.at = views[order], at[order]

    def shifts(self, blocks: np.ndarray) -> np.ndarray:
        slot = np.minimum(np.searchsorted(self.block, blocks), len(self.block) - 1)
        return np.where(self.block[slot] == blocks, self.shift[slot], self.default)

    def search(self, h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The places in h where the view of some pattern stands, of texts that stand end to end."""
        views = np.maximum(counts - self.m + 1, 0)
        parts = -(-views // STRIDE)
        text = np.repeat(np.arange(len(counts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = starts[text] + nth * STRIDE
        stop = starts[text] + np.minimum(views[text], (nth + 1) * STRIDE)
        blocks, found = _blocks(h, self.b), []
        while len(at):
            step = self.shifts(blocks[at + self.m - self.b])
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Matcher:
    """The patterns of a slice of the benchmark."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.names = [name for name, _ in items]
        words = [text_bytes(text).split() for _, text in items]
        self.data = [b" ".join(w) for w in words]
        self.h, counts = word_hashes(self.data)
        self.starts = np.cumsum(counts) - counts
        lengths = np.array([len(x) + 1 for w in words for x in w], np.int64)
        # Where each word begins in its item, for comparing.
        self.begin = np.cumsum(lengths) - lengths
        self.begin -= np.repeat(self.begin[np.minimum(self.starts, max(len(lengths) - 1, 0))], counts) if len(lengths) else 0
        self.lengths = []
        m = np.minimum(window, counts)
        for size in np.unique(m[m > 0]).tolist():
            own = np.flatnonzero(m == size)
            n = counts[own] - size + 1
            at = np.repeat(self.starts[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.lengths.append(_Length(size, self.h, at))

    def nbytes(self) -> int:
        arrays = [self.h, self.begin, *(a for x in self.lengths for a in (x.block, x.shift, x.view, x.at))]
        return sum(a.nbytes for a in arrays) + sum(map(len, self.data))

    def _words(self, at: int, m: int) -> tuple[int, bytes]:
        """The item that a pattern is of, and its words."""
        item = int(np.searchsorted(self.starts, at, side="right")) - 1
        data, last = self.data[item], at + m
        end = int(self.begin[last]) - 1 if last < len(self.begin) and self.begin[last] else len(data)
        return item, data[int(self.begin[at]) : end]

    def spans(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
        """Of each text (as text_bytes gives it): the number of words, the word ranges that occurrences cover, joined where they touch, and the items."""
        h, counts = word_hashes(texts)
        ends = np.cumsum(counts)
        starts = ends - counts
        change, items, split = np.zeros(len(h) + 1, np.int64), [set() for _ in texts], {}
        for x in self.lengths:
            places = x.search(h, starts, counts)
            if not len(places):
                continue
            views = run_hashes(h, x.m)[places]
            low, high = np.searchsorted(x.view, views), np.searchsorted(x.view, views, side="right")
            for k in np.flatnonzero(high > low).tolist():
                text = int(np.searchsorted(ends, places[k], side="right"))
                if text not in split:
                    split[text] = texts[text].split()
                a = int(places[k] - starts[text])
                view, hit = b" ".join(split[text][a : a + x.m]), False
                for p in range(int(low[k]), int(high[k])):
                    item, pattern = self._words(int(x.at[p]), x.m)
                    if pattern == view:
                        hit = True
                        items[text].add(self.names[item])
                if hit:
                    change[places[k]] += 1
                    change[places[k] + x.m] -= 1
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        covered = (np.cumsum(change) > 0).astype(np.int8)
        for text in split:
            edge = np.flatnonzero(np.diff(covered[starts[text] : ends[text]], prepend=0, append=0))
            out[text] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        return counts, out, items


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _search(matcher: Matcher, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """(words, ranges, items) of each text."""
    for a, b in slices([len(t or "") for t in texts]):
        yield from zip(*matcher.spans([text_bytes(t) for t in texts[a:b]]), strict=True)


_LONGS = pa.list_(pa.int64())
_FOUND = ("starts", "ends", "items")
_TYPES = "starts array<bigint>, ends array<bigint>, items array<string>"


def _found(rows: list[tuple[list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    """The columns starts, ends and items."""
    return [pa.array([[a for a, _ in s] for s, _ in rows], _LONGS), pa.array([[b for _, b in s] for s, _ in rows], _LONGS), pa.array([x for _, x in rows], pa.list_(pa.string()))]


def _names(items: set) -> list[str]:
    return sorted({str(x) for x in items if x is not None})


def _finder(matcher):
    """Of (id or digest, text): the first, n_words and what the slice finds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = list(_search(matcher.value, batch.column("text").to_pylist()))
            found = _found([(spans, _names(items)) for _, spans, items in rows])
            counts = pa.array([int(n) for n, _, _ in rows], pa.int64())
            others = [batch.column(k) for k in range(batch.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([*others, counts, *found], [*(n for n in batch.schema.names if n != "text"), "n_words", *_FOUND])

    return find


def _hits(matcher):
    """Of (digest, text): the digest and what the slice finds, of texts in which it finds anything."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = list(_search(matcher.value, batch.column("text").to_pylist()))
            hit = pa.array([bool(spans) for _, spans, _ in rows], pa.bool_())
            found = _found([(spans, _names(items)) for _, spans, items in rows if spans])
            yield pa.RecordBatch.from_arrays([batch.column("digest").filter(hit), *found], ["digest", *_FOUND])

    return find


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, n_words, starts, ends, items, and lists of these of the later slices): the ranges joined and the items in order."""
    for batch in batches:
        rows = []
        for starts, ends, items, others in zip(*(batch.column(k).to_pylist() for k in (*_FOUND, "later")), strict=True):
            spans, names = list(zip(starts, ends, strict=True)), set(items)
            for other in others or ():
                spans = _joined(spans, list(zip(other["starts"], other["ends"], strict=True)))
                names |= set(other["items"])
            rows.append((spans, sorted(names)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *_found(rows)], ["doc_id", "n_words", *_FOUND])


def _cleaner(matcher, column: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column):
            free = [not spans for _, spans, _ in _search(matcher.value, batch.column(column).to_pylist())]
            yield batch.filter(pa.array(free, pa.bool_()))

    return clean


def _matchers(spark, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, slice_bytes: int) -> tuple[int, Iterator]:
    """The number of slices of the benchmark, and a broadcast Matcher for each; they are dealt by hash and hold about slice_bytes of text."""
    items = benchmark.select(benchmark[item_col].alias("item"), text_of(benchmark[item_text_col]).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("b")).first()[0] or 0
    n = int(size // slice_bytes) + 1
    part = lambda k: items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
    return n, (spark.sparkContext.broadcast(Matcher([tuple(r) for r in part(k).collect()], window)) for k in range(n))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text_of(text).cast("binary")))


def _later(docs: DataFrame, text_col: str, matchers: Iterator) -> DataFrame:
    """(digest, later): what each of these slices finds in each text in which it finds anything, a written table; copies of a text count once."""
    texts = docs.select(_digest(docs[text_col]).alias("digest"), text_of(docs[text_col]).alias("text"))
    parts = []
    for k, matcher in enumerate(matchers):
        parts.append(materialise(texts.mapInArrow(_hits(matcher), f"digest binary, {_TYPES}").withColumn("slice", F.lit(k)), "hits"))
        matcher.unpersist()
    once = reduce(DataFrame.union, parts).groupBy("digest", "slice").agg(F.first(F.struct(*_FOUND)).alias("found"))
    out = materialise(once.groupBy("digest").agg(F.collect_list("found").alias("later")), "hits")
    discard(*parts)
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, the hit word ranges (starts, ends; not overlapping), and the items with occurring windows, sorted as strings."""
    n, matchers = _matchers(docs.sparkSession, benchmark, window, item_col, item_text_col, slice_bytes)
    first = next(matchers)
    out = docs.select(docs[id_col].alias("doc_id"), text_of(docs[text_col]).alias("text"), *([_digest(docs[text_col]).alias("digest")] if n > 1 else []))
    kept = T.StructType([f for f in out.schema.fields if f.name != "text"])
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    out = out.mapInArrow(_finder(first), T.StructType([*kept.fields, *found.fields]))
    if n == 1:
        return out
    # Copies of one text are one digest: where the hits are too many to broadcast, AQE splits the rows that share it.
    out = out.join(bounded(_later(docs, text_col, matchers)), "digest", "left").select("doc_id", "n_words", *_FOUND, "later")
    return out.mapInArrow(_merged, T.StructType([kept.fields[0], *found.fields]))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents without a benchmark window, with their columns: rows pass the search as they are, so ids do not matter."""
    n, matchers = _matchers(docs.sparkSession, benchmark, window, item_col, item_text_col, slice_bytes)
    if n == 1:
        return docs.mapInArrow(_cleaner(next(matchers), docs.columns.index(text_col)), docs.schema)
    hits = bounded(_later(docs, text_col, matchers).select("digest"))
    return docs.join(hits, _digest(docs[text_col]) == hits["digest"], "left_anti")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
