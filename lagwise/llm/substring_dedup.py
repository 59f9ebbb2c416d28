"""Substring dedup: fixed-block anchors, extended to exact repeats.

A window of `window` words holds a whole block of `block` = (window + 1) // 2 words that starts at a multiple of `block`,
wherever the window lies. So each document's non-overlapping blocks are its reference index, every rolling run of
`block` words is a probe, and a window repeats in another document only where a probe hits a block of that document.

Documents are dealt into units by a hash of id and text. Texts are exchanged three times: once for each of two phases, and once more
to take out what the second has found:

1. Anchors. For each unit the distinct probes travel, as 32-bit prints within a bucket of the hash space, with a bit for
   those that are blocks of the index. A bucket answers with a bit for each probe: another unit has it as a block, or it
   is a block and another unit has it as a probe. Prints may collide; they only choose candidates.
2. Repeats. Around the hits (and those found inside the unit) every window is hashed to 128 bits; a unit sends each
   distinct one with the least id that holds it, and a bucket answers which of them a smaller id of another unit holds.
   Runs of removed windows are the maximal exact repeats.

A unit sends a window once however often its documents hold it, so a passage that a third of all documents share reaches
a bucket once for each unit. Buckets and units grow in number with the input, not in size. A message holds what one unit has for
one bucket and is sent only if that is something: up to units times buckets messages, the square of the input, until each
holds a single probe. At 1 TB with the sizes below that is some billions of small messages; larger units lessen them.

Defined results: null and empty texts have no words; ids are compared as 64-bit integers and a null id counts as larger
than all; rows that share an id do not remove each other's words; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import discard, materialise, text_of
from lagwise.llm.hashing import U, run_checks, run_hashes, word_hashes

UNIT_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LAST = (1 << 63) - 1


class _Unit:
    """One unit's texts in order of id, with their word hashes end to end."""

    def __init__(self, table: pa.Table) -> None:
        order = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = np.array([LAST if x is None else x for x in order.column("id").to_pylist()], np.int64)
        self.raw_ids = order.column("id")
        self.texts = [x.encode("utf-8", "surrogatepass") for x in order.column("text").to_pylist()]
        self.h, self.counts = word_hashes(self.texts)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, document and hash of every run of k words inside one document."""
        doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), np.maximum(self.counts - k + 1, 0))
        first = np.cumsum(np.maximum(self.counts - k + 1, 0)) - np.maximum(self.counts - k + 1, 0)
        pos = np.arange(len(doc)) - first[doc] + self.starts[doc]
        return pos, doc, run_hashes(self.h, k)[pos] if len(pos) else np.zeros(0, U)


def _by_value(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts h, the starts of its groups of equal values in that order, and each group's value."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return order, first, s[first] if len(s) else s


def _by_both(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts pairs of h and check by h, and the starts of its groups of equal pairs."""
    order = np.argsort(h, kind="stable")
    if len(order) and ((h[order][1:] == h[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
    a, b = h[order], check[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(order) else np.zeros(0, np.int64)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(40)) * U(n)) >> U(24)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _cut(values: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket's part of sorted 64-bit values begins, with the end."""
    return np.searchsorted(_bucket(values, n), np.arange(n + 1))


class Repeats:
    """The map and reduce functions of the two phases, for a window, a block and a number of buckets."""

    def __init__(self, window: int, buckets: int) -> None:
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets

    def _probes(self, unit: _Unit) -> dict:
        pos, doc, h = unit.runs(self.block)
        order, first, value = _by_value(h)
        block = ((pos - unit.starts[doc]) % self.block == 0)[order]
        d = unit.ids[doc][order]
        out = {"pos": pos, "order": order, "first": first, "value": value, "d": d, "block": block}
        if len(first):
            out["indexed"] = np.logical_or.reduceat(block, first)
        else:
            out["indexed"] = np.zeros(0, bool)
        return out

    def _prints(self, p: dict):
        """For each bucket: its number, the slice of p's values, and its distinct prints with the value -> print map."""
        cut = _cut(p["value"], self.buckets)
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            prints, inverse = np.unique((p["value"][part] & U(0xFFFFFFFF)).astype("<u4"), return_inverse=True)
            yield int(b), part, prints, inverse

    def send_anchors(self, table: pa.Table) -> pa.Table:
        unit, rows = _Unit(table), {"bucket": [], "unit": [], "prints": [], "flags": []}
        p = self._probes(unit)
        for b, part, prints, inverse in self._prints(p):
            indexed = np.zeros(len(prints), bool)
            np.logical_or.at(indexed, inverse, p["indexed"][part])
            for key, x in zip(rows, (b, table.column("unit")[0].as_py(), prints.tobytes(), _bits(indexed)), strict=True):
                rows[key].append(x)
        return pa.table(rows, schema=ANCHORS)

    def answer_anchors(self, table: pa.Table) -> pa.Table:
        units = table.column("unit").to_pylist()
        prints = [np.frombuffer(x, "<u4") for x in table.column("prints").to_pylist()]
        index = [_flags(x, len(p)) for x, p in zip(table.column("flags").to_pylist(), prints, strict=True)]
        sizes = [len(p) for p in prints]
        value, inverse = np.unique(np.concatenate(prints), return_inverse=True)
        flat = np.concatenate(index)
        probing = np.bincount(inverse, minlength=len(value))
        holding = np.bincount(inverse, weights=flat, minlength=len(value)).astype(np.int64)
        hit = (holding[inverse] - flat > 0) | (flat & (probing[inverse] > 1))
        out = np.split(hit, np.cumsum(sizes)[:-1])
        return pa.table({"unit": units, "bucket": table.column("bucket"), "phase": [1] * len(units), "flags": [_bits(x) for x in out]}, schema=ANSWERS)

    def _windows(self, unit: _Unit, answers: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, ...]:
        """Of the windows around hits: position, document, order by hash, group starts, and both hashes of each group."""
        p = self._probes(unit)
        hit = np.zeros(len(p["value"]), bool)
        for b, part, prints, inverse in self._prints(p):
            hit[part] = _flags(answers[1, b], len(prints))[inverse]
        if len(p["first"]):  # and inside the unit, between different ids
            low, high = np.minimum.reduceat(p["d"], p["first"]), np.maximum.reduceat(p["d"], p["first"])
            hit |= p["indexed"] & (low != high)
        size = np.diff(np.append(p["first"], len(p["order"])))
        at = np.zeros(len(unit.h) + 1, np.int64)
        at[p["pos"][p["order"][np.repeat(hit, size)]] + 1] = 1
        at = np.cumsum(at)
        pos, doc, h = unit.runs(self.window)
        near = at[pos + self.window - self.block + 1] > at[pos]
        pos, doc, h = pos[near], doc[near], h[near]
        check = run_checks(unit.h, pos, self.window)
        order, first = _by_both(h, check)
        return pos, doc, order, first, h[order][first], check[order][first]

    @staticmethod
    def _answers(table: pa.Table) -> dict[tuple[int, int], bytes]:
        return dict(zip(zip(table.column("phase").to_pylist(), table.column("bucket").to_pylist(), strict=True), table.column("flags").to_pylist(), strict=True))

    def send_windows(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = {"bucket": [], "unit": [], "hashes": [], "checks": [], "ids": []}
        if table.num_rows and answers.num_rows:
            unit = _Unit(table)
            _, doc, order, first, value, check = self._windows(unit, self._answers(answers))
            least = np.minimum.reduceat(unit.ids[doc][order], first) if len(first) else np.zeros(0, np.int64)
            cut = _cut(value, self.buckets)
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                for key, x in zip(rows, (int(b), table.column("unit")[0].as_py(), value[part].tobytes(), check[part].tobytes(), least[part].tobytes()), strict=True):
                    rows[key].append(x)
        return pa.table(rows, schema=WINDOWS)

    def answer_windows(self, table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, U) for x in table.column("hashes").to_pylist()]
        ids, checks = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("checks", U)))
        order, first = _by_both(np.concatenate(hashes), checks)
        low = np.minimum.reduceat(ids[order], first)
        smaller = np.zeros(len(ids), bool)
        smaller[order] = np.repeat(low, np.diff(np.append(first, len(ids)))) < ids[order]
        out = np.split(smaller, np.cumsum([len(x) for x in hashes])[:-1])
        return pa.table({"unit": table.column("unit"), "bucket": table.column("bucket"), "phase": [2] * len(out), "flags": [_bits(x) for x in out]}, schema=ANSWERS)

    def _removed(self, unit: _Unit, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Whether each word of the unit is removed."""
        pos, doc, order, first, value, _ = self._windows(unit, answers)
        if not len(value):
            return np.zeros(len(unit.h), bool)
        cut, smaller = _cut(value, self.buckets), np.zeros(len(value), bool)
        for b in np.flatnonzero(np.diff(cut)):
            smaller[cut[b] : cut[b + 1]] = _flags(answers[2, int(b)], int(cut[b + 1] - cut[b]))
        d = unit.ids[doc][order]
        size = np.diff(np.append(first, len(order)))
        gone = np.repeat(smaller, size) | (d > np.repeat(np.minimum.reduceat(d, first), size))
        at = pos[order[gone]]
        change = np.zeros(len(unit.h) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.window, -1)
        return np.cumsum(change)[:-1] > 0

    def cleaned(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Per document: id, number of words, removed words, and what is left, its words joined by one space."""
        unit = _Unit(table)
        gone = self._removed(unit, self._answers(answers)) if answers.num_rows else np.zeros(len(unit.h), bool)
        n, removed, kept = [], [], []
        for k, text in enumerate(unit.texts):
            g = gone[unit.starts[k] : unit.ends[k]]
            w = text.split()
            n.append(len(w))
            removed.append(int(g.sum()))
            kept.append(b" ".join(w if not removed[-1] else [x for x, y in zip(w, g.tolist(), strict=True) if not y]))
        return pa.table({"doc_id": unit.raw_ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    def digests(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        out = self.cleaned(table, answers)
        sha = [hashlib.sha256(x).hexdigest() for x in out.column("kept").to_pylist()]
        return out.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sha, pa.string()))


ANCHORS = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("prints", pa.binary()), ("flags", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("hashes", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())])
ANSWERS = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("phase", pa.int32()), ("flags", pa.binary())])
_ANCHORS = "bucket int, unit long, prints binary, flags binary"
_WINDOWS = "bucket int, unit long, hashes binary, checks binary, ids binary"
_ANSWERS = "unit long, bucket int, phase int, flags binary"


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, unit_bytes: int = UNIT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and what is left: `kept` (the words in UTF-8, joined by one space), or its SHA-256 as kept_sha256.

    A word goes if a window over it also starts in a document with a smaller id; windows are judged on the input.
    """
    slim = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs[text_col]).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text")).alias("b")).first()[0] or 0
    units, buckets = total // unit_bytes + 1, total // bucket_bytes + 1
    job = Repeats(window, int(buckets))  # methods go in lambdas: Spark tells a group's key argument by the count of arguments
    dealt = slim.withColumn("unit", F.pmod(F.xxhash64("id", "text"), F.lit(units)))  # by the text too: any number of rows may share an id or have none

    anchors = dealt.groupBy("unit").applyInArrow(lambda t: job.send_anchors(t), _ANCHORS).groupBy("bucket").applyInArrow(lambda t: job.answer_anchors(t), _ANSWERS)
    anchors = materialise(anchors, "anchors")
    windows = dealt.groupBy("unit").cogroup(anchors.groupBy("unit")).applyInArrow(lambda t, a: job.send_windows(t, a), _WINDOWS).groupBy("bucket").applyInArrow(lambda t: job.answer_windows(t), _ANSWERS)
    answers = materialise(anchors.unionByName(windows), "answers")
    discard(anchors)
    last, schema = (job.digests, "kept_sha256 string") if digest else (job.cleaned, "kept binary")
    return dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(lambda t, a: last(t, a), f"doc_id long, n_words long, n_removed long, {schema}")
