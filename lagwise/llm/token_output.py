"""Token-ID output: ids packed to the fewest bits that hold the vocabulary, in blocks that can be read alone.

A file is a Parquet table with a row for each block, in ascending order of the documents' ids over all files:

    stream    number of the file's part of the order, ascending over the files
    block     number of the block in its stream
    width     bits for each id
    n_ids     number of ids in the block
    doc_ids   the documents of the block, in order
    offsets   where each document's ids begin in the block, and n_ids at the end
    payload   the ids, `width` bits each, least significant bit first, end to end, padded to whole bytes

A document is never split over blocks, so a block, a document or a range of ids in a block is found from the offsets and
unpacked by numpy without reading any other block; Parquet's own statistics and commit make reads selective and writes
safe against lost executors. Blocks close at `block_ids` ids; a longer document has a block of its own.

Defined results: a null text counts as empty; every document ends with the end id; null ids come first; rows that share
an id stand in order of a hash of their texts; an empty table gives an empty file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagwise.llm.common import BROADCAST_IDS, small_batches, text_of
from lagwise.llm.hashing import piece_hashes, slices

FILE = "stream int, block long, width int, n_ids long, doc_ids array<long>, offsets array<long>, payload binary"
_FILE = pa.schema([("stream", pa.int32()), ("block", pa.int64()), ("width", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Eight ids at a time fill `width` whole bytes."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    n = -(-len(ids) // 8) * 8
    groups = np.zeros(n, np.uint64)
    groups[: len(ids)] = ids
    bits = (groups[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()[: -(-len(ids) * width // 8)]


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids start..stop-1 of a block, reading only their bytes."""
    if width == 16:
        return np.frombuffer(payload, "<u2", stop - start, start * 2).astype(np.uint32)
    first, last = start * width, stop * width
    raw = np.frombuffer(payload, np.uint8)[first // 8 : -(-last // 8)]
    bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + last - first].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


#: White space beyond ASCII; texts with it go to the library whole.
FAR_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE, _MARK, _ASCII_LETTER = (np.zeros(256, bool) for _ in range(3))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK[list(b".,;:!?")] = True
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts that stand end to end begin: at texts, at white space after anything else, and at marks after a Latin letter."""
    space = _SPACE[buf]
    letter = _ASCII_LETTER[buf]
    two = (buf[:-1] == 0xC3) | (buf[:-1] == 0xC4) | (buf[:-1] == 0xC5)  # U+00C0..U+017F are letters but for the signs of U+00D7, U+00F7
    letter[1:] |= two & ~((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
    begins = np.zeros(len(buf), bool)
    begins[1:] = (space[1:] & ~space[:-1]) | (_MARK[buf[1:]] & letter[:-1])
    begins[starts] = True
    return np.flatnonzero(begins)


def splits_ahead_of_space(tokenizer) -> bool:
    """Whether a tokenizer normalises nothing and splits as PieceEncoder takes it to: byte-level, by the usual pattern, no space put in front."""
    parts = json.loads(tokenizer.to_str())
    split = parts["pre_tokenizer"] or {}
    plain = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    marks = [x for x in parts["added_tokens"] if x.get("lstrip") or x.get("rstrip") or x.get("normalized") or any(c.isspace() or c in ".,;:!?" for c in x["content"])]
    return bool(plain and parts["model"]["type"] == "BPE" and not marks)


class WholeEncoder:
    """Ids of texts by any tokenizer, each text as a whole."""

    def __init__(self, tokenizer) -> None:
        self.batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.batch(texts, add_special_tokens=False)]


class PieceEncoder:
    """Ids of texts, from the tokenizers library, by pieces of which the common ones are kept.

    A byte-level BPE tokenizer splits every text ahead of white space, and between letters and marks, before it merges
    anything, and merges within a split alone; so the ids of a text are those of its pieces, end to end. Pieces are told
    by 64-bit hashes, cut, hashed and looked up for a whole batch of texts at once. Those that are not kept go to the
    library: words as lines of one text, whose line ends part their ids again, other pieces one by one. A piece is kept
    when it is met again; all are let go once they no longer cover the texts.
    """

    def __init__(self, tokenizer, most: int = 1_000_000) -> None:
        self.tokenizer, self.most = tokenizer, most
        self.batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.line_end = self._ids("\n")
        self.lines = len(self.line_end) == 1 and self._ids(" a\n b") == self._ids(" a") + self.line_end + self._ids(" b")
        self.met = np.zeros(1 << 22, bool)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ask(self, pieces: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.lines and len(p) > 1 and p[0] == " " and not p[1].isspace()]
        parts = [plain[i : i + 128] for i in range(0, len(plain), 128)]
        for part, x in zip(parts, self.batch(["\n".join([pieces[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.uint32)
            ends = np.flatnonzero(ids == self.line_end[0])
            if len(ends) == len(part) - 1:
                for i, a, b in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.batch([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, np.uint32)
        return out

    def _keep(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in ids], np.int32)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *ids])
        order = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, order, keys), np.insert(self.at, order, at), np.insert(self.size, order, size)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        raw = [t.encode() for t in texts]
        whole = [k for k, t in enumerate(texts) if not t.isascii() and FAR_SPACE.search(t)]
        for k in whole:
            raw[k] = b""
        lengths = np.array([len(r) for r in raw])
        data = b"".join(raw)
        buf = np.frombuffer(data, np.uint8)
        first = np.cumsum(lengths) - lengths
        if not len(buf):
            parts = [np.zeros(0, np.uint32)] * len(texts)
        else:
            begins = cuts(buf, first[lengths > 0])
            ends = np.append(begins[1:], len(buf))
            value, inverse = np.unique(piece_hashes(buf, begins), return_inverse=True)
            slot = np.minimum(np.searchsorted(self.keys, value), max(len(self.keys) - 1, 0))
            known = self.keys[slot] == value if len(self.keys) else np.zeros(len(value), bool)
            at, size, flat = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64), self.flat
            at[known], size[known] = self.at[slot[known]], self.size[slot[known]]
            new = np.flatnonzero(~known)
            if len(new):
                one = np.zeros(len(value), np.int64)
                one[inverse] = np.arange(len(begins))
                spans = zip(begins[one[new]].tolist(), ends[one[new]].tolist(), strict=True)
                ids = self._ask([data[a:b].decode() for a, b in spans])
                size[new] = [len(x) for x in ids]
                at[new] = len(flat) + np.cumsum(size[new]) - size[new]
                flat = np.concatenate([flat, *ids])
                seen = (value[new] >> np.uint64(42)).astype(np.int64)
                again = np.flatnonzero(self.met[seen] | (np.bincount(inverse, minlength=len(value))[new] > 1))
                self.met[seen] = True
                if 3 * len(new) > len(begins) and len(self.keys) >= self.most:
                    self._forget()
                elif len(self.keys) < self.most and len(again):
                    self._keep(value[new[again]], [ids[k] for k in again.tolist()])
            n = size[inverse]
            total = int(n.sum())
            ids = flat[np.repeat(at[inverse] - (np.cumsum(n) - n), n) + np.arange(total)]
            of_text = np.searchsorted(begins, first)
            before = np.append(np.cumsum(n) - n, total)
            parts = [ids[a:b] for a, b in zip(before[of_text].tolist(), before[np.append(of_text[1:], len(begins))].tolist(), strict=True)]
        for k, x in zip(whole, self.batch([texts[k] for k in whole], add_special_tokens=False), strict=True):
            parts[k] = np.array(x.ids, np.uint32)
        return parts


_KEPT: dict[str, PieceEncoder | WholeEncoder] = {}


def encoder_of(tokenizer_path: str) -> PieceEncoder | WholeEncoder:
    """One encoder for each worker process, so that its pieces serve all tasks there."""
    if tokenizer_path not in _KEPT:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        _KEPT[tokenizer_path] = (PieceEncoder if splits_ahead_of_space(tokenizer) else WholeEncoder)(tokenizer)
    return _KEPT[tokenizer_path]


def _encoder(tokenizer_path: str, end_id: int, width: int, block_ids: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder, end = encoder_of(tokenizer_path), np.array([end_id], np.uint32)
        stream, block = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, parts)])
            row = {"stream": [stream], "block": [block], "width": [width], "n_ids": [size], "doc_ids": [docs], "offsets": [offsets.tolist()], "payload": [pack(np.concatenate(parts), width)]}
            return pa.RecordBatch.from_pydict(row, schema=_FILE)

        for batch in small_batches(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                for doc, x in zip(ids[a:b], encoder(texts[a:b]), strict=True):
                    one = np.append(x, end)
                    if parts and size + len(one) > block_ids:
                        yield close()
                        docs, parts, size, block = [], [], 0, block + 1
                    docs.append(doc)
                    parts.append(one)
                    size += len(one)
        if parts:
            yield close()

    return encode


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 65_536, partition_bytes: int = 16 << 20) -> None:
    """Encode the texts and write the file to path: one exchange, by range of the id and a hash of the text."""
    from tokenizers import Tokenizer

    width = width_for(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1))
    slim = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs[text_col]).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text")).alias("b")).first()[0] or 0
    # Rows that share an id, or have none, may be any number, so a hash of the text parts them further.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = slim.repartitionByRange(int(total // partition_bytes) + 1, *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(_encoder(tokenizer_path, end_id, width, block_ids), FILE).write.mode("overwrite").parquet(path)


def open_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"stream": [], "block": [], "inside": [], "doc_id": [], "n_tokens": [], "ids_crc32": []}
        for r in batch.to_pylist():
            ids = unpack(r["payload"], r["width"], 0, r["n_ids"]).astype("<u4")
            for doc, a, b in zip(r["doc_ids"], r["offsets"], r["offsets"][1:], strict=False):
                for key, x in zip(rows, (r["stream"], r["block"], a, doc, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                    rows[key].append(x)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("stream", pa.int32()), ("block", pa.int64()), ("inside", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    file = open_file(spark, path)
    docs = file.mapInArrow(_digests, "stream int, block long, inside long, doc_id long, n_tokens long, ids_crc32 long")
    # Ids ahead of a stream and of a block: sums over the small columns of the file, a row for each block.
    blocks = file.select("stream", "block", "n_ids")
    streams = blocks.groupBy("stream").agg(F.sum("n_ids").alias("n"))
    streams = streams.select(F.col("stream").alias("s"), (F.sum("n").over(Window.orderBy("stream")) - F.col("n")).alias("before"))
    ahead = F.sum("n_ids").over(Window.partitionBy("stream").orderBy("block")) - F.col("n_ids")
    blocks = blocks.select("stream", "block", ahead.alias("ahead")).join(streams, F.col("stream") == F.col("s")).select("stream", "block", (F.col("before") + F.col("ahead")).alias("base"))
    return docs.join(F.broadcast(blocks) if file.count() <= BROADCAST_IDS else blocks, ["stream", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
