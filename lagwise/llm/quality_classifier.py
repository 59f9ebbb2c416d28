"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `passage` words. Each passage is encoded on its own: shares of byte classes, word
shape and variety, and a signed hash of its words. A layer turns encodings into instances, gated attention (tanh times
sigmoid) weighs the instances of a bag, and the weighted mean is scored by a logistic unit; labels exist for documents
only. The model is learned by Adam in numpy on the driver, from every passage of at most `train_rows` labelled documents (those with
the least hash of the id); scoring reads every passage of every document and nothing but its text.

Defined results: a null or empty text is one passage of zeros and gets a score; labels that are null, or whose document
is missing, are not used; a document labelled twice counts twice; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm.common import small_batches, text_of
from lagwise.llm.hashing import U, word_hashes

PASSAGE = 64
HASHED = 32
# Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 full stop and comma, 6 other sentence marks, 7 symbols, 8 other ASCII, 9 beyond ASCII.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[128:] = 9
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,", b"!?;:'\"()-", b"#*$%&|<>@~^_=+{}[]\\/`")):
    _CLASS[list(_chars)] = _k
CLASSES = 10
WIDTH = CLASSES + 5 + HASHED


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The passages of all texts (rows of WIDTH features), and how many each text has (at least one)."""
    h, counts = word_hashes(texts)
    passages = np.maximum(-(-counts // PASSAGE), 1)
    total = int(passages.sum())
    first = np.cumsum(passages) - passages
    of_word = np.repeat(first, counts) + (np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)) // PASSAGE
    n = np.bincount(of_word, minlength=total).astype(np.float64)
    safe = np.maximum(n, 1)
    out = np.zeros((total, WIDTH))

    # Bytes belong to the passage of the word that they are part of or follow; what parts the texts here, and white space
    # before a text's first word, counts nowhere, so that a text's encoding does not depend on those around it.
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    text_at = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    kind = _CLASS[buf]
    space = (kind == 3) | (kind == 4) | (buf == 0x0B) | (buf == 0x0C)
    begins = ~space
    begins[1:] &= space[:-1]
    word_at = np.cumsum(begins) - 1
    ok = word_at >= 0
    if len(h):
        ok &= np.repeat(np.arange(len(texts), dtype=np.int32), counts)[word_at] == text_at
    ok[np.cumsum(sizes) - 1] = False
    where = np.zeros(len(buf), np.int64)
    if len(h):
        where[ok] = of_word[word_at[ok]]
        lengths = np.bincount(where[ok], weights=~space[ok], minlength=total)
        cells = np.bincount(where[ok] * CLASSES + kind[ok], minlength=total * CLASSES).reshape(total, CLASSES)
        out[:, :CLASSES] = np.log1p(cells / safe[:, None])
        # Distinct words, immediate repeats and the most frequent word of a passage.
        order = np.lexsort((h, of_word))
        p, s = of_word[order], h[order]
        new = np.append(True, (s[1:] != s[:-1]) | (p[1:] != p[:-1]))
        out[:, CLASSES] = np.bincount(p[new], minlength=total) / safe
        run = np.diff(np.append(np.flatnonzero(new), len(s)))
        most = np.zeros(total)
        np.maximum.at(most, p[new], run)
        out[:, CLASSES + 1] = most / safe
        same = np.append(False, (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1]))
        out[:, CLASSES + 2] = np.bincount(of_word, weights=same, minlength=total) / safe
        out[:, CLASSES + 3] = lengths / safe / 10
        out[:, CLASSES + 4] = np.minimum(n / PASSAGE, 1)
        slot = (h % U(HASHED)).astype(np.int64)
        sign = np.where((h >> U(40)) & U(1), 1.0, -1.0)
        out[:, CLASSES + 5 :] = np.bincount(of_word * HASHED + slot, weights=sign, minlength=total * HASHED).reshape(total, HASHED) / np.sqrt(safe)[:, None] / 4
    return out.astype(np.float32), passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """tanh layer, gated attention and a logistic unit, over standardised encodings."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, attention: int = 12, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"W": g(width, hidden), "b": np.zeros(hidden, np.float32), "V": g(hidden, attention), "G": g(hidden, attention), "w": g(attention, 1), "o": g(hidden, 1), "c": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["G"])
        e = ((v * u) @ p["w"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "y": _sigmoid((z @ p["o"])[:, 0] + p["c"][0])}

    def score(self, x: np.ndarray, passages: np.ndarray) -> np.ndarray:
        bag = np.repeat(np.arange(len(passages)), passages)
        return self._forward((x - self.mean) / self.scale, np.cumsum(passages) - passages, bag)["y"]

    def gradients(self, x: np.ndarray, passages: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of bags of standardised passages, by parameter."""
        p, bag, starts = self.p, np.repeat(np.arange(len(y)), passages), np.cumsum(passages) - passages
        f = self._forward(x, starts, bag)
        d = ((f["y"] - y) / len(y)).astype(x.dtype)
        g = {"o": f["z"].T @ d[:, None], "c": np.array([d.sum()], x.dtype)}
        dz = (d[:, None] * p["o"].T)[bag]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        g["w"] = (f["v"] * f["u"]).T @ de[:, None]
        dg = de[:, None] * p["w"].T
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["G"] = f["h"].T @ dv, f["h"].T @ du
        dh = (dz * f["a"][:, None] + dv @ p["V"].T + du @ p["G"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        return g

    def fit(self, x: np.ndarray, passages: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        p, rng, first = self.p, np.random.default_rng(seed), np.cumsum(passages) - passages
        m, s, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                own = order[i : i + batch]
                n = passages[own]
                rows = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                g = self.gradients(x[rows], n, y[own])
                t += 1
                for k in p:
                    grad = g[k] + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad**2
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def _bytes(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in batch.column(column).to_pylist()]


def _pieces(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes, so that arrays stay small."""
    a, total = 0, 0
    for k, t in enumerate(texts):
        if k > a and total + len(t) > size:
            yield a, k
            a, total = k, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 8000) -> Model | None:
    """A model from at most train_rows labelled documents, or None without labels."""
    picked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null")
    picked = picked.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            texts = _bytes(batch, 2)
            rows = []
            for a, b in _pieces(texts):
                x, passages = encode(texts[a:b])
                at = 0
                for n in passages.tolist():
                    rows.append(x[at : at + n].tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(rows, pa.binary())], ["id", "y", "x"])

    sample = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")
    found = sample.mapInArrow(bags, "id string, y int, x binary").collect()  # bounded: train_rows documents, 3 bytes for each of their words
    if not found:
        return None
    found.sort(key=lambda r: (r["id"], r["y"], bytes(r["x"])))
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in found]
    model = Model()
    model.fit(np.concatenate(xs), np.array([len(x) for x in xs]), np.array([r["y"] for r in found], np.float32))
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, from 0 to 1."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, out = _bytes(batch, 1), []
            for a, b in _pieces(texts):
                out += [0.5] * (b - a) if model is None else model.score(*encode(texts[a:b])).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    slim = docs.select(docs[id_col].alias("doc_id"), text_of(docs[text_col]).alias("text"))
    return slim.mapInArrow(scores, T.StructType([T.StructField("doc_id", slim.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))
