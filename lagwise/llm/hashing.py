"""Hashes of words and of runs of words, over whole batches of texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE, _WORD, _CHECK = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA24BAED4963EE407)
_CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all of them; one to one."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_chunk(data: bytes, starts_of_texts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, np.uint8)
    word = ~_IS_SPACE[buf]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.append(np.searchsorted(starts, starts_of_texts), len(starts)))
    if not len(starts):
        return np.zeros(0, U), counts
    lens = ends - starts
    at = np.flatnonzero(word).astype(np.int32)
    inside = at - np.repeat(starts.astype(np.int32), lens)
    h = (table[buf[at]].astype(U) + U(1)) * _powers(_BYTE, int(lens.max()))[inside]
    return mix(np.add.reduceat(h, np.cumsum(lens) - lens) + lens.astype(U)), counts


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts, one after the other, and the number of words of each text.

    Words are runs of bytes other than ASCII white space; lower: A-Z count as a-z.
    """
    table = _LOWER if lower else _SAME
    hashes, counts, k = [], [], 0
    while k < len(texts):
        part, size, at = [], 0, []
        while k < len(texts) and (not part or size + len(texts[k]) < _CHUNK):
            at.append(size)
            part.append(texts[k])
            size += len(texts[k]) + 1
            k += 1
        h, n = _hash_chunk(b"\n".join(part), np.array(at), table)
        hashes.append(h)
        counts.append(n)
    return (np.concatenate(hashes), np.concatenate(counts).astype(np.int64)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64))


def piece_hashes(buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each piece of a buffer that the pieces fill."""
    lens = np.diff(np.append(begins, len(buf)))
    inside = np.arange(len(buf), dtype=np.int32) - np.repeat(begins.astype(np.int32), lens)
    h = (buf.astype(U) + U(1)) * _powers(_BYTE, int(lens.max()))[inside]
    return mix(np.add.reduceat(h, begins) + lens.astype(U))


def slices(sizes: list[int], most: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of items of about `most` in size together, so that arrays over them stay small."""
    a, total = 0, 0
    for k, n in enumerate(sizes):
        if k > a and total + n > most:
            yield a, k
            a, total = k, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive words; runs cross from text to text, so the caller masks those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j, p in enumerate(_powers(_WORD, k)):
        out += h[j : j + n] * p
    return mix(out + U(k))


def run_checks(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the runs of k words that start at `at`, independent of run_hashes(): both together are 128 bits."""
    out = np.zeros(len(at), U)
    for j in range(k):
        out = (out ^ mix(h[at + j] + U(j))) * _CHECK
    return mix(out)
