"""Plain versions of the operators' contracts, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text: str | None) -> tuple:
    w, text = words(text), text or ""
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def shingles(text: str | None, k: int) -> set:
    w = words(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_groups(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple]:
    """doc_id -> (n_shingles, component_id), over all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for d, s in sets.items():
        common = Counter(y for x in s for y in holders[x] if y < d)
        for y, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[y]) - n):
                a, b = find(d), find(y)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple]:
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first: dict = {}
    split = {d: words(t) for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, w in split.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs: list, items: list, window: int) -> dict[int, tuple]:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    grams: dict[int, dict] = {}
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            grams.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
    out = {}
    for d, text in docs:
        w, hit, which = ALNUM.findall(lower(text or "")), set(), set()
        for m, g in grams.items():
            for i in range(len(w) - m + 1):
                if found := g.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    which |= found
        out[d] = (len(w), len(hit), len(which), sha(",".join(sorted(map(str, which)))), bool(hit))
    return out


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)


def secrets(text: str | None) -> tuple:
    spans = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m[g]) >= n]
    return *(sum(s[1] == k for s in spans) for k in range(3)), sha(",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in sorted(spans)))


def crc(data: bytes) -> int:
    return zlib.crc32(data)
