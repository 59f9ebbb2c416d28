"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Patterns give the base spans. Novelty adds to them: a candidate is a run of `LEAST_RUN` or more characters of
`[A-Za-z0-9+/_.=-]` that begins or ends at most `reach` characters from a sensitive word, on either side, and holds a letter (other
runs are numbers). Nothing else is asked of it: the compressor decides. It is primed with a dictionary and sees the text around the
candidate first; the candidate's marginal bytes are those by which the compressed size grows when it follows.

* The dictionary holds the identifiers below, the commonest words of a vocabulary (`vocabulary`, a tokenizer file: its earliest
  `VOCABULARY_WORDS` words) and of the documents themselves (`corpus_words`, counted over all of them).
* Runs are split where letters meet digits and where the case changes, and lower-cased; up to four digits between other signs are one number. So
  a name of known parts is a few known words, and a random string is many short parts.
* Each character is written as `WIDE` bytes. A known part is one match, whatever its length, and each unknown character is a
  match of its own: known parts of six letters cost a sixth, not two thirds, of what random ones cost.

How much a random string costs depends on its alphabet, shape and surroundings. So the marginal bytes are held against the mean of
random strings with the same signs in the same places, drawn by a hash of the candidate: one that costs at least `least` of it is
reported as `novel`, unless a base span overlaps it. Names of unknown parts alone (short abbreviations, words of other
languages that the corpus does not repeat) are reported too; so are digests. A secret of up to 12 letters alone that stands in the documents
`LEAST_COUNT` times becomes a word of the dictionary and is then not novel.

Defined results: a null text counts as empty and has no spans; other columns are not read; rows are scanned one by one, and alike
wherever they stand in the table. An empty table has no words to learn.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lagwise.llm.common import small_batches, text_of

# The patterns of the base kinds, and the least lengths of their values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|credential|api.?key|private.?key|access.?key|auth|bearer|signature", re.I | re.A)
LEAST_RUN = 10
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_RUN},}}", re.A)
_RUN = re.compile("[A-Za-z0-9+/_.=-]")
#: Where a run is split into parts, and digits that are a number (a version, a year, a day) by themselves.
_PARTS = re.compile("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_NUMBER = re.compile("(?<![A-Za-z0-9])[0-9]{1,4}(?![A-Za-z0-9])")
#: Sets of characters that strings are drawn from: hexadecimal digits, or all of the candidate's own kinds.
_HEX = ("0123456789abcdef", "0123456789ABCDEF")
_SETS = tuple(map(frozenset, ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")))
#: Bytes for each character, all different so that matches begin where characters do.
WIDE = 4
_WIDE = {c: bytes([c, c | 128, (c * 37 + 11) % 256, (c * 91 + 5) % 256][:WIDE]).decode("latin-1") for c in range(128)}
#: Below this share of the first three draws no more are made.
FAR = 0.6
VOCABULARY_WORDS, CORPUS_WORDS, LEAST_COUNT = 5000, 2000, 20
#: Letters of a word that the dictionary learns.
WORD_LETTERS = (3, 12)
IDENTIFIERS = (
    b"import from return function class public private static const void string number boolean config settings "
    b"environment variable username password secret_key access_token refresh_token api_key client_id client_secret "
    b"authorization bearer credentials https://www.example.com/index.html http://localhost:8080/api/v1/ application/json "
    b"/usr/local/bin/ /var/log/ /home/user/.config/ com.example.project.module org.apache.commons __init__ self.assertEqual "
    b"test_data_file.txt README.md package.json requirements.txt get_value set_value create_user delete_user update_user "
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020-01-01T00:00:00Z version-1.0.0 the and for that with this"
)


def alphabet(candidate: str) -> str:
    """The letters and digits that a random string like this one would be drawn from."""
    own = {c for c in candidate if c.isalnum()}
    for digits in _HEX:
        if own <= set(digits) and not own <= _SETS[2] and len(own & _SETS[2]) > 1:
            return digits
    return "".join(sorted(frozenset().union(*(k for k in _SETS if own & k))))


def wide(text: str) -> bytes:
    """A text in parts, lower case and wide characters; what is not ASCII is a question mark."""
    parts = _PARTS.sub(" ", _NUMBER.sub("0", text)).lower()
    return parts.encode("ascii", "replace").decode().translate(_WIDE).encode("latin-1")


def vocabulary_words(path: str, most: int = VOCABULARY_WORDS) -> list[str]:
    """The first words, by id, of a tokenizer's vocabulary, in lower case."""
    vocabulary, (least, longest) = Tokenizer.from_file(path).get_vocab(), WORD_LETTERS
    pieces = (re.sub("^[^A-Za-z]+", "", w).lower() for w in sorted(vocabulary, key=vocabulary.__getitem__))
    return list(islice(dict.fromkeys(w for w in pieces if least <= len(w) <= longest and w.isascii() and w.isalpha()), most))


def corpus_words(texts: DataFrame, most: int = CORPUS_WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The commonest words of letters in all texts (column text); at most `most` of them reach the driver."""
    low, high = WORD_LETTERS
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b[a-z]{{{low},{high}}}\b"), F.lit(0)))
    counts = texts.select(found.alias("word")).groupBy("word").count().where(F.col("count") >= least)
    return [r.word for r in counts.orderBy(F.desc("count"), "word").limit(most).collect()]


class Novelty:
    """Marginal compressed bytes against a dictionary: words (the commonest first) and the identifiers above."""

    def __init__(self, words: Iterable[str] = (), level: int = 12, draws: int = 12) -> None:
        numbers = [*(f"{n:02d}" for n in range(100)), *map(str, range(1900, 2040)), *(str(1 << n) for n in range(14))]
        primer = " ".join(["", *reversed(list(words)), *numbers, ""]).translate(_WIDE).encode("latin-1") + wide(IDENTIFIERS.decode() + " ")
        known = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        self.z = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False)
        self.draws = draws

    def share(self, before: str, after: str, candidate: str) -> float:
        """The candidate's marginal compressed bytes over the mean of random strings like it: in sum after its surroundings in either order."""
        places = [wide(f"{before} {after} "), wide(f"{after} {before} ")]
        alone = sum(len(self.z.compress(p)) for p in places)
        cost = lambda s: sum(len(self.z.compress(p + s)) for p in places) - alone
        rng, letters, own, total = random.Random(candidate), alphabet(candidate), cost(wide(candidate)), 0
        for k in range(1, self.draws + 1):
            total += cost(wide("".join(rng.choice(letters) if c.isalnum() else c for c in candidate)))
            if k == 3 and own < total / k * FAR:  # far below all that a few more draws could say
                break
        return own / max(total / k, 1.0)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern kinds, leftmost and not overlapping within a kind."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, reach: int, context: int, least: float) -> list[tuple[int, int, str]]:
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    taken, out, done = sorted(base), [], 0
    ends = [b for _, b, _ in taken]
    far = max((b - a for a, b, _ in taken), default=0)
    for start, end in words:
        # A run may begin before the reach that it ends in, so each is found from its own start.
        low = max(done, start - reach)
        while low > done and _RUN.fullmatch(text[low - 1]):
            low -= 1
        for c in CANDIDATE.finditer(text, low):
            if c.start() > end + reach:
                break
            done = max(done, c.end())
            run = c[0]
            if not any(x.isalpha() for x in run):
                continue
            k = bisect.bisect_right(ends, c.start())
            overlaps = False
            while k < len(taken) and taken[k][0] < c.end() + far:
                overlaps |= taken[k][0] < c.end() and taken[k][1] > c.start()
                k += 1
            before, after = text[max(0, c.start() - context) : c.start()], text[c.end() : c.end() + context]
            if not overlaps and novelty.share(before, after, run) >= least:
                out.append((c.start(), c.end(), "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scanner(words: list[str], reach: int, context: int, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in small_batches(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base_sha, spans = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                new = novel_spans(text, base, novelty, reach, context, least)
                for kind in KINDS:
                    counts[kind].append(sum(s[2] == kind for s in (*base, *new)))
                base_sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined([*base, *new]))
            longs = [pa.array(counts[k], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(base_sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return scan


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 64, context: int = 256, least: float = 0.79, vocabulary: str | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans (kind:start:end by start, code points, end exclusive)."""
    slim = docs.select(docs[id_col].alias("doc_id"), text_of(docs[text_col]).alias("text"))
    learned = corpus_words(slim)
    words = list(dict.fromkeys([*learned, *(vocabulary_words(vocabulary) if vocabulary else ())]))
    schema = T.StructType([T.StructField("doc_id", slim.schema["doc_id"].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return slim.mapInArrow(_scanner(words, reach, context, least), schema)
