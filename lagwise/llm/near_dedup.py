"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

1. Every document gets its shingle set, a digest of it, and a signature of `chunks * symbols` b-bit MinHash symbols
   (b = 16). Documents of one digest are a class; only its least id goes on.
2. The signature is split into chunks. By the pigeonhole principle, two signatures that differ in fewer than
   chunks * (errors + 1) symbols have a chunk with at most `errors` differing symbols. Every choice of `errors` symbols to
   leave out of a chunk makes a key of the rest, so all pairs under that distance share a key: 12 chunks of 6 with one
   error find every pair that differs in at most 23 of the 72 symbols, and miss a pair of Jaccard similarity 0.85 with
   probability 2e-8 (0.8: 3e-6).
3. Shingles that only one of the candidate documents has (`lone`) bound the similarity of any pair: the union exceeds
   the intersection by both lone counts at least. Documents that this bound keeps from linking with any other leave.
4. In each key, the document with the smallest share of lone shingles is the hub; the others are held against it on
   their full sets, and connected components of the links follow. What is left are pairs of members of one hub in
   different components. With d(x) the number of shingles by which x and the hub differ, a link of x and y forces the
   differences of both from the hub to share at least d * p / (100 + p) shingles (p percent; at least d(x) - L(x) for a
   member that the hub does not link, L(x) being the most by which x may differ from anything it links with). So by the
   prefix principle a pair needs a common shingle among the first d - c + 1 differences of each, in one order: what a
   member has beyond the hub first, then what it lacks. Such pairs are held against each other too. No link is lost, and
   a group that one hub links costs a comparison for each member, not for each pair.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; rows that share an id count as one document; a row with a null id is grouped by its text, but
gives no id to a component (a component of such rows alone is null, and they are kept); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm.common import bounded, small_batches, components, discard, joined, materialise, text_of
from lagwise.llm.hashing import U, mix, run_hashes, word_hashes


def _sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    h, counts = word_hashes(texts, lower=True)
    runs = run_hashes(h, shingle)
    at = 0
    for n in counts.tolist():
        if n >= shingle:
            yield np.unique(runs[at : at + n - shingle + 1])
        else:
            yield run_hashes(h[at : at + n], n) if n else np.zeros(0, U)
        at += n


def _signer(shingle: int, chunks: int, symbols: int, errors: int):
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, chunks * symbols, dtype=U) | U(1)
    masks = [np.array([j not in left for j in range(symbols)]) for left in combinations(range(symbols), errors)]
    weight = rng.integers(1, 1 << 63, symbols, dtype=U) | U(1)
    tag = rng.integers(1, 1 << 63, (len(masks), chunks), dtype=U)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            n, digests, least = [], [], np.full((len(texts), len(a)), ~U(0))
            for k, s in enumerate(_sets(texts, shingle)):
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                for i in range(0, len(s), 4096):
                    np.minimum(least[k], (s[i : i + 4096, None] * a).min(0), out=least[k])
            symbol = (mix(least) & U(0xFFFF)).reshape(len(texts), chunks, symbols)
            keys = np.stack([mix((symbol[:, :, m] * weight[m]).sum(2, dtype=U) + t) for m, t in zip(masks, tag, strict=True)], 2).reshape(len(texts), -1)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))], ["id", "n", "digest", "keys"])

    return sign


def _set_maker(shingle: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = list(_sets([x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()], shingle))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "set"])

    return make


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard similarity of at least `percent`."""
    x = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    y = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "b").join(y, "a").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> whether hub a links b, and the differences of b from a that lead to b's other links: `first` of all, `half` of them for members alike."""
    x = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    y = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    df = pairs.join(x, "b").join(y, "a").select("a", "b", F.size("sb").alias("n"), (F.size("sa") + F.size("sb")).alias("both"), F.array_except("sb", "sa").alias("more"), F.array_except("sa", "sb").alias("less"))
    df = df.withColumn("d", F.size("more") + F.size("less")).withColumn("linked", (100 + percent) * F.col("d") <= (100 - percent) * F.col("both"))
    most = F.floor((100 - percent) * F.col("n") / percent)
    df = df.withColumn("half", (F.col("d") - F.floor(F.col("d") * percent / (100 + percent))).cast("int"))
    long = (F.col("d") - F.greatest(F.lit(1), F.col("d") - most) + 1).cast("int")
    ahead = F.slice(F.concat(F.sort_array("more"), F.sort_array("less")), F.lit(1), F.when(F.col("linked"), F.col("half")).otherwise(F.greatest("half", long)))
    return df.select("a", "b", "linked", "d", "half", F.when(F.col("linked"), F.lit(0)).otherwise(long).alias("long"), ahead.alias("first"))


def _may_link(x: str, y: str, percent: int) -> Column:
    """The bound that the lone shingles of both set."""
    sizes, lone = f"({x}.n + {y}.n)", f"({x}.lone + {y}.lone)"
    return F.expr(f"100 * ({sizes} - {lone}) >= {percent} * ({sizes} + {lone}) and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)")


def _across(stars: DataFrame, labels: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of members of one hub, in different components, that share an early difference from it."""
    part = light.join(labels, light.id == labels.node, "left").select(F.col("id").alias("b"), "n", "lone", F.coalesce("label", "id").alias("part"))
    rows = stars.join(part, "b").select("a", "b", "part", "n", "lone", "linked", "d", "half", "long", F.posexplode("first").alias("i", "e"))
    # A hub and a difference make one key; a member takes part as one of the unlinked (`long`), or with its first `half`.
    rows = rows.select(F.xxhash64("a", "e").alias("key"), F.col("b").alias("id"), "part", "n", "lone", "linked", "d", (F.col("d") - F.col("i")).alias("left"), (F.col("i") < F.col("half")).alias("early"), (F.col("i") < F.col("long")).alias("far"))
    shared = rows.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count_if(~F.col("linked")).alias("u")).where("p <> q and u > 0").select("key")
    rows = materialise(rows.join(shared, "key", "left_semi"), "differences")
    x, y = rows.where("not linked").alias("x"), rows.where("early").alias("y")
    alike = F.expr("if(y.linked, x.far, x.early and x.id < y.id)")
    # If this is the first difference that both share, they share no more than either has left from here on.
    rest = F.expr(f"2 * least(x.left, y.left) >= x.d + y.d - floor({100 - percent} * (x.n + y.n) / {100 + percent})")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & alike & rest & _may_link("x", "y", percent))
    pairs = materialise(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "pairs")
    discard(rows)
    return pairs


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, chunks: int = 12, symbols: int = 6, errors: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) and kept (doc_id = component_id), for every row."""
    slim = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    id_field = T.StructField("id", slim.schema["id"].dataType)
    fields = [id_field, T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    full = materialise(slim.mapInArrow(_signer(shingle, chunks, symbols, errors), T.StructType(fields)), "signatures")
    signed = materialise(full.drop("keys"), "digests")
    classes = materialise(signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")), "classes")

    firsts = full.join(classes, [full.digest == classes.digest, full.id == classes.rep], "left_semi")
    keyed = firsts.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    found = materialise(keyed.join(shared, "key", "left_semi"), "members")
    discard(full)
    wanted = materialise(found.select("id").distinct(), "candidates")
    near = bounded(wanted)
    sets = slim.join(near, "id", "left_semi").mapInArrow(_set_maker(shingle), T.StructType([id_field, T.StructField("set", T.ArrayType(T.LongType()))]))
    sets = materialise(sets, "sets")

    alone = sets.select("id", F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    light = sets.where("size(set) > 0").select("id", F.size("set").cast("long").alias("n")).join(alone, "id", "left").select("id", "n", F.coalesce("lone", F.lit(0)).alias("lone"))
    light = materialise(light.where(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n")), "light")
    members = materialise(found.join(light, "id"), "members")
    discard(found)

    hubs = members.groupBy("key").agg(F.min(F.struct((F.col("lone") / F.col("n")).alias("share"), F.col("id").alias("id"), F.col("n").alias("n"), F.col("lone").alias("lone"))).alias("hub"), F.count(F.lit(1)).alias("c"))
    hubs = hubs.where("c > 1").select("key", "hub.*")
    pairs = members.alias("m").join(hubs.alias("h"), (F.col("m.key") == F.col("h.key")) & (F.col("m.id") != F.col("h.id")))
    stars = materialise(_stars(pairs.select(F.col("h.id").alias("a"), F.col("m.id").alias("b")).distinct(), sets, percent), "stars")
    links = stars.where("linked").select("a", "b")
    labels = components(links)
    pairs = _across(stars, labels, light, percent)
    more = materialise(_links(pairs, sets, percent), "links")
    if more.limit(1).count():
        labels = joined(labels, more)
    discard(wanted, members, light, stars, pairs, sets, more)

    # Only texts that stand twice or are linked are looked up, not all; a text that a third of all rows copy stays spread while these fit a broadcast.
    parts = classes.join(labels, F.col("rep") == F.col("node"), "left").where("c > 1 or label is not null").select("digest", F.coalesce("label", "rep").alias("part"))
    parts = bounded(materialise(parts, "parts"))
    out = signed.where("n > 0").join(parts, "digest", "left").select("id", "n", F.coalesce("part", "id").alias("part"))
    out = out.unionByName(signed.where("n = 0").select("id", "n", F.col("id").alias("part")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("part").alias("component_id"), F.col("id").eqNullSafe(F.col("part")).alias("kept"))


def _row_number(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A number for each pair of id and text, in order of the ids, null last; rows alike in both share it."""
    wide = lambda c: c.cast("decimal(20,0)")
    by_id = F.coalesce(wide(docs[id_col].cast("long")) + wide(F.lit(str(1 << 63))), wide(F.lit(str(1 << 64))))
    told = F.shiftrightunsigned(F.xxhash64(docs[text_col]), 3)
    return (by_id * F.lit(1 << 61).cast("decimal(19,0)") + wide(told)).cast("decimal(38,0)")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One document of each group, with its columns: the one with the least id. Rows without words all stay.

    Every row is a document here, whatever its id: rows that share an id, or have none, are grouped by their own texts. Of rows alike
    in id and text one stays, that with the least hash of all columns.
    """
    number = _row_number(docs, id_col, text_col)
    rows = docs.select(number.alias("doc_id"), docs[text_col].alias("text"))
    found = materialise(groups(rows, **options).where("n_shingles > 0").groupBy("doc_id", "kept").agg(F.count(F.lit(1)).alias("c")).where("not kept or c > 1"), "found")
    gone = found.where("not kept").select(F.col("doc_id").alias("_row"))
    twice = found.where("kept").select(F.col("doc_id").alias("_row"))
    out = docs.join(bounded(gone), number == gone["_row"], "left_anti")
    if not twice.limit(1).count():
        return out
    repeated = out.join(bounded(twice), number == twice["_row"]).select("_row", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = repeated.groupBy("_row").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return out.join(bounded(twice), number == twice["_row"], "left_anti").unionAll(one)
