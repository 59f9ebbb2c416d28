"""Mixing sources to target weights: Efraimidis-Spirakis keys within each source, filled to token budgets.

A source's target is its share of all words by weight, stopped at `most` times its size; what is above is shared out
again by weight (water filling, in closed form over the sources ordered by size / weight). A source gives as many whole
epochs as fit into its target; the rest is filled in order of the keys -ln(u) / quality, u uniform by a hash of id and
seed, so documents of higher quality come first more often, and a rerun gives the same mix. The document that crosses
the budget is taken if that comes nearer to it.

Running sums are two-level: each source's keys fall into buckets by exp(-key); sums of buckets give the words ahead of a
bucket, and only the bucket in which a source's budget ends has its rows ordered, to find the last row that is taken.
Whether a row is taken once more then follows from its own key, so texts are neither shuffled nor sorted, and a hot
source is no heavier for a task than any other.

Defined results: a null text has no words; null is a source of its own, ordered last; ties in the key fall to the id,
null ids first, then to the size; rows alike in all these are taken together; an empty table gives an empty result;
sources without words have target 0; quality that is null or not above 0 counts as the least weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import materialise, text_of, words

LEAST_QUALITY = 0.01
#: Plans of up to this many sources are broadcast (some 100 bytes each); beyond it, a skewed join is left to AQE.
BROADCAST_SOURCES = 100_000


def variety(text: Column) -> Column:
    """A quality weight: distinct words as a share of all words."""
    w = words(text)
    return F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size) -> also weight and target. One row for each source."""
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    df = sizes.select("source", "source_size", pick.alias("weight"))
    df = df.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    df = df.withColumn("fills_at", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    df = df.withColumn("level", level)
    level = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(every)
    return df.select("source", "source_size", "weight", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).alias("target"))


def _uniform(id_col: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _keyed(docs: DataFrame, rest: Column, id_col: str, source_col: str, text_col: str, quality: Column | None, seed: int, buckets: int) -> DataFrame:
    """row, and the columns by which a row is placed."""
    text = text_of(docs[text_col])
    weight = variety(text) if quality is None else quality
    df = docs.select(rest.alias("row"), docs[id_col].alias("id"), docs[source_col].alias("source"), F.size(words(text)).cast("long").alias("size"), weight.cast("double").alias("q"))
    q = F.when(F.col("q") > LEAST_QUALITY, F.col("q")).otherwise(F.lit(LEAST_QUALITY))
    df = df.withColumn("key", -F.log(_uniform(F.col("id"), seed)) / q).drop("q")
    return df.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))


def plan(slim: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """One row for each source: p_source, source_size, target, epochs, and the bucket (`last`) and key (`cut`) up to which its rows are taken once more."""
    cells = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goals = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goals = goals.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    goals = goals.withColumn("budget", F.when(F.col("epochs") < most, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    goals = goals.withColumnRenamed("source", "p_source")
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    edge = cells.withColumn("ahead", ahead).join(goals.select("p_source", "budget"), F.col("source").eqNullSafe(F.col("p_source")))
    edge = edge.where((F.col("ahead") < F.col("budget")) & (F.col("ahead") + F.col("words") >= F.col("budget")))
    edge = edge.select(F.col("source").alias("e_source"), F.col("bucket").alias("last"), "ahead", "budget")
    inside = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("last")))
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("before", before).where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("size") - F.col("budget") <= F.col("budget") - F.col("before")))
    cuts = rows.groupBy("e_source").agg(F.max(F.struct("key", "id", "size")).alias("cut"))
    edge = edge.join(cuts.withColumnRenamed("e_source", "c_source"), F.col("e_source").eqNullSafe(F.col("c_source")), "left").select("e_source", "last", "cut")
    return goals.join(edge, F.col("p_source").eqNullSafe(F.col("e_source")), "left").select("p_source", "source_size", "target", "epochs", "last", "cut")


def _small_plan(slim: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """The plan, broadcast if it is known to be small: joined by source instead, a hot source's rows would meet in one task."""
    out = materialise(plan(slim, weights, most), "plan")
    return F.broadcast(out) if out.count() <= BROADCAST_SOURCES else out


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    taken = (F.col("bucket") < F.col("last")) | (F.col("bucket") == F.col("last")) & (F.struct("key", "id", "size") <= F.col("cut"))
    copies = F.col("epochs") + F.when(taken, 1).otherwise(0)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    return rows.select("row", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    quality: Column | None = None, seed: int = 42, buckets: int = 4096,
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies and taken = copies * size."""
    slim = materialise(_keyed(docs, docs[id_col], id_col, source_col, text_col, quality, seed, buckets), "mix")
    return _placed(slim, _small_plan(slim, weights, most)).withColumnRenamed("row", "doc_id")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    quality: Column | None = None, seed: int = 42, buckets: int = 4096,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the documents' columns."""
    place = (id_col, source_col, text_col, quality, seed, buckets)
    slim = materialise(_keyed(docs, F.lit(None), *place).drop("row"), "mix")
    rows = _placed(_keyed(docs, F.struct(*[docs[c] for c in docs.columns]), *place), _small_plan(slim, weights, most)).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
