"""What the operators share: words, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space, which part words.
SPACE = r"[\x20\x09-\x0D]+"

#: The temporary folder of each local application.
_LOCAL: dict[str, str] = {}

#: Frees a query's shuffle files as soon as the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column | str) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(column: Column) -> Column:
    """The words of a text that is not null, as an array."""
    return F.filter(F.split(column, SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lagwise-"))
    return found.rstrip("/")


@contextmanager
def set_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors lose nothing.

    Shuffle files of the write are freed when it ends, so that a job's phases do not add up on disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with set_conf(spark, {_CLEANUP: "true"}):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() made and no result needs any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows up to which ids and hashes are broadcast: 8 bytes each, and as much again for the table. More are joined by shuffle.
BROADCAST_IDS = 2_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A broadcast hint, given after counting up to the bound; df should be a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of up to so many rows and bytes of a text column, so that what Python makes of one stays small; a longer text is a part alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        a, total = 0, 0
        for k, n in enumerate(lengths):
            if k > a and (total + n > size or k - a >= rows):
                yield batch.slice(a, k - a)
                a, total = k, 0
            total += n
        if a < len(lengths):
            yield batch.slice(a)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over the edges, for every node that has an edge.

    Each round takes the least label among a node and its neighbours, then follows the label's own label once (pointer
    jumping), so that long chains close in a logarithmic number of rounds. Labels are written to the shared folder
    every round; only one number a round reaches the driver. Up to the bound of bounded(), labels are broadcast, so that
    neither a hub's edges nor a large component's members, which share a label, meet in one task; beyond it, AQE splits them.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialise(both.union(both.select("v", "u")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    small = F.broadcast if labels.count() <= BROADCAST_IDS else lambda df: df
    while True:
        near = both.join(small(labels), both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(small(near), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = new.select("label").distinct().join(new.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        new = materialise(new.join(small(heads), "label", "left").select("node", "old", F.least("label", "next").alias("label")), "labels")
        discard(labels)
        labels = new
        if not new.where("label <> old").limit(1).count():
            discard(both)
            out = labels.select("node", "label")
            out._scratch = labels._scratch
            return out


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of components() after more edges (a, b), worked out on the components that these edges join."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    over = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    above = components(over).select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return old.union(above.join(labels, above["label"] == labels["node"], "left_anti").select("label", "top"))
