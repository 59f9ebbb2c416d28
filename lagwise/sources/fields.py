"""Field files: names that carry identity, inventories, reading and writing of long Parquet fields."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.model import clean
from lagwise.operators.epochs import small
from lagwise.sources.sinks import provenance, write_json

# The ten parts of a field file's name, in order.
PARTS = ("model", "forcing", "climate_scenario", "soc_scenario", "sens_scenario", "variable", "region", "timestep", "start", "end")
ENDINGS = ("nc", "nc4", "parquet")
NAME = "^" + "_".join([r"([^_/]+)"] * 8 + [r"(\d{4})"] * 2) + rf"\.({'|'.join(ENDINGS)})$"


def build_name(ending: str = "parquet", **parts: object) -> str:
    return "_".join(str(parts[p]).lower() if p not in ("start", "end") else str(parts[p]) for p in PARTS) + f".{ending}"


def parse_name(name: str) -> dict[str, str | int]:
    """The parts of a name; ValueError for one of another form."""
    m = re.match(NAME, name.rsplit("/", 1)[-1])
    if not m:
        raise ValueError(f"not a field file's name: {name!r}")
    out = dict(zip(PARTS, m.groups(), strict=False))
    return out | {"start": int(out["start"]), "end": int(out["end"])}


def name_columns(path: Column | str) -> dict[str, Column]:
    """The parts of a path's name as columns, null for names of another form."""
    base = F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)
    part = lambda k: F.nullif(F.regexp_extract(base, NAME, k), F.lit(""))
    return {p: part(k + 1).cast("int") if p in ("start", "end") else part(k + 1) for k, p in enumerate(PARTS)}


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """A row for each field file below root: path, sector (its folder), size and the parts of its name. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    sector = F.element_at(F.split("path", "/"), -2)
    return files.withColumns({"sector": sector} | name_columns("path")).where(F.col("variable").isNotNull())


def find_files(files: DataFrame, **wanted: str) -> DataFrame:
    """Rows of an inventory whose parts match the given values; * stands for anything."""
    for part, value in wanted.items():
        pattern = "^" + re.escape(value).replace(r"\*", ".*") + "$"
        files = files.where(F.col(part).rlike(pattern))
    return files


def read_field(spark: SparkSession, root: str, period: tuple[int, int] | None = None, **partitions: str) -> DataFrame:
    """A field written by write_field, pruned to the given partitions and years; NaN becomes null."""
    df = spark.read.parquet(root)
    for name, value in partitions.items():
        df = df.where(F.col(name) == value)
    if period:
        df = df.where(F.col("year").between(*period))
    return df.withColumn("value", clean("value"))


def write_field(df: DataFrame, root: str, partitions: tuple[str, ...] = ("variable", "climate_scenario", "soc_scenario"), mode: str = "overwrite", step: str | None = None, settings: dict | None = None) -> None:
    """Write partitioned and clustered by cell, values as floats, so that readers prune and each cell's series lies together.

    With a step, who made the field is written beside it, as root/_provenance.json, which readers of the field pass over.
    """
    order = [c for c in ("cell_id", "t") if c in df.columns]
    df = df.withColumn("value", F.col("value").cast("float"))
    df.repartition(*partitions, *order[:1]).sortWithinPartitions(*partitions, *order).write.mode(mode).partitionBy(*partitions).parquet(root)
    if step:
        write_json(df.sparkSession, f"{root}/_provenance.json", provenance(step, settings or {}))


def write_store(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """A field as a table bucketed by cell_id and sorted by month within: opened as open_store() does.

    Climatologies, detrending, epochs and composites all work cell by cell. Over a store they take its buckets as they are, and the field
    is not exchanged again, however many of them run. buckets: some 100 to 200 MB of the field each.
    """
    df = df.withColumn("value", F.col("value").cast("double"))
    name = f"store_{uuid.uuid4().hex}"
    df.repartition(buckets, "cell_id").write.mode("overwrite").option("path", path).bucketBy(buckets, "cell_id").sortBy("t").saveAsTable(name)
    return df.sparkSession.table(name)


def open_store(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """A store written before, by this session or another; schema as of its columns. Its table is named in this session alone."""
    name = f"store_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (cell_id) SORTED BY (t) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def align(members: dict[str, DataFrame], keys: list[str], member: str = "model") -> DataFrame:
    """(keys, t, member, value): every member on the union of all members' axes, null where it has nothing.

    Members may lack cells or months that others have: their rows meet by full outer joins on (keys, t), and cells and months that no member
    has together are filled in, as of a dense array. df of a member has (keys, t, value).
    """
    wide = None
    for k, (_, df) in enumerate(members.items()):
        one = df.select(*keys, "t", F.col("value").cast("double").alias(f"_m{k}"))
        wide = one if wide is None else wide.join(one, [*keys, "t"], "full")
    every = wide.select(*keys).distinct().crossJoin(small(wide.select("t").distinct()))
    names = [F.struct(F.lit(name).alias(member), F.col(f"_m{k}").alias("value")) for k, name in enumerate(members)]
    return every.join(wide, [*keys, "t"], "left").select(*keys, "t", F.explode(F.array(*names)).alias("_e")).select(*keys, "t", "_e.*")


def ensemble_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Members averaged for each key and month; months that a member lacks are averaged over the others."""
    return df.groupBy(*keys, "t", "year", "month").agg(F.avg("value").alias("value"))


def harmonise(df: DataFrame, land: DataFrame | None = None, period: tuple[int, int] | None = None, spin_up: int = 10) -> DataFrame:
    """Units by column `units`, years of the period less its spin-up, and null off land. land has (cell_id, land)."""
    from lagwise.functions.units import to_celsius, to_mm_per_day

    df = df.withColumn("value", to_celsius(to_mm_per_day(F.col("value"), F.col("units")), F.col("units")))
    if period:
        df = df.where(F.col("year").between(period[0] - spin_up, period[1]))
    if land is not None:
        df = df.join(land.select("cell_id", "land"), "cell_id", "left").withColumn("value", F.when(F.col("land"), F.col("value"))).drop("land")
    return df


def coverage(df: DataFrame, keys: list[str], expected_months: int, least: float = 0.9) -> DataFrame:
    """(keys): months present, their share of those expected, and whether that is under `least`."""
    out = df.groupBy(*keys).agg(F.countDistinct("t").alias("n_months")).withColumn("share", F.col("n_months") / expected_months)
    return out.withColumn("short", F.col("share") < least)
