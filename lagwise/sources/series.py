"""Readers of index series: fixed-width yearly tables, column tables, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.model import clean, with_month

NUMBER = r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"


def read_yearly(spark: SparkSession, path: str, missing: float | None = None) -> DataFrame:
    """(year, month, t, value) of a text table: a head of two years, rows of a year and twelve values, and lone missing codes at the end.

    Values equal to a lone code, to `missing`, or not above -90 are null. The file is read as lines; the codes are one
    small aggregate beside it.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.get("w", F.lit(0)) != "")
    codes = lines.where((F.size("w") == 1) & F.get("w", F.lit(0)).rlike(NUMBER)).agg(F.collect_set(F.get("w", F.lit(0)).cast("double")).alias("codes"))
    rows = lines.where((F.size("w") >= 13) & F.get("w", F.lit(0)).rlike(r"^\d{4}$")).crossJoin(F.broadcast(codes))
    rows = rows.select(F.get("w", F.lit(0)).cast("int").alias("year"), "codes", F.posexplode(F.slice("w", 2, 12)).alias("m", "x"))
    x = F.expr("try_cast(x as double)")
    bad = (x <= -90) | F.coalesce(F.array_contains("codes", x), F.lit(False)) | (F.lit(missing is not None) & (x == F.lit(missing if missing is not None else 0.0)))
    month = F.col("m") + 1
    return rows.select("year", month.cast("int").alias("month"), (F.col("year") * 12 + F.col("m")).cast("int").alias("t"), F.when(~bad, clean(x)).alias("value"))


def read_columns(spark: SparkSession, path: str, value: str, year: str = "YR", month: str = "MON") -> DataFrame:
    """(year, month, t, value) of a white-space table with a head line of column names."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"))
    head = lines.where(F.array_contains("w", year)).first()
    if head is None or value not in head["w"]:
        raise ValueError(f"no column {value!r} in {path}")
    at = {c: head["w"].index(c) for c in (year, month, value)}
    rows = lines.where(F.get("w", F.lit(at[year])).rlike(r"^\d{4}$"))
    y, m = F.get("w", F.lit(at[year])).cast("int"), F.get("w", F.lit(at[month])).cast("int")
    return rows.select(y.alias("year"), m.alias("month"), (y * 12 + m - 1).alias("t"), clean(F.expr(f"try_cast(get(w, {at[value]}) as double)")).alias("value"))


def read_csv_series(spark: SparkSession, path: str) -> DataFrame:
    """(year, month, t, value) from the first two columns of a CSV file with a head: a date and a value."""
    df = spark.read.csv(path, header=True)
    date, value = df.columns[:2]
    df = df.select(F.to_date(F.col(f"`{date}`")).alias("_date"), clean(F.expr(f"try_cast(`{value}` as double)")).alias("value"))
    return with_month(df, "_date").drop("_date")


def read_series(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """The yearly table `stem`.data (or .txt) of a folder, or else its CSV."""
    fs = spark._jvm.org.apache.hadoop.fs
    for ending in (".data", ".txt", ".csv"):
        path = fs.Path(f"{folder}/{stem}{ending}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            read = read_csv_series if ending == ".csv" else read_yearly
            return read(spark, f"{folder}/{stem}{ending}")
    raise FileNotFoundError(f"no series {stem!r} in {folder}")
