"""Index series: base-period anomalies, running means, two-index transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.model import in_time


def sliding_base_anomaly(df: DataFrame, keys: list[str], window_years: int = 30, step_years: int = 5) -> DataFrame:
    """Anomalies against a base period that moves with each block of step_years.

    The block that starts in year b has the base lo..lo + window - 1, lo = b + step / 2 - window / 2 rounded half to
    even, moved inside the record where it sticks out. Few blocks (years / step) meet the series in a range join, and
    come back by an equi-join on (block, month).
    """
    ends = df.groupBy(*keys).agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    first = F.col("y0") - F.pmod(F.col("y0"), F.lit(step_years))
    blocks = ends.select(*keys, "y0", "y1", F.explode(F.sequence(first, F.col("y1"), F.lit(step_years))).alias("block"))
    lo = F.bround(F.col("block") + F.lit(step_years / 2 - window_years / 2), 0).cast("int")
    lo = F.greatest(F.least(lo, F.col("y1") - (window_years - 1)), F.col("y0"))
    blocks = blocks.select(*keys, "block", lo.alias("lo")).withColumn("hi", F.col("lo") + (window_years - 1))
    d, b = df.alias("d"), blocks.alias("b")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    inside = F.col("d.year").between(F.col("b.lo"), F.col("b.hi"))
    on = inside
    for s in same:
        on = on & s
    base = d.join(F.broadcast(b) if not keys else b, on).groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], "block", "month").agg(F.avg("value").alias("base"))
    out = df.withColumn("block", F.col("year") - F.pmod(F.col("year"), F.lit(step_years)))
    return out.join(base, [*keys, "block", "month"], "left").withColumn("value", F.col("value") - F.col("base")).drop("base", "block")


def fixed_base_anomaly(df: DataFrame, keys: list[str], base: tuple[int, int]) -> DataFrame:
    inside = F.when(F.col("year").between(*base), F.col("value"))
    return df.withColumn("value", F.col("value") - F.avg(inside).over(Window.partitionBy(*keys, "month")))


def running_mean(df: DataFrame, keys: list[str], width: int = 3) -> DataFrame:
    """Centred mean of `width` rows, all with a value; rows without one are dropped. Rows are taken as they follow each other."""
    half = width // 2
    frame = in_time(keys).rowsBetween(-half, width - 1 - half)
    out = df.where("value is not null").withColumns({"_n": F.count("value").over(frame), "value": F.avg("value").over(frame)})
    return out.where(F.col("_n") == width).drop("_n")


def two_index_transform(east: DataFrame, west: DataFrame, same_sign: float = 0.4) -> DataFrame:
    """(t, nct, nwp) of two index series: each loses `same_sign` times the other where both have one sign."""
    df = east.select("t", F.col("value").alias("e")).join(west.select("t", F.col("value").alias("w")), "t")
    a = F.when(F.col("e") * F.col("w") > 0, same_sign).otherwise(0.0)
    return df.select("t", (F.col("e") - a * F.col("w")).alias("nct"), (F.col("w") - a * F.col("e")).alias("nwp"))


def looks_like_anomaly(df: DataFrame, limit: float = 5.0) -> bool:
    """Whether a series is of anomalies: its mean absolute value is small. One row reaches the driver."""
    mean = df.agg(F.avg(F.abs("value"))).first()[0]
    return mean is not None and mean < limit


def base_period_index(df: DataFrame, keys: list[str], method: str = "sliding", window_years: int = 30, step_years: int = 5, base: tuple[int, int] | None = None, width: int = 3) -> DataFrame:
    """Anomalies (sliding or fixed base, or none for a series of anomalies) and their running mean."""
    if method == "sliding":
        df = sliding_base_anomaly(df, keys, window_years, step_years)
    elif method == "fixed":
        df = fixed_base_anomaly(df, keys, base)
    return running_mean(df, keys, width)


def zscore(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each series against its own mean and population deviation; null where it does not vary."""
    whole = Window.partitionBy(*keys)
    sd: Column = F.stddev_pop("value").over(whole)
    df = df.withColumns({"_m": F.avg("value").over(whole), "_s": sd})
    return df.withColumn("value", (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))).drop("_m", "_s")
