"""Fields and events from streams: an extension, for records that still grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_field(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, sum and mean of value for each key and tumbling window; rows later than `late` behind the newest are dropped.

    Windows come out complete, once the watermark passes them, so the result can be appended to a field. time may be a
    timestamp without time zone; watermarks need one with, so it is cast.
    """
    df = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = df.groupBy(F.window("_time", width), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("value"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total", "value")


def running_events(stream: DataFrame, time: str, keys: list[str], flag: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of flagged rows: first and last time and number of rows of each run whose rows lie no further than `gap` apart."""
    df = stream.where(flag).withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = df.groupBy(F.session_window("_time", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
