"""Superposed epochs: fields aligned on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events, seasons and anchors are small tables; beyond this many rows they are joined by shuffle instead.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint, given only after counting up to the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def anchor(kind: str = "december") -> Column:
    """The month ordinal that lag 0 falls on: December of the developing year, or the peak month."""
    return F.col("event_year") * 12 + 11 if kind == "december" else F.col("peak_t")


def epochs(df: DataFrame, anchors: DataFrame, lag_min: int, lag_max: int) -> DataFrame:
    """The rows of df within lag_min..lag_max months of each anchor; adds the anchors' columns and `lag`.

    anchors has anchor_t. It is unfolded to one row for each lag first, so the join is an equi-join on the month, where a
    range condition would have to compare every pair.
    """
    lags = anchors.withColumn("lag", F.explode(F.sequence(F.lit(lag_min), F.lit(lag_max)))).withColumn("t", F.col("anchor_t") + F.col("lag"))
    return df.join(small(lags), "t")


def gather(df: DataFrame, keys: list[str], anchors: DataFrame, lag_min: int, lag_max: int) -> DataFrame:
    """As epochs(), with a row for every key, anchor and lag; null outside the record."""
    lags = anchors.withColumn("lag", F.explode(F.sequence(F.lit(lag_min), F.lit(lag_max)))).withColumn("t", F.col("anchor_t") + F.col("lag"))
    grid = df.select(*keys).distinct().crossJoin(small(lags))
    return grid.join(df.select(*keys, "t", "value"), [*keys, "t"], "left")


def require_overlap(epoch: DataFrame) -> None:
    if not epoch.limit(1).count():
        raise ValueError("no event overlaps the record")


def composite(epoch: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over events for each key and lag, with the number of events that have a value."""
    return epoch.groupBy(*keys, "lag").agg(F.avg("value").alias("value"), F.count("value").alias("n_events"))


def class_composites(df: DataFrame, keys: list[str], events: DataFrame, lag_min: int, lag_max: int, by: str = "event_class") -> DataFrame:
    """(by, keys, lag): the composite of each class of events, with its events' number and mean absolute peak. events has `by`, event_year, anchor_t, peak.

    Events of all classes are aligned in one pass, so a field is read once however many classes there are; an event may be in several.
    """
    peaks = events.groupBy(by).agg(F.avg(F.abs("peak")).alias("mean_peak"), F.countDistinct("event_year").alias("n_class_events"))
    epoch = epochs(df, events.select(by, "event_year", "anchor_t"), lag_min, lag_max)
    out = epoch.groupBy(by, *keys, "lag").agg(F.avg("value").alias("value"), F.count("value").alias("n_events"))
    return out.join(small(peaks), by)


def season_means(epoch: DataFrame, keys: list[str], seasons: DataFrame, event: str = "event_year") -> DataFrame:
    """Mean over the available lags of each season, for each key and event. seasons has (season, lag)."""
    return epoch.join(small(seasons), "lag").groupBy(*keys, event, "season").agg(F.avg("value").alias("value"))


def eligible(candidates: DataFrame, exclude: DataFrame, buffer: int = 1, column: str = "anchor_t") -> DataFrame:
    """Candidates further than `buffer` from every excluded one; the buffer is unfolded, so this is an equi anti-join."""
    near = exclude.select(F.explode(F.sequence(F.col(column) - buffer, F.col(column) + buffer)).alias(column)).distinct()
    return candidates.join(near, column, "left_anti")


def anchor_pool(df: DataFrame, keys: list[str], candidates: DataFrame, lag_min: int, lag_max: int, seasons: DataFrame | None = None) -> DataFrame:
    """Every candidate's epoch: (anchor_t, keys, lag, value), or season means (anchor_t, keys, season, value).

    Reducing lags to seasons here, ahead of any resampling, makes what is resampled several times smaller.
    """
    pool = epochs(df, candidates.select("anchor_t"), lag_min, lag_max)
    if seasons is None:
        return pool.select("anchor_t", *keys, "lag", "value")
    return season_means(pool, keys, seasons, "anchor_t")


def envelope(index: DataFrame, anchors: DataFrame, lag_min: int, lag_max: int, by: str) -> DataFrame:
    """The index around events of each class: mean, least and largest for each lag."""
    return epochs(index, anchors, lag_min, lag_max).groupBy(by, "lag").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
