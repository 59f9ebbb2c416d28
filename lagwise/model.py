"""The data model: long frames of monthly values, and the month ordinal that makes lags plain subtraction.

A field has key columns (such as cell_id, model, scenario), `year`, `month`, the month ordinal `t = year * 12 + month - 1`,
and `value`. Missing values are null, never NaN: `clean` turns NaN into null once, on the way in, and the aggregates skip
nulls from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def clean(value: Column | str) -> Column:
    """The value as a double, null for NaN."""
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def with_month(df: DataFrame, time: str) -> DataFrame:
    """Add year, month and t from a date or timestamp column; any day of a month counts as that month."""
    year, month = F.year(time), F.month(time)
    return df.withColumns({"year": year, "month": month, "t": year * 12 + month - 1})


def month_of(t: Column | str) -> dict[str, Column]:
    """year and month of a month ordinal."""
    t = F.col(t) if isinstance(t, str) else t
    return {"year": F.floor(t / 12).cast("int"), "month": (F.pmod(t, F.lit(12)) + 1).cast("int")}


def first_of_month(year: Column | str = "year", month: Column | str = "month") -> Column:
    return F.make_date(F.col(year) if isinstance(year, str) else year, F.col(month) if isinstance(month, str) else month, F.lit(1))


def by_month(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "month")


def in_time(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t")


def complete(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fill each key's missing months, between the first and last month of all, with null values.

    Frames that count rows (running means, lags) need this; frames over years do not. The calendar is one row, sent to
    every task; each key unfolds its own months, so nothing but the keys is shuffled.
    """
    span = df.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    every = df.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.sequence("t0", "t1")).alias("t"))
    rest = [c for c in df.columns if c not in (*keys, "t", "year", "month")]
    return every.join(df.select(*keys, "t", *rest), [*keys, "t"], "left").withColumns(month_of("t"))


def pinned(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table of at most `rows` rows, worked out once and held by the driver; a larger one is returned as it is.

    For index series and event lists, which have a row for each month or event of a record whatever the number of cells:
    every use would otherwise work them out again from the field.
    """
    found = df.limit(rows + 1).collect()
    return df.sparkSession.createDataFrame(found, df.schema) if len(found) <= rows else df
