"""Events of an index series: runs beyond a threshold, their peaks, classes, flavours and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.calendar import CLASSES, amplitude_class
from lagwise.model import first_of_month, in_time, month_of


def runs(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """The rows of each key where flag holds, with `run`: rows that follow one another share it.

    Rows without a value are dropped first and runs go by row, so a gap in time does not end a run. Gaps and islands: the
    row number among all rows less the one among flagged rows is constant within a run.
    """
    df = df.where("value is not null").withColumn("_flag", F.coalesce(flag, F.lit(False)))
    island = F.row_number().over(in_time(keys)) - F.row_number().over(Window.partitionBy(*keys, "_flag").orderBy("t"))
    return df.withColumn("run", island).where("_flag").drop("_flag")


def detect(df: DataFrame, keys: list[str], threshold: float = 0.5, min_length: int = 5, phase: str = "warm", classes: dict = CLASSES, presatellite_before: int = 1950) -> DataFrame:
    """One row for each event: a run of at least min_length rows at or beyond the threshold (warm: above, cold: below minus it).

    The peak is the first largest (smallest) value. Its developing year is the year of the peak, or the one before if the
    peak falls in January to July. Of the events of one developing year the one with the largest absolute peak stays, the
    earliest of equal ones. `djf` is the index in the January after.
    """
    warm = phase == "warm"
    flag = F.col("value") >= threshold if warm else F.col("value") <= -threshold
    order = F.struct(F.col("value") if warm else -F.col("value"), -F.col("t"))
    found = runs(df, keys, flag).groupBy(*keys, "run").agg(
        F.min("t").alias("onset_t"), F.max("t").alias("end_t"), F.count(F.lit(1)).alias("length"), F.max_by("t", order).alias("peak_t"), F.max_by("value", order).alias("peak"), F.sum("value").alias("total")
    )
    peak = month_of("peak_t")
    found = found.where(F.col("length") >= min_length).withColumn("event_year", F.when(peak["month"] >= 8, peak["year"]).otherwise(peak["year"] - 1))
    best = Window.partitionBy(*keys, "event_year").orderBy(F.abs("peak").desc(), F.col("onset_t"))
    found = found.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best", "run")
    january = df.where(F.pmod(F.col("t"), F.lit(12)) == 0).select(*keys, (F.floor(F.col("t") / 12) - 1).cast("int").alias("event_year"), F.col("value").alias("djf"))
    found = found.join(january, [*keys, "event_year"], "left")
    label = F.concat(F.col("event_year").cast("string"), F.lit("/"), F.lpad(F.pmod(F.col("event_year") + 1, F.lit(100)).cast("string"), 2, "0"))
    return found.withColumns({
        "phase": F.lit(phase), "label": label, "amplitude": amplitude_class("peak", classes), "presatellite": F.col("event_year") < presatellite_before,
    })


def catalogue(df: DataFrame, keys: list[str], **options: object) -> DataFrame:
    """Warm and cold events together, with dates."""
    both = detect(df, keys, phase="warm", **options).unionByName(detect(df, keys, phase="cold", **options))
    date = lambda c: first_of_month(*month_of(c).values())
    return both.withColumns({"onset": date("onset_t"), "peak_date": date("peak_t"), "end": date("end_t")})


def flavour(events: DataFrame, transformed: DataFrame) -> DataFrame:
    """Add flavour EP, CP or unknown, by the larger absolute mean of nct and nwp from December to February of each event."""
    winter = events.select("event_year", F.explode(F.sequence(F.col("event_year") * 12 + 11, F.col("event_year") * 12 + 13)).alias("t")).distinct()
    means = winter.join(transformed, "t").groupBy("event_year").agg(F.avg("nct").alias("nct"), F.avg("nwp").alias("nwp"))
    kind = F.when(F.col("nct").isNull() | F.col("nwp").isNull(), "unknown").when(F.abs("nct") >= F.abs("nwp"), "EP").otherwise("CP")
    return events.join(means, "event_year", "left").withColumn("flavour", kind)


def sample_flags(events: DataFrame, start: int, end: int, spin_up: int = 10, use_presatellite: bool = True) -> DataFrame:
    """Add in_period (the years start + spin_up .. end - 2) and in_sample (of those, not presatellite unless these are used)."""
    inside = (F.col("event_year") >= start + spin_up) & (F.col("event_year") + 2 <= end)
    return events.withColumns({"in_period": inside, "in_sample": inside & (F.lit(use_presatellite) | ~F.col("presatellite"))})


def select_class(events: DataFrame, kind: str, sample_only: bool = True) -> DataFrame:
    """Events of a class: an amplitude, `reference` (moderate or strong), all_warm, all_cold, or cold_<amplitude>."""
    warm, size = F.col("phase") == "warm", F.col("amplitude")
    if kind == "all_warm":
        chosen = warm
    elif kind == "all_cold":
        chosen = ~warm
    elif kind.startswith("cold_"):
        chosen = ~warm & (size == kind.removeprefix("cold_"))
    elif kind in ("reference", "moderate_strong"):
        chosen = warm & size.isin("moderate", "strong")
    else:
        chosen = warm & (size == kind)
    return events.where(chosen & F.col("in_sample") if sample_only else chosen)


def summary(events: DataFrame) -> DataFrame:
    """(phase, amplitude): number of events and their years in order."""
    return events.groupBy("phase", "amplitude").agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_list("event_year")).alias("years"))
