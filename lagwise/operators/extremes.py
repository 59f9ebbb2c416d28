"""Extremes around events: counts in windows, odds, yearly metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.operators.epochs import epochs, small
from lagwise.operators.inference import DRAWS, draw_matrix
from lagwise.operators.regions import weighted_mean


def window_counts(df: DataFrame, keys: list[str], anchors: DataFrame, low: int, high: int, drought: float = -1.0, flood: float = 1.0, event: str = "event_year") -> DataFrame:
    """(keys): means over events of the months below and above the thresholds and of the least and largest value in lags low..high.

    An event counts only if at least (high - low + 1) // 2 months of its window lie in the record (whatever their values);
    a missing value is beyond no threshold, so it counts as 0.
    """
    inside = epochs(df, anchors, low, high)
    months = inside.groupBy(event).agg(F.countDistinct("t").alias("_n")).where(F.col("_n") >= (high - low + 1) // 2)
    each = inside.join(small(months.select(event)), event).groupBy(*keys, event).agg(
        F.count_if(F.col("value") < drought).alias("dry"), F.count_if(F.col("value") > flood).alias("wet"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return each.groupBy(*keys).agg(F.avg("dry").alias("dry_months"), F.avg("wet").alias("wet_months"), F.avg("low").alias("least"), F.avg("high").alias("largest"), F.count(F.lit(1)).alias("n_events"))


def odds_ratio(p: DataFrame, q: DataFrame, keys: list[str], floor: float = 1e-4) -> DataFrame:
    """(keys): odds of the first sample's share over the second's; shares kept within floor..1 - floor, null where both are 0."""
    both = p.select(*keys, F.col("share").alias("p")).join(q.select(*keys, F.col("share").alias("q")), keys)
    inside = lambda c: F.least(F.greatest(F.col(c), F.lit(floor)), F.lit(1 - floor))
    ratio = (inside("p") / (1 - inside("p"))) / (inside("q") / (1 - inside("q")))
    return both.withColumn("odds_ratio", F.when((F.col("p") > 0) | (F.col("q") > 0), ratio))


def neutral_interval(
    df: DataFrame, keys: list[str], neutral: list[int], n: int, low: int, high: int, iterations: int, seed: int, drought: float = -1.0,
    weight: str = "area", floor: float = 1e-4, cells_a_block: int = 1024,
) -> DataFrame:
    """One row: the mean, and the 5th and 95th percentile, of the weighted mean share of dry months over draws of n neutral anchors.

    A draw's share in a cell is its mean number of dry months in lags low..high over the window's length, kept within floor..1 - floor;
    anchors with fewer than (high - low + 1) // 2 months in the record do not count. Each block of cells is one matrix of anchors x
    cells, and gives two sums for each draw, so cells x draws never become rows.
    """
    spark, length, neutral = df.sparkSession, high - low + 1, sorted(set(neutral))
    inside = epochs(df, spark.createDataFrame([(a,) for a in neutral], "anchor_t int"), low, high)
    months = inside.groupBy("anchor_t").agg(F.countDistinct("t").alias("_n")).where(F.col("_n") >= length // 2)
    each = inside.join(small(months.select("anchor_t")), "anchor_t").groupBy(*keys, "anchor_t").agg(F.count_if(F.col("value") < drought).cast("double").alias("_dry"), F.first(weight).cast("double").alias("_w"))
    draws, at = draw_matrix(neutral, n, iterations, seed), {a: k for k, a in enumerate(neutral)}

    def sums(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        cells, cell = np.unique(frame["_cell"].to_numpy(), return_inverse=True)
        row = np.array([at[a] for a in frame["anchor_t"]])
        dry, there, w = np.zeros((len(neutral), len(cells))), np.zeros((len(neutral), len(cells))), np.zeros(len(cells))
        dry[row, cell], there[row, cell], w[cell] = frame["_dry"], 1, np.nan_to_num(frame["_w"].to_numpy(float))
        parts, weights = [], []
        for i in range(0, iterations, DRAWS):
            d = draws[i : i + DRAWS]
            count = d @ there
            share = np.divide(d @ dry, count, out=np.zeros(count.shape), where=count > 0) / length
            parts.append((np.clip(share, floor, 1 - floor) * (count > 0)) @ w)
            weights.append((count > 0) @ w)
        return pa.table({"iteration": pa.array(range(iterations), pa.int32()), "s": np.concatenate(parts), "w": np.concatenate(weights)})

    blocks = df.select(*keys).distinct().count() // cells_a_block + 1
    dealt = each.withColumn("_cell", F.xxhash64(*keys)).withColumn("_block", F.pmod(F.col("_cell"), F.lit(blocks)))
    drawn = dealt.groupBy("_block").applyInArrow(lambda t: sums(t), "iteration int, s double, w double").groupBy("iteration").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("share"))
    return drawn.agg(F.avg("share").alias("mean"), F.percentile("share", 0.05).alias("ci_low"), F.percentile("share", 0.95).alias("ci_high"))


def extremes_table(events: DataFrame, neutral: DataFrame, keys: list[str], cells: DataFrame, length: int, weight: str = "area", floor: float = 1e-4) -> DataFrame:
    """One row over all cells: the weighted means of dry and wet months of event and neutral windows (both from window_counts), the share of
    dry months, the median odds ratio and the share of cells where any window is dry, and the area with over a month more than neutral."""
    both = events.alias("e").join(neutral.alias("n"), keys).join(cells.select(*keys, F.col(weight).alias("_w")), keys)
    share = lambda side: F.least(F.greatest(F.col(f"{side}.dry_months") / length, F.lit(floor)), F.lit(1 - floor))
    occurs = (F.col("e.dry_months") > 0) | (F.col("n.dry_months") > 0)
    odds = F.when(occurs, (share("e") / (1 - share("e"))) / (share("n") / (1 - share("n"))))
    mean = lambda c: weighted_mean(F.col(c), F.col("_w"))
    return both.agg(
        F.max("e.n_events").alias("n_events"), mean("e.dry_months").alias("dry_event"), mean("n.dry_months").alias("dry_neutral"), mean("e.wet_months").alias("wet_event"), mean("n.wet_months").alias("wet_neutral"),
        weighted_mean(share("e"), F.col("_w")).alias("dry_share"), F.percentile(odds, 0.5).alias("median_odds_ratio"), F.avg(occurs.cast("double")).alias("frac_cells_dry"),
        F.sum(F.when(F.col("e.dry_months") > F.col("n.dry_months") + 1, F.col("_w")).otherwise(0.0)).alias("area_drier"),
    )


def extra_months(strong: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys): dry and wet months of the strong events beyond those of the reference."""
    a, b = strong.alias("a"), reference.alias("b")
    return a.join(b, keys).select(*keys, (F.col("a.dry_months") - F.col("b.dry_months")).alias("extra_dry"), (F.col("a.wet_months") - F.col("b.wet_months")).alias("extra_wet"))


def yearly_months(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys, year): months above the threshold; a year without values counts 0."""
    return df.groupBy(*keys, "year").agg(F.count_if(F.col("value") > threshold).cast("double").alias("value"))


def event_year_change(yearly: DataFrame, keys: list[str], years: DataFrame) -> DataFrame:
    """(keys): mean over the event years minus the mean over all years."""
    flagged = yearly.join(small(years.select(F.col("event_year").alias("year"), F.lit(True).alias("_e")).distinct()), "year", "left")
    return flagged.groupBy(*keys).agg((F.avg(F.when(F.col("_e"), F.col("value"))) - F.avg("value")).alias("change"))


def change_summary(change: DataFrame, cells: DataFrame, by: list[str] | None = None, weight: str = "area") -> DataFrame:
    """(by): of event_year_change(): the weighted mean change, the least one, and the share of cells where it is below 0."""
    df = change.join(cells.select("cell_id", F.col(weight).alias("_w")), "cell_id")
    below = (F.col("change") < 0).cast("double")
    return df.groupBy(*(by or [])).agg(weighted_mean("change", "_w").alias("mean_change"), F.min("change").alias("least_change"), F.avg(F.coalesce(below, F.lit(0.0))).alias("frac_less"))
