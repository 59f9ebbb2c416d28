"""Result tables that bring several operators together, a row for each variable or variable and season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.operators.epochs import anchor_pool, small
from lagwise.operators.inference import fdr_mask
from lagwise.operators.regions import weighted_mean
from lagwise.operators.response import ar1_memory, best_correlation, cross_correlation, duration_recovery, peak_lag


def yearly_responses(df: DataFrame, keys: list[str], seasons: DataFrame, index: DataFrame, lag_min: int, lag_max: int, lead: int = 2, tail: int = 3, step: int = 12, least: int = 20) -> DataFrame:
    """(keys, season, anchor_t, value, index): season means around every anchor of the record, with the index in the month after the anchor.

    Anchors are the Decembers from `lead` years after the first year to `tail` years before the last, or every `step` months between
    them; those without an index value are left out, and with fewer than `least` of them there are no rows. This is the sample that a
    response curve needs: events alone cannot say how a response bends. seasons has (season, lag).
    """
    span = df.agg((F.min("year") + lead).alias("y0"), (F.max("year") - tail).alias("y1")).where("y0 <= y1")
    every = span.select(F.explode(F.sequence((F.col("y0") * 12 + 11).cast("int"), (F.col("y1") * 12 + 11).cast("int"), F.lit(step))).alias("anchor_t"))
    known = every.join(small(index.where("value is not null").select((F.col("t") - 1).alias("anchor_t"), F.col("value").alias("index"))), "anchor_t")
    known = known.crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("_n")))).where(F.col("_n") >= least).drop("_n")
    return anchor_pool(df, keys, known, lag_min, lag_max, seasons).join(small(known), "anchor_t")


def nonlinearity_table(excess: DataFrame, hinge: DataFrame, keys: list[str], by: list[str], family: list[str], scale: float, alpha: float = 0.1) -> DataFrame:
    """(by): how far strong events exceed scaled ones, of bootstrap_difference() and hinge_fit() over keys and by.

    Each of `family` (columns of by) holds its own false discoveries. frac_significant and frac_hinge_significant are shares of all keys,
    those that could not be tested included; frac_amplified is the share of positive excess among the significant ones; medians and
    frac_steepening leave out what could not be fitted. Keys that only one of the two tables has keep their row (a full outer join).
    """
    both = fdr_mask(excess, alpha=alpha, by=family).join(
        hinge.select(*by, *keys, "ratio", "excess_frac", "steepening", F.col("p_value").alias("hinge_p")), [*by, *keys], "full"
    )
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return both.groupBy(*by).agg(
        F.lit(float(scale)).alias("scaling_factor"), F.avg("excess").alias("mean_excess"), F.avg(F.abs("excess")).alias("mean_abs_excess"), share(F.col("significant")).alias("frac_significant"),
        F.avg(F.when(F.col("significant"), (F.col("excess") > 0).cast("double"))).alias("frac_amplified"), F.avg(F.col("steepening").cast("double")).alias("frac_steepening"),
        F.percentile("excess_frac", 0.5).alias("median_excess_frac"), share(F.col("hinge_p") < alpha).alias("frac_hinge_significant"), F.percentile("ratio", 0.5).alias("median_ratio"),
    )


def lag_cascade_table(composite: DataFrame, anomaly: DataFrame, index: DataFrame, cells: DataFrame, lag_min: int = -6, lag_max: int = 24, threshold: float = 0.5) -> DataFrame:
    """(variable): when and how long each variable answers, earliest peak first by peak_lag.

    composite has (variable, cell_id, lag, value), anomaly (variable, cell_id, t, value), cells (cell_id, area). peak_lag and peak_amplitude
    are of the area mean of the composite; medians are over cells that have any value (recovery: to the first month within the threshold);
    best_lag and best_corr correlate the area mean of the anomalies with the index.
    """
    area, key = cells.select("cell_id", "area"), ["variable", "cell_id"]
    mean = lambda df, by: df.join(small(area), "cell_id").groupBy("variable", by).agg(weighted_mean().alias("value"))
    profile = peak_lag(mean(composite, "lag"), ["variable"]).select("variable", "peak_lag", F.col("peak_value").alias("peak_amplitude"))
    grid = peak_lag(composite, key).where("peak_lag is not null").join(duration_recovery(composite, key, threshold), key)
    grid = grid.groupBy("variable").agg(
        F.percentile("peak_lag", 0.5).alias("median_peak_lag"), F.percentile("duration_months", 0.5).alias("median_duration"), F.percentile("recovery_months_first", 0.5).alias("median_recovery"),
        F.percentile("recovery_months_first", 0.9).alias("p90_recovery"),
    )
    memory = ar1_memory(anomaly, key).groupBy("variable").agg(F.percentile("memory_months", 0.5).alias("median_memory"))
    best = best_correlation(cross_correlation(mean(anomaly, "t"), ["variable"], index, lag_min, lag_max), ["variable"])
    return profile.join(grid, "variable", "left").join(memory, "variable", "left").join(best, "variable", "left")


def response_profile(composite: DataFrame, mask: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, lag): the area mean of the size of the composite over the cells of a mask (cell_id, robust), and the number of cells.

    Wet and dry regions would cancel in a signed mean; sizes say how strongly the response region is moved, whichever way.
    """
    inside = composite.join(small(mask.where("robust").select("cell_id")), "cell_id").join(small(cells.select("cell_id", "area")), "cell_id")
    return inside.groupBy(*by, "lag").agg(weighted_mean(F.abs("value"), "area").alias("value"), F.count("value").alias("n_cells"))


def exceedance(responses: DataFrame, by: list[str], scale: float, strong: str = "super", reference: str = "reference") -> DataFrame:
    """(by): of amplification() over regions with both responses: the share whose strong one is above the scaled reference in size, and the number."""
    both = responses.where(F.col("amplification").isNotNull() & F.col(reference).isNotNull())
    return both.groupBy(*by).agg(F.avg((F.abs(strong) > scale * F.abs(reference)).cast("double")).alias("share_above"), F.count(F.lit(1)).alias("n_regions"))
