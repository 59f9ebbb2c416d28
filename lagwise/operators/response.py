"""Responses: nonlinearity, fits, variance partition, lags, memory and cross-correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.model import in_time
from lagwise.operators.epochs import small
from lagwise.operators.inference import DRAWS, in_blocks, pick


def excess_over_scaled(strong: DataFrame, reference: DataFrame, keys: list[str], strong_amplitude: float | Column, reference_amplitude: float | Column) -> DataFrame:
    """(keys): expected = reference scaled by the ratio of amplitudes, and excess = strong - expected."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    ratio = as_col(strong_amplitude) / F.when(as_col(reference_amplitude) != 0, as_col(reference_amplitude))
    both = strong.select(*keys, F.col("value").alias("strong")).join(reference.select(*keys, F.col("value").alias("reference")), keys)
    both = both.withColumn("expected", ratio * F.col("reference"))
    return both.withColumn("excess", F.col("strong") - F.col("expected"))


def quadratic_fit(df: DataFrame, keys: list[str], y: str = "value", x: str = "index", least: int = 10) -> DataFrame:
    """(keys): b0, b1, b2 and r2 of y = b0 + b1 x + b2 x^2, where more than `least` rows have both; else null.

    One aggregation of moments of the centred x, then Cramer's rule in column expressions; nothing leaves the JVM.
    """
    df = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(y).alias("y"), F.col(x).alias("x"))
    whole = Window.partitionBy(*keys)
    df = df.withColumns({"mx": F.avg("x").over(whole), "my": F.avg("y").over(whole)}).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    u, v = F.col("u"), F.col("v")
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.avg(u * u).alias("s2"), F.avg(u * u * u).alias("s3"),
        F.avg(u * u * u * u).alias("s4"), F.avg(u * v).alias("c1"), F.avg(u * u * v).alias("c2"), F.avg(v * v).alias("vv"),
    )
    # With centred x and y: [s2, s3; s3, s4 - s2^2] [q1, q2] = [c1, c2], and the constant is -q2 * s2.
    det = F.expr("s2 * (s4 - s2 * s2) - s3 * s3")
    good = (F.col("n") > least) & (det > 1e-12 * F.expr("s2 * s2 * s2"))
    m = m.withColumn("det", F.when(good, det))
    m = m.withColumns({"q1": F.expr("(c1 * (s4 - s2 * s2) - c2 * s3) / det"), "q2": F.expr("(c2 * s2 - c1 * s3) / det")})
    return m.select(
        *keys, "n", F.expr("my - q2 * s2 - q1 * mx + q2 * mx * mx").alias("b0"), F.expr("q1 - 2 * q2 * mx").alias("b1"), F.col("q2").alias("b2"),
        F.when(F.col("vv") > 0, F.expr("q1 * c1 + q2 * c2") / F.when(F.col("vv") > 0, F.col("vv"))).alias("r2"),
    )


def _hinge_design(x: np.ndarray, knot: float) -> np.ndarray:
    return np.stack([np.ones(len(x)), x, np.maximum(x - knot, 0), np.minimum(x + knot, 0)], 1)


def _solved(design: np.ndarray) -> np.ndarray:
    """What turns values into least-squares coefficients (terms x items); NaN where the items do not determine them."""
    if len(design) < design.shape[1] or np.linalg.matrix_rank(design) < design.shape[1]:
        return np.full(design.T.shape, np.nan)
    return np.linalg.pinv(design)


def hinge_fit(
    df: DataFrame, keys: list[str], item: str = "anchor_t", y: str = "value", x: str = "index", knot: float = 1.5, iterations: int = 200, seed: int = 1,
    evaluate_at: float = 2.3, coverage: float = 0.5, min_rows: int = 20, cells_a_block: int = 1024,
) -> DataFrame:
    """(keys): least-squares fit of 1, x, max(x - k, 0), min(x + k, 0), with a bootstrap over items.

    ratio = warm / slope where |slope| > 1e-6; excess is the warm hinge's part at evaluate_at (0 below the knot), excess_frac that part
    as a share of the linear one, where that is above 1e-6 in size; steepening: slope and warm hinge have one sign. Items covered by
    fewer than `coverage` of the best covered one's cells are dropped; x belongs to the item. Cells that have every item are fitted
    whatever their number of items, others with max(min_rows, 24) items; coefficients that the items do not determine are null.

    p_value = 2 (1 - share of draws whose hinge has the fit's sign), at most 1. Draws resample all items; those with fewer than 3 items
    above the knot or 3 below its negative are skipped. Cells that lack an item are fitted but not resampled: their p_value is 1.

    A draw's hinge is linear in a cell's values: its coefficients are one row over the items, worked out once for all cells. So all
    draws are one matrix (draws x items; items are years or months, thousands at most), and a block of cells takes one product with it.
    """
    df = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(item).alias("_item"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    cover = df.groupBy("_item").agg(F.count(F.lit(1)).alias("c"), F.max("_x").alias("x")).collect()  # one row for each year or month
    most = max((r["c"] for r in cover), default=0)
    chosen = sorted((r["_item"], r["x"]) for r in cover if r["c"] >= coverage * most)
    at, xs = {k: i for i, (k, _) in enumerate(chosen)}, np.array([v for _, v in chosen])
    design = _hinge_design(xs, knot)
    whole, rows = _solved(design), []
    for i in range(iterations if len(xs) else 0):
        p = np.array([pick(seed, i, s, len(xs)) for s in range(len(xs))])
        if (xs[p] > knot).sum() >= 3 and (xs[p] < -knot).sum() >= 3:
            rows.append(np.bincount(p, _solved(design[p])[2], len(xs)))
    drawn = np.array(rows).reshape(len(rows), len(xs))
    least = max(min_rows, 6 * design.shape[1])

    def fit(frame: pd.DataFrame, cell: np.ndarray, n: int) -> dict[str, np.ndarray]:
        row = np.array([at.get(k, -1) for k in frame["_item"]], int)
        ys = np.full((len(xs), n), np.nan)
        ys[row[row >= 0], cell[row >= 0]] = frame["_y"].to_numpy()[row >= 0]
        there = np.isfinite(ys)
        full = there.all(0)
        beta = np.full((4, n), np.nan)
        beta[:, full] = whole @ ys[:, full]
        # Cells that lack the same items share a design.
        ragged = np.flatnonzero(~full & (there.sum(0) >= least))
        for pattern in np.unique(there[:, ragged], axis=1).T if len(ragged) else []:
            own = ragged[(there[:, ragged] == pattern[:, None]).all(0)]
            beta[:, own] = _solved(design[pattern]) @ ys[np.ix_(pattern, own)]
        same = np.zeros(n)
        for i in range(0, len(drawn), DRAWS):
            same[full] += (np.sign(drawn[i : i + DRAWS] @ ys[:, full]) == np.sign(beta[2, full])).sum(0)
        b0, slope, warm, cold = beta
        over = lambda a, b: np.divide(a, b, out=np.full(n, np.nan), where=np.abs(b) > 1e-6)
        excess = warm * max(evaluate_at - knot, 0)
        p = np.where(np.isfinite(warm), np.clip(2 * (1 - same / max(len(drawn), 1)), 0, 1), np.nan)
        steep = np.where(np.isfinite(warm), (np.sign(slope) == np.sign(warm)).astype(float), np.nan)
        return {
            "b0": b0, "slope": slope, "warm": warm, "cold": cold, "ratio": over(warm, slope), "excess": excess, "excess_frac": over(excess, slope * evaluate_at), "p_value": p, "steepening": steep,
            "n": there.sum(0), "n_draws": np.full(n, len(drawn)),
        }

    kinds = {f: "double" for f in ("b0", "slope", "warm", "cold", "ratio", "excess", "excess_frac", "p_value", "steepening")} | {"n": "long", "n_draws": "long"}
    return in_blocks(df, keys, cells_a_block, fit, kinds).withColumn("steepening", F.col("steepening") == 1)


def collinearity(df: DataFrame, x: str = "index", knot: float = 1.5) -> DataFrame:
    """One row: the correlation of x with its hinge beyond the knot, the largest of any two of x and both hinges, and the rows beyond either knot."""
    warm, cold = F.greatest(F.col(x) - knot, F.lit(0.0)), F.least(F.col(x) + knot, F.lit(0.0))
    most = F.greatest(F.abs(F.corr(F.col(x), warm)), F.abs(F.corr(F.col(x), cold)), F.abs(F.corr(warm, cold)))
    return df.agg(
        F.corr(F.col(x), warm).alias("corr_hinge"), most.alias("max_collinearity"), F.count_if(F.col(x) > knot).alias("n_beyond"), F.count_if(F.col(x) < -knot).alias("n_below"), F.count(x).alias("n")
    )


def variance_partition(df: DataFrame, keys: list[str], member: str = "model", event: str = "event_year") -> DataFrame:
    """(keys): shares of the variance due to members, events and the rest.

    The sums of squares use the full numbers of members and events of all of df, as of a dense array, even where a key
    lacks some; the residual is at least 0; shares are null where the total is not above 0.
    """
    sizes = df.agg(F.countDistinct(member).alias("n_m"), F.countDistinct(event).alias("n_e"))
    cell = Window.partitionBy(*keys)
    df = df.withColumns({"g": F.avg("value").over(cell), "m": F.avg("value").over(Window.partitionBy(*keys, member)), "e": F.avg("value").over(Window.partitionBy(*keys, event))})
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    by_m = df.groupBy(*keys, member).agg(F.first(sq("m", "g")).alias("d")).groupBy(*keys).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("sm"))
    by_e = df.groupBy(*keys, event).agg(F.first(sq("e", "g")).alias("d")).groupBy(*keys).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("se"))
    total = df.groupBy(*keys).agg(F.coalesce(F.sum(sq("value", "g")), F.lit(0.0)).alias("ss_total"))
    out = total.join(by_m, keys).join(by_e, keys).crossJoin(F.broadcast(sizes))
    out = out.withColumns({"ss_model": F.col("n_e") * F.col("sm"), "ss_event": F.col("n_m") * F.col("se")})
    out = out.withColumn("ss_rest", F.greatest(F.col("ss_total") - F.col("ss_model") - F.col("ss_event"), F.lit(0.0)))
    share = lambda c: F.when(F.col("ss_total") > 0, F.col(c) / F.when(F.col("ss_total") > 0, F.col("ss_total")))
    return out.select(*keys, share("ss_model").alias("frac_model"), share("ss_event").alias("frac_event"), share("ss_rest").alias("frac_rest"))


def leave_one_out(df: DataFrame, by: str, cell: list[str], weight: Column, flag: float = 0.5) -> DataFrame:
    """(left_out): the weighted mean over cells of each cell's mean without one value of `by`, and its relative change.

    A cell's mean without an item is (total - the item's part) / (count - its count), so no item is joined with all others.
    """
    parts = df.groupBy(*cell, by).agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.first(weight).alias("w"))
    whole = parts.groupBy(*cell).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.first("w").alias("tw"))
    items = parts.select(F.col(by).alias("left_out")).distinct()
    grid = whole.crossJoin(small(items))  # items are the members or events of an ensemble
    own = parts.select(*cell, F.col(by).alias("left_out"), "s", "n")
    rest = grid.join(own, [*cell, "left_out"], "left").withColumn("k", F.col("tn") - F.coalesce("n", F.lit(0)))
    rest = rest.withColumn("v", (F.coalesce("ts", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))) / F.when(F.col("k") > 0, F.col("k")))
    mean = lambda v, w: F.sum(F.col(v) * F.col(w)) / F.sum(F.when(F.col(v).isNotNull(), F.col(w)))
    without = rest.groupBy("left_out").agg(mean("v", "tw").alias("mean"))
    full = whole.withColumn("v", F.col("ts") / F.when(F.col("tn") > 0, F.col("tn"))).agg(mean("v", "tw").alias("full_mean"))
    out = without.crossJoin(F.broadcast(full)).withColumn("change", (F.col("mean") - F.col("full_mean")) / F.when(F.col("full_mean") != 0, F.abs("full_mean")))
    return out.withColumn("flagged", F.coalesce(F.abs("change") > flag, F.lit(False)))


def peak_lag(composite: DataFrame, keys: list[str]) -> DataFrame:
    """(keys): the first lag of the largest absolute value, and that value; null where there is none."""
    order = F.when(F.col("value").isNotNull(), F.struct(F.abs("value"), -F.col("lag")))
    return composite.groupBy(*keys).agg(F.max_by("lag", order).alias("peak_lag"), F.max_by("value", order).alias("peak_value"))


def duration_recovery(composite: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys): months beyond the threshold; months from 0 to the first, and to the last, lag >= 0 beyond it (counted from 1; 0 if none);
    and the length of the run of such months around the peak."""
    strong = F.abs("value") > threshold
    after = F.when(strong & (F.col("lag") >= 0), F.col("lag"))
    out = composite.groupBy(*keys).agg(
        F.count_if(strong).alias("duration_months"), F.coalesce(F.min(after) + 1, F.lit(0)).alias("recovery_months_first"), F.coalesce(F.max(after) + 1, F.lit(0)).alias("recovery_months_last")
    )
    order = Window.partitionBy(*keys).orderBy("lag")
    flagged = composite.withColumn("_s", F.coalesce(strong, F.lit(False)))
    flagged = flagged.withColumn("_run", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("lag"))).where("_s")
    size = flagged.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.abs("value").alias("a"), (-F.col("lag")).alias("l"))).alias("top"))
    best = size.groupBy(*keys).agg(F.max_by("n", "top").alias("consecutive_months"))
    return out.join(best, keys, "left").withColumn("consecutive_months", F.coalesce("consecutive_months", F.lit(0)))


def ar1_memory(df: DataFrame, keys: list[str], limit: float = 0.99) -> DataFrame:
    """(keys): lag-one autocorrelation mean(x x-1) / mean(x^2), kept within +-limit, and the memory -1 / ln(r1) where r1 > 0."""
    df = df.withColumn("_p", F.col("value") * F.lag("value").over(in_time(keys)))
    r = df.groupBy(*keys).agg(F.avg("_p").alias("p"), F.avg(F.col("value") * F.col("value")).alias("q"))
    r = r.withColumn("r1", F.greatest(F.least(F.col("p") / F.when(F.col("q") > 0, F.col("q")), F.lit(limit)), F.lit(-limit)))
    return r.select(*keys, "r1", F.when(F.col("r1") > 0, -1 / F.ln(F.when(F.col("r1") > 0, F.col("r1")))).alias("memory_months"))


def cross_correlation(df: DataFrame, keys: list[str], index: DataFrame, lag_min: int = -6, lag_max: int = 24) -> DataFrame:
    """(keys, lag): correlation of a series with the index `lag` rows earlier, over the months that both have, and their number.

    Months are taken as they follow each other among the joined rows, so the shift is by row. Every lag is a column over one window, so
    a key is sorted once; one aggregation takes the moments of all of them, and its row is unfolded to one for each lag with pairs.
    """
    both = df.where("value is not null").select(*keys, "t", "value").join(small(index.where("value is not null").select("t", F.col("value").alias("_x"))), "t")
    lags = range(lag_min, lag_max + 1)
    shifted = both.withColumns({f"_x{k}": F.lag("_x", lag).over(in_time(keys)) for k, lag in enumerate(lags)})
    each = [F.struct(F.lit(lag).alias("lag"), F.corr("value", f"_x{k}").alias("corr"), F.count(f"_x{k}").alias("n")) for k, lag in enumerate(lags)]
    found = shifted.groupBy(*keys).agg(F.array(*each).alias("_each")).select(*keys, F.explode("_each").alias("_e")).select(*keys, "_e.*")
    return found.where("n > 0")


def lag_summary(peaks: DataFrame, by: list[str]) -> DataFrame:
    """(by): median, 90th percentile and mean of cells' peak lags."""
    return peaks.groupBy(*by).agg(F.percentile("peak_lag", 0.5).alias("median_lag"), F.percentile("peak_lag", 0.9).alias("p90_lag"), F.avg("peak_lag").alias("mean_lag"), F.count("peak_lag").alias("n_cells"))


def best_correlation(xcorr: DataFrame, keys: list[str]) -> DataFrame:
    """(keys): the first lag of the largest absolute correlation."""
    order = F.when(F.col("corr").isNotNull(), F.struct(F.abs("corr"), -F.col("lag")))
    return xcorr.groupBy(*keys).agg(F.max_by("lag", order).alias("best_lag"), F.max_by("corr", order).alias("best_corr"))


def nonlinearity_summary(df: DataFrame, by: list[str], weight: str = "area", alpha: float = 0.1) -> DataFrame:
    """(by): of excess and p_value over cells: weighted means, weighted share that is significant, and medians."""
    w = F.when(F.col("excess").isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(
        (F.sum(F.col("excess") * w) / F.sum(w)).alias("mean_excess"), (F.sum(F.abs("excess") * w) / F.sum(w)).alias("mean_abs_excess"),
        (F.sum(F.when(F.col("p_value") < alpha, w).otherwise(w * 0)) / F.sum(w)).alias("area_frac_significant"), F.percentile("excess", 0.5).alias("median_excess"),
    )
