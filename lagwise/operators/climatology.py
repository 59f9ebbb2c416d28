"""Climatologies, anomalies and standardised indices of monthly fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lagwise.functions import numeric
from lagwise.functions.special import normal_quantile
from lagwise.model import by_month, in_time


def fixed_climatology(df: DataFrame, keys: list[str], base: tuple[int, int] | None = None) -> DataFrame:
    """(keys, month): mean and population deviation over the base years (all years without a base); nulls are skipped."""
    if base:
        df = df.where(F.col("year").between(*base))
    return df.groupBy(*keys, "month").agg(F.avg("value").alias("clim_mean"), F.stddev_pop("value").alias("clim_std"))


def moving_climatology(df: DataFrame, keys: list[str], window_years: int = 30, min_years: int = 20) -> DataFrame:
    """Add clim_mean, clim_std (sample deviation) and clim_n over the years [y - w/2, y - w/2 + w - 1] of the same month.

    Null where fewer than min_years of those years have a value. The frame goes by year, so gaps need no filling. One
    shuffle on (keys, month) serves all three.
    """
    half = window_years // 2
    frame = by_month(keys).orderBy("year").rangeBetween(-half, window_years - half - 1)
    n = F.count("value").over(frame)
    df = df.withColumns({"clim_n": n, "clim_mean": F.avg("value").over(frame), "clim_std": F.stddev_samp("value").over(frame)})
    enough = F.col("clim_n") >= min_years
    return df.withColumns({"clim_mean": F.when(enough, F.col("clim_mean")), "clim_std": F.when(enough, F.col("clim_std"))})


def require_record(df: DataFrame, min_years: int) -> None:
    """Refuse, at once, a record that is too short for any climatology window."""
    n = df.agg(F.countDistinct("year")).first()[0]
    if n < min_years:
        raise ValueError(f"the record has {n} years; at least {min_years} are needed")


def long_enough(df: DataFrame, min_years: int) -> DataFrame:
    """df; when it is run, a record of fewer than min_years years fails. The years come as one row to every task, in the same job."""
    years = df.agg(F.countDistinct("year").alias("_years"))
    short = F.raise_error(F.format_string("the record has %d years; at least %d are needed", "_years", F.lit(min_years))).cast("double")
    return df.crossJoin(F.broadcast(years)).withColumn("value", F.when(F.col("_years") >= min_years, F.col("value")).otherwise(short)).drop("_years")


def linear_detrend(df: DataFrame, keys: list[str]) -> DataFrame:
    """Take slope and intercept off each key's series; x counts rows in time order, null rows included."""
    df = df.withColumn("_x", (F.row_number().over(in_time(keys)) - 1).cast("double"))
    whole = Window.partitionBy(*keys)
    line = F.regr_intercept("value", "_x").over(whole) + F.regr_slope("value", "_x").over(whole) * F.col("_x")
    return df.withColumn("value", F.col("value") - line).drop("_x")


def anomalies(
    df: DataFrame, keys: list[str], method: str = "standardized", climatology: str = "moving", window_years: int = 30, min_years: int = 20,
    base: tuple[int, int] | None = None, detrend: bool = False, min_std_relative: float = 1e-6,
) -> DataFrame:
    """Replace value by its anomaly.

    climatology: moving, fixed or none (mean 0 and deviation 1). method: standardized (null where the deviation is at most
    min_std_relative of the population deviation of the whole series), absolute, or percent (null where the climatology
    is 0). detrend takes the line off the difference from the climatology, ahead of any scaling. Under a moving climatology,
    a record of fewer than min_years years fails the query.
    """
    if method not in ("standardized", "absolute", "percent") or climatology not in ("moving", "fixed", "none"):
        raise ValueError(f"unknown method or climatology: {method!r}, {climatology!r}")
    if climatology == "moving":
        out = moving_climatology(long_enough(df, min_years), keys, window_years, min_years)
    elif climatology == "fixed":
        inside = F.when(F.col("year").between(*base), F.col("value")) if base else F.col("value")
        out = df.withColumns({"clim_mean": F.avg(inside).over(by_month(keys)), "clim_std": F.stddev_pop(inside).over(by_month(keys))})
    else:
        out = df.withColumns({"clim_mean": F.lit(0.0), "clim_std": F.lit(1.0)})
    if method == "standardized":
        out = out.withColumn("_scale", F.stddev_pop("value").over(Window.partitionBy(*keys)))
    out = out.withColumn("value", F.col("value") - F.col("clim_mean"))
    if detrend:
        out = linear_detrend(out, keys)
    if method == "percent":
        out = out.withColumn("value", F.when(F.col("clim_mean") != 0, 100.0 * F.col("value") / F.when(F.col("clim_mean") != 0, F.col("clim_mean"))))
    elif method == "standardized":
        steady = (F.col("_scale") > 0) & (F.col("clim_std") > min_std_relative * F.col("_scale"))
        out = out.withColumn("value", F.when(steady, F.col("value") / F.when(steady, F.col("clim_std"))))
    return out.drop("clim_mean", "clim_std", "clim_n", "_scale")


def accumulate(df: DataFrame, keys: list[str], scale: int) -> DataFrame:
    """Trailing mean of `scale` rows in time order, null unless all have a value."""
    if scale <= 1:
        return df
    frame = in_time(keys).rowsBetween(-(scale - 1), 0)
    return df.withColumn("value", F.when(F.count("value").over(frame) == scale, F.avg("value").over(frame)))


def plotting_position(df: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Add p: Gringorten's position of each value among its month's values, ties at their mean rank; null under `least` values."""
    month = by_month(keys)
    n = F.count("value").over(month)
    rank = F.rank().over(month.orderBy(F.col("value").asc_nulls_last())) + (F.count("value").over(Window.partitionBy(*keys, "month", "value")) - 1) / 2
    return df.withColumn("p", F.when(F.col("value").isNotNull() & (n >= least), (rank - 0.44) / (n + 0.12)))


def empirical_index(df: DataFrame, keys: list[str], scale: int = 1, least: int = 10) -> DataFrame:
    """Standard normal scores of plotting positions."""
    out = plotting_position(accumulate(df, keys, scale), keys, least)
    return out.withColumn("value", normal_quantile("p")).drop("p")


@F.pandas_udf(DoubleType())
def _gamma_shares(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for value, mean, mean_log, zeros in batches:
        x, m, ml, q = (s.to_numpy(float) for s in (value, mean, mean_log, zeros))
        out = np.full(len(x), np.nan)
        ok = np.isfinite(x) & np.isfinite(m) & np.isfinite(ml)
        if ok.any():
            # The fit depends on the month's statistics alone: one for each distinct pair, however many rows share it.
            stats, back = np.unique(np.stack([m[ok], ml[ok]], 1), axis=0, return_inverse=True)
            shape = numeric.gamma_shape(stats[:, 0], stats[:, 1])[back.reshape(-1)]
            out[ok] = np.where(x[ok] > 0, q[ok] + (1 - q[ok]) * numeric.gamma_cdf(shape, np.maximum(x[ok], 0) * shape / m[ok]), q[ok])
        yield pd.Series(out)


def gamma_index(df: DataFrame, keys: list[str], scale: int = 1, least: int = 10, least_positive: int = 5) -> DataFrame:
    """Normal scores under a gamma distribution of the positive values of each month; zeros score at their own share.

    The sufficient statistics (mean and mean logarithm) come from window aggregates; Python only solves for the shape and
    the distribution function, the score is a column expression.
    Null under `least` values, under `least_positive` positive ones, or where all positive values are alike.
    """
    df = accumulate(df, keys, scale)
    month = by_month(keys)
    positive = F.when(F.col("value") > 0, F.col("value"))
    out = df.withColumns({
        "_n": F.count("value").over(month), "_k": F.count(positive).over(month), "_mean": F.avg(positive).over(month),
        "_log": F.avg(F.ln(positive)).over(month), "_lo": F.min(positive).over(month), "_hi": F.max(positive).over(month),
    })
    fits = (F.col("_n") >= least) & (F.col("_k") >= least_positive) & (F.col("_hi") - F.col("_lo") > 1e-8 + 1e-5 * F.abs("_lo"))
    zeros = 1 - F.col("_k") / F.when(F.col("_n") > 0, F.col("_n"))
    p = _gamma_shares("value", F.when(fits, F.col("_mean")), F.when(fits, F.col("_log")), zeros)
    out = out.withColumn("_p", p).withColumn("_p", F.when(F.col("_p").isNotNull() & ~F.isnan("_p"), F.greatest(F.least(F.col("_p"), F.lit(1 - 1e-6)), F.lit(1e-6))))
    return out.withColumn("value", normal_quantile("_p")).drop("_n", "_k", "_mean", "_log", "_lo", "_hi", "_p")


def standardized_index(df: DataFrame, keys: list[str], scale: int = 1, distribution: str = "gamma", least: int = 10) -> DataFrame:
    return {"gamma": gamma_index, "empirical": empirical_index}[distribution](df, keys, scale, least)


# Which standardised index belongs to which variable.
INDEX_OF = {"dis": "ssi", "qtot": "sri", "qr": "sgri", "groundwstor": "sgi", "rootmoist": "ssmi"}


def index_set(df: DataFrame, keys: list[str], scales: tuple[int, ...] = (1, 3, 12), distribution: str = "gamma", least: int = 10) -> DataFrame:
    """Every scale's index of each variable that has one, stacked: adds `index` and `scale`. df has a column `variable`."""
    name = F.create_map(*[F.lit(x) for pair in INDEX_OF.items() for x in pair])
    df = df.where(F.col("variable").isin(*INDEX_OF))
    parts = [standardized_index(df, ["variable", *keys], s, distribution, least).withColumn("scale", F.lit(s)) for s in scales]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("index", name[F.col("variable")])


def threshold_counts(df: DataFrame, keys: list[str], threshold: float, below: bool = True) -> DataFrame:
    """Months beyond a threshold for each key; null where there never was a value."""
    beyond: Column = F.col("value") < threshold if below else F.col("value") > threshold
    return df.groupBy(*keys).agg(F.when(F.count("value") > 0, F.count_if(beyond)).alias("n_months"))
