"""Evaluation of fields against station series and gridded observations, and tables of contrasts between scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.operators.regions import weighted_mean


def good_stations(df: DataFrame, station: str = "station", least: int = 480, most_missing: float = 0.10) -> DataFrame:
    """Rows of stations with at least `least` values and at most that share of rows missing."""
    n = F.count("value")
    good = df.groupBy(station).agg(n.alias("n"), F.count(F.lit(1)).alias("rows")).where((F.col("n") >= least) & (1 - F.col("n") / F.col("rows") <= most_missing))
    return df.join(good.select(station), station, "left_semi")


def composite_agreement(observed: DataFrame, simulated: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """(keys): of two composites by lag: correlation over joint lags (null under `least`), both largest absolute values, and whether these have one sign."""
    both = observed.select(*keys, "lag", F.col("value").alias("_o")).join(simulated.select(*keys, "lag", F.col("value").alias("_s")), [*keys, "lag"])
    both = both.where("_o is not null and _s is not null")
    top = lambda c: F.max_by(c, F.struct(F.abs(c), -F.col("lag")))
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lags"), F.corr("_o", "_s").alias("r"), top("_o").alias("peak_observed"), top("_s").alias("peak_simulated"))
    return out.withColumns({"r": F.when(F.col("n_lags") >= least, F.col("r")), "same_sign": F.signum("peak_observed") == F.signum("peak_simulated")})


def bilinear(points: DataFrame, grid: DataFrame, point: str, step: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(point, value): grid values (lat, lon, value) interpolated between the four nodes around each point.

    Nodes are numbered by their place on the grid, so each point meets its four nodes by an equi-join. Null unless all
    four have a value (nodes of weight 0 aside), as linear interpolation gives.
    """
    place = lambda c, o: (F.col(c) - o) / step
    p = points.withColumns({"_y": place("lat", origin[0]), "_x": place("lon", origin[1])})
    p = p.withColumns({"_i": F.floor("_y").cast("int"), "_j": F.floor("_x").cast("int")}).withColumns({"_v": F.col("_y") - F.col("_i"), "_u": F.col("_x") - F.col("_j")})
    corner = F.explode(F.array(*[F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((F.col("_v") if a else 1 - F.col("_v")) * (F.col("_u") if b else 1 - F.col("_u"))).alias("w")) for a in (0, 1) for b in (0, 1)])).alias("c")
    p = p.select(point, corner).select(point, "c.i", "c.j", "c.w").where("w > 0")
    g = grid.select(F.round(place("lat", origin[0])).cast("int").alias("i"), F.round(place("lon", origin[1])).cast("int").alias("j"), "value")
    each = p.join(g, ["i", "j"], "left").groupBy(point).agg(F.sum(F.col("value") * F.col("w")).alias("value"), F.count_if(F.col("value").isNull()).alias("_lacking"))
    return each.select(point, F.when(F.col("_lacking") == 0, F.col("value")).alias("value"))


def pattern_comparison(observed: DataFrame, simulated: DataFrame, on: list[str], by: list[str], least: int = 100) -> DataFrame:
    """(by): of two fields over joint cells: pattern correlation, ratio of population deviations, share of cells with one sign."""
    both = observed.select(*by, *on, F.col("value").alias("_o")).join(simulated.select(*by, *on, F.col("value").alias("_s")), [*by, *on]).where("_o is not null and _s is not null")
    sd = F.stddev_pop("_o")
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_o", "_s").alias("r"), (F.stddev_pop("_s") / F.when(sd > 0, sd)).alias("std_ratio"), F.avg((F.signum("_o") == F.signum("_s")).cast("double")).alias("sign_agreement"))
    return out.where(F.col("n") >= least)


def station_table(agreement: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by), of composite_agreement(): number of stations, median correlation over lags, and the share whose largest values have one sign."""
    same = F.coalesce(F.col("same_sign"), F.lit(False)).cast("double")
    return agreement.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_stations"), F.percentile("r", 0.5).alias("median_r"), F.avg(same).alias("frac_same_sign"))


def contrast_table(contrast: DataFrame, response: DataFrame, cells: DataFrame, by: list[str] | None = None, weight: str = "area") -> DataFrame:
    """(by), of paired_difference() with a column `significant`: weighted mean and mean absolute difference, the latter over the mean size of the
    response (its plain mean over cells; null where that is 0), and the share of cells that are significant. response has (by, cell_id, value)."""
    by = by or []
    df = contrast.join(cells.select("cell_id", F.col(weight).alias("_w")), "cell_id").join(response.select(*by, "cell_id", F.abs("value").alias("_size")), [*by, "cell_id"], "left")
    size = F.avg("_size")
    out = df.groupBy(*by).agg(
        weighted_mean("difference", "_w").alias("mean_difference"), weighted_mean(F.abs("difference"), F.col("_w")).alias("mean_abs_difference"), size.alias("_size"),
        F.avg(F.coalesce(F.col("significant"), F.lit(False)).cast("double")).alias("frac_significant"),
    )
    return out.withColumn("relative_to_response", F.col("mean_abs_difference") / F.when(F.col("_size") > 0, F.col("_size"))).drop("_size")
