"""The named queries over the driver tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.functions import calendar, units
from lagwise.model import clean, pinned
from lagwise.operators import climatology, epochs, evaluation, events, extremes, index, inference, regions, response, tables
from lagwise.plans import ctes
from lagwise.plans.adapter import CLASSES, ITERATIONS, LAG_MAX, LAG_MIN, MIN_RUN, MIN_YEARS, SEASONS, SEED, THRESHOLD, WINDOW, cells, field, fixed, monthly, orders, table, variables
from lagwise.sources import fields, manifest, sinks
from lagwise.sources.scratch import fresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
r4 = lambda c: fixed(c, 4)
s4 = lambda x: ctes.fixed(x, 4)
s6 = ctes.fixed
CELL, MEMBER = ["cell_id"], ["cell_id", "model"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = ctes.sql(sql)
        return f

    return add


def out(df: DataFrame, *plain: str, **computed: object) -> DataFrame:
    """The plain columns, and the computed ones at six fixed digits."""
    return df.select(*plain, *[fixed(c).alias(name) for name, c in computed.items()])


# --- what the queries share -------------------------------------------------------------------------------------------


def anom(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return climatology.anomalies(field(spark, d, *keys), ["cell_id", *keys], "standardized", "moving", WINDOW, MIN_YEARS)


def index_series(spark: SparkSession, d: str) -> DataFrame:
    return pinned(index.running_mean(index.zscore(monthly(spark, d), []), [], 3))


def event_table(spark: SparkSession, d: str, phase: str | None = None, series: DataFrame | None = None) -> DataFrame:
    """The catalogue of the index: a handful of rows. Queries that need it, or the index, more than once hand it down."""
    found = pinned(events.catalogue(series or index_series(spark, d), [], threshold=THRESHOLD, min_length=MIN_RUN, classes=CLASSES))
    return found.where(F.col("phase") == phase) if phase else found


def anchors(found: DataFrame) -> DataFrame:
    return found.select("event_year", F.col("peak_t").alias("anchor_t"))


def epoch(spark: SparkSession, d: str, *keys: str, phase: str = "warm", found: DataFrame | None = None) -> DataFrame:
    found = (found or event_table(spark, d)).where(F.col("phase") == phase)
    return epochs.epochs(anom(spark, d, *keys), anchors(found), LAG_MIN, LAG_MAX)


def responses(spark: SparkSession, d: str, *keys: str, phase: str = "warm", found: DataFrame | None = None) -> DataFrame:
    """The mean over lags 0 to 2 of each event."""
    found = (found or event_table(spark, d)).where(F.col("phase") == phase)
    df = epochs.epochs(anom(spark, d, *keys), anchors(found), 0, 2)
    return df.groupBy("cell_id", *keys, "event_year").agg(F.avg("value").alias("value"))


def phase_means(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """(cell_id, event_class): the mean response to the events of either phase, from one pass over the field."""
    found = (found or event_table(spark, d)).select("phase", "event_year", F.col("peak_t").alias("anchor_t"))
    each = epochs.epochs(anom(spark, d), found, 0, 2).groupBy("cell_id", "phase", "event_year").agg(F.avg("value").alias("value"))
    return each.groupBy("cell_id", F.col("phase").alias("event_class")).agg(F.avg("value").alias("value"))


def geography(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumn("area", units.cell_area(F.col("lat"), 5.0, 14.0))


def anchor_sets(spark: SparkSession, d: str, peaks: DataFrame | None = None, series: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pool of three-month means from every month on, the warm peaks, and the months apart from any peak."""
    anomaly, series = anom(spark, d), series or index_series(spark, d)
    every = orders(spark, d).agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b")).alias("anchor_t"))
    pool = epochs.epochs(anomaly, every, 0, 2).groupBy("anchor_t", "cell_id").agg(F.avg("value").alias("value"))
    peaks = peaks or event_table(spark, d, series=series)
    warm = anchors(peaks.where("phase = 'warm'")).select("anchor_t")
    neutral = epochs.eligible(series.select(F.col("t").alias("anchor_t")), anchors(peaks), 1)
    return pool, warm, neutral


def mc(spark: SparkSession, d: str) -> DataFrame:
    pool, warm, neutral = anchor_sets(spark, d)
    return inference.mc_test(pool, CELL, warm, neutral, ITERATIONS, SEED)


def mc_blocked(spark: SparkSession, d: str, peaks: DataFrame | None = None, series: DataFrame | None = None) -> DataFrame:
    pool, warm, neutral = anchor_sets(spark, d, peaks, series)
    months = lambda df: sorted(r[0] for r in df.distinct().collect())  # noqa: E731  anchors: months of the record
    return inference.mc_test_blocked(pool, CELL, months(warm), months(neutral), ITERATIONS, SEED, cells_a_block=8)


def agreement(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    means = responses(spark, d, "model", found=found).groupBy("cell_id", "model").agg(F.avg("value").alias("value"))
    return inference.sign_agreement(means, CELL)


def robust(spark: SparkSession, d: str) -> DataFrame:
    series = index_series(spark, d)
    found = event_table(spark, d, series=series)
    return inference.robust_mask(agreement(spark, d, found), mc_blocked(spark, d, found, series), CELL)


# --- projections and scalar normalisation -----------------------------------------------------------------------------


@query("q01_monthly_field", "SELECT cell_id, t::INT AS t, year::INT AS year, month::INT AS month, " + s4("value") + " AS value FROM field")
def monthly_field(spark: SparkSession, d: str) -> DataFrame:
    return field(spark, d).select("cell_id", "t", "year", "month", r4("value").alias("value"))


@query(
    "q02_unit_conversion",
    f"SELECT l_orderkey, l_linenumber, {s4("CASE l_returnflag WHEN 'A' THEN l_quantity / 86400 * 86400.0 WHEN 'N' THEN l_quantity + 273.15 - 273.15 ELSE l_quantity END")} AS value FROM lineitem",
)
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    raw = F.when(flag == "A", F.col("l_quantity") / 86400).when(flag == "N", F.col("l_quantity") + 273.15).otherwise(F.col("l_quantity"))
    name = F.when(flag == "A", "kg m-2 s-1").when(flag == "N", "K").otherwise("mm/day")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clean(raw).alias("raw"), name.alias("units"))
    value = units.to_celsius(units.to_mm_per_day(F.col("raw"), F.col("units")), F.col("units"))
    return df.select("l_orderkey", "l_linenumber", r4(value).alias("value"))


@query(
    "q02b_coordinates",
    f"SELECT n_nationkey AS cell_id, CASE WHEN lon > 180 OR (SELECT max(14.5 * n_nationkey) FROM nation) > 180 THEN {s6('(lon + 180) - 360 * floor((lon + 180) / 360) - 180')} ELSE lon END AS lon, {s6('6371.0 * 6371.0 * radians(5) * (sin(radians(lat + 2.5)) - sin(radians(lat - 2.5)))')} AS area_km2 FROM (SELECT n_nationkey, 14.5::DOUBLE * n_nationkey AS lon, -60.0::DOUBLE + 5 * n_nationkey AS lat FROM nation)",
)
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_id"), (F.lit(14.5) * F.col("n_nationkey")).alias("lon"), (-60.0 + 5 * F.col("n_nationkey")).alias("lat"))
    most = n.agg(F.max("lon").alias("most"))
    lon = units.wrap_longitude(F.col("lon"), F.col("most"))
    return out(n.crossJoin(F.broadcast(most)), "cell_id", lon=lon, area_km2=units.cell_area(F.col("lat"), 5.0, 5.0) / 1e6)


@query("q02c_season_labels", "SELECT t::INT AS t, ['DJF', 'JFM', 'FMA', 'MAM', 'AMJ', 'MJJ', 'JJA', 'JAS', 'ASO', 'SON', 'OND', 'NDJ'][month] AS season, " + s6("value") + " AS value FROM (SELECT t, t % 12 + 1 AS month, value FROM oni)")
def season_labels(spark: SparkSession, d: str) -> DataFrame:
    return out(index_series(spark, d).withColumn("season", calendar.season_label(F.pmod(F.col("t"), F.lit(12)) + 1)), "t", "season", value="value")


# --- climatologies, anomalies, indices --------------------------------------------------------------------------------


@query("q03_fixed_climatology", f"SELECT cell_id, month::INT AS month, {s4('avg(value)')} AS clim_mean, {s4('stddev_pop(value)')} AS clim_std FROM field WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL")
def fixed_climatology(spark: SparkSession, d: str) -> DataFrame:
    return climatology.fixed_climatology(field(spark, d), CELL, (1996, 1999)).select("cell_id", "month", r4("clim_mean").alias("clim_mean"), r4("clim_std").alias("clim_std"))


@query(
    "q04_moving_climatology",
    f"SELECT cell_id, t::INT AS t, n AS clim_n, {s4(f'CASE WHEN n >= {MIN_YEARS} THEN m END')} AS clim_mean, {s4(f'CASE WHEN n >= {MIN_YEARS} THEN sd END')} AS clim_std FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM field WINDOW w AS (PARTITION BY cell_id, month ORDER BY year RANGE BETWEEN {WINDOW // 2} PRECEDING AND {WINDOW - WINDOW // 2 - 1} FOLLOWING))",
)
def moving_climatology(spark: SparkSession, d: str) -> DataFrame:
    df = climatology.moving_climatology(field(spark, d), CELL, WINDOW, MIN_YEARS)
    return df.select("cell_id", "t", "clim_n", r4("clim_mean").alias("clim_mean"), r4("clim_std").alias("clim_std"))


@query("q05_anom_standardized", f"SELECT cell_id, t::INT AS t, {s6('value')} AS value FROM anom")
def anom_standardized(spark: SparkSession, d: str) -> DataFrame:
    return out(anom(spark, d), "cell_id", "t", value="value")


_MOVING = f"SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m FROM field WINDOW w AS (PARTITION BY cell_id, month ORDER BY year RANGE BETWEEN {WINDOW // 2} PRECEDING AND {WINDOW - WINDOW // 2 - 1} FOLLOWING)"


@query("q05b_anom_absolute", f"SELECT cell_id, t::INT AS t, {s4(f'CASE WHEN n >= {MIN_YEARS} THEN value - m END')} AS value FROM ({_MOVING})")
def anom_absolute(spark: SparkSession, d: str) -> DataFrame:
    df = climatology.anomalies(field(spark, d), CELL, "absolute", "moving", WINDOW, MIN_YEARS)
    return df.select("cell_id", "t", r4("value").alias("value"))


@query("q05c_anom_percent_fixed", f"SELECT cell_id, t::INT AS t, {s6('CASE WHEN m <> 0 THEN 100.0 * (value - m) / nullif(m, 0) END')} AS value FROM (SELECT *, avg(value) FILTER (year BETWEEN 1996 AND 1999) OVER (PARTITION BY cell_id, month) AS m FROM field)")
def anom_percent(spark: SparkSession, d: str) -> DataFrame:
    return out(climatology.anomalies(field(spark, d), CELL, "percent", "fixed", base=(1996, 1999)), "cell_id", "t", value="value")


_DIFF = f"SELECT *, CASE WHEN n >= {MIN_YEARS} THEN value - m END AS diff, (row_number() OVER (PARTITION BY cell_id ORDER BY t) - 1)::DOUBLE AS x FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, stddev_pop(value) OVER (PARTITION BY cell_id) AS whole FROM field WINDOW w AS (PARTITION BY cell_id, month ORDER BY year RANGE BETWEEN {WINDOW // 2} PRECEDING AND {WINDOW - WINDOW // 2 - 1} FOLLOWING))"


@query("q05d_anom_detrended", f"SELECT cell_id, t::INT AS t, {s6('CASE WHEN sd > 1e-6 * whole THEN (diff - (regr_intercept(diff, x) OVER c + regr_slope(diff, x) OVER c * x)) / sd END')} AS value FROM ({_DIFF}) WINDOW c AS (PARTITION BY cell_id)")
def anom_detrended(spark: SparkSession, d: str) -> DataFrame:
    return out(climatology.anomalies(field(spark, d), CELL, "standardized", "moving", WINDOW, MIN_YEARS, detrend=True), "cell_id", "t", value="value")


@query("q05e_anom_without_climatology", f"SELECT cell_id, t::INT AS t, {s4('value - (regr_intercept(value, x) OVER w + regr_slope(value, x) OVER w * x)')} AS value FROM (SELECT *, (row_number() OVER (PARTITION BY cell_id ORDER BY t) - 1)::DOUBLE AS x FROM field) WINDOW w AS (PARTITION BY cell_id)")
def anom_without_climatology(spark: SparkSession, d: str) -> DataFrame:
    df = climatology.anomalies(field(spark, d), CELL, "standardized", "none", detrend=True)
    return df.select("cell_id", "t", r4("value").alias("value"))


@query("q06_linear_detrend", f"SELECT cell_id, t::INT AS t, {s4('value - (regr_intercept(value, x) OVER w + regr_slope(value, x) OVER w * x)')} AS value FROM (SELECT *, (row_number() OVER (PARTITION BY cell_id ORDER BY t) - 1)::DOUBLE AS x FROM field) WINDOW w AS (PARTITION BY cell_id)")
def linear_detrend(spark: SparkSession, d: str) -> DataFrame:
    return climatology.linear_detrend(field(spark, d), CELL).select("cell_id", "t", r4("value").alias("value"))


@query("q07_accumulate_3", f"SELECT cell_id, t::INT AS t, {s4('CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END')} AS value FROM field WINDOW w AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def accumulate(spark: SparkSession, d: str) -> DataFrame:
    return climatology.accumulate(field(spark, d), CELL, 3).select("cell_id", "t", r4("value").alias("value"))


@query("q08_plotting_position", f"SELECT cell_id, t::INT AS t, {s6('CASE WHEN value IS NOT NULL AND n >= 5 THEN (k + (ties - 1) / 2 - 0.44) / (n + 0.12) END')} AS p FROM (SELECT *, count(value) OVER (PARTITION BY cell_id, month) AS n, rank() OVER (PARTITION BY cell_id, month ORDER BY value NULLS LAST) AS k, count(value) OVER (PARTITION BY cell_id, month, value) AS ties FROM field)")
def plotting_position(spark: SparkSession, d: str) -> DataFrame:
    return out(climatology.plotting_position(field(spark, d), CELL, 5), "cell_id", "t", p="p")


_RANKED = "SELECT {0}, t, CASE WHEN v IS NOT NULL AND n >= {1} THEN (k + (ties - 1) / 2 - 0.44) / (n + 0.12) END AS p FROM (SELECT *, count(v) OVER (PARTITION BY {0}, month) AS n, rank() OVER (PARTITION BY {0}, month ORDER BY v NULLS LAST) AS k, count(v) OVER (PARTITION BY {0}, month, v) AS ties FROM ({2}))"
_TRAILING = "SELECT cell_id, t, month, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS v FROM field WINDOW w AS (PARTITION BY cell_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_PLAIN = "SELECT cell_id, t, month, value AS v FROM field"


@query("q08b_empirical_index", f"SELECT cell_id, t::INT AS t, {s6(ctes.normal_quantile('p'))} AS value FROM ({_RANKED.format('cell_id', 5, _TRAILING)})")
def empirical_index(spark: SparkSession, d: str) -> DataFrame:
    return out(climatology.empirical_index(field(spark, d), CELL, 3, 5), "cell_id", "t", value="value")


@query("q09_gamma_index")
def gamma_index(spark: SparkSession, d: str) -> DataFrame:
    return out(climatology.gamma_index(field(spark, d), CELL, 3, 5, 5), "cell_id", "t", value="value")


_INDEX_SETS = " UNION ALL ".join(f"SELECT '{v}' AS variable, '{i}' AS index, {n} AS scale, cell_id, t::INT AS t, {s6(ctes.normal_quantile('p'))} AS value FROM ({_RANKED.format('cell_id', 5, source)})" for v, i in (("qtot", "sri"), ("dis", "ssi")) for n, source in ((1, _PLAIN), (3, _TRAILING)))


@query("q09b_index_set", _INDEX_SETS)
def index_set(spark: SparkSession, d: str) -> DataFrame:
    both = field(spark, d).withColumn("variable", F.explode(F.array(F.lit("qtot"), F.lit("dis"))))
    return out(climatology.index_set(both, CELL, (1, 3), "empirical", 5), "variable", "index", "scale", "cell_id", "t", value="value")


@query("q09c_threshold_counts", "SELECT cell_id, CASE WHEN count(value) > 0 THEN count(*) FILTER (value < -1) END AS n_months FROM anom GROUP BY cell_id")
def threshold_counts(spark: SparkSession, d: str) -> DataFrame:
    return climatology.threshold_counts(anom(spark, d), CELL, -1.0)



@query(
    "q10_sliding_base_anomaly",
    f"SELECT i.t::INT AS t, {s4('i.value - b.base')} AS value FROM idx i LEFT JOIN (SELECT block, month, avg(value) AS base FROM idx JOIN (SELECT b AS block, greatest(least(round_even(b + 1 - 2, 0)::INT, y1 - 3), y0) AS lo FROM (SELECT min(year) AS y0, max(year) AS y1 FROM idx) e CROSS JOIN (SELECT unnest(range(1990, 2010, 2)) AS b) WHERE b BETWEEN y0 - y0 % 2 AND y1) k ON idx.year BETWEEN lo AND lo + 3 GROUP BY ALL) b ON b.block = i.year - i.year % 2 AND b.month = i.month",
)
def sliding_base_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return index.sliding_base_anomaly(monthly(spark, d), [], 4, 2).select("t", r4("value").alias("value"))


@query("q10b_fixed_base_anomaly", f"SELECT t::INT AS t, {s4('value - avg(value) FILTER (year BETWEEN 1996 AND 1999) OVER (PARTITION BY month)')} AS value FROM idx")
def fixed_base_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return index.fixed_base_anomaly(monthly(spark, d), [], (1996, 1999)).select("t", r4("value").alias("value"))


@query("q11_index_3mo_mean", f"SELECT t::INT AS t, {s6('value')} AS value FROM oni")
def index_3mo_mean(spark: SparkSession, d: str) -> DataFrame:
    return out(index_series(spark, d), "t", value="value")


def _scenario_z(s: str) -> str:
    return f"SELECT t, (value - avg(value) OVER ()) / nullif(stddev_pop(value) OVER (), 0) AS value FROM (SELECT t, sum(cents) / count(*) / 100 AS value FROM o WHERE scenario = '{s}' GROUP BY t)"


_TWO = f"SELECT a.t, a.value - k * b.value AS nct, b.value - k * a.value AS nwp FROM (SELECT x.t, x.value AS xv, y.value AS yv, CASE WHEN x.value * y.value > 0 THEN 0.4 ELSE 0.0 END AS k FROM ({_scenario_z('F')}) x JOIN ({_scenario_z('O')}) y ON x.t = y.t) q JOIN ({_scenario_z('F')}) a ON a.t = q.t JOIN ({_scenario_z('O')}) b ON b.t = q.t"


def two_indices(spark: SparkSession, d: str) -> DataFrame:
    return index.two_index_transform(index.zscore(monthly(spark, d, "F"), []), index.zscore(monthly(spark, d, "O"), []))


@query("q12_two_index_transform", f"SELECT t::INT AS t, {s6('nct')} AS nct, {s6('nwp')} AS nwp FROM ({_TWO})")
def two_index_transform(spark: SparkSession, d: str) -> DataFrame:
    return out(two_indices(spark, d), "t", nct="nct", nwp="nwp")


# --- events -----------------------------------------------------------------------------------------------------------


@query("q13_event_runs", "SELECT min(t)::INT AS onset_t, max(t)::INT AS end_t, count(*) AS length FROM islands WHERE f AND phase = 'warm' GROUP BY run")
def event_runs(spark: SparkSession, d: str) -> DataFrame:
    found = events.runs(index_series(spark, d), [], F.col("value") >= THRESHOLD)
    return found.groupBy("run").agg(F.min("t").alias("onset_t"), F.max("t").alias("end_t"), F.count(F.lit(1)).alias("length")).drop("run")


@query(
    "q14_event_catalogue",
    f"SELECT e.phase, e.event_year::INT AS event_year, e.onset_t::INT AS onset_t, e.end_t::INT AS end_t, e.length, e.peak_t::INT AS peak_t, {s6('e.peak')} AS peak, {s6('j.value')} AS djf, e.amplitude, e.event_year || '/' || lpad(((e.event_year + 1) % 100)::VARCHAR, 2, '0') AS label, strftime(make_date((e.peak_t // 12)::INT, (e.peak_t % 12 + 1)::INT, 1), '%Y-%m-%d') AS peak_date FROM catalogue e LEFT JOIN oni j ON j.t = (e.event_year + 1) * 12",
)
def event_catalogue(spark: SparkSession, d: str) -> DataFrame:
    df = event_table(spark, d).withColumn("peak_date", F.date_format("peak_date", "yyyy-MM-dd"))
    return out(df, "phase", "event_year", "onset_t", "end_t", "length", "peak_t", "amplitude", "label", "peak_date", peak="peak", djf="djf")


@query(
    "q14b_event_flavour",
    f"SELECT e.phase, e.event_year::INT AS event_year, {s6('avg(x.nct)')} AS nct, {s6('avg(x.nwp)')} AS nwp, CASE WHEN avg(x.nct) IS NULL OR avg(x.nwp) IS NULL THEN 'unknown' WHEN abs(avg(x.nct)) >= abs(avg(x.nwp)) THEN 'EP' ELSE 'CP' END AS flavour FROM catalogue e LEFT JOIN ({_TWO}) x ON x.t BETWEEN e.event_year * 12 + 11 AND e.event_year * 12 + 13 GROUP BY ALL",
)
def event_flavour(spark: SparkSession, d: str) -> DataFrame:
    return out(events.flavour(event_table(spark, d), two_indices(spark, d)), "phase", "event_year", "flavour", nct="nct", nwp="nwp")


@query("q15_class_select", "SELECT event_year::INT AS event_year, amplitude FROM catalogue WHERE phase = 'warm' AND amplitude IN ('moderate', 'strong') AND event_year >= 1995 AND event_year + 2 <= 2001")
def class_select(spark: SparkSession, d: str) -> DataFrame:
    flagged = events.sample_flags(event_table(spark, d), 1995, 2001, 0)
    return events.select_class(flagged, "reference").select("event_year", "amplitude")


@query("q15b_event_summary", "SELECT phase, amplitude, count(*) AS n_events, list_aggregate(list_sort(list(event_year::INT)), 'string_agg', ',') AS years FROM catalogue GROUP BY ALL")
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.summary(event_table(spark, d)).withColumn("years", F.concat_ws(",", F.col("years").cast("array<string>")))


# --- epochs -----------------------------------------------------------------------------------------------------------


@query("q16_epoch_composite", f"SELECT cell_id, lag, {s6('value')} AS value, n_events FROM comp")
def epoch_composite(spark: SparkSession, d: str) -> DataFrame:
    return out(epochs.composite(epoch(spark, d), CELL), "cell_id", "lag", "n_events", value="value")


@query("q16d_class_composites", f"SELECT c.amplitude, c.cell_id, c.lag, {s6('c.value')} AS value, c.n_events, {s6('p.mean_peak')} AS mean_peak, p.n_class_events FROM (SELECT e.amplitude, a.cell_id, l.lag, avg(a.value) AS value, count(a.value) AS n_events FROM catalogue e CROSS JOIN lags l JOIN anom a ON a.t = e.peak_t + l.lag GROUP BY ALL) c JOIN (SELECT amplitude, avg(abs(peak)) AS mean_peak, count(DISTINCT event_year) AS n_class_events FROM catalogue GROUP BY ALL) p ON p.amplitude = c.amplitude")
def class_composites(spark: SparkSession, d: str) -> DataFrame:
    found = event_table(spark, d).select("amplitude", "event_year", F.col("peak_t").alias("anchor_t"), "peak")
    df = epochs.class_composites(anom(spark, d), CELL, found, LAG_MIN, LAG_MAX, "amplitude")
    return out(df, "amplitude", "cell_id", "lag", "n_events", "n_class_events", value="value", mean_peak="mean_peak")


@query("q16b_gather_epochs", f"SELECT c.cell_id, e.event_year::INT AS event_year, l.lag, {s6('a.value')} AS value FROM (SELECT DISTINCT cell_id FROM o) c CROSS JOIN catalogue e CROSS JOIN lags l LEFT JOIN anom a ON a.cell_id = c.cell_id AND a.t = e.peak_t + l.lag WHERE e.phase = 'warm'")
def gather_epochs(spark: SparkSession, d: str) -> DataFrame:
    return out(epochs.gather(anom(spark, d), CELL, anchors(event_table(spark, d, "warm")), LAG_MIN, LAG_MAX), "cell_id", "event_year", "lag", value="value")


@query("q16c_index_envelope", f"SELECT phase, lag, {s6('avg(value)')} AS mean, {s6('min(value)')} AS low, {s6('max(value)')} AS high, count(value) AS n FROM (SELECT e.phase, l.lag, i.value FROM catalogue e CROSS JOIN lags l JOIN oni i ON i.t = e.peak_t + l.lag) GROUP BY ALL")
def index_envelope(spark: SparkSession, d: str) -> DataFrame:
    found = event_table(spark, d).select("phase", F.col("peak_t").alias("anchor_t"))
    return out(epochs.envelope(index_series(spark, d), found, LAG_MIN, LAG_MAX, "phase"), "phase", "lag", "n", mean="mean", low="low", high="high")


def seasonal(spark: SparkSession, d: str) -> DataFrame:
    found = event_table(spark, d, "warm").select("event_year", epochs.anchor("december").alias("anchor_t"))
    return epochs.season_means(epochs.epochs(anom(spark, d), found, LAG_MIN, LAG_MAX), CELL, calendar.season_table(spark, SEASONS))


def stored(spark: SparkSession, d: str, buckets: int = 8) -> DataFrame:
    """The field as a table bucketed by cell, in the shared folder."""
    return fields.write_store(field(spark, d), fresh(spark, "store"), buckets)


def stored_composite(spark: SparkSession, store: DataFrame, d: str) -> DataFrame:
    series = climatology.anomalies(store, CELL, "standardized", "moving", WINDOW, MIN_YEARS)
    return epochs.composite(epochs.epochs(series, anchors(event_table(spark, d, "warm")), LAG_MIN, LAG_MAX), CELL)


@query("q16e_composite_from_store", f"SELECT cell_id, lag, {s6('value')} AS value, n_events FROM comp")
def composite_from_store(spark: SparkSession, d: str) -> DataFrame:
    return out(stored_composite(spark, stored(spark, d), d), "cell_id", "lag", "n_events", value="value")


@query("q17_season_means", f"SELECT cell_id, event_year::INT AS event_year, season, {s6('value')} AS value FROM sched")
def season_means(spark: SparkSession, d: str) -> DataFrame:
    return out(seasonal(spark, d), "cell_id", "event_year", "season", value="value")


@query("q18_eligible_anchors", "SELECT anchor_t::INT AS anchor_t FROM neutral")
def eligible_anchors(spark: SparkSession, d: str) -> DataFrame:
    return epochs.eligible(index_series(spark, d).select(F.col("t").alias("anchor_t")), anchors(event_table(spark, d)), 1).select("anchor_t")


# --- inference --------------------------------------------------------------------------------------------------------

_MC = f"SELECT cell_id, {s6('composite')} AS composite, {s6('p_value')} AS p_value, {s6('null_mean')} AS null_mean, {s6('null_std')} AS null_std FROM mc"


def _mc_columns(df: DataFrame) -> DataFrame:
    return out(df, "cell_id", composite="composite", p_value="p_value", null_mean="null_mean", null_std="null_std")


@query("q19_mc_composite_test", _MC)
def mc_composite_test(spark: SparkSession, d: str) -> DataFrame:
    return _mc_columns(mc(spark, d))


@query("q19b_mc_test_blocked", _MC)
def mc_test_blocked(spark: SparkSession, d: str) -> DataFrame:
    return _mc_columns(mc_blocked(spark, d))


@query("q20_fdr_mask", f"SELECT cell_id, {s6('p_value')} AS p_value, {s6('threshold')} AS threshold, significant FROM masked")
def fdr_mask(spark: SparkSession, d: str) -> DataFrame:
    return out(inference.fdr_mask(mc_blocked(spark, d)), "cell_id", "significant", p_value="p_value", threshold="threshold")


def member_test(spark: SparkSession, d: str) -> DataFrame:
    """mc_test() of every member on its own, in one pass over the members' field: (cell_id, model)."""
    series = anom(spark, d, "model")
    every = series.select(F.col("t").alias("anchor_t")).distinct()
    pool = epochs.epochs(series, every, 0, 2).groupBy("anchor_t", *MEMBER).agg(F.avg("value").alias("value"))
    peaks = event_table(spark, d)
    neutral = epochs.eligible(index_series(spark, d).select(F.col("t").alias("anchor_t")), anchors(peaks), 1)
    months = lambda df: sorted(r[0] for r in df.select("anchor_t").distinct().collect())  # noqa: E731  months of the record
    return inference.mc_test_blocked(pool, MEMBER, months(anchors(peaks.where("phase = 'warm'"))), months(neutral), ITERATIONS, SEED, cells_a_block=32)


ctes.CTES["mpool"] = "SELECT n.t AS anchor_t, a.cell_id, a.model, avg(a.value) AS value FROM cal n JOIN manom a ON a.t BETWEEN n.t AND n.t + 2 GROUP BY ALL"
ctes.CTES["mmc"] = "SELECT c.cell_id, c.model, any_value(composite) AS composite, (count(*) FILTER (abs(null_value) >= abs(composite) - 1e-12 * top) + 1) / (count(null_value) + 1) AS p_value FROM (SELECT cell_id, model, max(abs(value)) AS top FROM mpool GROUP BY ALL) c LEFT JOIN (SELECT cell_id, model, avg(value) AS composite FROM mpool WHERE anchor_t IN (SELECT anchor_t FROM warm_t) GROUP BY ALL) o USING (cell_id, model) LEFT JOIN (SELECT cell_id, model, iteration, avg(value) AS null_value FROM mpool JOIN draws USING (anchor_t) GROUP BY ALL) n USING (cell_id, model) GROUP BY c.cell_id, c.model"


@query(
    "q20b_fdr_by_family",
    f"SELECT cell_id, model, {s6('p_value')} AS p_value, {s6('threshold')} AS threshold, p_value <= threshold AND threshold > 0 AS significant FROM (SELECT *, coalesce(max(CASE WHEN p_value <= 0.1 * i / n THEN p_value END) OVER (PARTITION BY model), 0) AS threshold FROM (SELECT *, count(p_value) OVER (PARTITION BY model ORDER BY p_value) AS i, count(p_value) OVER (PARTITION BY model) AS n FROM mmc))",
)
def fdr_by_family(spark: SparkSession, d: str) -> DataFrame:
    """False discoveries held within each member: every one of them is a family, all in one plan."""
    return out(inference.fdr_mask(member_test(spark, d), by=["model"]), "cell_id", "model", "significant", p_value="p_value", threshold="threshold")


@query("q21_sign_agreement", f"SELECT cell_id, {s6('agreement')} AS agreement, n_models, {s6('ensemble_mean')} AS ensemble_mean FROM agree")
def sign_agreement(spark: SparkSession, d: str) -> DataFrame:
    return out(agreement(spark, d), "cell_id", "n_models", agreement="agreement", ensemble_mean="ensemble_mean")


@query("q22_robust_mask", "SELECT cell_id, significant, robust, n_models FROM robust")
def robust_mask(spark: SparkSession, d: str) -> DataFrame:
    return robust(spark, d).select("cell_id", "significant", "robust", "n_models")


@query("q22b_significance_summary", f"SELECT region, {s6('avg(significant::INT)')} AS frac_significant, {s6('avg(robust::INT)')} AS frac_robust, {s6('max(abs(composite))')} AS max_abs_composite, count(*) AS n_cells, any_value((SELECT n FROM n_events)) AS n_events, max(n_models) AS n_models, {s6('max(threshold)')} AS threshold FROM robust JOIN cells USING (cell_id) WHERE (SELECT n FROM n_events) >= 2 GROUP BY region")
def significance_summary(spark: SparkSession, d: str) -> DataFrame:
    df = inference.significance_summary(robust(spark, d).join(cells(spark, d).select("cell_id", "region"), "cell_id"), ["region"])
    return out(df, "region", "n_cells", "n_events", "n_models", frac_significant="frac_significant", frac_robust="frac_robust", max_abs_composite="max_abs_composite", threshold="threshold")


_AMPS = "(SELECT avg(abs(peak)) FROM catalogue WHERE phase = 'warm') / nullif((SELECT avg(abs(peak)) FROM catalogue WHERE phase = 'cold'), 0)"


@query(
    "q23_excess_vs_scaled",
    f"SELECT cell_id, {s6('s')} AS strong, {s6('k * r')} AS expected, {s6('s - k * r')} AS excess FROM (SELECT a.cell_id, a.s, b.r, {_AMPS} AS k FROM (SELECT cell_id, avg(value) AS s FROM resp GROUP BY ALL) a JOIN (SELECT cell_id, avg(value) AS r FROM cresp GROUP BY ALL) b USING (cell_id))",
)
def excess_vs_scaled(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda phase: responses(spark, d, phase=phase).groupBy("cell_id").agg(F.avg("value").alias("value"))
    size = {r["phase"]: r["a"] for r in event_table(spark, d).groupBy("phase").agg(F.avg(F.abs("peak")).alias("a")).collect()}
    return out(response.excess_over_scaled(mean("warm"), mean("cold"), CELL, size["warm"], size["cold"]), "cell_id", strong="strong", expected="expected", excess="excess")


def _picks(items: str, seed: int) -> str:
    """SQL of resampling all the events of a table together: (iteration, event_year, weight)."""
    n = f"(SELECT count(DISTINCT event_year) FROM {items})"
    return f"SELECT i AS iteration, event_year, count(*) AS weight FROM (SELECT i, ('0x' || substr(md5('{seed}:' || i || ':' || s), 1, 8))::BIGINT % {n} AS k FROM range({ITERATIONS}) a(i), (SELECT unnest(range(0, {n})) AS s)) JOIN (SELECT event_year, row_number() OVER (ORDER BY event_year) - 1 AS k FROM (SELECT DISTINCT event_year FROM {items})) USING (k) GROUP BY ALL"


def _boot(items: str, seed: int, value: str = "value") -> str:
    return f"SELECT cell_id, iteration, sum({value} * weight) / nullif(sum(weight) FILTER ({value} IS NOT NULL), 0) AS m FROM {items} JOIN ({_picks(items, seed)}) USING (event_year) GROUP BY ALL"


def _interval(items: str) -> str:
    """SQL of bootstrap_ci over (cell_id, event_year, value): each key's own values, drawn by slot."""
    own = f"SELECT cell_id, value, row_number() OVER (PARTITION BY cell_id ORDER BY event_year) - 1 AS k, count(*) OVER (PARTITION BY cell_id) AS n FROM {items} WHERE value IS NOT NULL"
    drawn = f"SELECT s.cell_id, i, avg(v.value) AS m FROM ({own}) s CROSS JOIN range({ITERATIONS}) r(i) JOIN ({own}) v ON v.cell_id = s.cell_id AND v.k = ('0x' || substr(md5('{SEED}:' || i || ':' || s.k), 1, 8))::BIGINT % s.n GROUP BY ALL"
    return f"SELECT a.cell_id, a.mean, lo, hi FROM (SELECT cell_id, avg(value) AS mean FROM {items} GROUP BY ALL) a LEFT JOIN (SELECT cell_id, quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM ({drawn}) GROUP BY cell_id) b ON a.cell_id = b.cell_id"


_TWO_SIDED = "least(1.0, 2.0 * (count(*) FILTER (CASE WHEN obs >= -1e-12 THEN draw <= 1e-12 ELSE draw >= -1e-12 END) + 1) / (count(draw) + 1))"


_EXCESS = f"SELECT cell_id, obs AS excess, {_TWO_SIDED} AS p_value, stddev_pop(draw) AS sd FROM (SELECT a.cell_id, a.m - 0.5 * b.m AS draw, o.obs FROM ({_boot('resp', SEED)}) a JOIN ({_boot('cresp', SEED + 1)}) b ON a.cell_id = b.cell_id AND a.iteration = b.iteration JOIN (SELECT x.cell_id, x.v - 0.5 * y.v AS obs FROM (SELECT cell_id, avg(value) AS v FROM resp GROUP BY ALL) x JOIN (SELECT cell_id, avg(value) AS v FROM cresp GROUP BY ALL) y ON x.cell_id = y.cell_id) o ON o.cell_id = a.cell_id) GROUP BY cell_id, obs"


@query("q24_excess_bootstrap", f"SELECT cell_id, {s6('excess')} AS excess, {s6('p_value')} AS p_value, {s6('sd')} AS sd FROM ({_EXCESS})")
def excess_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    found = event_table(spark, d)
    df = inference.bootstrap_difference(responses(spark, d, found=found), responses(spark, d, phase="cold", found=found), CELL, ITERATIONS, SEED, 0.5)
    return out(df, "cell_id", excess="excess", p_value="p_value", sd="sd")


def scenario_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = responses(spark, d, "scenario")
    return tuple(df.where(F.col("scenario") == s).drop("scenario") for s in "FO")


ctes.CTES["pairs"] = "SELECT a.cell_id, a.event_year, a.value - b.value AS value FROM sresp a JOIN sresp b ON a.cell_id = b.cell_id AND a.event_year = b.event_year WHERE a.scenario = 'F' AND b.scenario = 'O'"


_PAIRED = f"SELECT cell_id, obs AS difference, n_events, {_TWO_SIDED} AS p_value, stddev_pop(draw) AS sd FROM (SELECT o.cell_id, obs, n_events, b.m AS draw FROM (SELECT cell_id, avg(value) AS obs, count(value) AS n_events FROM pairs GROUP BY ALL) o LEFT JOIN ({_boot('pairs', SEED)}) b USING (cell_id)) GROUP BY cell_id, obs, n_events"


@query("q25_paired_contrast", f"SELECT cell_id, {s6('difference')} AS difference, n_events, {s6('p_value')} AS p_value, {s6('sd')} AS sd FROM ({_PAIRED})")
def paired_contrast(spark: SparkSession, d: str) -> DataFrame:
    df = inference.paired_difference(*scenario_pairs(spark, d), CELL, ITERATIONS, SEED)
    return out(df, "cell_id", "n_events", difference="difference", p_value="p_value", sd="sd")


_MASKED = f"SELECT *, p_value <= threshold AND threshold > 0 AS significant FROM (SELECT *, coalesce(max(CASE WHEN p_value <= 0.1 * i / m THEN p_value END) OVER (), 0) AS threshold FROM (SELECT *, count(p_value) OVER (ORDER BY p_value) AS i, count(p_value) OVER () AS m FROM ({_PAIRED})))"


@query(
    "q25c_contrast_table",
    f"SELECT {s6('sum(difference * area) / sum(area) FILTER (difference IS NOT NULL)')} AS mean_difference, {s6('sum(abs(difference) * area) / sum(area) FILTER (difference IS NOT NULL)')} AS mean_abs_difference, {s6('sum(abs(difference) * area) / sum(area) FILTER (difference IS NOT NULL) / nullif(avg(size), 0)')} AS relative_to_response, {s6('avg(coalesce(significant, false)::INT)')} AS frac_significant FROM ({_MASKED}) JOIN geo USING (cell_id) LEFT JOIN (SELECT cell_id, abs(avg(value)) AS size FROM sresp WHERE scenario = 'F' GROUP BY ALL) USING (cell_id)",
)
def contrast_table(spark: SparkSession, d: str) -> DataFrame:
    a, b = scenario_pairs(spark, d)
    contrast = inference.fdr_mask(inference.paired_difference(a, b, CELL, ITERATIONS, SEED))
    df = evaluation.contrast_table(contrast, a.groupBy("cell_id").agg(F.avg("value").alias("value")), geography(spark, d))
    return out(df, **{c: c for c in df.columns})


ctes.CTES["regional"] = "SELECT region AS cell_id, event_year, sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0) AS value FROM resp JOIN geo USING (cell_id) GROUP BY ALL"


@query(
    "q25b_bootstrap_ci",
    f"SELECT cell_id AS region, {s6('mean')} AS mean, {s6('lo')} AS ci_low, {s6('hi')} AS ci_high FROM ({_interval('regional')})",
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    df = responses(spark, d).join(geography(spark, d), "cell_id").groupBy("region", "event_year").agg(regions.weighted_mean().alias("value"))
    return out(inference.bootstrap_ci(df, ["region"], ITERATIONS, SEED), "region", mean="mean", ci_low="ci_low", ci_high="ci_high")


# --- responses --------------------------------------------------------------------------------------------------------


@query(
    "q26_variance_partition",
    f"SELECT cell_id, {s6('sm * ne / nullif(st, 0)')} AS frac_model, {s6('se * nm / nullif(st, 0)')} AS frac_event, {s6('greatest(st - sm * ne - se * nm, 0) / nullif(st, 0)')} AS frac_rest FROM (SELECT t.cell_id, st, sm, se, (SELECT count(DISTINCT model) FROM mresp) AS nm, (SELECT count(DISTINCT event_year) FROM mresp) AS ne FROM (SELECT cell_id, coalesce(sum(pow(value - g, 2)), 0) AS st FROM (SELECT *, avg(value) OVER (PARTITION BY cell_id) AS g FROM mresp) GROUP BY ALL) t JOIN (SELECT cell_id, coalesce(sum(pow(m - g, 2)), 0) AS sm FROM (SELECT DISTINCT cell_id, model, avg(value) OVER (PARTITION BY cell_id, model) AS m, avg(value) OVER (PARTITION BY cell_id) AS g FROM mresp) GROUP BY ALL) a ON a.cell_id = t.cell_id JOIN (SELECT cell_id, coalesce(sum(pow(e - g, 2)), 0) AS se FROM (SELECT DISTINCT cell_id, event_year, avg(value) OVER (PARTITION BY cell_id, event_year) AS e, avg(value) OVER (PARTITION BY cell_id) AS g FROM mresp) GROUP BY ALL) b ON b.cell_id = t.cell_id)",
)
def variance_partition(spark: SparkSession, d: str) -> DataFrame:
    df = response.variance_partition(responses(spark, d, "model"), CELL)
    return out(df, "cell_id", frac_model="frac_model", frac_event="frac_event", frac_rest="frac_rest")


@query(
    "q27_leave_one_out",
    f"SELECT left_out, {s6('m')} AS mean, {s6('f')} AS full_mean, {s6('(m - f) / nullif(abs(f), 0)')} AS change, coalesce(abs((m - f) / nullif(abs(f), 0)) > 0.5, false) AS flagged FROM (SELECT left_out, sum(v * area) / sum(area) FILTER (v IS NOT NULL) AS m FROM (SELECT k.left_out, r.cell_id, avg(r.value) AS v FROM mresp r CROSS JOIN (SELECT DISTINCT model AS left_out FROM mresp) k WHERE r.model <> k.left_out GROUP BY ALL) JOIN geo USING (cell_id) GROUP BY ALL) CROSS JOIN (SELECT sum(v * area) / sum(area) FILTER (v IS NOT NULL) AS f FROM (SELECT cell_id, avg(value) AS v FROM mresp GROUP BY ALL) JOIN geo USING (cell_id))",
)
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    df = responses(spark, d, "model").join(geography(spark, d).select("cell_id", "area"), "cell_id")
    return out(response.leave_one_out(df, "model", CELL, F.col("area")), "left_out", "flagged", mean="mean", full_mean="full_mean", change="change")


ctes.CTES["onidx"] = "SELECT a.cell_id, a.t, a.value AS y, i.value AS x FROM anom a JOIN oni i ON a.t = i.t WHERE a.value IS NOT NULL"


def on_index(spark: SparkSession, d: str) -> DataFrame:
    return anom(spark, d).join(epochs.small(index_series(spark, d).select("t", F.col("value").alias("index"))), "t")


@query(
    "q28_quadratic_fit",
    "SELECT cell_id, n, " + s6("my - q2 * s2 - q1 * mx + q2 * mx * mx") + " AS b0, " + s6("q1 - 2 * q2 * mx") + " AS b1, " + s6("q2") + " AS b2, " + s6("(q1 * c1 + q2 * c2) / nullif(vv, 0)") + " AS r2 FROM (SELECT *, (c1 * (s4 - s2 * s2) - c2 * s3) / det AS q1, (c2 * s2 - c1 * s3) / det AS q2 FROM (SELECT *, CASE WHEN n > 10 AND s2 * (s4 - s2 * s2) - s3 * s3 > 1e-12 * s2 * s2 * s2 THEN s2 * (s4 - s2 * s2) - s3 * s3 END AS det FROM (SELECT cell_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, avg(u * u) AS s2, avg(u * u * u) AS s3, avg(u * u * u * u) AS s4, avg(u * v) AS c1, avg(u * u * v) AS c2, avg(v * v) AS vv FROM (SELECT *, x - mx AS u, y - my AS v FROM (SELECT *, avg(x) OVER (PARTITION BY cell_id) AS mx, avg(y) OVER (PARTITION BY cell_id) AS my FROM onidx)) GROUP BY cell_id)))",
)
def quadratic_fit(spark: SparkSession, d: str) -> DataFrame:
    return out(response.quadratic_fit(on_index(spark, d), CELL), "cell_id", "n", b0="b0", b1="b1", b2="b2", r2="r2")


_HINGE = ctes.hinge("(SELECT cell_id, t AS item, x, y FROM onidx)", "cell_id", 0.3, 100, 1, 1.0)


@query("q29_hinge_fit", "SELECT cell_id, n, n_draws, steepening, " + ", ".join(f"{s6(c)} AS {c}" for c in ("b0", "slope", "warm", "cold", "ratio", "excess", "excess_frac", "p_value")) + f" FROM ({_HINGE})")
def hinge_fit(spark: SparkSession, d: str) -> DataFrame:
    df = response.hinge_fit(on_index(spark, d), CELL, "t", knot=0.3, iterations=100, evaluate_at=1.0, cells_a_block=8)
    return out(df, "cell_id", "n", "n_draws", "steepening", **{c: c for c in ("b0", "slope", "warm", "cold", "ratio", "excess", "excess_frac", "p_value")})


@query("q29b_collinearity", f"SELECT {s6('corr(value, greatest(value - 0.3, 0))')} AS corr_hinge, {s6('greatest(abs(corr(value, greatest(value - 0.3, 0))), abs(corr(value, least(value + 0.3, 0))), abs(corr(greatest(value - 0.3, 0), least(value + 0.3, 0))))')} AS max_collinearity, count(*) FILTER (value > 0.3) AS n_beyond, count(*) FILTER (value < -0.3) AS n_below, count(value) AS n FROM oni")
def collinearity(spark: SparkSession, d: str) -> DataFrame:
    return out(response.collinearity(index_series(spark, d), "value", 0.3), "n_beyond", "n_below", "n", corr_hinge="corr_hinge", max_collinearity="max_collinearity")


ctes.CTES["peak"] = "SELECT cell_id, lag AS peak_lag, value AS peak_value FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(value) DESC, lag) AS k FROM comp WHERE value IS NOT NULL) WHERE k = 1"


@query("q30_peak_lag", f"SELECT c.cell_id, p.peak_lag, {s6('p.peak_value')} AS peak_value FROM (SELECT DISTINCT cell_id FROM comp) c LEFT JOIN peak p USING (cell_id)")
def peak_lag(spark: SparkSession, d: str) -> DataFrame:
    return out(response.peak_lag(epochs.composite(epoch(spark, d), CELL), CELL), "cell_id", "peak_lag", peak_value="peak_value")


@query(
    "q31_duration_recovery",
    "SELECT cell_id, count(*) FILTER (abs(value) > 0.2) AS duration_months, coalesce(min(lag) FILTER (abs(value) > 0.2 AND lag >= 0) + 1, 0)::INT AS recovery_months_first, coalesce(max(lag) FILTER (abs(value) > 0.2 AND lag >= 0) + 1, 0)::INT AS recovery_months_last, coalesce(any_value(n), 0) AS consecutive_months FROM comp LEFT JOIN (SELECT cell_id, n FROM (SELECT cell_id, n, row_number() OVER (PARTITION BY cell_id ORDER BY a DESC, l) AS k FROM (SELECT cell_id, run, count(*) AS n, max(abs(value)) AS a, min(lag) FILTER (top) AS l FROM (SELECT *, abs(value) = max(abs(value)) OVER (PARTITION BY cell_id, run) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY lag) - row_number() OVER (PARTITION BY cell_id, coalesce(abs(value) > 0.2, false) ORDER BY lag) AS run FROM comp) WHERE abs(value) > 0.2) GROUP BY ALL)) WHERE k = 1) USING (cell_id) GROUP BY cell_id",
)
def duration_recovery(spark: SparkSession, d: str) -> DataFrame:
    return response.duration_recovery(epochs.composite(epoch(spark, d), CELL), CELL, 0.2)


@query("q32_ar1_memory", f"SELECT cell_id, {s6('r1')} AS r1, {s6('CASE WHEN r1 > 0 THEN -1 / ln(r1) END')} AS memory_months FROM (SELECT cell_id, greatest(least(avg(p) / nullif(avg(value * value), 0), 0.99), -0.99) AS r1 FROM (SELECT *, value * lag(value) OVER (PARTITION BY cell_id ORDER BY t) AS p FROM anom) GROUP BY cell_id)")
def ar1_memory(spark: SparkSession, d: str) -> DataFrame:
    return out(response.ar1_memory(anom(spark, d), CELL), "cell_id", r1="r1", memory_months="memory_months")


ctes.CTES["joined"] = "SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY t) AS rn FROM onidx"
ctes.CTES["xcorr"] = "SELECT a.cell_id, l.lag, corr(a.y, b.x) AS corr, count(*) AS n FROM lags l CROSS JOIN joined a JOIN joined b ON a.cell_id = b.cell_id AND b.rn = a.rn - l.lag GROUP BY ALL"


@query("q33_cross_correlation", f"SELECT cell_id, lag, {s6('corr')} AS corr, n FROM xcorr")
def cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    return out(response.cross_correlation(anom(spark, d), CELL, index_series(spark, d), LAG_MIN, LAG_MAX), "cell_id", "lag", "n", corr="corr")


@query("q33b_best_correlation", f"SELECT cell_id, lag AS best_lag, {s6('corr')} AS best_corr FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(corr) DESC, lag) AS k FROM xcorr WHERE corr IS NOT NULL) WHERE k = 1")
def best_correlation(spark: SparkSession, d: str) -> DataFrame:
    xc = response.cross_correlation(anom(spark, d), CELL, index_series(spark, d), LAG_MIN, LAG_MAX)
    return out(response.best_correlation(xc, CELL), "cell_id", "best_lag", best_corr="best_corr")


@query("q33c_lag_summary", f"SELECT region, {s6('quantile_cont(peak_lag, 0.5)')} AS median_lag, {s6('quantile_cont(peak_lag, 0.9)')} AS p90_lag, {s6('avg(peak_lag)')} AS mean_lag, count(peak_lag) AS n_cells FROM peak JOIN cells USING (cell_id) GROUP BY region")
def lag_summary(spark: SparkSession, d: str) -> DataFrame:
    peaks = response.peak_lag(epochs.composite(epoch(spark, d), CELL), CELL).join(cells(spark, d).select("cell_id", "region"), "cell_id")
    return out(response.lag_summary(peaks, ["region"]), "region", "n_cells", median_lag="median_lag", p90_lag="p90_lag", mean_lag="mean_lag")


# --- regions, bands, exposure -----------------------------------------------------------------------------------------


@query("q34_area_weighted_mean", f"SELECT t::INT AS t, {s6('sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0)')} AS value FROM anom JOIN geo USING (cell_id) GROUP BY t")
def area_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    df = anom(spark, d).join(geography(spark, d).select("cell_id", "area"), "cell_id")
    return out(df.groupBy("t").agg(regions.weighted_mean().alias("value")), "t", value="value")


@query(
    "q35_region_aggregate",
    f"SELECT 'mean' AS how, region, t::INT AS t, {s6('sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0)')} AS value FROM anom JOIN geo USING (cell_id) GROUP BY region, t UNION ALL SELECT 'sum', region, t::INT, {s6('coalesce(sum(value * area / 1e12), 0)')} FROM anom JOIN geo USING (cell_id) GROUP BY region, t UNION ALL SELECT 'max', region, t::INT, {s6('max(value)')} FROM anom JOIN geo USING (cell_id) GROUP BY region, t",
)
def region_aggregate(spark: SparkSession, d: str) -> DataFrame:
    geo = geography(spark, d)
    df = anom(spark, d).join(geo.select("cell_id", "area"), "cell_id").withColumn("area12", F.col("area") / 1e12)
    parts = [out(regions.region_aggregate(df, geo.select("cell_id", "region"), ["t"], how, "area12" if how == "sum" else "area").withColumn("how", F.lit(how)), "how", "region", "t", value="value") for how in ("mean", "sum", "max")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("q36_outlet_cell", f"SELECT region, cell_id, {s4('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY value DESC, cell_id) AS k FROM (SELECT region, cell_id, avg(value) AS value FROM field JOIN cells USING (cell_id) GROUP BY ALL)) WHERE k = 1")
def outlet_cell(spark: SparkSession, d: str) -> DataFrame:
    return regions.outlet_cells(field(spark, d), cells(spark, d).select("cell_id", "region")).select("region", "cell_id", r4("value").alias("value"))


@query("q36b_fallback_region", "SELECT cell_id, (floor((lat + 90) / 30) * 12 + floor((lon + 180) / 30))::INT AS region FROM cells")
def fallback_region(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("cell_id", regions.fallback_region().alias("region"))


@query("q36c_polygon_regions", "SELECT cell_id, CASE WHEN lat < -10 THEN 1 ELSE 2 END AS region FROM cells WHERE lat BETWEEN -52 AND 31 AND lon BETWEEN -178 AND 170")
def polygon_regions(spark: SparkSession, d: str) -> DataFrame:
    def ring(region: int, south: float, north: float) -> list[tuple]:
        p = [(-178.5, south), (170.5, south), (170.5, north), (-178.5, north)]
        return [(region, *p[k], *p[(k + 1) % 4]) for k in range(4)]

    edges = spark.createDataFrame(ring(1, -52.5, -10.5) + ring(2, -10.5, 31.5), "region int, x1 double, y1 double, x2 double, y2 double")
    return regions.regions_of_polygons(cells(spark, d), edges)


@query("q36d_raster_regions", "SELECT cell_id, region::INT AS region FROM cells")
def raster_regions(spark: SparkSession, d: str) -> DataFrame:
    raster = cells(spark, d).select((F.col("lat") + 0.4).alias("lat"), (F.col("lon") - 0.3).alias("lon"), F.col("region").cast("double").alias("region"))
    return regions.regions_of_raster(raster, cells(spark, d), 2.0)


@query("q37_amplification_pivot", f"SELECT cell_id, {s6('s')} AS warm, {s6('r')} AS cold, {s6('CASE WHEN abs(r) > 0.05 THEN s / r END')} AS amplification FROM (SELECT cell_id, avg(value) AS s FROM resp GROUP BY ALL) FULL JOIN (SELECT cell_id, avg(value) AS r FROM cresp GROUP BY ALL) USING (cell_id)")
def amplification_pivot(spark: SparkSession, d: str) -> DataFrame:
    df = regions.amplification(phase_means(spark, d), CELL, "warm", "cold")
    return out(df, "cell_id", warm="warm", cold="cold", amplification="amplification")


@query("q37b_region_response", f"SELECT region, {s6('any_value(m)')} AS mean, count(value) AS n_events, bool_and(sign(value) = sign(m)) AS sign_consistent FROM (SELECT *, avg(value) OVER (PARTITION BY region) AS m FROM (SELECT region, event_year, avg(value) AS value FROM mresp JOIN cells USING (cell_id) GROUP BY ALL)) GROUP BY region")
def region_response(spark: SparkSession, d: str) -> DataFrame:
    df = responses(spark, d, "model").join(cells(spark, d).select("cell_id", "region"), "cell_id")
    return out(regions.region_response(df, ["region"]), "region", "n_events", "sign_consistent", mean="mean")


ctes.CTES["rresp"] = "SELECT region AS cell_id, event_year, avg(value) AS value FROM mresp JOIN cells USING (cell_id) GROUP BY ALL"


@query(
    "q37c_region_table",
    f"SELECT a.region, {s6('a.mean')} AS mean, a.n_events, a.sign_consistent, {s6('b.lo')} AS ci_low, {s6('b.hi')} AS ci_high FROM (SELECT cell_id AS region, any_value(m) AS mean, count(value) AS n_events, bool_and(sign(value) = sign(m)) AS sign_consistent FROM (SELECT *, avg(value) OVER (PARTITION BY cell_id) AS m FROM rresp) GROUP BY cell_id) a JOIN ({_interval('rresp')}) b ON a.region = b.cell_id",
)
def region_table(spark: SparkSession, d: str) -> DataFrame:
    df = responses(spark, d, "model").join(cells(spark, d).select("cell_id", "region"), "cell_id")
    return out(regions.region_table(df, ["region"], ITERATIONS, SEED), "region", "n_events", "sign_consistent", mean="mean", ci_low="ci_low", ci_high="ci_high")


_BANDS = "(VALUES ('south', -60.0, -20.0), ('tropics', -20.0, 20.0), ('north', 20.0, 60.0)) b(band, low, high)"


@query("q38_band_response", f"SELECT band, lag, {s6('sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0)')} AS value FROM comp JOIN geo USING (cell_id) JOIN {_BANDS} ON lat BETWEEN low AND high GROUP BY ALL")
def band_response(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("south", -60.0, -20.0), ("tropics", -20.0, 20.0), ("north", 20.0, 60.0)], "band string, low double, high double")
    df = epochs.composite(epoch(spark, d), CELL).join(geography(spark, d).select("cell_id", "lat", "area"), "cell_id")
    return out(regions.band_join(df, bands).groupBy("band", "lag").agg(regions.weighted_mean().alias("value")), "band", "lag", value="value")


ctes.CTES["bresp"] = f"SELECT band AS cell_id, event_year, sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0) AS value FROM resp JOIN geo USING (cell_id) JOIN {_BANDS} ON lat BETWEEN low AND high GROUP BY ALL"


@query(
    "q38c_band_table",
    f"SELECT a.band, {s6('a.mean')} AS mean, {s6('a.lo')} AS ci_low, {s6('a.hi')} AS ci_high, p.lag AS peak_lag, {s6('p.value')} AS peak_amplitude, {s6('g.agreement')} AS mean_agreement, g.n_models FROM (SELECT cell_id AS band, mean, lo, hi FROM ({_interval('bresp')})) a JOIN (SELECT band, lag, value FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY abs(value) DESC, lag) AS k FROM (SELECT band, lag, sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0) AS value FROM comp JOIN geo USING (cell_id) JOIN {_BANDS} ON lat BETWEEN low AND high GROUP BY ALL) WHERE value IS NOT NULL) WHERE k = 1) p ON p.band = a.band JOIN (SELECT band, avg(agreement) AS agreement, max(n_models) AS n_models FROM agree JOIN cells USING (cell_id) JOIN {_BANDS} ON lat BETWEEN low AND high GROUP BY ALL) g ON g.band = a.band",
)
def band_table(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("south", -60.0, -20.0), ("tropics", -20.0, 20.0), ("north", 20.0, 60.0)], "band string, low double, high double")
    found = event_table(spark, d)
    df = regions.band_table(epochs.composite(epoch(spark, d, found=found), CELL), responses(spark, d, found=found), agreement(spark, d, found), geography(spark, d), bands, ITERATIONS, SEED)
    return out(df, "band", "peak_lag", "n_models", **{c: c for c in ("mean", "ci_low", "ci_high", "peak_amplitude", "mean_agreement")})


@query("q38b_box_means", f"SELECT box, event_year::INT AS event_year, {s6('avg(value)')} AS value FROM resp JOIN cells USING (cell_id) JOIN (VALUES ('a', -60.0, -10.0, -180.0, 0.0), ('b', -10.0, 60.0, -40.0, 180.0)) b(box, south, north, west, east) ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL")
def box_means(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.createDataFrame([("a", -60.0, -10.0, -180.0, 0.0), ("b", -10.0, 60.0, -40.0, 180.0)], "box string, south double, north double, west double, east double")
    df = regions.box_join(responses(spark, d).join(cells(spark, d), "cell_id"), boxes)
    return out(df.groupBy("box", "event_year").agg(F.avg("value").alias("value")), "box", "event_year", value="value")


def _counts(phase: str) -> str:
    return f"SELECT cell_id, avg(dry) AS dry, avg(wet) AS wet, avg(lo) AS lo, avg(hi) AS hi, count(*) AS n FROM (SELECT a.cell_id, e.event_year, count(*) FILTER (a.value < -0.5) AS dry, count(*) FILTER (a.value > 0.5) AS wet, min(a.value) AS lo, max(a.value) AS hi FROM catalogue e CROSS JOIN lags l JOIN anom a ON a.t = e.peak_t + l.lag WHERE e.phase = '{phase}' AND l.lag BETWEEN 0 AND 5 AND e.event_year IN (SELECT event_year FROM (SELECT e2.event_year, count(DISTINCT c.t) AS m FROM catalogue e2 JOIN cal c ON c.t BETWEEN e2.peak_t AND e2.peak_t + 5 WHERE e2.phase = '{phase}' GROUP BY ALL) WHERE m >= 3) GROUP BY ALL) GROUP BY cell_id"


def counts(spark: SparkSession, d: str, phase: str) -> DataFrame:
    return extremes.window_counts(anom(spark, d), CELL, anchors(event_table(spark, d, phase)), 0, 5, -0.5, 0.5)


@query("q39_window_counts", f"SELECT cell_id, {s6('dry')} AS dry_months, {s6('wet')} AS wet_months, {s6('lo')} AS least, {s6('hi')} AS largest, n AS n_events FROM ({_counts('warm')})")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return out(counts(spark, d, "warm"), "cell_id", "n_events", dry_months="dry_months", wet_months="wet_months", least="least", largest="largest")


@query("q39b_extra_months", f"SELECT a.cell_id, {s6('a.dry - b.dry')} AS extra_dry, {s6('a.wet - b.wet')} AS extra_wet FROM ({_counts('warm')}) a JOIN ({_counts('cold')}) b ON a.cell_id = b.cell_id")
def extra_months(spark: SparkSession, d: str) -> DataFrame:
    return out(extremes.extra_months(counts(spark, d, "warm"), counts(spark, d, "cold"), CELL), "cell_id", extra_dry="extra_dry", extra_wet="extra_wet")


@query("q39c_odds_ratio", f"SELECT cell_id, {s6('CASE WHEN p > 0 OR q > 0 THEN (pc / (1 - pc)) / (qc / (1 - qc)) END')} AS odds_ratio FROM (SELECT *, least(greatest(p, 1e-4), 1 - 1e-4) AS pc, least(greatest(q, 1e-4), 1 - 1e-4) AS qc FROM (SELECT a.cell_id, a.dry / 6 AS p, b.dry / 6 AS q FROM ({_counts('warm')}) a JOIN ({_counts('cold')}) b ON a.cell_id = b.cell_id))")
def odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    share = lambda phase: counts(spark, d, phase).select("cell_id", (F.col("dry_months") / 6).alias("share"))
    return out(extremes.odds_ratio(share("warm"), share("cold"), CELL), "cell_id", odds_ratio="odds_ratio")


_NEUTRAL_DRY = "SELECT a.cell_id, n.anchor_t, count(*) FILTER (a.value < -0.5) AS dry, count(*) FILTER (a.value > 0.5) AS wet FROM neutral n CROSS JOIN lags l JOIN anom a ON a.t = n.anchor_t + l.lag WHERE l.lag BETWEEN 0 AND 5 AND (SELECT count(DISTINCT c.t) FROM cal c WHERE c.t BETWEEN n.anchor_t AND n.anchor_t + 5) >= 3 GROUP BY ALL"


@query(
    "q39e_neutral_interval",
    f"SELECT {s6('avg(share)')} AS mean, {s6('quantile_cont(share, 0.05)')} AS ci_low, {s6('quantile_cont(share, 0.95)')} AS ci_high FROM (SELECT iteration, sum(least(greatest(p, 1e-4), 1 - 1e-4) * area) / sum(area) AS share FROM (SELECT d.iteration, c.cell_id, avg(c.dry) / 6 AS p FROM draws d JOIN ({_NEUTRAL_DRY}) c ON c.anchor_t = d.anchor_t GROUP BY ALL) JOIN geo USING (cell_id) GROUP BY iteration)",
)
def neutral_interval(spark: SparkSession, d: str) -> DataFrame:
    pool, warm, neutral = anchor_sets(spark, d)
    df = anom(spark, d).join(geography(spark, d).select("cell_id", "area"), "cell_id")
    inside = pool.select("anchor_t").distinct().join(warm, "anchor_t", "left_semi").count()
    found = extremes.neutral_interval(df, CELL, [r[0] for r in neutral.distinct().collect()], inside, 0, 5, ITERATIONS, SEED, -0.5, cells_a_block=8)
    return out(found, mean="mean", ci_low="ci_low", ci_high="ci_high")


_ODDS = "least(greatest({0} / 6, 1e-4), 1 - 1e-4) / (1 - least(greatest({0} / 6, 1e-4), 1 - 1e-4))"


@query(
    "q39f_extremes_table",
    f"SELECT max(n) AS n_events, {s6('sum(e * area) / sum(area)')} AS dry_event, {s6('sum(q * area) / sum(area)')} AS dry_neutral, {s6('sum(we * area) / sum(area)')} AS wet_event, {s6('sum(wq * area) / sum(area)')} AS wet_neutral, {s6('sum(least(greatest(e / 6, 1e-4), 1 - 1e-4) * area) / sum(area)')} AS dry_share, {s6('quantile_cont(CASE WHEN e > 0 OR q > 0 THEN (' + _ODDS.format('e') + ') / (' + _ODDS.format('q') + ') END, 0.5)')} AS median_odds_ratio, {s6('avg((e > 0 OR q > 0)::INT)')} AS frac_cells_dry, {s6('coalesce(sum(area) FILTER (e > q + 1), 0) / 1e12')} AS area_drier FROM (SELECT a.cell_id, a.dry AS e, a.wet AS we, a.n, b.q, b.wq FROM ({_counts('warm')}) a JOIN (SELECT cell_id, avg(dry) AS q, avg(wet) AS wq FROM ({_NEUTRAL_DRY}) GROUP BY ALL) b ON a.cell_id = b.cell_id) JOIN geo USING (cell_id)",
)
def extremes_table(spark: SparkSession, d: str) -> DataFrame:
    neutral = anchor_sets(spark, d)[2].distinct().withColumn("event_year", F.col("anchor_t"))
    base = extremes.window_counts(anom(spark, d), CELL, neutral, 0, 5, -0.5, 0.5)
    df = extremes.extremes_table(counts(spark, d, "warm"), base, CELL, geography(spark, d).select("cell_id", "area"), 6).withColumn("area_drier", F.col("area_drier") / 1e12)
    return out(df, "n_events", **{c: c for c in df.columns if c != "n_events"})


@query("q39d_yearly_change", f"SELECT cell_id, {s6('avg(n) FILTER (year IN (SELECT event_year FROM catalogue)) - avg(n)')} AS change FROM (SELECT cell_id, year, (count(*) FILTER (value > 0.5))::DOUBLE AS n FROM anom GROUP BY ALL) GROUP BY cell_id")
def yearly_change(spark: SparkSession, d: str) -> DataFrame:
    return out(extremes.event_year_change(extremes.yearly_months(anom(spark, d), CELL), CELL, event_table(spark, d)), "cell_id", change="change")


@query("q39g_change_summary", f"SELECT {s6('sum(change * area) / sum(area) FILTER (change IS NOT NULL)')} AS mean_change, {s6('min(change)')} AS least_change, {s6('avg(coalesce((change < 0)::INT, 0))')} AS frac_less FROM (SELECT cell_id, avg(n) FILTER (year IN (SELECT event_year FROM catalogue)) - avg(n) AS change FROM (SELECT cell_id, year, (count(*) FILTER (value > 0.5))::DOUBLE AS n FROM anom GROUP BY ALL) GROUP BY cell_id) JOIN geo USING (cell_id)")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    change = extremes.event_year_change(extremes.yearly_months(anom(spark, d), CELL), CELL, event_table(spark, d))
    return out(extremes.change_summary(change, geography(spark, d)), mean_change="mean_change", least_change="least_change", frac_less="frac_less")


_EXPOSED = "SELECT region, phase, value, area, population, agreement >= 0.6 AS robust FROM (SELECT cell_id, 'warm' AS phase, avg(value) AS value FROM resp GROUP BY ALL UNION ALL SELECT cell_id, 'cold', avg(value) FROM cresp GROUP BY ALL) JOIN geo USING (cell_id) JOIN agree USING (cell_id)"


def exposed(spark: SparkSession, d: str) -> DataFrame:
    found = event_table(spark, d)
    df = phase_means(spark, d, found).join(geography(spark, d), "cell_id").join(agreement(spark, d, found).select("cell_id", "agreement"), "cell_id")
    return df.withColumn("robust", F.col("agreement") >= 0.6)


def _part(sign: str, what: str) -> str:
    return f"sum(CASE WHEN value {sign} AND robust THEN {what} ELSE 0 END)"


@query("q40_exposure", f"SELECT region, phase AS event_class, {s4(_part('<= -0.1', 'area / 1e6'))} AS dry_area_km2, {s4(_part('>= 0.1', 'area / 1e6'))} AS wet_area_km2, {s4(_part('<= -0.1', 'population'))} AS dry_population, {s4(_part('>= 0.1', 'population'))} AS wet_population FROM ({_EXPOSED}) GROUP BY ALL")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    df = regions.exposure(exposed(spark, d), ["region", "event_class"], 0.1)
    return df.select("region", "event_class", *[r4(c).alias(c) for c in ("dry_area_km2", "wet_area_km2", "dry_population", "wet_population")])


@query("q40b_exposure_pivot", f"SELECT region, {', '.join(s4(f'{_part(sign, chr(39).join(["CASE WHEN phase = ", k, " THEN population ELSE 0 END"]))}') + f' AS {k}_{w}_population' for k in ('warm', 'cold') for w, sign in (('dry', '<= -0.1'), ('wet', '>= 0.1')))} FROM ({_EXPOSED}) GROUP BY region")
def exposure_pivot(spark: SparkSession, d: str) -> DataFrame:
    df = regions.exposure_pivot(regions.exposure(exposed(spark, d), ["region", "event_class"], 0.1), ["region"], ["warm", "cold"])
    return df.select("region", *[r4(c).alias(c) for c in df.columns if c != "region"])


@query("q41_nearest_year", "SELECT event_year::INT AS event_year, year::INT AS year FROM (SELECT e.event_year, y.year, row_number() OVER (PARTITION BY e.event_year ORDER BY abs(y.year - e.event_year), y.year) AS k FROM (SELECT DISTINCT event_year FROM catalogue) e CROSS JOIN (SELECT unnest([1994, 1996, 1998, 2000]) AS year) y) WHERE k = 1")
def nearest_year(spark: SparkSession, d: str) -> DataFrame:
    return regions.nearest_year(event_table(spark, d), spark.createDataFrame([(1994,), (1996,), (1998,), (2000,)], "year int"))


# --- manifests, files, tables -----------------------------------------------------------------------------------------


@query("q42_availability_matrix", "SELECT o_orderpriority AS model, o_orderstatus AS scenario, count(*) AS n_files, floor(sum(round(o_totalprice * 1000)::BIGINT) / 1e9 * 100 + 0.5) / 100 AS total_gb FROM orders GROUP BY ALL")
def availability_matrix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("scenario"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("size"))
    return manifest.availability(o, ("model", "scenario"))


@query("q42b_required_gaps", "SELECT n_nationkey AS cell_id, p.model, m.t::INT AS t FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority AS model FROM orders) p CROSS JOIN (SELECT DISTINCT t FROM o) m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.cell_id = n_nationkey AND o.model = p.model AND o.t = m.t)")
def required_gaps(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_id"))
    for column in ("model", "t"):  # what is required: every cell, member and month
        wanted = wanted.crossJoin(epochs.small(o.select(column).distinct()))
    return manifest.gaps(wanted, o, ["cell_id", "model", "t"])


@query("q42c_manifest_flatten", "SELECT 'set' || o_orderkey AS dataset, o_orderpriority AS model, o_orderstatus AS climate_scenario, CASE WHEN k IS NOT NULL THEN 'f' || o_orderkey || '_' || k END AS file_name, coalesce(o_custkey + k, -1) AS size FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber::BIGINT AS k FROM lineitem) ON l_orderkey = o_orderkey")
def manifest_flatten(spark: SparkSession, d: str) -> DataFrame:
    return flattened(table(spark, d, "orders"), table(spark, d, "lineitem"))


#: Orders and items in one task of flattened(), whose sorts hold them in memory.
MANIFEST_ROWS = 500_000


def flattened(o: DataFrame, items: DataFrame, rows: int = MANIFEST_ROWS) -> DataFrame:
    """The manifest of orders as datasets and their items as files, in as many tasks as the tables have times `rows` rows."""
    n = max(1, -(-(o.count() + items.count()) // rows))
    o = o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").repartition(n, "o_orderkey")
    files = items.select("l_orderkey", "l_linenumber").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber")).alias("items"))
    name = lambda i: F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit("_"), i["l_linenumber"].cast("string"))
    files_ = F.transform("items", lambda i: F.struct(name(i).alias("name"), (F.col("o_custkey") + i["l_linenumber"]).alias("size")))
    spec = F.struct(F.array("o_orderpriority").alias("model"), F.array("o_orderstatus").alias("climate_scenario"))
    docs = o.join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.to_json(F.struct(F.concat(F.lit("set"), F.col("o_orderkey").cast("string")).alias("name"), spec.alias("specifiers"), files_.alias("files"))).alias("json"))
    return manifest.flatten(docs).select("dataset", "model", "climate_scenario", "file_name", F.coalesce("size", F.lit(-1)).alias("size"))


@query("q42d_name_parse", "SELECT 'm' || (n_nationkey % 3) AS model, 'qtot' AS variable, 1900 + n_nationkey AS start, 2000 AS \"end\" FROM nation WHERE n_nationkey % 5 <> 0")
def name_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    path = F.concat(F.lit("/data/sector/m"), (n % 3).cast("string"), F.lit("_gswp3_obsclim_histsoc_default_qtot_global_monthly_"), (1900 + n).cast("string"), F.lit("_2000.nc"))
    odd = F.when(n % 5 == 0, F.lit("/data/readme.txt")).otherwise(path)
    parts = table(spark, d, "nation").select(odd.alias("path")).withColumns(fields.name_columns("path"))
    return parts.where("variable is not null").select("model", "variable", "start", "end")


@query("q43_decade_crosstab", "SELECT (event_year // 10 * 10)::INT AS decade, count(*) FILTER (amplitude = 'weak') AS weak, count(*) FILTER (amplitude = 'moderate') AS moderate, count(*) FILTER (amplitude = 'strong') AS strong, count(*) FILTER (amplitude = 'super') AS super FROM catalogue GROUP BY 1")
def decade_crosstab(spark: SparkSession, d: str) -> DataFrame:
    df = event_table(spark, d).withColumn("decade", (F.floor(F.col("event_year") / 10) * 10).cast("int"))
    return df.groupBy("decade").pivot("amplitude", list(CLASSES)).agg(F.count(F.lit(1))).fillna(0)


# --- evaluation -------------------------------------------------------------------------------------------------------


@query("q44_pattern_evaluation", f"SELECT {s6('corr(a.v, b.v)')} AS r, {s6('stddev_pop(b.v) / nullif(stddev_pop(a.v), 0)')} AS std_ratio, {s6('avg((sign(a.v) = sign(b.v))::INT)')} AS sign_agreement, count(*) AS n FROM (SELECT cell_id, avg(value) AS v FROM sresp WHERE scenario = 'F' GROUP BY ALL) a JOIN (SELECT cell_id, avg(value) AS v FROM sresp WHERE scenario = 'O' GROUP BY ALL) b ON a.cell_id = b.cell_id WHERE a.v IS NOT NULL AND b.v IS NOT NULL HAVING count(*) >= 10")
def pattern_evaluation(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.groupBy("cell_id").agg(F.avg("value").alias("value")) for x in scenario_pairs(spark, d))
    return out(evaluation.pattern_comparison(a, b, CELL, [], 10), "n", r="r", std_ratio="std_ratio", sign_agreement="sign_agreement")


_NODES = "SELECT c_nationkey AS i, c_custkey % 10 AS j, sum(round(c_acctbal * 100)::BIGINT) / count(*) / 100 AS v FROM customer GROUP BY ALL"
_PLACES = "SELECT s_suppkey AS point, 24 * (s_suppkey * 37 % 101) / 101.0::DOUBLE AS y, 9 * (s_suppkey * 53 % 97) / 97.0::DOUBLE AS x FROM supplier"


@query(
    "q44b_bilinear",
    f"SELECT point, CASE WHEN count(*) FILTER (v IS NULL) = 0 THEN {s4('sum(w * v)')} END AS value FROM (SELECT point, w, v FROM (SELECT point, floor(y)::BIGINT + a AS i, floor(x)::BIGINT + b AS j, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM ({_PLACES}) CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)) LEFT JOIN ({_NODES}) USING (i, j) WHERE w > 0) GROUP BY point",
)
def bilinear(spark: SparkSession, d: str) -> DataFrame:
    """The mean balance of customers on a grid of nations and key groups, at every supplier's place in it."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_custkey") % 10).cast("double").alias("lon"))
    grid = c.agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / F.count(F.lit(1)) / 100).alias("value"))
    key = F.col("s_suppkey")
    points = table(spark, d, "supplier").select(key.alias("point"), (24 * (key * 37 % 101) / 101.0).alias("lat"), (9 * (key * 53 % 97) / 97.0).alias("lon"))
    return evaluation.bilinear(points, grid, "point", 1.0).select("point", r4("value").alias("value"))


_FC = "SELECT cell_id, scenario, lag, avg(value) AS v FROM sepoch GROUP BY ALL"


_AGREEMENT = f"SELECT cell_id, count(*) AS n_lags, {s6('CASE WHEN count(*) >= 6 THEN corr(o, s) END')} AS r, {s6('arg_max(o, abs(o))')} AS peak_observed, {s6('arg_max(s, abs(s))')} AS peak_simulated, sign(arg_max(o, abs(o))) = sign(arg_max(s, abs(s))) AS same_sign FROM (SELECT a.cell_id, a.lag, a.v AS o, b.v AS s FROM ({_FC}) a JOIN ({_FC}) b ON a.cell_id = b.cell_id AND a.lag = b.lag WHERE a.scenario = 'F' AND b.scenario = 'O' AND a.v IS NOT NULL AND b.v IS NOT NULL) GROUP BY cell_id"


@query("q44c_composite_agreement", _AGREEMENT)
def composite_agreement(spark: SparkSession, d: str) -> DataFrame:
    comp = epochs.composite(epoch(spark, d, "scenario"), ["cell_id", "scenario"])
    one = lambda s: comp.where(F.col("scenario") == s)
    df = evaluation.composite_agreement(one("F"), one("O"), CELL)
    return out(df, "cell_id", "n_lags", "same_sign", r="r", peak_observed="peak_observed", peak_simulated="peak_simulated")


@query("q44d_station_table", f"SELECT count(*) AS n_stations, {s4('quantile_cont(r, 0.5)')} AS median_r, {s6('avg(coalesce(same_sign, false)::INT)')} AS frac_same_sign FROM ({_AGREEMENT})")
def station_table(spark: SparkSession, d: str) -> DataFrame:
    comp = epochs.composite(epoch(spark, d, "scenario"), ["cell_id", "scenario"])
    one = lambda s: comp.where(F.col("scenario") == s)
    df = evaluation.station_table(evaluation.composite_agreement(one("F"), one("O"), CELL))
    return df.select("n_stations", r4("median_r").alias("median_r"), fixed("frac_same_sign").alias("frac_same_sign"))


ctes.CTES["pepoch"] = "SELECT e.phase, a.cell_id, a.scenario, l.lag, avg(a.value) AS v FROM catalogue e CROSS JOIN lags l JOIN sanom a ON a.t = e.peak_t + l.lag GROUP BY ALL"


@query(
    "q44e_station_table_by_class",
    f"SELECT phase, count(*) AS n_stations, {s4('quantile_cont(r, 0.5)')} AS median_r, {s6('avg(coalesce(same, false)::INT)')} AS frac_same_sign FROM (SELECT phase, cell_id, CASE WHEN count(*) >= 4 THEN corr(o, s) END AS r, sign(arg_max(o, (abs(o), -lag))) = sign(arg_max(s, (abs(s), -lag))) AS same FROM (SELECT a.phase, a.cell_id, a.lag, a.v AS o, b.v AS s FROM pepoch a JOIN pepoch b ON a.phase = b.phase AND a.cell_id = b.cell_id AND a.lag = b.lag WHERE a.scenario = 'F' AND b.scenario = 'O' AND a.v IS NOT NULL AND b.v IS NOT NULL) GROUP BY ALL) GROUP BY phase",
)
def station_table_by_class(spark: SparkSession, d: str) -> DataFrame:
    """The station evaluation for either phase, all events aligned in one pass."""
    found = event_table(spark, d).select("phase", "event_year", F.col("peak_t").alias("anchor_t"))
    comp = epochs.composite(epochs.epochs(anom(spark, d, "scenario"), found, LAG_MIN, LAG_MAX), ["phase", "cell_id", "scenario"])
    one = lambda s: comp.where(F.col("scenario") == s)
    df = evaluation.station_table(evaluation.composite_agreement(one("F"), one("O"), ["phase", "cell_id"], 4), ["phase"])
    return df.select("phase", "n_stations", r4("median_r").alias("median_r"), fixed("frac_same_sign").alias("frac_same_sign"))


@query("q45_station_nearest", "SELECT cell_id AS station, cell_id FROM cells")
def station_nearest(spark: SparkSession, d: str) -> DataFrame:
    stations = cells(spark, d).select(F.col("cell_id").alias("station"), (F.col("lat") + 1.1).alias("lat"), (F.col("lon") - 0.9).alias("lon"))
    return regions.nearest_cell(stations, cells(spark, d), "station", 2.0)


@query("q45b_station_filter", "SELECT cell_id, model, count(value) AS n FROM mfield GROUP BY ALL HAVING count(value) >= 40 AND 1 - count(value) / count(*) <= 0.1")
def station_filter(spark: SparkSession, d: str) -> DataFrame:
    df = field(spark, d, "model").withColumn("station", F.struct("cell_id", "model"))
    return evaluation.good_stations(df, "station", 40, 0.1).groupBy("cell_id", "model").agg(F.count("value").alias("n"))


@query("q46_coverage", f"SELECT cell_id, model, count(DISTINCT t) AS n_months, {s6('count(DISTINCT t) / 80')} AS share, count(DISTINCT t) / 80 < 0.9 AS short FROM fm GROUP BY ALL")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    have = field(spark, d, "model").where("value is not null")
    return out(fields.coverage(have, MEMBER, 80), "cell_id", "model", "n_months", "short", share="share")


@query("q47_land_mask", "SELECT cell_id, coalesce(bool_or(value IS NOT NULL), false) AS land FROM anom GROUP BY cell_id")
def land_mask(spark: SparkSession, d: str) -> DataFrame:
    return regions.land_mask(anom(spark, d))


@query("q48_ensemble_mean", f"SELECT cell_id, t::INT AS t, {s6('avg(value)')} AS value FROM manom GROUP BY ALL")
def ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    return out(fields.ensemble_mean(anom(spark, d, "model"), CELL), "cell_id", "t", value="value")


@query("q48b_member_alignment", f"SELECT c.cell_id, t.t::INT AS t, m.scenario, {s4('s.value')} AS value FROM (SELECT DISTINCT cell_id FROM fs) c CROSS JOIN (SELECT DISTINCT t FROM fs) t CROSS JOIN (VALUES ('F'), ('O'), ('P')) m(scenario) LEFT JOIN fs s ON s.cell_id = c.cell_id AND s.t = t.t AND s.scenario = m.scenario")
def member_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Three scenarios of unequal months and cells, on the union of their axes."""
    each = orders(spark, d).groupBy("cell_id", "scenario", "t").agg((F.sum("cents") / F.count("cents") / 100).alias("value"))
    members = {m: each.where(F.col("scenario") == m) for m in ("F", "O", "P")}
    return fields.align(members, CELL, "scenario").select("cell_id", "t", "scenario", r4("value").alias("value"))


@query("q49_value_histogram", "SELECT floor(value / 0.5)::BIGINT AS bin, count(*) AS n FROM anom WHERE value IS NOT NULL GROUP BY 1")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return anom(spark, d).where("value is not null").groupBy(F.floor(F.col("value") / 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("q50_common_events", "SELECT event_year::INT AS event_year, cell_id FROM sresp WHERE scenario = 'F' AND value > 0 INTERSECT SELECT event_year::INT, cell_id FROM sresp WHERE scenario = 'O' AND value > 0")
def common_events(spark: SparkSession, d: str) -> DataFrame:
    """The events and cells that answer upwards in both scenarios."""
    a, b = (x.where("value > 0").select("event_year", "cell_id") for x in scenario_pairs(spark, d))
    return a.intersect(b)


@query(
    "q51_long_record_runs",
    "SELECT event_type, run_start, n FROM (SELECT event_type, min(h) AS run_start, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h) - row_number() OVER (PARTITION BY event_type, f ORDER BY h) AS run FROM (SELECT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS h, count(*) >= 3 AS f FROM (SELECT event_type, ts FROM events) GROUP BY 1, 2)) WHERE f GROUP BY event_type, run) WHERE n >= 2",
)
def long_record_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("t"))
    e = e.groupBy("event_type", "t").agg(F.count(F.lit(1)).cast("double").alias("value"))
    found = events.runs(e, ["event_type"], F.col("value") >= 3).groupBy("event_type", "run").agg(F.min("t").alias("run_start"), F.count(F.lit(1)).alias("n"))
    return found.where("n >= 2").drop("run")


_SHARE = "sum({0}) FILTER (excess IS NOT NULL) / sum(area) FILTER (excess IS NOT NULL)"


@query(
    "q52_region_nonlinearity",
    f"SELECT region, {s6(_SHARE.format('excess * area'))} AS mean_excess, {s6(_SHARE.format('abs(excess) * area'))} AS mean_abs_excess, {s6(_SHARE.format('CASE WHEN p_value < 0.1 THEN area ELSE 0 END'))} AS area_frac_significant, {s6('quantile_cont(excess, 0.5)')} AS median_excess FROM ({_EXCESS}) JOIN geo USING (cell_id) GROUP BY region",
)
def region_nonlinearity(spark: SparkSession, d: str) -> DataFrame:
    found = event_table(spark, d)
    df = inference.bootstrap_difference(responses(spark, d, found=found), responses(spark, d, phase="cold", found=found), CELL, ITERATIONS, SEED, 0.5).join(geography(spark, d), "cell_id")
    df = response.nonlinearity_summary(df, ["region"])
    return out(df, "region", **{c: c for c in df.columns if c != "region"})


# --- tables of several variables --------------------------------------------------------------------------------------

ctes.CTES["vseas"] = "SELECT a.variable, a.cell_id, e.phase, e.event_year, s.season, avg(a.value) AS value FROM catalogue e CROSS JOIN seasons s JOIN vanom a ON a.t = e.event_year * 12 + 11 + s.lag GROUP BY ALL"
ctes.CTES["vwarm"] = "SELECT * FROM vseas WHERE phase = 'warm'"
ctes.CTES["vcold"] = "SELECT * FROM vseas WHERE phase = 'cold'"
ctes.CTES["anchor12"] = "SELECT unnest(range((SELECT min(t // 12) FROM cal) * 12 + 11, (SELECT max(t // 12) - 1 FROM cal) * 12 + 12, 3)) AS anchor_t"
ctes.CTES["yresp"] = "SELECT a.variable, a.cell_id, s.season, c.anchor_t::INT AS anchor_t, avg(a.value) AS value, any_value(i.value) AS x FROM anchor12 c JOIN oni i ON i.t = c.anchor_t + 1 CROSS JOIN seasons s JOIN vanom a ON a.t = c.anchor_t + s.lag GROUP BY ALL"


def vanom(spark: SparkSession, d: str) -> DataFrame:
    return climatology.anomalies(variables(spark, d), ["cell_id", "variable"], "standardized", "moving", WINDOW, MIN_YEARS)


def yearly(spark: SparkSession, d: str, series: DataFrame | None = None) -> DataFrame:
    """Season means around the last month of every quarter: the record is too short for a December of each year alone."""
    return tables.yearly_responses(vanom(spark, d), ["variable", "cell_id"], calendar.season_table(spark, SEASONS), series or index_series(spark, d), LAG_MIN, LAG_MAX, 0, 1, 3)


@query("q53_yearly_responses", f"SELECT variable, cell_id, season, anchor_t, {s6('value')} AS value, {s6('x')} AS index FROM yresp")
def yearly_responses(spark: SparkSession, d: str) -> DataFrame:
    return out(yearly(spark, d), "variable", "cell_id", "season", "anchor_t", value="value", index="index")


def _drawn(items: str, seed: int) -> str:
    return f"SELECT variable, season, cell_id, iteration, sum(value * weight) / nullif(sum(weight) FILTER (value IS NOT NULL), 0) AS m FROM {items} JOIN ({_picks(items, seed)}) USING (event_year) GROUP BY ALL"


_VKEYS = "variable, season, cell_id"
_VOBS = f"SELECT {_VKEYS}, s - k * r AS obs, k FROM (SELECT {_VKEYS}, avg(value) AS s FROM vwarm GROUP BY ALL) JOIN (SELECT {_VKEYS}, avg(value) AS r FROM vcold GROUP BY ALL) USING ({_VKEYS}) CROSS JOIN (SELECT {_AMPS} AS k)"
_VEXCESS = f"SELECT {_VKEYS}, obs AS excess, k, {_TWO_SIDED} AS p_value FROM (SELECT {_VKEYS}, obs, k, a.m - k * b.m AS draw FROM ({_VOBS}) JOIN ({_drawn('vwarm', SEED)}) a USING ({_VKEYS}) JOIN ({_drawn('vcold', SEED + 1)}) b USING ({_VKEYS}, iteration)) GROUP BY ALL"
_VMASK = f"SELECT *, p_value <= threshold AND threshold > 0 AS significant FROM (SELECT *, coalesce(max(CASE WHEN p_value <= 0.1 * i / n THEN p_value END) OVER (PARTITION BY variable), 0) AS threshold FROM (SELECT *, count(p_value) OVER (PARTITION BY variable ORDER BY p_value) AS i, count(p_value) OVER (PARTITION BY variable) AS n FROM ({_VEXCESS})))"
_VHINGE = " UNION ALL ".join(f"SELECT '{v}' AS variable, * FROM ({ctes.hinge(f"(SELECT season, cell_id, anchor_t AS item, x, value AS y FROM yresp WHERE variable = '{v}' AND value IS NOT NULL)", 'season, cell_id', 0.3, 100, 1, 1.0)})" for v in ("price", "total"))


@query(
    "q54_nonlinearity_table",
    f"SELECT variable, season, {s6(_AMPS)} AS scaling_factor, {s6('avg(e.excess)')} AS mean_excess, {s6('avg(abs(e.excess))')} AS mean_abs_excess, {s6('avg(coalesce(significant, false)::INT)')} AS frac_significant, {s6('avg((e.excess > 0)::INT) FILTER (significant)')} AS frac_amplified, {s6('avg(steepening::INT)')} AS frac_steepening, {s6('quantile_cont(excess_frac, 0.5)')} AS median_excess_frac, {s6('avg(coalesce(h.p_value < 0.1, false)::INT)')} AS frac_hinge_significant, {s6('quantile_cont(ratio, 0.5)')} AS median_ratio FROM ({_VMASK}) e FULL JOIN ({_VHINGE}) h USING ({_VKEYS}) GROUP BY variable, season",
)
def nonlinearity_table(spark: SparkSession, d: str) -> DataFrame:
    """The excess of warm events over scaled cold ones, and the bend of the response curve, by variable and season."""
    series = index_series(spark, d)
    found = event_table(spark, d, series=series)
    size = {r["phase"]: r["a"] for r in found.groupBy("phase").agg(F.avg(F.abs("peak")).alias("a")).collect()}
    aligned = epochs.epochs(vanom(spark, d), found.select("phase", "event_year", epochs.anchor("december").alias("anchor_t")), LAG_MIN, LAG_MAX)
    seasonal = epochs.season_means(aligned, ["phase", "variable", "cell_id"], calendar.season_table(spark, SEASONS))
    one = lambda phase: seasonal.where(F.col("phase") == phase)
    scale, keys = size["warm"] / size["cold"], ["variable", "season", "cell_id"]
    excess = inference.bootstrap_difference(one("warm"), one("cold"), keys, ITERATIONS, SEED, scale)
    fits = [response.hinge_fit(yearly(spark, d, series).where(F.col("variable") == v), keys, knot=0.3, iterations=100, evaluate_at=1.0) for v in ("price", "total")]
    df = tables.nonlinearity_table(excess, fits[0].unionByName(fits[1]), CELL, ["variable", "season"], ["variable"], scale)
    return out(df, "variable", "season", **{c: c for c in df.columns if c not in ("variable", "season")})


ctes.CTES["vcomp"] = "SELECT a.variable, a.cell_id, l.lag, avg(a.value) AS value FROM catalogue e CROSS JOIN lags l JOIN vanom a ON a.t = e.peak_t + l.lag WHERE e.phase = 'warm' GROUP BY ALL"
ctes.CTES["vprofile"] = "SELECT variable, lag, sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0) AS value FROM vcomp JOIN geo USING (cell_id) GROUP BY ALL"
ctes.CTES["vmean"] = "SELECT variable, t, sum(value * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0) AS value FROM vanom JOIN geo USING (cell_id) GROUP BY ALL"
ctes.CTES["vjoin"] = "SELECT a.variable, a.t, a.value AS y, i.value AS x, row_number() OVER (PARTITION BY a.variable ORDER BY a.t) AS rn FROM vmean a JOIN oni i ON a.t = i.t WHERE a.value IS NOT NULL"
_VPEAK = "SELECT variable, lag AS peak_lag, value AS peak_amplitude FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY abs(value) DESC, lag) AS k FROM vprofile WHERE value IS NOT NULL) WHERE k = 1"
_VGRID = "SELECT variable, quantile_cont(peak_lag, 0.5) AS median_peak_lag, quantile_cont(duration, 0.5) AS median_duration, quantile_cont(recovery, 0.5) AS median_recovery, quantile_cont(recovery, 0.9) AS p90_recovery FROM (SELECT variable, cell_id, arg_max(lag, (abs(value), -lag)) FILTER (value IS NOT NULL) AS peak_lag, count(*) FILTER (abs(value) > 0.2) AS duration, coalesce(min(lag) FILTER (abs(value) > 0.2 AND lag >= 0) + 1, 0) AS recovery FROM vcomp GROUP BY ALL HAVING count(value) > 0) GROUP BY variable"
_VMEMORY = "SELECT variable, quantile_cont(CASE WHEN r1 > 0 THEN -1 / ln(r1) END, 0.5) AS median_memory FROM (SELECT variable, cell_id, greatest(least(avg(p) / nullif(avg(value * value), 0), 0.99), -0.99) AS r1 FROM (SELECT *, value * lag(value) OVER (PARTITION BY variable, cell_id ORDER BY t) AS p FROM vanom) GROUP BY ALL) GROUP BY variable"
_VCORR = "SELECT variable, lag AS best_lag, r AS best_corr FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY abs(r) DESC, lag) AS k FROM (SELECT a.variable, l.lag, corr(a.y, b.x) AS r FROM lags l CROSS JOIN vjoin a JOIN vjoin b ON a.variable = b.variable AND b.rn = a.rn - l.lag GROUP BY ALL) WHERE r IS NOT NULL) WHERE k = 1"


@query(
    "q55_lag_cascade_table",
    f"SELECT variable, peak_lag, {s6('peak_amplitude')} AS peak_amplitude, {s6('median_peak_lag')} AS median_peak_lag, {s6('median_duration')} AS median_duration, {s6('median_recovery')} AS median_recovery, {s6('p90_recovery')} AS p90_recovery, {s6('median_memory')} AS median_memory, best_lag, {s6('best_corr')} AS best_corr FROM ({_VPEAK}) LEFT JOIN ({_VGRID}) USING (variable) LEFT JOIN ({_VMEMORY}) USING (variable) LEFT JOIN ({_VCORR}) USING (variable)",
)
def lag_cascade_table(spark: SparkSession, d: str) -> DataFrame:
    """When and how long each variable answers to warm events."""
    series = vanom(spark, d)
    composite = epochs.composite(epochs.epochs(series, anchors(event_table(spark, d, "warm")), LAG_MIN, LAG_MAX), ["variable", "cell_id"])
    df = tables.lag_cascade_table(composite, series, index_series(spark, d), geography(spark, d), LAG_MIN, LAG_MAX, 0.2)
    plain = ("variable", "peak_lag", "best_lag")
    return out(df, *plain, **{c: c for c in df.columns if c not in plain})


_NUM_EVENTS = f"SELECT '{{' || string_agg('\"' || phase || '\":{{\"n_events\":' || n || ',\"mean_peak\":' || p || ',\"last_year\":' || y || '}}', ',' ORDER BY phase) || '}}' AS e FROM (SELECT phase, count(*) AS n, {ctes.fixed('avg(abs(peak))', 3)} AS p, max(event_year) AS y FROM catalogue GROUP BY phase)"
_NUM_LAGS = f"SELECT '{{' || string_agg('\"' || variable || '\":{{\"peak_lag\":' || peak_lag || ',\"best_lag\":' || best_lag || ',\"median_recovery\":' || r || '}}', ',' ORDER BY variable) || '}}' AS l FROM (SELECT variable, peak_lag, best_lag, {ctes.fixed('median_recovery', 3)} AS r FROM ({_VPEAK}) LEFT JOIN ({_VGRID}) USING (variable) LEFT JOIN ({_VCORR}) USING (variable))"
_NUM_MASK = f"SELECT '{{\"n_cells\":' || count(*) || ',\"frac_robust\":' || {ctes.fixed('avg(robust::INT)', 3)} || '}}' AS m FROM robust"


@query("q56_numbers_document", f"SELECT '{{\"events\":' || e || ',\"lag_cascade\":' || l || ',\"significance\":' || m || ',\"stations\":null}}' AS numbers FROM ({_NUM_EVENTS}) CROSS JOIN ({_NUM_LAGS}) CROSS JOIN ({_NUM_MASK})")
def numbers_document(spark: SparkSession, d: str) -> DataFrame:
    """What a text quotes: events, the lag cascade and significance as one JSON document; a table that is empty is null."""
    found = event_table(spark, d)
    counts_ = found.groupBy("phase").agg(F.count(F.lit(1)).alias("n_events"), fixed(F.avg(F.abs("peak")), 3).alias("mean_peak"), F.max("event_year").alias("last_year"))
    lags = lag_cascade_table(spark, d).select("variable", "peak_lag", "best_lag", fixed("median_recovery", 3).alias("median_recovery"))
    mask = robust(spark, d).agg(F.count(F.lit(1)).alias("n_cells"), fixed(F.avg(F.col("robust").cast("double")), 3).alias("frac_robust"))
    stations = counts_.where("n_events < 0")
    return sinks.numbers({"events": (counts_, "phase"), "lag_cascade": (lags, "variable"), "significance": (mask, None), "stations": (stations, "phase")})


@query("q57_response_profile", f"SELECT lag, {s6('sum(abs(value) * area) / nullif(sum(area) FILTER (value IS NOT NULL), 0)')} AS value, count(value) AS n_cells FROM comp JOIN geo USING (cell_id) WHERE cell_id IN (SELECT cell_id FROM agree WHERE agreement >= 0.6) GROUP BY lag")
def response_profile(spark: SparkSession, d: str) -> DataFrame:
    """How strongly the cells are moved in which most members agree, by lag."""
    found = event_table(spark, d)
    mask = agreement(spark, d, found).select("cell_id", (F.col("agreement") >= 0.6).alias("robust"))
    return out(tables.response_profile(epochs.composite(epoch(spark, d, found=found), CELL), mask, geography(spark, d), []), "lag", "n_cells", value="value")


@query(
    "q58_exceedance",
    f"SELECT region, {s6('avg((abs(s) > k * abs(r))::INT)')} AS share_above, count(*) AS n_regions FROM (SELECT region, s, r, {_AMPS} AS k FROM (SELECT cell_id, avg(value) AS s FROM resp GROUP BY ALL) JOIN (SELECT cell_id, avg(value) AS r FROM cresp GROUP BY ALL) USING (cell_id) JOIN cells USING (cell_id) WHERE s IS NOT NULL AND abs(r) > 0.05) GROUP BY region",
)
def exceedance(spark: SparkSession, d: str) -> DataFrame:
    """The share of each region's cells whose warm response is above the scaled cold one."""
    size = {r["phase"]: r["a"] for r in event_table(spark, d).groupBy("phase").agg(F.avg(F.abs("peak")).alias("a")).collect()}
    wide = regions.amplification(phase_means(spark, d), CELL, "warm", "cold").join(cells(spark, d).select("cell_id", "region"), "cell_id")
    return out(tables.exceedance(wide, ["region"], size["warm"] / size["cold"], "warm", "cold"), "region", "n_regions", share_above="share_above")
