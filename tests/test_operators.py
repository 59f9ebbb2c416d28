"""Analytic cases: known answers, edges and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.functions import calendar, numeric, special, units
from lagwise.model import clean, complete, month_of
from lagwise.operators import climatology, epochs, evaluation, events, extremes, index, inference, regions, response, tables


def series(spark, values, start=1950 * 12, **keys):
    rows = [(start + k, None if v is None else float(v), *keys.values()) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "t int, value double" + "".join(f", {k} {'int' if isinstance(v, int) else 'string'}" for k, v in keys.items()))
    return df.withColumns(month_of("t"))


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*(cols[:-1] or cols)).collect()]


def test_season_codes():
    assert calendar.season_lags("DJF01") == (0, 1, 2)
    assert calendar.season_lags("JJA0") == (-6, -5, -4)
    assert calendar.season_lags("SON0") == (-3, -2, -1)
    assert calendar.season_lags("MAM1") == (3, 4, 5)
    assert calendar.season_lags("DJF1") == (12, 13, 14)
    for bad in ("djf1", "XYZ0", "DJF", "DJF123"):
        with pytest.raises(ValueError):
            calendar.season_lags(bad)


def test_season_labels_and_classes(spark):
    df = spark.createDataFrame([(1, 0.2), (7, -1.2), (12, 2.5)], "m int, p double")
    assert values(df.select("m", calendar.season_label("m").alias("s"), calendar.amplitude_class("p").alias("c")), "m", "s", "c") == [(1, "DJF", "none"), (7, "JJA", "moderate"), (12, "NDJ", "super")]


def test_units(spark):
    df = spark.createDataFrame([(1.0, "kg m-2 s-1"), (1.0, "mm/day"), (1.0, "furlong"), (300.0, "K")], "v double, u string")
    assert [r[0] for r in df.select(units.to_mm_per_day(F.col("v"), F.col("u"))).collect()] == [86400.0, 1.0, 1.0, 300.0]
    assert df.where("u = 'K'").select(units.to_celsius(F.col("v"), F.col("u"))).first()[0] == pytest.approx(26.85)
    lon = spark.createDataFrame([(0.0,), (180.0,), (181.0,), (359.5,)], "x double").select(units.wrap_longitude(F.col("x")))
    assert [r[0] for r in lon.collect()] == [0.0, -180.0, -179.0, -0.5]


def test_cell_areas_cover_the_earth(spark):
    total = spark.range(360).select(units.cell_area(-89.75 + F.col("id") * 0.5, 0.5, 0.5).alias("a")).agg(F.sum("a")).first()[0] * 720
    assert total == pytest.approx(510.1e12, rel=2e-3)


def test_nan_becomes_null_and_calendars_fill(spark):
    df = spark.createDataFrame([(1, 24000, float("nan")), (1, 24002, 2.0)], "k int, t int, v double").select("k", "t", clean("v").alias("value"))
    assert values(complete(df, ["k"]), "t", "value") == [(24000, None), (24001, None), (24002, 2.0)]


def test_moving_climatology_is_a_direct_window(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40 * 12)
    df = climatology.moving_climatology(series(spark, x, k=1), ["k"], 10, 7)
    got = {(r.year, r.month): (r.clim_mean, r.clim_std) for r in df.collect()}
    for year in (1950, 1953, 1960, 1989):
        own = [x[(y - 1950) * 12] for y in range(max(1950, year - 5), min(1989, year + 4) + 1)]
        mean, std = got[year, 1]
        if len(own) < 7:
            assert mean is None
        else:
            assert (mean, std) == (pytest.approx(np.mean(own)), pytest.approx(np.std(own, ddof=1)))


def test_standardised_anomalies(spark):
    rng = np.random.default_rng(1)
    x = [10 + 2 * math.sin(2 * math.pi * k / 12) + 0.01 * k / 12 + rng.normal() for k in range(100 * 12)]
    got = climatology.anomalies(series(spark, x, k=1), ["k"], window_years=30, min_years=20)
    mean, sd = got.agg(F.avg("value"), F.stddev("value")).first()
    assert abs(mean) < 0.05 and abs(sd - 1) < 0.1
    by_month = [r[0] for r in got.groupBy("month").agg(F.avg("value").alias("m")).select("m").collect()]
    assert max(map(abs, by_month)) < 0.15
    flat = climatology.anomalies(series(spark, [5.0] * 480, k=1), ["k"])
    assert flat.where("value is not null").count() == 0
    with pytest.raises(ValueError):
        climatology.anomalies(flat, ["k"], "odd")
    with pytest.raises(ValueError):
        climatology.require_record(series(spark, [1.0] * 60, k=1), 20)


def test_percent_of_zero_climatology_is_null(spark):
    got = climatology.anomalies(series(spark, [0.0] * 24, k=1), ["k"], "percent", "fixed")
    assert got.where("value is not null").count() == 0


def test_detrend_and_accumulate(spark):
    ramp = climatology.linear_detrend(series(spark, [0.5 * k for k in range(60)], k=1), ["k"])
    assert ramp.agg(F.max(F.abs("value"))).first()[0] < 1e-9
    got = climatology.accumulate(series(spark, [1, 2, None, 4, 5, 6], k=1), ["k"], 3)
    assert [r[1] for r in values(got, "t", "value")] == [None, None, None, None, None, 5.0]


def test_standardised_indices_are_normal(spark):
    rng = np.random.default_rng(2)
    x = rng.gamma(2.0, 3.0, size=80 * 12)
    df = series(spark, x, k=1)
    for kind in ("gamma", "empirical"):
        z = np.array([r[0] for r in climatology.standardized_index(df, ["k"], 1, kind).select("value").collect()], float)
        assert abs(np.nanmean(z)) < 0.05 and abs(np.nanstd(z) - 1) < 0.06 and abs(np.nanmean(z < -1) - 0.16) < 0.03
    few = climatology.gamma_index(series(spark, [1.0, 2.0] * 30, k=1), ["k"])
    assert few.where("value is not null").count() == 0


def test_special_functions():
    assert numeric.digamma(1.0)[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert numeric.trigamma(1.0)[0] == pytest.approx(math.pi**2 / 6, abs=1e-10)
    assert numeric.log_gamma(5.0)[0] == pytest.approx(math.log(24), abs=1e-12)
    assert numeric.gamma_cdf(np.array([1.0, 1.0]), np.array([0.5, 5.0])) == pytest.approx(1 - np.exp([-0.5, -5.0]), abs=1e-12)
    assert numeric.gamma_cdf(np.array([0.5]), np.array([2.0]))[0] == pytest.approx(math.erf(math.sqrt(2)), abs=1e-12)
    x = np.random.default_rng(0).gamma(2.5, 1.0, 200_000)
    assert numeric.gamma_shape(np.array([x.mean()]), np.array([np.log(x).mean()]))[0] == pytest.approx(2.5, rel=0.02)


def test_threshold_counts_are_null_without_values(spark):
    df = series(spark, [-2, None, 3], k=1).unionByName(series(spark, [None, None], k=2))
    assert values(climatology.threshold_counts(df, ["k"], -1.0), "k", "n_months") == [(1, 1), (2, None)]


def test_sliding_base_removes_a_trend(spark):
    got = index.sliding_base_anomaly(series(spark, [0.02 * k / 12 for k in range(100 * 12)]), [], 30, 5)
    inside = got.where("year between 1965 and 2030").agg(F.max(F.abs("value"))).first()[0]
    assert inside < 0.06
    fixed = index.fixed_base_anomaly(series(spark, [0.02 * k / 12 for k in range(100 * 12)]), [], (1950, 1979))
    assert fixed.where("year = 2049").agg(F.avg("value")).first()[0] > 1.5


def test_events(spark):
    x = [0.0] * 12 + [0, 0, 0, 0, 0, 0, 0, 0, 0.6, 0.9, 1.2, 2.3] + [2.3, 0.8, 0.6] + [0.0] * 9 + [0.7] * 4 + [0.0] * 20 + [-1.1] * 6 + [0.0] * 5
    df = index.running_mean(series(spark, x, start=1996 * 12), [], 1)
    found = events.catalogue(df, []).collect()
    warm = [r for r in found if r.phase == "warm"]
    assert len(warm) == 1 and warm[0].event_year == 1997 and warm[0].label == "1997/98" and warm[0].amplitude == "super" and warm[0].length == 7
    assert warm[0].peak_t == 1997 * 12 + 11 and warm[0].djf == 2.3 and not warm[0].presatellite
    cold = [r for r in found if r.phase == "cold"]
    assert len(cold) == 1 and cold[0].length == 6 and cold[0].amplitude == "moderate"


def test_runs_cross_gaps(spark):
    df = series(spark, [1, 1, None, 1, 0, 1])
    got = events.runs(df, [], F.col("value") > 0).groupBy("run").count()
    assert sorted(r["count"] for r in got.collect()) == [1, 3]


def test_sample_flags_and_selection(spark):
    found = spark.createDataFrame([(1940, "warm", "strong", True), (1972, "warm", "super", False), (1999, "cold", "strong", False), (2014, "warm", "moderate", False)], "event_year int, phase string, amplitude string, presatellite boolean")
    flagged = events.sample_flags(found, 1901, 2016, 10, use_presatellite=False)
    years = lambda kind, only=True: sorted(r.event_year for r in events.select_class(flagged, kind, only).collect())
    assert years("super") == [1972] and years("reference") == [2014] and years("reference", False) == [1940, 2014]
    assert years("all_cold") == [1999] and years("cold_strong") == [1999] and years("all_warm") == [1972, 2014]


def test_epochs_recover_a_signal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600) * 0.3
    peaks = [100, 220, 350, 480]
    for p in peaks:
        x[p : p + 3] += 2
    anchors = spark.createDataFrame([(k, 1950 * 12 + p) for k, p in enumerate(peaks)], "event_year int, anchor_t int")
    comp = dict(values(epochs.composite(epochs.epochs(series(spark, x, k=1), anchors, -6, 6), ["k"]), "lag", "value"))
    assert all(abs(comp[k] - 2) < 0.5 for k in (0, 1, 2)) and abs(comp[-4]) < 0.5
    with pytest.raises(ValueError):
        epochs.require_overlap(epochs.epochs(series(spark, x, k=1), anchors.withColumn("anchor_t", F.lit(0)), -1, 1))


def test_eligible_anchors(spark):
    years = spark.createDataFrame([(y,) for y in range(1990, 2000)], "anchor_t int")
    out = spark.createDataFrame([(1992,), (1999,)], "anchor_t int")
    assert values(epochs.eligible(years, out, 1), "anchor_t") == [(y,) for y in (1990, 1994, 1995, 1996, 1997)]


def pool_of(spark, n_years=40, n_cells=30, signal=0.0, event_years=(3, 11, 19, 27)):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n_years, n_cells))
    v[list(event_years)] += signal
    rows = [(y, c, None if c == 0 and y % 3 == 0 else float(v[y, c])) for y in range(n_years) for c in range(n_cells)]
    pool = spark.createDataFrame(rows, "anchor_t int, cell_id int, value double")
    ev = spark.createDataFrame([(y,) for y in event_years], "anchor_t int")
    return pool, ev, pool.select("anchor_t").distinct().join(ev, "anchor_t", "left_anti")


def test_blocked_test_equals_the_join(spark):
    pool, ev, neutral = pool_of(spark)
    a = inference.mc_test(pool, ["cell_id"], ev, neutral, 60, 7).orderBy("cell_id").collect()
    b = inference.mc_test_blocked(pool, ["cell_id"], [r[0] for r in ev.collect()], [r[0] for r in neutral.collect()], 60, 7, cells_a_block=3).orderBy("cell_id").collect()
    for x, y in zip(a, b, strict=True):
        assert [x.cell_id, x.composite, x.p_value, x.null_mean, x.null_std] == pytest.approx([y.cell_id, y.composite, y.p_value, y.null_mean, y.null_std])


def test_monte_carlo_finds_signals_only(spark):
    strong = inference.mc_test(*((p := pool_of(spark, signal=3.0))[0], ["cell_id"], p[1], p[2]), 200, 1)
    assert strong.where("p_value > 0.05").count() == 0
    noise = inference.mc_test(*((p := pool_of(spark))[0], ["cell_id"], p[1], p[2]), 200, 1)
    assert noise.where("p_value < 0.05").count() <= 5
    with pytest.raises(ValueError):
        inference.mc_test(p[0], ["cell_id"], p[1], p[2].limit(2), 10, 1)
    with pytest.raises(ValueError):
        inference.mc_test(p[0], ["cell_id"], p[1].withColumn("anchor_t", F.lit(999)), p[2], 10, 1)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.02, 0.04, 0.5, 0.9, 1.0)], "p_value double")
    assert inference.bh_threshold(df, alpha=0.1).first()[0] == 0.04
    assert inference.fdr_mask(df, alpha=0.1).where("significant").count() == 3
    assert inference.fdr_mask(df.where("p_value > 0.3"), alpha=0.1).where("significant").count() == 0


def test_agreement_and_robustness(spark):
    rows = [(1, m, v) for m, v in enumerate((1.0, 2.0, 1.5))] + [(2, m, v) for m, v in enumerate((1.0, -2.0, 0.5))] + [(3, 0, 1.0), (3, 1, None), (3, 2, 1.0)]
    got = inference.sign_agreement(spark.createDataFrame(rows, "cell_id int, model int, value double"), ["cell_id"])
    assert values(got, "cell_id", "n_models", "agreement") == [(1, 3, 1.0), (2, 3, pytest.approx(1 / 3)), (3, 2, 1.0)]
    test = spark.createDataFrame([(k, 0.001, 1.0) for k in (1, 2, 3)], "cell_id int, p_value double, composite double")
    assert values(inference.robust_mask(got, test, ["cell_id"]), "cell_id", "robust") == [(1, True), (2, False), (3, False)]


def test_bootstrap_brackets_the_mean(spark):
    df = spark.createDataFrame([(1, e, float(e % 5)) for e in range(40)], "cell_id int, event_year int, value double")
    r = inference.bootstrap_ci(df, ["cell_id"], 200, 3).first()
    assert r.ci_low < r.mean == 2.0 < r.ci_high
    same = inference.paired_difference(df, df, ["cell_id"], 50, 3).first()
    assert same.difference == 0 and same.p_value == 1.0


def test_an_interval_does_not_depend_on_other_keys(spark):
    rng = np.random.default_rng(6)
    rows = [(c, 1900 + e, None if c == 1 and e % 5 else float(rng.normal())) for c in (1, 2, 3) for e in range(20)] + [(4, 1900, None)]
    df = spark.createDataFrame(rows, "cell_id int, event_year int, value double")
    both = {r.cell_id: r for r in inference.bootstrap_ci(df, ["cell_id"], 150, 5).collect()}
    alone = inference.bootstrap_ci(df.where("cell_id = 1"), ["cell_id"], 150, 5, cells_a_block=1).first()
    assert both[1] == alone and both[4].ci_low is None and both[4].mean is None
    for c in (1, 2):
        own = [v for k, _, v in rows if k == c and v is not None]
        means = [np.mean([own[inference.pick(5, i, s, len(own))] for s in range(len(own))]) for i in range(150)]
        assert (both[c].mean, both[c].ci_low, both[c].ci_high) == pytest.approx((np.mean(own), *np.percentile(means, [5, 95])))


def test_differences_against_plain_resampling(spark):
    rng = np.random.default_rng(7)
    rows = [(s, c, 1950 + e, None if (c + e) % 6 == 0 else float(rng.normal() + 0.4 * s)) for s in (0, 1) for c in range(5) for e in range(9 + s)]
    rows += [(0, 9, 1950, 1.0), (0, 8, 1950, None), (1, 8, 1951, None)]
    df = spark.createDataFrame(rows, "side int, cell_id int, event_year int, value double")
    a, b = (df.where(F.col("side") == s).drop("side") for s in (0, 1))
    value = {(s, c, e): v for s, c, e, v in rows}
    mean = lambda s, c, events: np.mean(v) if (v := [value[s, c, e] for e in events if value.get((s, c, e)) is not None]) else math.nan
    events = [sorted({e for t, _, e, _ in rows if t == s}) for s in (0, 1)]
    draw = lambda items, seed: [[items[inference.pick(seed, i, k, len(items))] for k in range(len(items))] for i in range(60)]
    got = {r.cell_id: r for r in inference.bootstrap_difference(a, b, ["cell_id"], 60, 3, 0.7, cells_a_block=2).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 8}  # cell 9 is on one side only
    assert got[8].excess is None and got[8].p_value == 1.0 and got[8].sd is None
    for c in range(5):
        excess = mean(0, c, events[0]) - 0.7 * mean(1, c, events[1])
        drawn = np.array([mean(0, c, x) - 0.7 * mean(1, c, y) for x, y in zip(draw(events[0], 3), draw(events[1], 4), strict=True)])
        drawn = drawn[np.isfinite(drawn)]
        cross = (drawn <= 0).sum() if excess >= 0 else (drawn >= 0).sum()
        assert (got[c].excess, got[c].p_value, got[c].sd) == pytest.approx((excess, min(1, 2 * (cross + 1) / (len(drawn) + 1)), drawn.std()))
    got = {r.cell_id: r for r in inference.paired_difference(a, b, ["cell_id"], 60, 3, cells_a_block=2).collect()}
    common = sorted({e for s, c, e, _ in rows if s == 0 and (1, c, e) in value})
    for c in range(5):
        off = {e: value[0, c, e] - value[1, c, e] for e in events[0] if value.get((0, c, e)) is not None and value.get((1, c, e)) is not None}
        one = lambda items: np.mean(v) if (v := [off[e] for e in items if e in off]) else math.nan  # noqa: B023, E731
        drawn = np.array([one(x) for x in draw(common, 3)])
        cross = (drawn <= 0).sum() if one(common) >= 0 else (drawn >= 0).sum()
        assert (got[c].difference, got[c].n_events, got[c].p_value) == pytest.approx((one(common), len(off), min(1, 2 * (cross + 1) / (np.isfinite(drawn).sum() + 1))))


def test_families_have_their_own_thresholds(spark):
    ps = {"a": (0.01, 0.02, 0.04, 0.5, 0.9, 1.0), "b": (0.3, 0.4, None), None: (0.001,), "c": (None,)}
    df = spark.createDataFrame([(f, p) for f, own in ps.items() for p in own], "family string, p_value double")
    got = {(r.family, r.p_value): r for r in inference.fdr_mask(df, by=["family"]).collect()}
    assert got["a", 0.04].threshold == 0.04 and got["b", 0.3].threshold == 0 and got[None, 0.001].significant and got["c", None].threshold == 0
    assert sum(r.significant for r in got.values()) == 4 and len(got) == 11


def test_cross_correlation_against_plain_shifts(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=40), rng.normal(size=40)
    y[[3, 4, 17]] = np.nan
    df = spark.createDataFrame([(1, t, None if np.isnan(v) else float(v)) for t, v in enumerate(y)] + [(2, 5, 1.0), (2, 6, 2.0)], "k int, t int, value double")
    got = {(r.k, r.lag): r for r in response.cross_correlation(df, ["k"], spark.createDataFrame([(t, float(v)) for t, v in enumerate(x)], "t int, value double"), -3, 5).collect()}
    ok = ~np.isnan(y)
    a, b = y[ok], x[ok]
    for lag in range(-3, 6):
        p, q = (a[lag:], b[: len(b) - lag]) if lag >= 0 else (a[:lag], b[-lag:])
        assert got[1, lag].corr == pytest.approx(np.corrcoef(p, q)[0, 1]) and got[1, lag].n == len(p)
    assert {lag for k, lag in got if k == 2} == {-1, 0, 1}


def test_variance_partition(spark):
    rng = np.random.default_rng(1)
    rows = [(c, m, e, float(rng.normal() + (3 * m if c == 1 else 0))) for c in (1, 2) for m in range(4) for e in range(5)]
    got = {r.cell_id: r for r in response.variance_partition(spark.createDataFrame(rows + [(3, 0, 0, None)], "cell_id int, model int, event_year int, value double"), ["cell_id"]).collect()}
    for c in (1, 2):
        assert got[c].frac_model + got[c].frac_event + got[c].frac_rest == pytest.approx(1.0)
    assert got[1].frac_model > 0.8 and got[3].frac_model is None


def test_leave_one_out(spark):
    rows = [("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 10.0), ("a", 2, 1.0), ("b", 2, 1.0), ("c", 2, 10.0)]
    df = spark.createDataFrame(rows, "model string, cell_id int, value double")
    got = {r.left_out: r for r in response.leave_one_out(df, "model", ["cell_id"], F.lit(1.0)).collect()}
    assert got["c"].mean == 1.0 and got["a"].mean == 5.5 and got["a"].full_mean == 4.0 and got["c"].flagged and not got["a"].flagged


def test_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=120) * 1.5
    rows = [(1, k, float(v), float(1 + 2 * v + 0.5 * v * v)) for k, v in enumerate(x)] + [(2, k, float(v), float(v)) for k, v in enumerate(x[:5])]
    q = {r.cell_id: r for r in response.quadratic_fit(spark.createDataFrame(rows, "cell_id int, i int, index double, value double"), ["cell_id"]).collect()}
    assert (q[1].b0, q[1].b1, q[1].b2, q[1].r2) == pytest.approx((1, 2, 0.5, 1)) and q[2].b1 is None
    y = lambda v: 0.5 + v + 2 * max(v - 1.5, 0) + 0.3 * min(v + 1.5, 0)
    rows = [(c, k, float(v), None if c == 2 and k % 4 == 0 else float(y(v))) for c in (1, 2) for k, v in enumerate(x)]
    h = {r.cell_id: r for r in response.hinge_fit(spark.createDataFrame(rows, "cell_id int, anchor_t int, index double, value double"), ["cell_id"], iterations=30, cells_a_block=1).collect()}
    for c in (1, 2):
        assert (h[c].b0, h[c].slope, h[c].warm, h[c].cold, h[c].ratio) == pytest.approx((0.5, 1, 2, 0.3, 2)) and h[c].p_value == float(c == 2) and h[c].steepening


def test_peaks_durations_and_memory(spark):
    comp = spark.createDataFrame([(1, k, v) for k, v in enumerate((0.0, 0.6, 0.7, 0.0, 0.9, 0.0))] + [(2, 0, None)], "cell_id int, lag int, value double")
    assert values(response.peak_lag(comp, ["cell_id"]), "cell_id", "peak_lag", "peak_value") == [(1, 4, 0.9), (2, None, None)]
    d = response.duration_recovery(comp, ["cell_id"]).orderBy("cell_id").first()
    assert (d.duration_months, d.recovery_months_first, d.recovery_months_last, d.consecutive_months) == (3, 2, 5, 1)
    rng = np.random.default_rng(0)
    x = [0.0]
    for _ in range(2000):
        x.append(0.7 * x[-1] + rng.normal())
    assert response.ar1_memory(series(spark, x, k=1), ["k"]).first().r1 == pytest.approx(0.7, abs=0.05)


def test_cross_correlation_finds_the_lag(spark):
    x = np.random.default_rng(4).normal(size=200)
    idx, y = series(spark, x).select("t", "value"), series(spark, np.roll(x, 3), k=1)
    best = response.best_correlation(response.cross_correlation(y, ["k"], idx, -2, 6), ["k"]).first()
    assert best.best_lag == 3 and best.best_corr > 0.95


def test_regions(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, None, 5.0), (4, 7.0, 0.0)], "cell_id int, value double, area double")
    reg = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "cell_id int, region int")
    assert values(regions.region_aggregate(df, reg, []), "region", "value") == [(1, 2.0), (2, None)]
    assert values(regions.region_aggregate(df, reg, [], "sum"), "region", "value") == [(1, 4.0), (2, 0.0)]
    assert values(regions.region_aggregate(df, reg, [], "max"), "region", "value") == [(1, 3.0), (2, None)]
    assert values(regions.outlet_cells(df, reg), "region", "cell_id") == [(1, 2), (3, 4)]


def test_polygons_with_a_hole(spark):
    ring = lambda r, a, b: [(r, *p, *q) for p, q in zip([(a, a), (b, a), (b, b), (a, b)], [(b, a), (b, b), (a, b), (a, a)], strict=True)]
    edges = spark.createDataFrame([tuple(float(x) if k else x for k, x in enumerate(e)) for e in ring(1, 0, 10) + ring(1, 4, 6)], "region int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(1, 2.5, 2.5), (2, 5.0, 5.0), (3, 12.0, 5.0)], "cell_id int, lat double, lon double")
    assert values(regions.regions_of_polygons(cells, edges), "cell_id", "region") == [(1, 1)]


def test_exposure_and_nearest_year(spark):
    df = spark.createDataFrame([(1, -2.0, True, 2e6, 10.0), (1, -2.0, False, 1e6, 5.0), (1, 1.0, True, 3e6, 7.0), (1, None, None, 1e6, 9.0)], "k int, value double, robust boolean, area double, population double")
    assert tuple(regions.exposure(df, ["k"], 1.0).first()) == (1, 2.0, 3.0, 10.0, 7.0)
    years = spark.createDataFrame([(1990,), (2000,)], "year int")
    ev = spark.createDataFrame([(1995,), (1996,), (2015,)], "event_year int")
    assert values(regions.nearest_year(ev, years), "event_year", "year") == [(1995, 1990), (1996, 2000), (2015, 2000)]


def test_window_counts_skip_short_windows(spark):
    df = series(spark, [-2, -2, 2, None, -2, -2], k=1)
    anchors = spark.createDataFrame([(1, 1950 * 12), (2, 1950 * 12 + 5)], "event_year int, anchor_t int")
    r = extremes.window_counts(df, ["k"], anchors, 0, 3).first()
    assert (r.dry_months, r.wet_months, r.least, r.largest, r.n_events) == (2.0, 1.0, -2.0, 2.0, 1)


def test_odds(spark):
    p = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 0.0)], "k int, share double")
    q = spark.createDataFrame([(1, 0.2), (2, 0.0), (3, 0.5)], "k int, share double")
    got = dict(values(extremes.odds_ratio(p, q, ["k"]), "k", "odds_ratio"))
    assert got[1] == pytest.approx(4.0) and got[2] is None and got[3] == pytest.approx(1e-4 / (1 - 1e-4))


def test_evaluation(spark):
    grid = spark.createDataFrame([(float(a), float(b), None if (a, b) == (2, 2) else float(a + 10 * b)) for a in range(3) for b in range(3)], "lat double, lon double, value double")
    pts = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.5, 1.5), (3, 1.0, 1.0)], "p int, lat double, lon double")
    assert values(evaluation.bilinear(pts, grid, "p", 1.0), "p", "value") == [(1, 3.0), (2, None), (3, 11.0)]
    lag = lambda f: spark.createDataFrame([(1, k, float(f(k))) for k in range(8)], "s int, lag int, value double")
    r = evaluation.composite_agreement(lag(lambda k: k), lag(lambda k: 2 * k + 1), ["s"]).first()
    assert r.r == pytest.approx(1.0) and r.peak_observed == 7 and r.same_sign


def test_anomalies_detrend_before_scaling_and_refuse_short_records(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=30 * 12) * (1 + np.arange(360) % 12) + 0.05 * np.arange(360)
    df = series(spark, x, k=1)
    got = [r[1] for r in values(climatology.anomalies(df, ["k"], "standardized", "fixed", base=(1950, 1979), detrend=True), "t", "value")]
    month = np.arange(360) % 12
    diff = x - np.array([x[month == m].mean() for m in month])
    t = np.arange(360.0)
    line = np.polyval(np.polyfit(t, diff, 1), t)
    assert got == pytest.approx((diff - line) / np.array([x[month == m].std() for m in month]))
    plain = [r[1] for r in values(climatology.anomalies(df, ["k"], "standardized", "none"), "t", "value")]
    assert plain == pytest.approx(x)
    assert {r[1] for r in values(climatology.anomalies(df, ["k"], "percent", "none"), "t", "value")} == {None}
    with pytest.raises(Exception, match="at least 40 are needed"):
        climatology.anomalies(df, ["k"], window_years=40, min_years=40).collect()


def test_blocked_test_counts_the_events_in_the_pool(spark):
    pool, ev, neutral = pool_of(spark)
    years, rest = [r[0] for r in ev.collect()], [r[0] for r in neutral.collect()]
    a = inference.mc_test(pool, ["cell_id"], ev.unionAll(spark.createDataFrame([(999_999,)], ev.schema)), neutral, 40, 7).orderBy("cell_id").collect()
    b = inference.mc_test_blocked(pool, ["cell_id"], [*years, 999_999], rest, 40, 7).orderBy("cell_id").collect()
    assert [(x.p_value, x.n_events) for x in a] == [(y.p_value, y.n_events) for y in b]
    with pytest.raises(ValueError):
        inference.mc_test_blocked(pool, ["cell_id"], [999_999], rest, 40, 7)


def test_hinge_draws_need_items_beyond_both_knots(spark):
    x = [0.1 * k for k in range(-10, 21)]  # two above 1.8, none below -1.8
    rows = [(1, k, v, 2 * v) for k, v in enumerate(x)]
    h = response.hinge_fit(spark.createDataFrame(rows, "cell_id int, anchor_t int, index double, value double"), ["cell_id"], knot=1.8, iterations=20).first()
    assert h.n_draws == 0 and h.b0 is None and h.p_value is None  # the cold hinge is nowhere: the design has no full rank
    short = [(1, k, float(v), 1 + float(v)) for k, v in enumerate((-3, -2.5, -2, -1, 0, 0.5, 1, 2, 2.5, 3))]
    h = response.hinge_fit(spark.createDataFrame(short, "cell_id int, anchor_t int, index double, value double"), ["cell_id"], iterations=20, evaluate_at=1.0).first()
    assert (h.b0, h.slope, h.excess) == pytest.approx((1, 1, 0)) and h.n == 10  # complete cells are fitted whatever their number of items


def test_the_nearest_cell_is_found_however_far_it_is(spark):
    rng = np.random.default_rng(9)
    # Land alone: two islands on a grid of 2 degrees, and points all over, some without a place.
    cells = [(k, float(lat), float(lon)) for k, (lat, lon) in enumerate([(a, b) for a in range(-60, -40, 2) for b in range(-170, -150, 2)] + [(a, b) for a in range(50, 60, 2) for b in range(100, 140, 2)])]
    points = [(k, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for k in range(120)] + [(200, -41.0, -151.0), (201, None, 3.0)]
    got = regions.nearest_cell(spark.createDataFrame(points, "station int, lat double, lon double"), spark.createDataFrame(cells, "cell_id int, lat double, lon double"), "station", 2.0)
    want = {k: None if lat is None else min(cells, key=lambda c: ((lat - c[1]) ** 2 + (lon - c[2]) ** 2, c[0]))[0] for k, lat, lon in points}  # noqa: B023
    assert {r.station: r.cell_id for r in got.collect()} == want and got.count() == len(points)
    nothing = regions.nearest_cell(spark.createDataFrame(points[:2], "station int, lat double, lon double"), spark.createDataFrame([], "cell_id int, lat double, lon double"), "station", 90.0)
    assert [r.cell_id for r in nothing.collect()] == [None, None]


def test_normal_quantile_as_a_column(spark):
    from statistics import NormalDist

    p = [1e-30, 1e-12, 1e-6, 0.01, 0.074, 0.076, 0.3, 0.5, 0.77, 0.925, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, -1.0, None]], "p double").select("p", special.normal_quantile("p").alias("z")).collect()
    assert [r.z for r in got[: len(p)]] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-13)
    assert [r.z for r in got[len(p) :]] == [None] * 4


def test_yearly_responses_take_the_index_after_each_anchor(spark):
    x = np.arange(40 * 12, dtype=float)
    field, index_ = series(spark, x, k=1), series(spark, 1000 + x).select("t", "value")
    got = tables.yearly_responses(field, ["k"], calendar.season_table(spark, ["DJF01"]), index_, -3, 6)
    rows = {r.anchor_t: r for r in got.collect()}
    assert sorted(rows) == [y * 12 + 11 for y in range(1952, 1987)]  # two years after the first, three before the last
    for t, r in rows.items():
        assert r.value == t + 1 - 1950 * 12 and r["index"] == 1000 + t + 1 - 1950 * 12
    assert tables.yearly_responses(field, ["k"], calendar.season_table(spark, ["DJF01"]), index_, -3, 6, least=36).count() == 0


def test_nonlinearity_table_counts_by_family(spark):
    excess = spark.createDataFrame([("a", "s", 1, 1.0, 0.001), ("a", "s", 2, -1.0, 0.9), ("a", "s", 3, None, None), ("b", "s", 1, 2.0, 0.06), ("b", "s", 2, 1.0, 0.9)], "variable string, season string, cell_id int, excess double, p_value double")
    hinge = spark.createDataFrame([("a", "s", 1, 0.5, 0.1, True, 0.01), ("a", "s", 4, 1.5, 0.3, False, 0.5), ("a", "s", 2, None, None, None, None)], "variable string, season string, cell_id int, ratio double, excess_frac double, steepening boolean, p_value double")
    got = {r.variable: r for r in tables.nonlinearity_table(excess, hinge, ["cell_id"], ["variable", "season"], ["variable"], 1.5).collect()}
    a, b = got["a"], got["b"]
    assert (a.mean_excess, a.mean_abs_excess, a.frac_significant, a.frac_amplified, a.frac_steepening, a.frac_hinge_significant, a.median_ratio, a.scaling_factor) == (0, 1, 0.25, 1.0, 0.5, 0.25, 1.0, 1.5)
    assert a.median_excess_frac == pytest.approx(0.2) and b.frac_significant == 0 and b.frac_amplified is None and b.median_ratio is None


def test_profiles_and_exceedance(spark):
    comp = spark.createDataFrame([("v", 1, 0, 1.0), ("v", 2, 0, -3.0), ("v", 3, 0, 9.0), ("v", 1, 1, None), ("v", 2, 1, 2.0)], "variable string, cell_id int, lag int, value double")
    mask = spark.createDataFrame([(1, True), (2, True), (3, False)], "cell_id int, robust boolean")
    area = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 1.0)], "cell_id int, area double")
    assert values(tables.response_profile(comp, mask, area, ["variable"]), "lag", "n_cells", "value") == [(0, 2, 2.5), (1, 1, 2.0)]
    wide = spark.createDataFrame([(1, 3.0, 1.0, 3.0), (1, -1.0, 1.0, -1.0), (1, 5.0, None, None), (2, 1.0, 0.01, None)], "region int, super double, reference double, amplification double")
    assert values(tables.exceedance(wide, ["region"], 2.0), "region", "n_regions", "share_above") == [(1, 2, 0.5)]
