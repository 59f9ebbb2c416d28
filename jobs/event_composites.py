"""Composites around the events of a record, tested against neutral months: from the raw tables to what a study's figures and tables need.

    python -m jobs.event_composites --input /data/tables --output /data/results [--config my.json]

Reads orders, customer and nation (a cell is a nation, its value in a month the mean price of its orders) and writes, as Parquet,

    anomalies/    year=...   cell_id, t, month, value: standardised against a moving climatology
    events/       phase=...  onset, end, peak, year and class of each event of the index, the mean over all cells
    composites/   phase=...  cell_id, region, lag, value, n_events, and the cell's test: composite, p_value, threshold, significant
    responses/    phase=...  region, mean, ci_low, ci_high, n_events, sign_consistent: the response of each region's events

A run is a function of its input and settings alone: draws come from digests, and every output is written anew, so a run that failed is
repeated as it is. Anomalies, the only output with a row for each cell and month, are written once and read back by what follows. The
index and its events have a row for each month or event of the record, whatever the number of cells; they alone reach the driver.

The settings beside this file suit a record of a few years. A century takes window_years 30, min_years 20, lags -18 to 30 and 10,000
iterations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, read, write
from lagwise.model import complete, month_of, pinned
from lagwise.operators import climatology, epochs, events, index, inference, regions
from lagwise.sources.config import Settings


def monthly_prices(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """(cell_id, t, cents, n): the sum of prices, in whole cents, and the number of orders of each cell and month."""
    t = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    by = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell_id")), "o_custkey")
    return by.groupBy("cell_id", t.alias("t")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("o_totalprice").alias("n"))


def run(spark: SparkSession, input: str, output: str, settings: Settings) -> dict[str, DataFrame]:
    """The outputs, read back."""
    output, phases = output.rstrip("/"), list(settings["phases"])
    (lag_min, lag_max), (first, last), keys = settings["lags"], settings["response_lags"], ["cell_id"]
    prices = monthly_prices(read(spark, input, "orders"), read(spark, input, "customer"))
    cells = read(spark, input, "nation").select(F.col("n_nationkey").alias("cell_id"), F.col("n_regionkey").alias("region"))
    mean = (F.sum("cents") / F.sum("n") / 100).alias("value")

    field = complete(prices.groupBy("cell_id", "t").agg(mean), keys)
    anomaly = climatology.anomalies(field, keys, "standardized", "moving", settings["climatology.window_years"], settings["climatology.min_years"])
    part = F.pmod(F.xxhash64("cell_id"), F.lit(settings["files_a_year"]))
    anomaly = write(anomaly.select("cell_id", "t", "month", "value", "year").repartition("year", part), f"{output}/anomalies", "year")
    out = {"anomalies": anomaly}

    series = pinned(index.running_mean(index.zscore(prices.groupBy("t").agg(mean).withColumns(month_of("t")), []), [], 3))
    classes = {name: (low, high) for name, (low, high) in settings["classes"].items()}
    found = pinned(events.catalogue(series, [], threshold=settings["threshold"], min_length=settings["min_length"], classes=classes))
    out["events"] = write(found.where(F.col("phase").isin(*phases)).coalesce(1), f"{output}/events", "phase")

    anchors = found.where(F.col("phase").isin(*phases)).select("phase", "event_year", F.col("peak_t").alias("anchor_t"))
    composites = epochs.composite(epochs.epochs(anomaly, anchors, lag_min, lag_max), ["phase", *keys])
    responses = epochs.epochs(anomaly, anchors, first, last).groupBy("phase", *keys, "event_year").agg(F.avg("value").alias("value"))

    months = lambda df: sorted({r["anchor_t"] for r in df.select("anchor_t").collect()})  # noqa: E731  months of the record
    neutral = months(epochs.eligible(series.select(F.col("t").alias("anchor_t")), found.select(F.col("peak_t").alias("anchor_t")), settings["neutral_buffer"]))
    every = anomaly.select(F.col("t").alias("anchor_t")).distinct()
    pool = epochs.epochs(anomaly, every, first, last).groupBy("anchor_t", *keys).agg(F.avg("value").alias("value"))
    tests = []
    for phase in phases:
        chosen = months(anchors.where(F.col("phase") == phase))
        log.info("%s: %d events, %d neutral months", phase, len(chosen), len(neutral))
        if chosen:
            one = inference.mc_test_blocked(pool, keys, chosen, neutral, settings["test.iterations"], settings["test.seed"], cells_a_block=settings["test.cells_a_block"])
            tests.append(one.select(*keys, "composite", "p_value", F.lit(phase).alias("phase")))
    if tests:
        tested = inference.fdr_mask(reduce(DataFrame.unionByName, tests), alpha=settings["test.alpha"], by=["phase"])
        composites = composites.join(tested, ["phase", *keys], "left")
    else:
        composites = composites.withColumns({"composite": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double"), "threshold": F.lit(0.0), "significant": F.lit(False)})
    composites = composites.join(epochs.small(cells), keys, "left").select(*keys, "region", "lag", "value", "n_events", "composite", "p_value", "threshold", "significant", "phase")
    out["composites"] = write(composites, f"{output}/composites", "phase")

    regional = regions.region_table(responses.join(epochs.small(cells), keys), ["phase", "region"], settings["interval.iterations"], settings["interval.seed"])
    regional = regional.select("region", "mean", "ci_low", "ci_high", "n_events", "sign_consistent", "phase")
    out["responses"] = write(regional.repartition(1), f"{output}/responses", "phase")
    return out


if __name__ == "__main__":
    command("event_composites", __doc__.split("\n", 1)[0], run)
