"""The driver tables as fields: orders by nation, month, priority (members) and status (scenarios)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.model import complete, month_of

OFFSET = 0.4142
MIN_RUN, THRESHOLD = 2, 0.3
WINDOW, MIN_YEARS = 5, 3
LAG_MIN, LAG_MAX = -3, 6
SEASONS = ["SON0", "DJF01", "MAM1"]
ITERATIONS, SEED = 200, 42
#: Amplitude classes for these short series: name -> (least, below).
CLASSES = {"weak": (0.3, 0.6), "moderate": (0.6, 0.9), "strong": (0.9, 1.2), "super": (1.2, float("inf"))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(x: Column | str, digits: int = 6) -> Column:
    """The value at a fixed number of digits by scaling and floor, which engines agree on where their rounding differs.

    The offset is not a half: means and deviations of few values often lie just between two steps, where the last bit decides.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10**digits + OFFSET) / float(10**digits)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, model, scenario, t and the price in cents (whole numbers, so that sums do not depend on their order)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("cell_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("scenario"), t.alias("t"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    )


def mean_price() -> Column:
    return (F.sum("cents") / F.count("cents") / 100).alias("value")


def field(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """The mean price by cell_id, the given keys and month, missing months as null."""
    by = ["cell_id", *keys]
    return complete(orders(spark, sf_dir).groupBy(*by, "t").agg(mean_price()), by)


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables of each cell and month: the mean price and the total of prices."""
    by = orders(spark, sf_dir).groupBy("cell_id", "t").agg(mean_price().alias("price"), (F.sum("cents") / 100).alias("total"))
    return complete(by.unpivot(["cell_id", "t"], ["price", "total"], "variable", "value"), ["cell_id", "variable"])


def monthly(spark: SparkSession, sf_dir: str, scenario: str | None = None) -> DataFrame:
    """The mean price by month, over all cells."""
    df = orders(spark, sf_dir)
    if scenario:
        df = df.where(F.col("scenario") == scenario)
    return df.groupBy("t").agg(mean_price()).withColumns(month_of("t"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, made-up lat and lon, region, population (account balances, not below 0)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell_id"), F.col("n_regionkey").alias("region"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cell_id")).agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / 100).alias("balance"))
    n = n.join(c, "cell_id", "left").withColumns({"lat": -60.0 + 5 * F.col("cell_id"), "lon": -175.0 + 14 * F.col("cell_id")})
    return n.select("cell_id", "lat", "lon", "region", F.greatest(F.coalesce("balance", F.lit(0.0)), F.lit(0.0)).alias("population"))
