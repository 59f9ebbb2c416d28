"""What the jobs share: settings, logs, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lagwise.sources.config import Settings, load

log = logging.getLogger("jobs")


def settings(name: str) -> Settings:
    """The settings file that lies beside a job."""
    return load(Path(__file__).with_name(f"{name}.json"))


def settings_at(spark: SparkSession, path: str | None, name: str) -> Settings:
    """The settings at a path, by Spark where the path has a scheme; without a path, those beside the job."""
    if path is None:
        return settings(name)
    return Settings(json.loads(spark.read.text(path, wholetext=True).first()[0])) if "://" in path else load(path)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, whether a file or a folder of files; logs its rows (from the files' footers)."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    log.info("read %s: %d rows", name, df.count())
    return df


def write(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write a partitioned Parquet output anew; gives it as read back, and logs its rows. Without rows it has no file, but its schema all the same."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    log.info("%s now holds %d rows", path, out.count())
    return out


def command(name: str, text: str, run: Callable[[SparkSession, str, str, Settings], object], extra: Callable[[argparse.ArgumentParser], None] = lambda p: None) -> None:
    """The command line: makes a session, runs the job, stops the session."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=text)
    p.add_argument("--input", required=True, help="folder of the tables, any path that Spark reads")
    p.add_argument("--output", required=True, help="folder of the results, any path that Spark writes")
    p.add_argument("--config", help=f"settings in JSON (default: jobs/{name}.json)")
    p.add_argument("--master", help="Spark's master, where the environment does not set one")
    extra(p)
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    try:
        more = {k: v for k, v in vars(args).items() if k not in ("input", "output", "config", "master")}
        run(spark, args.input, args.output, settings_at(spark, args.config, name), **more)
    finally:
        spark.stop()
