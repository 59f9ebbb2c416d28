"""The jobs as named queries: each runs twice into one new folder and gives its output as it then stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import event_composites, text_inventory
from jobs.common import settings
from lagwise.plans import ctes
from lagwise.plans.adapter import fixed
from lagwise.sources.scratch import fresh


def job1_event_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "job1")
    for _ in range(2):
        out = event_composites.run(spark, sf_dir, path, settings("event_composites"))["composites"]
    return out.select("phase", "cell_id", "region", "lag", "n_events", "significant", *[fixed(c).alias(c) for c in ("value", "composite", "p_value", "threshold")])


def job2_text_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "job2")
    for _ in range(2):
        out = text_inventory.run(spark, sf_dir, path, settings("text_inventory"))["ledger"]
    return out.select("doc_id", "source", "lang", "n_chars", "length", "size", "sha256", "state")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_event_composites": job1_event_composites, "job2_text_inventory": job2_text_inventory}

_COLUMNS = ", ".join(f"{ctes.fixed(f'{t}.{c}')} AS {c}" for t, c in (("c", "value"), ("m", "composite"), ("m", "p_value"), ("m", "threshold")))
_WARM = ctes.sql(f"SELECT 'warm' AS phase, c.cell_id, g.region, c.lag, c.n_events, m.significant, {_COLUMNS} FROM comp c JOIN masked m ON m.cell_id = c.cell_id JOIN cells g ON g.cell_id = c.cell_id")
_COLD = _WARM.replace("phase = 'warm'", "phase = 'cold'").replace("SELECT 'warm' AS phase, c.cell_id", "SELECT 'cold' AS phase, c.cell_id")

_INVENTORY = """SELECT doc_id, source, lang, n_chars, length(text)::BIGINT AS length, strlen(text)::BIGINT AS size, sha256(text) AS sha256,
CASE WHEN text IS NULL THEN 'missing' WHEN n_chars IS NULL THEN 'undeclared' WHEN n_chars = length(text) THEN 'whole' ELSE 'changed' END AS state FROM documents"""

ORACLES: dict[str, str] = {"job1_event_composites": f"SELECT * FROM ({_WARM}) UNION ALL SELECT * FROM ({_COLD})", "job2_text_inventory": _INVENTORY}
