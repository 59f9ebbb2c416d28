"""A training corpus from `documents`, in five stages; each works on all that its predecessor kept.

1. quality_rules: documents that the rule policy rejects go.
2. near_dedup: one document of each group of near copies stays (5-word shingles, Jaccard similarity of 0.8).
3. decontamination: documents that hold a 10-word window of a benchmark item go.
4. mixing: documents are repeated or left out to meet the sources' weights.
5. sharding: what is left is dealt into 24 shards of near equal bytes, with a gapless slot in each.

Rows are documents in every stage, whatever their ids: rows that share an id or have none are judged by their own texts, and of rows
alike in id and text near_dedup keeps one. A null or empty text fails the quality rules. Stages read id, text and source only and
pass all columns on; the last adds size, text_crc32, shard and slot, in place of columns of these names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagwise.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from lagwise.llm.common import discard, materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, "v1")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, weights=(5, 2, 1), most=3)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 24)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL has no MinHash components and no histogram splitters; tests hold run() against a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
