"""Dataset manifests: flattening nested search results, availability, gaps, verification."""

from __future__ import annotations

import itertools
import json
import os
import shutil
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT = (
    "id string, name string, specifiers struct<simulation_round string, sector array<string>, model array<string>, climate_forcing array<string>, climate_scenario array<string>, "
    "soc_scenario array<string>, sens_scenario array<string>, variable array<string>, time_step array<string>>, "
    "files array<struct<name string, file_url string, size bigint, checksum string, checksum_type string>>"
)
SPECIFIERS = ("simulation_round", "sector", "model", "climate_forcing", "climate_scenario", "soc_scenario", "sens_scenario", "variable", "time_step")


def flatten(results: DataFrame, column: str = "json") -> DataFrame:
    """One row for each file of each dataset from JSON results; a specifier that is a list gives its first entry."""
    parsed = results.select(F.from_json(column, RESULT).alias("d"))
    one = lambda s: F.col(f"d.specifiers.{s}") if s == "simulation_round" else F.get(F.col(f"d.specifiers.{s}"), F.lit(0))
    rows = parsed.select(F.col("d.name").alias("dataset"), *[one(s).alias(s) for s in SPECIFIERS], F.explode_outer("d.files").alias("f"))
    return rows.select("dataset", *SPECIFIERS, F.col("f.name").alias("file_name"), F.col("f.file_url").alias("file_url"), F.col("f.size").alias("size"), F.col("f.checksum").alias("checksum"), F.col("f.checksum_type").alias("checksum_type"))


def discover(spark: SparkSession, wanted: dict[str, list[str]], search: Callable[[dict[str, str]], list[dict]]) -> DataFrame:
    """The manifest of every combination of the wanted values, each file once. search() answers one combination with result documents.

    Every combination is a partition of a data source, so searches run side by side in tasks, and one that fails is tried again apart;
    search() must be something that can be sent to them. The driver holds the wanted values alone.
    """
    name = f"search_{uuid.uuid4().hex}"
    spark.dataSource.register(type("Search", (_GridSearch,), {"called": name, "wanted": wanted, "search": staticmethod(search)}))
    return flatten(spark.read.format(name).load()).dropDuplicates(["file_url"])


class _GridSearch(DataSource):
    """A batch source with a partition for each combination of `wanted`: discover() makes a class of it for each search."""

    called, wanted, search = "", {}, None

    @classmethod
    def name(cls) -> str:
        return cls.called

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> DataSourceReader:
        return _GridReader(type(self).wanted, type(self).search)


class _GridReader(DataSourceReader):
    def __init__(self, wanted: dict[str, list[str]], search: Callable[[dict[str, str]], list[dict]]) -> None:
        self.wanted, self.search = wanted, search

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(values) for values in itertools.product(*self.wanted.values())]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        for doc in self.search(dict(zip(self.wanted, partition.value, strict=True))):
            yield (json.dumps(doc),)


def availability(manifest: DataFrame, by: tuple[str, ...] = ("sector", "model", "climate_scenario", "soc_scenario", "variable"), files: str | None = None) -> DataFrame:
    """(by): number of files and their size in GB. A row is a file, or as many as its column `files` says."""
    n = F.sum(files) if files else F.count(F.lit(1))
    return manifest.groupBy(*by).agg(n.alias("n_files"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / 1e9, 2).alias("total_gb"))


def gaps(required: DataFrame, manifest: DataFrame, on: list[str]) -> DataFrame:
    """Required combinations without any file."""
    return required.join(manifest.select(*on).distinct(), on, "left_anti")


def verify(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(file_name, size, ok): whether each file below root has the manifest's size and SHA-256 or SHA-512 checksum."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    have = files.select(F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("have_size"), F.sha2("content", 256).alias("s256"), F.sha2("content", 512).alias("s512"))
    both = manifest.join(have, "file_name", "left")
    right = F.when(F.col("checksum_type") == "sha512", F.col("s512") == F.col("checksum")).otherwise(F.col("s256") == F.col("checksum"))
    return both.select("file_name", "size", F.coalesce((F.col("have_size") == F.col("size")) & right, F.lit(False)).alias("ok"))


def fetch(manifest: DataFrame, root: str, retries: int = 4, backoff: float = 2.0, timeout: int = 300) -> DataFrame:
    """(file_name, path, state): download every file of a manifest into root, a folder that all executors share.

    state is `there` (a file of the manifest's size exists and is not fetched), `fetched`, or what went wrong after the last attempt;
    attempts wait backoff ** attempt seconds. A download goes to a name of its own first and is moved when it is whole, so a lost
    executor leaves no half file under the final name, and a repeated task fetches only what is missing.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, url, size in zip(batch["file_name"], batch["file_url"], batch["size"], strict=True):
                path = os.path.join(root, os.path.basename(name))  # a name cannot lead out of root
                rows.append((name, path, _download(url, path, None if pd.isna(size) else int(size), retries, backoff, timeout)))
            yield pd.DataFrame(rows, columns=["file_name", "path", "state"])

    files = manifest.where("file_name is not null and file_url is not null").select("file_name", "file_url", "size").dropDuplicates(["file_name"])
    return files.mapInPandas(run, "file_name string, path string, state string")


def _download(url: str, path: str, size: int | None, retries: int, backoff: float, timeout: int) -> str:
    if size and os.path.exists(path) and os.path.getsize(path) == size:
        return "there"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part, error = f"{path}.{uuid.uuid4().hex}.part", ""
    for attempt in range(retries):
        if attempt:
            time.sleep(backoff**attempt)
        try:
            with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as target:
                shutil.copyfileobj(source, target, 1 << 20)
            if size and os.path.getsize(part) != size:
                raise OSError(f"{os.path.getsize(part)} bytes instead of {size}")
            os.replace(part, path)
            return "fetched"
        except OSError as e:  # URLError and time-outs are OSErrors
            error = f"failed: {e}"
    if os.path.exists(part):
        os.remove(part)
    return error


class PagedSearch(DataSource):
    """A batch source over a paged search: spark.read.format("paged_search").options(module=..., pages=...).load().

    `module` names "package.module:function"; function(page, options) returns that page's result documents, or none past
    the last page. With `pages` each page is one partition, so pages are fetched side by side and retried apart; without, one
    partition asks for page after page until one is empty, for `max_pages` (100) at most.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "page int, json string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(1, int(self.options["pages"]) + 1)] if "pages" in self.options else [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        import importlib

        module, function = self.options["module"].split(":")
        search = getattr(importlib.import_module(module), function)
        pages = range(1, int(self.options.get("max_pages", "100")) + 1) if partition.value is None else [partition.value]
        for page in pages:
            found = list(search(page, self.options))
            for doc in found:
                yield page, json.dumps(doc)
            if not found:
                return
