"""Sinks: tables with provenance, markdown, JSON numbers and templates filled from them."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def revision(folder: str = ".") -> str:
    """The git revision of a folder, or 'unknown'."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def provenance(step: str, settings: dict) -> dict[str, str]:
    """Who made a result: step, time, revision, digest of the settings."""
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    return {"step": step, "created": datetime.now(UTC).isoformat(timespec="seconds"), "revision": revision(), "settings_sha256": digest}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_table(df: DataFrame, path: str, step: str, settings: dict, mode: str = "overwrite") -> None:
    """A result table (small by nature) as one CSV part with a head, and path.meta.json beside it. mode 'ignore' keeps what exists."""
    df.coalesce(1).write.mode(mode).csv(path, header=True)
    back = df.sparkSession.read.csv(path, header=True)
    write_json(df.sparkSession, f"{path}.meta.json", {"n_rows": back.count(), "columns": df.columns} | provenance(step, settings))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All floating-point columns rounded."""
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def markdown(df: DataFrame, rows: int = 40) -> str:
    """The first rows as a markdown table, floats to three significant digits. The row limit is the feature."""
    show = lambda x: "" if x is None else f"{x:.3g}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in df.limit(rows).collect())])


def lookup(numbers: object, path: str) -> object:
    """The value at a dotted path of nested dicts and lists; KeyError where there is none."""
    for part in path.split("."):
        try:
            numbers = numbers[int(part)] if isinstance(numbers, list) else numbers[part]
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise KeyError(path) from e
    return numbers


def render(template: str, numbers: dict) -> tuple[str, list[str]]:
    """Fill {{path}} and {{path:format}}; what cannot be found stays as it is, and its paths are returned too."""
    missing: list[str] = []

    def fill(m: re.Match) -> str:
        try:
            return format(lookup(numbers, m[1].strip()), m[2] or "")
        except (KeyError, ValueError, TypeError):
            missing.append(m[1].strip())
            return m[0]

    return re.sub(r"\{\{([^{}:]+)(?::([^{}]*))?\}\}", fill, template), missing


def numbers_document(df: DataFrame, key: str) -> dict:
    """A small table as {key value: {column: value}}; key values must differ, nulls among the values stay."""
    return json.loads(numbers({"table": (df, key)}).first()["numbers"])["table"] or {}


def numbers(sections: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row, `numbers`: a JSON document with an entry for each section, worked out in one plan.

    A section is a result table, small by nature, with a key column, and becomes {key value: {column: value}}; or, without a key, a table of
    one row, which becomes {column: value}. A table without rows gives null. Columns of a section stay in their order, keys are sorted.
    """
    parts = None
    for name, (df, key) in sections.items():
        value = F.struct(*[F.col(c) for c in df.columns if c != key])
        if key is None:
            one = df.agg(F.first(value).alias(name))
        else:
            rows = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), value.alias("value"))))
            one = df.agg(F.when(F.count(F.lit(1)) > 0, F.map_from_entries(rows)).alias(name))
        parts = one if parts is None else parts.crossJoin(F.broadcast(one))  # tables of one row
    return parts.select(F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("numbers"))
