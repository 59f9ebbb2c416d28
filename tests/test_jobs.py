"""The jobs: against their SQL, over growing input, after a lost commit, from the command line."""

import hashlib
import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import event_composites, text_inventory
from jobs.common import settings
from jobs.queries import ORACLES, QUERIES
from lagwise.sources.config import Settings
from tests.test_oracles import DIR, TABLES, rows

needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
TEXTS = [
    (1, "one\ntwo é", "en", "a", 9), (2, "", "de", "a", 0), (3, None, "en", "b", 4), (4, "short", "fr", "b", 50), (4, "short", "fr", "b", 5), (None, "no id", None, None, None),
    (5, "x" * 200_000, "es", "a b/c=d", 200_000),
]
MORE = [(6, "later", "de", "", 5), (1, "one\ntwo é", "en", "a", 9), (7, "", "fr", "a", 1)]


def add(spark, folder, name, documents):
    """One more file of the table, as a download would bring it."""
    staged = f"{folder}/staged-{name}"
    spark.createDataFrame(documents, text_inventory.TEXTS).coalesce(1).write.parquet(staged)
    (Path(folder) / "documents.parquet").mkdir(exist_ok=True)
    next(Path(staged).glob("part-*.parquet")).rename(Path(folder) / "documents.parquet" / f"{name}.parquet")


def plain(documents):
    out = []
    for doc, text, lang, source, n in documents:
        state = "missing" if text is None else "undeclared" if n is None else "whole" if n == len(text) else "changed"
        raw = None if text is None else text.encode()
        out.append((doc, source, lang, n, None if text is None else len(text), raw and len(raw) if raw else (0 if raw == b"" else None), None if raw is None else hashlib.sha256(raw).hexdigest(), state))
    return sorted(out, key=repr)


def found(out):
    return sorted((tuple(r) for r in out["ledger"].drop("batch").collect()), key=repr)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df, want = QUERIES[name](spark, DIR), con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_the_inventory_takes_only_what_is_new(spark, tmp_path):
    tables, output, wanted = str(tmp_path / "tables"), f"file://{tmp_path}/out", settings("text_inventory")
    os.makedirs(tables)
    add(spark, tables, "first", TEXTS)
    out = text_inventory.run(spark, tables, output, wanted)
    assert found(out) == plain(TEXTS)
    before = {f: f.stat().st_mtime_ns for f in Path(tmp_path, "out", "ledger").rglob("part-*")}
    assert found(text_inventory.run(spark, tables, output, wanted)) == plain(TEXTS)

    add(spark, tables, "second", MORE)
    out = text_inventory.run(spark, tables, output, wanted)
    assert found(out) == plain(TEXTS + MORE)
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())  # what was taken before is not touched
    assert dict(tuple(r) for r in out["ledger"].groupBy("batch").count().collect()) == {0: len(TEXTS), 1: len(MORE)}
    held = {(r.source, r.lang): (r.n_files, r.n_whole) for r in out["availability"].collect()}
    assert held["a", "en"] == (2, 2) and held["b", "fr"] == (2, 1) and held["a", "fr"] == (1, 0) and held["", "de"] == (1, 1) and held[None, None] == (1, 0)
    assert sum(n for n, _ in held.values()) == len(TEXTS + MORE)
    assert {(r.source, r.lang) for r in out["gaps"].collect() if r.source in ("a", "b")} == {("a", "es"), ("b", "de"), ("b", "es")}
    # The last batch once more, as after a driver that was lost before it could commit: the same ledger.
    (tmp_path / "out" / "_checkpoint" / "commits" / "1").unlink()
    (tmp_path / "out" / "_checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    again = text_inventory.run(spark, tables, output, wanted)
    assert found(again) == plain(TEXTS + MORE) and {(r.source, r.lang): (r.n_files, r.n_whole) for r in again["availability"].collect()} == held


def test_an_archive_without_documents(spark, tmp_path):
    (tmp_path / "documents.parquet").mkdir()
    out = text_inventory.run(spark, str(tmp_path), f"{tmp_path}/out", settings("text_inventory"))
    assert all(df.count() == 0 for df in out.values())
    add(spark, str(tmp_path), "first", MORE)
    assert found(text_inventory.run(spark, str(tmp_path), f"{tmp_path}/out", settings("text_inventory"))) == plain(MORE)


@needs_tables
def test_composites_are_written_anew_and_by_phase(spark, tmp_path):
    wanted = settings("event_composites").as_dict() | {"phases": ["warm"]}
    out = event_composites.run(spark, DIR, str(tmp_path / "out"), Settings(wanted))
    assert {r.phase for r in out["composites"].select("phase").distinct().collect()} == {"warm"}
    assert {p.name for p in (tmp_path / "out" / "anomalies").iterdir() if p.name.startswith("year=")} == {f"year={r[0]}" for r in spark.read.parquet(f"{DIR}/orders.parquet").selectExpr("year(o_orderdate)").distinct().collect()}
    assert out["responses"].where("ci_low > ci_high").count() == 0 and out["responses"].count() == 5
    none = event_composites.run(spark, DIR, str(tmp_path / "none"), Settings(wanted | {"threshold": 99.0, "phases": ["warm", "cold"]}))
    assert none["anomalies"].count() > 0 and none["events"].count() == none["composites"].count() == none["responses"].count() == 0  # a record without events


def test_command_line(tmp_path, spark):
    add(spark, str(tmp_path), "first", TEXTS)
    config = tmp_path / "my.json"
    config.write_text(json.dumps({"table": "documents", "required_languages": ["it"], "files_a_batch": 1}))
    root = Path(__file__).resolve().parents[1]
    args = [sys.executable, "-m", "jobs.text_inventory", "--input", str(tmp_path), "--output", str(tmp_path / "out"), "--config", str(config), "--checkpoint", str(tmp_path / "marks"), "--master", "local[2]"]
    done = subprocess.run(args, cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "7 new rows" in done.stderr and "now holds 7 rows" in done.stderr
    assert {r.lang for r in spark.read.parquet(str(tmp_path / "out" / "gaps")).collect()} == {"it"} and (tmp_path / "marks" / "commits" / "0").exists()
