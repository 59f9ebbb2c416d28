"""Readers, names, manifests, sinks and settings."""

import json

import pytest
from pyspark.sql import functions as F

from lagwise.operators import climatology
from lagwise.sources import config, fields, manifest, series, sinks


def test_yearly_table(spark, tmp_path):
    rows = ["  1950 1951", " 1950 " + " ".join(str(k) for k in range(12)), " 1951 " + " ".join(["-99.9"] * 6 + ["1.5"] * 5 + ["9999"]), "  -99.90", "  9999", " a note"]
    (tmp_path / "nino.data").write_text("\n".join(rows))
    got = {(r.year, r.month): r.value for r in series.read_series(spark, str(tmp_path), "nino").collect()}
    assert len(got) == 24 and got[1950, 12] == 11.0 and got[1951, 1] is None and got[1951, 7] == 1.5 and got[1951, 12] is None


def test_column_table_and_csv(spark, tmp_path):
    (tmp_path / "c.txt").write_text("YR MON NINO3.4 ANOM\n1950 1 24.5 -1.5\n1950 2 25.0 nan\n")
    got = series.read_columns(spark, str(tmp_path / "c.txt"), "ANOM").orderBy("t").collect()
    assert [(r.t, r.value) for r in got] == [(23400, -1.5), (23401, None)]
    with pytest.raises(ValueError):
        series.read_columns(spark, str(tmp_path / "c.txt"), "OTHER")
    (tmp_path / "x.csv").write_text("time,x.y\n1950-01-16,1.0\n1950-02-15,\n")
    assert [(r.month, r.value) for r in series.read_series(spark, str(tmp_path), "x").orderBy("t").collect()] == [(1, 1.0), (2, None)]
    with pytest.raises(FileNotFoundError):
        series.read_series(spark, str(tmp_path), "none")


def test_names(spark, tmp_path):
    parts = dict(model="H08", forcing="gswp3", climate_scenario="obsclim", soc_scenario="histsoc", sens_scenario="default", variable="qtot", region="global", timestep="monthly", start=1901, end=2019)
    name = fields.build_name("nc", **parts)
    assert fields.parse_name(f"/a/{name}") == parts | {"model": "h08"}
    for bad in ("readme.txt", name.replace("1901", "19x1"), name[:-3]):
        with pytest.raises(ValueError):
            fields.parse_name(bad)
    (tmp_path / "water").mkdir()
    (tmp_path / "water" / name).write_text("abc")
    (tmp_path / "water" / "note.txt").write_text("abc")
    found = fields.inventory(spark, str(tmp_path))
    r = found.first()
    assert found.count() == 1 and (r.sector, r.size, r.model, r.start) == ("water", 3, "h08", 1901)
    assert fields.find_files(found, model="h*", variable="qtot").count() == 1 and fields.find_files(found, variable="dis").count() == 0


def test_fields_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("qtot", "o", "h", 1, 1950, 1, 23400, 1.5), ("qtot", "o", "h", 1, 1951, 1, 23412, float("nan")), ("dis", "o", "h", 1, 1950, 1, 23400, 2.0)], "variable string, climate_scenario string, soc_scenario string, cell_id int, year int, month int, t int, value double")
    fields.write_field(df, str(tmp_path / "f"), step="harmonise", settings={"a": 1})
    assert json.loads((tmp_path / "f" / "_provenance.json").read_text())["step"] == "harmonise"
    got = fields.read_field(spark, str(tmp_path / "f"), (1950, 1951), variable="qtot").orderBy("t").collect()
    assert [r.value for r in got] == [1.5, None]
    land = spark.createDataFrame([(1, False)], "cell_id int, land boolean")
    assert fields.harmonise(df.withColumn("units", F.lit("kg m-2 s-1")), land, (1960, 1970)).where("value is not null").count() == 0


def test_manifest(spark, tmp_path):
    docs = [{"name": "a", "specifiers": {"model": ["m", "n"], "sector": ["w"]}, "files": [{"name": "f1", "file_url": "u1", "size": 3}, {"name": "f2", "file_url": "u2", "size": None}]}, {"name": "b", "specifiers": {"model": ["m"]}, "files": []}]
    flat = manifest.flatten(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"))
    assert sorted((r.dataset, r.model, r.file_url) for r in flat.where("file_url is not null").collect()) == [("a", "m", "u1"), ("a", "m", "u2")]
    assert flat.where("file_url is null").count() == 1
    found = manifest.discover(spark, {"model": ["m", "n"], "variable": ["x"]}, lambda q: docs)
    assert found.where("file_url is not null").count() == 2
    (tmp_path / "f1").write_text("abc")
    import hashlib

    m = spark.createDataFrame([("f1", 3, hashlib.sha512(b"abc").hexdigest(), "sha512"), ("f2", 3, "x", "sha256")], "file_name string, size long, checksum string, checksum_type string")
    assert {r.file_name: r.ok for r in manifest.verify(spark, str(tmp_path), m).collect()} == {"f1": True, "f2": False}


def page(number, options):
    return [{"name": f"p{number}"}]


def test_paged_source(spark):
    reader = manifest.PagedSearch({"pages": "3", "module": "tests.test_sources:page"}).reader(None)
    assert [p.value for p in reader.partitions()] == [1, 2, 3]
    assert list(reader.read(reader.partitions()[1])) == [(2, '{"name": "p2"}')]


def pages_until_empty(number, options):
    return [{"name": f"p{number}"}] if number < 4 else []


def test_paged_source_stops_at_an_empty_page():
    reader = manifest.PagedSearch({"module": "tests.test_sources:pages_until_empty"}).reader(None)
    (only,) = reader.partitions()
    assert [p for p, _ in reader.read(only)] == [1, 2, 3]
    short = manifest.PagedSearch({"module": "tests.test_sources:page", "max_pages": "2"}).reader(None)
    assert [p for p, _ in short.read(short.partitions()[0])] == [1, 2]


def test_downloads_skip_what_is_there_and_say_what_failed(spark, tmp_path):
    source, root = tmp_path / "source", tmp_path / "root"
    source.mkdir()
    root.mkdir()
    for name in ("a", "b", "c"):
        (source / name).write_text(name * 5)
    (root / "b").write_text("older")
    rows = [("a", f"file://{source}/a", 5), ("b", f"file://{source}/missing", 5), ("c", f"file://{source}/c", 7), ("d", f"file://{source}/none", None), ("../e", f"file://{source}/a", None), (None, None, None)]
    df = spark.createDataFrame(rows, "file_name string, file_url string, size long")
    got = {r.file_name: r.state for r in manifest.fetch(df, str(root), retries=2, backoff=0.01).collect()}
    assert got["a"] == got["../e"] == "fetched" and got["b"] == "there" and "5 bytes instead of 7" in got["c"] and got["d"].startswith("failed")
    assert sorted(p.name for p in root.iterdir()) == ["a", "b", "e"] and (root / "a").read_text() == "aaaaa"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456), ("b", None)], "k string, v double")
    sinks.write_table(df, str(tmp_path / "t"), "step", {"x": 1})
    meta = json.loads((tmp_path / "t.meta.json").read_text())
    assert meta["n_rows"] == 2 and meta["columns"] == ["k", "v"] and meta["step"] == "step"
    assert sinks.markdown(df).splitlines()[2] == "| a | 1.23 |"
    assert sinks.rounded(df).first().v == 1.2346
    text, missing = sinks.render("{{a.b:.2f}} {{a.c.1}} {{no.where}}", {"a": {"b": 1.005, "c": [1, 2]}})
    assert text.split()[1] == "2" and "{{no.where}}" in text and missing == ["no.where"]
    assert sinks.numbers_document(df, "k") == {"a": {"v": 1.23456}, "b": {"v": None}}


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "l": [1]}')
    (tmp_path / "top.json").write_text('{"_base": "base.json", "a": {"y": 3}}')
    c = config.load(tmp_path / "top.json", {"a.z": 4})
    assert c["a.x"] == 1 and c["a.y"] == 3 and c["a.z"] == 4 and c.get("a.q", 5) == 5 and len(c) == 2
    (tmp_path / "base.json").write_text('{"_base": "top.json"}')
    with pytest.raises(ValueError):
        config.load(tmp_path / "top.json")


def test_a_store_is_not_exchanged_again(spark, tmp_path):
    rows = [(c, y * 12 + m, y, m + 1, float(c + y + m)) for c in range(6) for y in range(1990, 1996) for m in range(12)]
    df = spark.createDataFrame(rows, "cell_id int, t int, year int, month int, value double")
    path = str(tmp_path / "store")
    fields.write_store(df, path, 4)
    store = fields.open_store(spark, path, "cell_id int, t int, year int, month int, value double", 4)
    assert sorted(map(tuple, store.collect())) == sorted(rows)
    anomaly = climatology.fixed_climatology(store, ["cell_id"])
    lines = climatology.linear_detrend(climatology.moving_climatology(store, ["cell_id"], 3, 2), ["cell_id"]).groupBy("cell_id", "month").agg(F.avg("value").alias("value"))
    for out in (anomaly, lines):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in climatology.fixed_climatology(df, ["cell_id"])._jdf.queryExecution().executedPlan().toString()


def test_members_align_on_the_union_of_their_axes(spark):
    one = lambda rows: spark.createDataFrame(rows, "cell_id int, t int, value double")
    got = fields.align({"a": one([(1, 0, 1.0), (1, 1, 2.0)]), "b": one([(1, 1, 3.0), (2, 5, 4.0)]), "c": one([])}, ["cell_id"])
    rows = {(r.cell_id, r.t, r.model): r.value for r in got.collect()}
    assert len(rows) == got.count() == 2 * 3 * 3
    assert {k: v for k, v in rows.items() if v is not None} == {(1, 0, "a"): 1.0, (1, 1, "a"): 2.0, (1, 1, "b"): 3.0, (2, 5, "b"): 4.0}


def test_numbers_come_as_one_document(spark):
    a = spark.createDataFrame([("y", 2, None), ("x", 1, 0.5)], "k string, n int, v double")
    one = spark.createDataFrame([(3, "s")], "m int, t string")
    df = sinks.numbers({"a": (a, "k"), "one": (one, None), "none": (a.where("false"), "k"), "nothing": (one.where("false"), None)})
    assert df.count() == 1
    assert json.loads(df.first()["numbers"]) == {"a": {"x": {"n": 1, "v": 0.5}, "y": {"n": 2, "v": None}}, "one": {"m": 3, "t": "s"}, "none": None, "nothing": None}
    assert sinks.render("{{a.x.v:.2f}} of {{one.m}}", json.loads(df.first()["numbers"])) == ("0.50 of 3", [])


def test_searches_run_in_tasks(spark):
    import os

    here = os.getpid()

    def search(query):
        if os.getpid() == here:
            raise RuntimeError("in the driver")
        return [{"name": query["model"], "specifiers": {"model": [query["model"]], "variable": [query["variable"]]}, "files": [{"name": f"{query['model']}.nc", "file_url": f"u/{query['model']}", "size": 1}]}]

    found = manifest.discover(spark, {"model": ["m", "n", "o"], "variable": ["x", "y"]}, search)
    assert sorted(r.file_url for r in found.collect()) == ["u/m", "u/n", "u/o"]  # each file once


def test_manifest_of_orders_takes_more_tasks_for_more_rows(spark):
    from lagwise.plans.queries import flattened

    orders = spark.createDataFrame([(k, 100 + k, "P", "S") for k in range(50)] + [(7, 900, "Q", "S"), (None, 1, "P", "S")], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string")
    items = spark.createDataFrame([(k, n) for k in range(40) for n in range(k % 4)] + [(39, None)], "l_orderkey long, l_linenumber int")
    few, many = flattened(orders, items), flattened(orders, items, 20)
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 6
    expected = []
    for o in orders.collect():
        found = [i.l_linenumber for i in items.collect() if i.l_orderkey == o.o_orderkey] if o.o_orderkey is not None else []
        name = None if o.o_orderkey is None else f"set{o.o_orderkey}"
        for n in found or [None]:
            expected.append((name, o.o_orderpriority, "S", *((None, -1) if n is None else (f"f{o.o_orderkey}_{n}", o.o_custkey + n))))
    for df in (few, many):
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)
