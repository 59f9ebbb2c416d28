"""The pipeline against its parts in plain Python, and the registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from lagwise.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_operators import bench_items, check_shards, corpus, frame

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs = corpus(7, 150)
    path = tmp_path_factory.mktemp("tables")
    frame(spark, docs).drop("shard", "size").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([x for x in bench_items(docs) if x[1] and len(x[1]) > 30], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_stages(spark, folder):
    path, docs = folder
    rows, text = spark.read.parquet(f"{path}/documents.parquet"), dict(docs)
    columns = rows.columns
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.doc_id for r in rows.collect()]
        rows = stage(spark, rows, path).cache()
        after = [r.doc_id for r in rows.collect()]
        if k < 4:
            assert rows.columns == columns, name
        if name == "quality_rules":
            assert set(after) <= {d for d in before if brute.quality(text[d])[0] >= 50} and after
        if name == "near_dedup":
            groups = brute.near_groups([(d, text[d]) for d in before], 5, 80)
            assert set(after) == {d for d, (_, c) in groups.items() if c == d}
        if name == "decontamination":
            hit = brute.contamination([(d, text[d]) for d in before], items, 10)
            assert set(after) == {d for d in before if not hit[d][1]}
        if name == "mixing":
            assert set(after) <= set(before) and max(map(after.count, after)) <= 3
    check_shards(rows.collect(), 24, len(before))
    out = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows.collect())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op11_topk_search", "op12_hard_negatives"}))  # over vectors: their SQL says what they give
def test_queries(spark, name):
    df = QUERIES[name](spark, DIR)
    assert "doc_id" in df.columns and df.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    from tests.test_oracles import rows

    df, found = QUERIES[name](spark, DIR), con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in found.description], found.fetchall())


def test_every_text_operator_is_registered():
    import __spark_entry__

    names = {k.split("_")[0] for k in __spark_entry__.queries()}
    assert {f"op{n}" for n in range(1, 13)} <= names and "pipeline" in names and set(ORACLES) <= set(__spark_entry__.oracle_sql())
