"""The queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import decontamination, hard_negatives, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup, token_output, topk_search
from lagwise.llm.common import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = ~quality_rules.passes("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & quality_rules.passes("v1")).alias("kept"), "n_lines", "n_capitals", "failed")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 24, carry=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 13, digest=True)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a null id is not held out, but has no label either
    model = quality_classifier.train(docs, labels.where(~fifth))
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", fifth.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    token_output.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_output.read_digests(spark, path)


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, 5, 3, 50, 95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_secret_scan": op3_secret_scan,
    "op4_mixing": op4_mixing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_output": op10_token_output,
    "op11_topk_search": op11_topk_search,
    "op12_hard_negatives": op12_hard_negatives,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {WORDS} AS w,
                  [s FOR s IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(s, '[^\x20\x09-\x0D]')] AS lines FROM documents),
     m AS (SELECT *, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                  length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                  length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS n_capitals FROM t),
     g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) >= 3),
     h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
     p AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM h, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id),
     r AS (SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
                  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
                  len(lines)::BIGINT AS n_lines, n_capitals::BIGINT AS n_capitals FROM m LEFT JOIN p USING (doc_id)),
     f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
                  + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words)::BIGINT
                  + 32 * (2 * n_capitals > word_chars)::BIGINT AS failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, n_capitals, failed FROM f
"""

OP4_SQL = rf"""
WITH t AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, len(list_distinct({WORDS})) / len({WORDS}) AS q FROM documents),
     k AS (SELECT *, -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
                     / CASE WHEN size > 0 AND q > 0.01 THEN q ELSE 0.01::DOUBLE END AS key FROM t),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
     w AS (SELECT *, ([5.0::DOUBLE, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
     l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lev FROM w
           WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     g AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN lev <= cap / weight THEN lev END) OVER () * weight), cap) AS target FROM l),
     e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs FROM g),
     b AS (SELECT k.doc_id, k.size, e.*, target - epochs * source_size AS budget,
                  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN epochs < 3 AND before < budget AND before + size - budget <= budget - before THEN 1 ELSE 0 END))::BIGINT AS taken FROM b
"""

VECTORS = "SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH v AS ({VECTORS}),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12_SQL = f"""
WITH v AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({VECTORS}) WHERE label IS NOT NULL),
     s AS (SELECT q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0),
     p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5),
     n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST)::INT AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op4_mixing": OP4_SQL, "op11_topk_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
