"""Quality rules: a ledger of failure bits and measurements, and versioned policies over the bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each rule that the
document fails; a policy is a mask of the bits that count, so a new policy, or the question what a rule adds to one,
never reads texts again.

Defined results: a null or empty text has no words and fails `short`; other columns of the input are not read, so nulls
or clashing names there do not matter; repeated rows are judged one by one; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import text_of, words

#: Rule -> when it fails, over the measurements. The order gives the bits and is part of the ledger's format.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 12 * n_words or 2 * word_chars < 5 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
BITS: dict[str, int] = {name: 1 << k for k, name in enumerate(RULES)}

#: Policy version -> the rules that count in it.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("short", "repeats"),
    "v1": tuple(RULES),
}


def mask(rules: Iterable[str]) -> int:
    return sum(BITS[name] for name in set(rules))


def _measure(docs: DataFrame, carried: Column, text_col: str) -> DataFrame:
    df = docs.select(carried.alias("doc_id"), text_of(text_col).alias("text"))
    df = df.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    # A window of three words is told by its 64-bit hash; equal ones are neighbours once sorted.
    window = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)).alias("h"), i.alias("i")))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(window)).alias("s"),
    )
    m = F.size("s")
    same = lambda i, j: F.get("s", i)["h"] == F.get("s", j)["h"]
    twice = F.filter(F.sequence(F.lit(0), m - 1), lambda k: F.coalesce(F.when(k > 0, same(k, k - 1)), F.lit(False)) | F.coalesce(F.when(k < m - 1, same(k, k + 1)), F.lit(False)))
    df = df.withColumn("at", F.when(m >= 2, F.transform(twice, lambda k: F.get("s", k)["i"]))).drop("s")
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2))))
    return df.select("*", F.coalesce(F.when(F.size("at") > 0, F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words")).drop("at")


def _ledger(docs: DataFrame, carried: Column, text_col: str) -> DataFrame:
    df = _measure(docs, carried, text_col)
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.withColumn("failed", bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and `failed`: the bits of the rules that the document fails."""
    return _ledger(docs, F.col(id_col), text_col)


def passes(policy: str = "v1", failed: str | Column = "failed") -> Column:
    """Whether a row of the ledger passes a policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule adds to a policy: rule, n_fail, n_only (documents that fail by this rule alone), n_kept_without.

    The ledger is first counted by its bits, of which there are at most 2 ** rules kinds; all else is bitwise work on
    those few rows.
    """
    kinds = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")).alias("bits")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[policy]])).alias("r")
    each = kinds.select("bits", "count", rules).select("bits", "count", "r.rule", "r.bit")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(hit).alias("n_fail"), total(hit & (rest == 0)).alias("n_only"), total(rest == 0).alias("n_kept_without"))


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that pass a policy, row by row, with their columns.

    A row travels beside its bits as one struct, so nothing is joined or shuffled. The row number holds the filter above
    the projection that makes the bits: pushed below it, the filter would work out every measurement once for each use.
    """
    rows = _ledger(docs, F.struct(*[docs[c] for c in docs.columns]), text_col)
    rows = rows.select(F.col("doc_id").alias("row"), "failed", F.monotonically_increasing_id().alias("n"))
    return rows.where(passes(policy) & (F.col("n") >= 0)).select("row.*")
