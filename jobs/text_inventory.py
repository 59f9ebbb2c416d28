"""The inventory of a growing archive of texts: what has arrived, whether it is whole, what each source holds and what it still lacks.

    python -m jobs.text_inventory --input /data/tables --output /data/inventory [--config my.json] [--checkpoint /data/inventory/_checkpoint]

An archive that is filled over weeks, by downloads that are resumed and repeated, needs a ledger before anything is computed from it. This
job takes the files of a text table (doc_id, text, lang, source, n_chars) that no run has taken before and writes, as Parquet,

    ledger/        batch=.../state=...  doc_id, source, lang, n_chars, length, size, sha256: a row for each document
    totals/        batch=...            source, lang, n_files, size, n_whole: what the batch adds
    availability/                       source, lang, n_files, total_gb, n_whole: all batches together
    gaps/                               source, lang: required languages of which a source has nothing

length counts characters, size UTF-8 bytes. state: `whole` (as many characters as declared), `changed` (not so many), `undeclared` (no number
is declared), `missing` (no text). One row of the table is one document, whatever its id; the ledger is what later runs of a study compare
checksums with.

Which files were taken is kept in the checkpoint of a file stream, which runs until nothing new is there and stops. A batch that failed is
run again with the same files, and replaces its own partitions, so the ledger holds every document once. Totals are added up batch by
batch: a run's work is in proportion to what is new, and to the batches and sources there are. Output and checkpoint belong
together: a new checkpoint needs a new output folder. Files are never changed once they are in the table's folder, only added.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, write
from lagwise.operators.epochs import small
from lagwise.sources import manifest
from lagwise.sources.config import Settings

TEXTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LEDGER = "doc_id bigint, source string, lang string, n_chars bigint, length bigint, size bigint, sha256 string, batch bigint, state string"
TOTALS = "source string, lang string, n_files bigint, size bigint, n_whole bigint, batch bigint"


def state(text: Column, declared: Column, length: Column) -> Column:
    return F.when(text.isNull(), "missing").when(declared.isNull(), "undeclared").when(declared == length, "whole").otherwise("changed")


def ledger(docs: DataFrame) -> DataFrame:
    """A row for each document: its size in characters and bytes, its checksum, and whether it is whole."""
    text = F.col("text")
    length = F.length(text).cast("long")
    return docs.select(
        "doc_id", "source", "lang", "n_chars", length.alias("length"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("sha256"),
        state(text, F.col("n_chars"), length).alias("state"),
    )


def run(spark: SparkSession, input: str, output: str, settings: Settings, checkpoint: str | None = None) -> dict[str, DataFrame]:
    """Take what is new; the outputs, read back."""
    output = output.rstrip("/")
    new_rows = []
    replace = lambda df, path, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def take(new: DataFrame, batch: int) -> None:
        replace(ledger(new).withColumn("batch", F.lit(batch).cast("long")), f"{output}/ledger", "batch", "state")
        taken = spark.read.schema(LEDGER).parquet(f"{output}/ledger").where(F.col("batch") == batch)
        sums = taken.groupBy("source", "lang", "batch").agg(
            F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count_if(F.col("state") == "whole").alias("n_whole")
        )
        replace(sums.repartition(1), f"{output}/totals", "batch")
        new_rows.append(taken.count())
        log.info("batch %d: %d documents taken", batch, new_rows[-1])

    path = f"{input.rstrip('/')}/{settings['table']}.parque[t]"  # a pattern: a stream's plain path has to be a folder, and a table may be one file
    texts = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", settings["files_a_batch"]).parquet(path)
    stream = texts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint or f"{output}/_checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %s: %d new rows in %d batches", path, sum(new_rows), len(new_rows))

    if not sum(new_rows):
        # A table without any document has no partition to read back; its outputs are empty, not absent.
        for name, schema, by in (("ledger", LEDGER, ("batch", "state")), ("totals", TOTALS, ("batch",))):
            spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{output}/{name}")
    totals = spark.read.schema(TOTALS).parquet(f"{output}/totals")
    by = ["source", "lang"]
    whole = totals.groupBy(*by).agg(F.sum("n_whole").alias("n_whole")).select(*[F.col(c).alias(f"_{c}") for c in by], "n_whole")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang"))
    held = manifest.availability(totals, tuple(by), files="n_files").join(small(whole), same).drop("_source", "_lang")
    languages = spark.createDataFrame([(x,) for x in settings["required_languages"]], "lang string")
    required = totals.select("source").where("source is not null").distinct().crossJoin(F.broadcast(languages))
    out = {"ledger": spark.read.schema(LEDGER).parquet(f"{output}/ledger"), "totals": totals}
    log.info("%s/ledger now holds %d rows", output, out["ledger"].count())
    out["availability"] = write(held.repartition(1), f"{output}/availability")
    out["gaps"] = write(manifest.gaps(required, totals, by).repartition(1), f"{output}/gaps")
    return out


def _arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--checkpoint", help="folder of the stream's checkpoint (default: _checkpoint in the output)")


if __name__ == "__main__":
    command("text_inventory", __doc__.split("\n", 1)[0], run, _arguments)
