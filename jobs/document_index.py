"""Keeps the keyword index of a growing library of documents up to date.

    python -m jobs.document_index --documents PATH --out PATH [--checkpoint PATH] [--config FILE]

Documents are Parquet files in one folder (or found by a pattern). A file stream with a checkpoint takes the files
that are new since the last run, in batches. Of a batch only documents that are new or whose
text has changed are indexed. Every batch writes its own partitions, by dynamic overwrite,
of three tables in ``--out``:

    documents  batch, folder | doc_id, n_terms, digest, replaces   replaces: the batch whose rows of it no longer count
    postings   batch, bucket | term, doc_id, tf, dl, folder        bucket: a hash of the term
    changes    batch         | term, df, cf                        what the batch adds to and takes from the counts

so what an interrupted run has written is written over when its batch is done again, and a run
without new files changes nothing. At the end ``dictionary`` (bucket | term, df, cf) is made
from ``changes``. ``read`` gives the index as it stands. An index from before postings had
their document's folder has to be made anew.

Texts are read twice, for their digests and for their terms. They are moved only where an id has
several rows in a batch, or where more than ``FEW`` documents of a later batch have changed. Postings are
moved once, into files of a bounded size, so that a larger batch has more files and not larger tasks.

Defined results: a null text counts as empty and has no postings (so it takes a document's
words out of the index). Rows without an id are counted in the log and not indexed. Of several
rows of one batch with the same id the greatest text stays. A null folder is written as
``__HIVE_DEFAULT_PARTITION__`` by Spark and read back as null.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import bm25, segments

log = logging.getLogger("jobs.document_index")

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "document_index.json")
#: Columns of the tables, those after the bar as partitions.
TABLES = {
    "postings": ("term string, doc_id {id}, tf long, dl long, folder string, batch long, bucket int", ["batch", "bucket"]),
    "documents": ("doc_id {id}, n_terms long, digest string, replaces long, batch long, folder string", ["batch", "folder"]),
    "changes": ("term string, df long, cf long, batch long", ["batch"]),
    "dictionary": ("term string, df long, cf long, bucket int", ["bucket"]),
}
#: Bytes of text whose postings go into one file a bucket: with 16 buckets about 4 million rows a file.
TEXT_PER_FILE = 1 << 29
#: So many rows of ids or terms at most are sent to every task, where they are joined.
FEW = 1 << 20


class Tables:
    """The tables in a folder, read and written by Spark."""

    def __init__(self, spark: SparkSession, out: str, id_type: str) -> None:
        self.spark, self.out, self.id_type = spark, out.rstrip("/"), id_type

    def schema(self, name: str) -> str:
        return TABLES[name][0].format(id=self.id_type)

    def begin(self) -> None:
        """Every table exists, if only as an empty folder."""
        for name, (_, parts) in TABLES.items():
            self.spark.createDataFrame([], self.schema(name)).write.mode("append").partitionBy(*parts).parquet(f"{self.out}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.out}/{name}")

    def write(self, name: str, rows: DataFrame, batch: int | None = None) -> None:
        """Replaces the batch's partitions, or without a batch the table."""
        mode = "static" if batch is None else "dynamic"
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*TABLES[name][1]).parquet(f"{self.out}/{name}")
        written = self.read(name) if batch is None else self.of_batch(name, batch)
        log.info("%s: %d rows written", name, written.count())  # by the files' footers

    def of_batch(self, name: str, batch: int) -> DataFrame:
        return self.read(name).filter(F.col("batch") == batch)


def bucket_of(config: dict):
    return F.pmod(F.xxhash64("term"), F.lit(config["buckets"])).cast("int")


def spread(rows: DataFrame, config: dict, by: str, files: int = 1) -> DataFrame:
    """``files`` files for each bucket, ``files_per_bucket`` at least, a task each; dealt out by a hash of ``by`` and sorted by term."""
    files = max(files, config["files_per_bucket"])
    part = F.col("bucket") * files + F.pmod(F.xxhash64(by, F.lit(1)), F.lit(files)).cast("int")
    return rows.repartitionById(config["buckets"] * files, part).sortWithinPartitions("bucket", "term")


def few(keys: DataFrame, n: int) -> DataFrame:
    """``keys``, sent to every task if they are few, so that what they are joined with stays where it is."""
    return F.broadcast(keys) if n <= FEW else keys


def newest(rows: DataFrame, doubled: DataFrame | None) -> DataFrame:
    """One row a document: the greatest text of those ids that have several rows."""
    if doubled is None:
        return rows
    last = rows.join(doubled, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "folder")).alias("last"))
    return rows.join(doubled, "doc_id", "left_anti").unionByName(last.select("doc_id", "last.text", "last.folder"))


def index_batch(rows: DataFrame, batch: int, out: str, id_type: str, config: dict) -> None:
    """One batch of documents. Doing it again gives the same files' contents: it looks at earlier batches only."""
    spark = rows.sparkSession
    tables = Tables(spark, out, id_type)
    folder = F.col(f"`{config['folder']}`").cast("string") if config.get("folder") else F.lit(None).cast("string")
    read = rows.select(F.col(f"`{config['id']}`").alias("doc_id"), F.coalesce(F.col(f"`{config['text']}`"), F.lit("")).alias("text"), folder.alias("folder"))
    ids = read.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1").persist()
    changed = None
    try:
        lost, several = ids.agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.count("doc_id")).first()
        log.info("batch %d: %d rows read, %d without an id", batch, rows.count(), lost or 0)
        found = newest(read.filter("doc_id IS NOT NULL"), few(ids.filter("doc_id IS NOT NULL").select("doc_id"), several) if several else None)

        before, own = F.col("batch") < batch, F.lit(batch).cast("long").alias("batch")
        old = tables.read("documents").filter(before)
        first = old.isEmpty()
        marks = found.select("doc_id", "folder", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("length"))
        if first:
            changed = marks.withColumn("replaces", F.lit(None).cast("long")).persist()
        else:
            known = live(old.select(F.col("batch").alias("segment"), "doc_id", F.col("digest").alias("old_digest"), F.col("folder").alias("old_folder")), replaced(old))
            same = F.col("digest").eqNullSafe(F.col("old_digest")) & F.col("folder").eqNullSafe(F.col("old_folder"))
            changed = marks.join(known, "doc_id", "left").filter(~same).select(*marks.columns, F.col("segment").alias("replaces")).persist()
        n, length = changed.agg(F.count(F.lit(1)), F.sum("length")).first()
        texts = found if first else found.join(few(changed.select("doc_id"), n), "doc_id", "left_semi")
        postings = bm25.batch_postings(texts, "doc_id", keep=("folder",)).withColumnRenamed("chunk_id", "doc_id").select("*", own, bucket_of(config).alias("bucket"))
        tables.write("postings", spread(postings, config, "doc_id", -(-(length or 0) // TEXT_PER_FILE)), batch)
        lengths = tables.of_batch("postings", batch).groupBy("doc_id").agg(F.max("dl").alias("n_terms"))
        listed = changed.join(lengths, "doc_id", "left").select("doc_id", F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"), "digest", "replaces", own, "folder")
        tables.write("documents", listed, batch)
    finally:
        for kept in filter(None, (ids, changed)):
            kept.unpersist()
    postings, dead = tables.read("postings").withColumnRenamed("batch", "segment"), replaced(tables.of_batch("documents", batch))
    hurt = segments_of(dead)
    gone = postings.filter(F.col("segment").isin(*hurt)).join(few(dead, sum(hurt.values())), ["doc_id", "segment"], "left_semi") if hurt else None
    tables.write("changes", segments.term_changes(tables.of_batch("postings", batch), gone).select("*", own), batch)


def replaced(documents: DataFrame) -> DataFrame:
    """(doc_id, segment): the documents that batches have replaced, and the batch whose rows that concerns."""
    return documents.filter("replaces IS NOT NULL").select("doc_id", F.col("replaces").alias("segment"))


def segments_of(dead: DataFrame) -> dict[int, int]:
    """How many documents of which batches ``dead`` names."""
    return {r["segment"]: r["count"] for r in dead.groupBy("segment").count().collect()}


def live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """``rows`` without the dead; those of batches that ``dead`` doesn't name needn't meet it."""
    if not (hurt := segments_of(dead)):
        return rows
    named = F.col("segment").isin(*hurt)
    return rows.filter(~named).unionByName(segments.live(rows.filter(named), few(dead, sum(hurt.values())), "doc_id"))


def read(spark: SparkSession, out: str, id_type: str = "bigint") -> DataFrame:
    """The index as it stands: (doc_id, folder, term, tf, dl, df, cf), a row per term of a document."""
    tables = Tables(spark, out, id_type)
    postings = live(tables.read("postings").withColumnRenamed("batch", "segment"), replaced(tables.read("documents")))
    dictionary = tables.read("dictionary").drop("bucket")
    # not sorted for a join: a term is one row there, and that side of a partition is small
    dictionary = F.broadcast(dictionary) if dictionary.count() <= FEW else dictionary.hint("shuffle_hash")
    return postings.select("doc_id", "folder", "term", "tf", "dl").join(dictionary, "term").select("doc_id", "folder", "term", "tf", "dl", "df", "cf")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> int:
    """Takes what is new in the folder ``documents``; the number of batches that this took."""
    config = load() | (config or {})
    schema = spark.read.parquet(documents).schema
    id_type = schema[config["id"]].dataType.simpleString()
    Tables(spark, out, id_type).begin()
    done = []

    def each(rows: DataFrame, batch: int) -> None:
        index_batch(rows, batch, out, id_type, config)
        done.append(batch)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"])
    stream = stream.option("maxFileAge", config["file_age"]).parquet(documents)  # Spark's own limit of a week would pass over older files that come late
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    tables = Tables(spark, out, id_type)
    dictionary = segments.summed_terms(tables.read("changes")).withColumn("bucket", bucket_of(config))
    tables.write("dictionary", spread(dictionary, config, "term"))
    log.info("%d batches of %s taken into %s", len(done), documents, out)
    return len(done)


def load(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--documents", required=True, help="folder of Parquet files, or a pattern of paths")
    parser.add_argument("--out", required=True)
    parser.add_argument("--checkpoint", help="default: _checkpoint in --out")
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from sparkloom.session import session

    spark = session("document-index")
    try:
        run(spark, given.documents, given.out, given.checkpoint or f"{given.out.rstrip('/')}/_checkpoint", load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
