"""Indexes of source tables, built once and kept for the session: inverted indexes of texts, cells of vectors.

An index lies in the folder that driver and executors share (``spark.checkpoint.dir``;
a folder of our own only on one machine). It is known by the path, sizes and times of
its table's files, so a table that has changed is indexed anew. Postings lie sorted by
term; with them go document frequencies and collection statistics.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, dense, graph


@dataclass(frozen=True)
class Index:
    path: str
    stats: tuple[int, float]

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("term string, chunk_id long, tf long, dl long").parquet(f"{self.path}/postings")

    def term_stats(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("term string, df long").parquet(f"{self.path}/terms")


@dataclass(frozen=True)
class Cells:
    """Vectors (chunk_id, embedding) in a folder for each cell, with the cells' centres and radii."""

    path: str
    centres: list[list[float]]
    radii: dict[int, float]

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("chunk_id long, embedding array<double>, apart double, cell int").parquet(f"{self.path}/cells").drop("apart")


@dataclass(frozen=True)
class Graph:
    """The neighbour graph of a table of vectors."""

    path: str

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("a long, b long, score double").parquet(f"{self.path}/edges")


_known: dict[tuple, Index | Cells | Graph] = {}
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only under a local master where none is set."""
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkloom-index-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _files(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table from another."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    listed, found = fs.listFiles(p, True), []
    while listed.hasNext():
        s = listed.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(found))


def known(spark: SparkSession, path: str, id_col: str, text_col: str = "text") -> Index | None:
    """The index of the Parquet table at ``path``, if it has been built in this session."""
    return _known.get((spark.sparkContext.applicationId, path, id_col, text_col, _files(spark, path)))


def of(spark: SparkSession, path: str, id_col: str, text_col: str = "text") -> Index:
    """The index of the Parquet table at ``path``."""
    key = (spark.sparkContext.applicationId, path, id_col, text_col, _files(spark, path))
    if key not in _known:
        _known[key] = build(spark, spark.read.parquet(path), f"{folder(spark)}/index-{uuid.uuid4().hex}", id_col, text_col)
    return _known[key]


def build(spark: SparkSession, chunks: DataFrame, out: str, id_col: str, text_col: str = "text") -> Index:
    """Texts are read into terms once; sorting and statistics work on what that wrote."""
    bm25.build_postings(chunks, id_col, text_col).write.parquet(f"{out}/counted")
    counted = spark.read.schema("term string, chunk_id long, tf long, dl long").parquet(f"{out}/counted")
    # (term, chunk_id) rather than term alone: a term of most chunks isn't one task's
    counted.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.option("parquet.block.size", str(4 << 20)).parquet(f"{out}/postings")
    bm25.term_stats(counted).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{out}/terms")
    row = bm25.corpus_stats(counted).first()
    counted_dir = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/counted")
    counted_dir.getFileSystem(spark._jsc.hadoopConfiguration()).delete(counted_dir, True)
    return Index(out, (row["n"], row["avgdl"] or 1.0))


def cells_of(spark: SparkSession, path: str, id_col: str, vector_col: str = "embedding") -> Cells:
    """The cells of the Parquet table at ``path``."""
    key = (spark.sparkContext.applicationId, path, id_col, vector_col, _files(spark, path))
    if key not in _known:
        rows = spark.read.parquet(path).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull())
        _known[key] = build_cells(rows, f"{folder(spark)}/cells-{uuid.uuid4().hex}")
    return _known[key]


def build_cells(rows: DataFrame, out: str, cells: int | None = None) -> Cells:
    n = rows.count()
    centres = dense.fit_centres(rows, cells or dense.n_cells(n)) if n else []
    celled = dense.in_cells(rows, centres) if n else rows.withColumn("apart", F.lit(None).cast("double")).withColumn("cell", F.lit(-1))
    celled.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).write.partitionBy("cell").parquet(f"{out}/cells")
    stats = dense.cell_stats(rows.sparkSession.read.schema("apart double, cell int").parquet(f"{out}/cells"))
    return Cells(out, centres, dense.radii_of(stats))


def cutter(spark: SparkSession, out: str):
    """A function that writes a DataFrame under ``out`` and reads it back, so that nothing is worked out twice."""

    def cut(rows: DataFrame) -> DataFrame:
        path = f"{out}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return cut


def graph_of(spark: SparkSession, path: str, id_col: str, vector_col: str = "embedding") -> Graph:
    """The neighbour graph of the Parquet table at ``path``."""
    key = (spark.sparkContext.applicationId, "graph", path, id_col, vector_col, _files(spark, path))
    if key not in _known:
        out = f"{folder(spark)}/graph-{uuid.uuid4().hex}"
        rows = spark.read.parquet(path).select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("embedding"))
        graph.build(rows, cutter(spark, f"{out}/rounds")).repartitionByRange("a").sortWithinPartitions("a").write.parquet(f"{out}/edges")
        rounds = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/rounds")
        rounds.getFileSystem(spark._jsc.hadoopConfiguration()).delete(rounds, True)
        _known[key] = Graph(out)
    return _known[key]


@atexit.register
def _remove() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for index in _known.values():
        try:
            known = spark._jvm.org.apache.hadoop.fs.Path(index.path)
            known.getFileSystem(spark._jsc.hadoopConfiguration()).delete(known, True)
        except Exception as gone:  # noqa: BLE001  the JVM may be shutting down
            del gone
