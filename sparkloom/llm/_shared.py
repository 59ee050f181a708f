"""Helpers that every operator of this subpackage uses.

Tables cut the lineage at points where recomputing would be dear: they are
written as Parquet in the folder that the cluster names in
``spark.checkpoint.dir``, so they outlive any executor.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on one machine (a local master) where none is set."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(set_by_cluster)
        return set_by_cluster.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/staged-{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_staged() -> None:
    for spark, path in _staged:
        jsc = spark.sparkContext._jsc
        if jsc is None:  # the session has ended already
            continue
        try:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception as gone:  # noqa: BLE001  the JVM may be shutting down
            del gone


#: Rows that go to a Python worker at once, where texts may be long.
ROWS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batches to ``ROWS_AT_ONCE`` rows unless smaller ones are set, so that a worker's memory is bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))
    return spark


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that no column has (Spark ignores case)."""
    lower = {t.lower() for t in taken}
    for candidate in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))):
        if candidate.lower() not in lower:
            return candidate
    raise AssertionError


#: A key with more than one in so many of the rows is joined without a shuffle; there are fewer such keys than this.
HOT = 1000


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row per ``key`` and says in ``n`` how many of ``rows`` have it.

    Frequent keys (fewer than ``HOT`` by definition, so they can be broadcast) stay where
    they are; no other key brings more than one in ``HOT`` of the rows to a task.
    """
    limit = (per_key.agg(F.sum(n)).first()[0] or 0) // HOT
    hot = F.broadcast(per_key.filter(F.col(n) > limit))
    rest = rows.join(hot.select(key), key, "left_anti").join(per_key.filter(F.col(n) <= limit), key)
    return rows.join(hot, key).unionByName(rest)


def join_salted(rows: DataFrame, per_key: DataFrame, key: str, spread, n: str = "n") -> DataFrame:
    """As ``join_counted``, for ``per_key`` rows too large to broadcast: a frequent key's row is copied and ``rows`` are dealt out over the copies by the number ``spread``."""
    limit = F.lit(max((per_key.agg(F.sum(n)).first()[0] or 0) // HOT, 1))
    copies, salt = fresh("copies", [*rows.columns, *per_key.columns]), fresh("salt", [*rows.columns, *per_key.columns])
    sized = per_key.withColumn(copies, F.ceil(F.col(n) / limit))
    hot = F.broadcast(sized.filter(F.col(copies) > 1).select(key, copies))  # fewer than HOT rows
    dealt = rows.join(hot, key, "left").withColumn(salt, F.pmod(spread, F.coalesce(copies, F.lit(1)))).drop(copies)
    copied = sized.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1))).drop(copies)
    return dealt.join(copied, [key, salt]).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
