"""How good a ranking is, and how fast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def per_query(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall) at ``k`` of hits (query_id, chunk_id, rank) against relevant (query_id, chunk_id).

    Precision is over the hits that there are; a query without hits has both zero.
    """
    wanted = relevant.select("query_id", "chunk_id").distinct()
    top = hits.filter(F.col("rank") <= k).select("query_id", "chunk_id")
    good = top.join(wanted.withColumn("good", F.lit(1)), ["query_id", "chunk_id"], "left")
    found = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("good"))
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    both = total.join(found, "query_id", "left")
    part = lambda of: F.round(F.coalesce(F.col("good") / F.col(of), F.lit(0.0)), DIGITS)
    return both.select("query_id", part("n").alias("precision"), part("relevant").alias("recall"))


def overall(scores: DataFrame) -> DataFrame:
    """Mean, least and greatest precision and recall."""
    return scores.agg(*(f(c).alias(f"{name}_{c}") for c in ("precision", "recall") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


def latency(times: DataFrame, column: str = "ms", group: str | None = None) -> DataFrame:
    """Interpolated percentiles."""
    parts = [F.percentile(column, p / 100).alias(f"p{p}") for p in (50, 95, 99)]
    return times.groupBy(*([group] if group else [])).agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), *parts)


def nearest_rank(times: DataFrame, p: float, column: str = "ms") -> DataFrame:
    """The smallest value that ``p`` percent of the values don't exceed."""
    return times.agg(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").alias("value"))
