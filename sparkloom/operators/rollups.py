"""Usage by day as partial aggregates that can be put together again.

A day's row holds counts, sums and two sketches: distinct users (HyperLogLog) and the
distribution of a measure (KLL). Counts of longer periods are sums of days, sketches of
longer periods are merges of days, so no log is read twice and a day can be replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketches: ranks are right within about 0.7 % (1.33 % is the bound that tests hold them to).
QUANTILE_SIZE = 400
#: 2 to this power registers of the distinct counts: a standard error of about 1.6 %.
DISTINCT_SIZE = 12


def day_of(seconds: Column) -> Column:
    """The UTC day of a time in seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def daily_queries(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """(day, query, searches, results, clicks): queries without regard to case; both logs are summed up before they meet."""
    zero = F.lit(0).cast("long")
    asked = searches.select(day_of(F.col("searched_at")).alias("day"), F.lower("query").alias("query"), F.lit(1).cast("long").alias("searches"), F.col("result_count").alias("results"), zero.alias("clicks"))
    opened = clicks.select(day_of(F.col("clicked_at")).alias("day"), F.lower("query").alias("query"), zero.alias("searches"), zero.alias("results"), F.lit(1).cast("long").alias("clicks"))
    sums = [F.sum(c).alias(c) for c in ("searches", "results", "clicks")]
    return asked.unionByName(opened).groupBy("day", "query").agg(*sums)


def daily(rows: DataFrame, user: str = "user_id", value: str = "value", at: str = "at") -> DataFrame:
    """(day, n, total, low, high, users, values): ``users`` and ``values`` are sketches; rows without a time are left out."""
    timed = rows.filter(F.col(at).isNotNull())
    return timed.groupBy(day_of(F.col(at)).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.hll_sketch_agg(F.col(user), DISTINCT_SIZE).alias("users"), F.kll_sketch_agg_double(F.col(value), QUANTILE_SIZE).alias("values"),
    )


def merged(days: DataFrame, *by: Column | str) -> DataFrame:
    """Rows of ``daily`` put together, per group of ``by`` or all."""
    return days.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("values").alias("values"),
    )


def figures(rolled: DataFrame, *shares: float) -> DataFrame:
    """Sketches read out: ``users`` as a number, ``p50`` and so on for each share (0 to 1) of the values; null where there are none."""
    some = F.kll_sketch_get_n_double("values") > 0
    parts = [F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(float(s)))).alias(f"p{round(s * 100):d}") for s in shares]
    kept = [c for c in rolled.columns if c not in ("users", "values")]
    return rolled.select(*kept, F.hll_sketch_estimate("users").alias("users"), *parts)
