"""Reports by day what was searched for and opened, and how much the log holds.

    python -m jobs.usage_report --events PATH --out PATH [--since DAY] [--until DAY] [--config FILE]

Reads a log (event_id, ts, user_id, event_type, value, props) and writes, in ``--out``:

    queries  day   | query, searches, results, clicks
    days     day   | n, total, low, high, users, values   users and values are sketches
    report   month | day, query, searches, avg_results, clicks, click_share, day_searches, day_share
    months   month | n, total, low, high, users, p50, ...

Only the days from ``--since`` to ``--until`` (all, without them) are read and written again, by
dynamic overwrite of their partitions; ``report`` and ``months`` come from the stored days of the
months concerned, by sums and merged sketches, not from the log. So running it again for any days
gives the same result, and a late event is taken up by running its day again.

Defined results: rows without a time, and searches and clicks without a query in ``props``, are
left out of ``queries``; rows without a time are left out of ``days`` too. Queries don't
differ by case. Shares of nothing are 0.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import rollups

log = logging.getLogger("jobs.usage_report")

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "usage_report.json")
#: Columns of the tables and the one that each is partitioned by. ``months`` has a percentile more for each of the config's shares.
TABLES = {
    "queries": ("query string, searches long, results long, clicks long, day date", "day"),
    "days": ("n long, total double, low double, high double, users binary, values binary, day date", "day"),
    "report": ("day date, query string, searches long, avg_results double, clicks long, click_share double, day_searches long, day_share double, month string", "month"),
    "months": ("n long, total double, low double, high double, users long, month string", "month"),
}


def seconds(at: str):
    """Seconds since 1970 of a time with or without a zone (without: UTC)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({at} AS TIMESTAMP_NTZ))") / 1e6


def logs(events: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """The searches and the clicks of a log, with the query that each belongs to."""
    key = F.get_json_object("props", "$.k")
    timed = events.filter(F.col("at").isNotNull() & key.isNotNull()).withColumn("query", F.concat(F.lit("key "), key))
    searches = timed.filter(F.col("event_type") == config["search"]).select("query", F.col("user_id").alias("result_count"), F.col("at").alias("searched_at"))
    clicks = timed.filter(F.col("event_type") == config["click"]).select("query", F.col("at").alias("clicked_at"))
    return searches, clicks


def write(rows: DataFrame, path: str, part: str, files: int) -> None:
    """Replaces the partitions that ``rows`` has."""
    dealt = rows.repartition(F.col(part), F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("users", "values")]), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def run(spark: SparkSession, events: str, out: str, since: str | None = None, until: str | None = None, config: dict | None = None) -> None:
    """Writes the days' tables and what follows from them."""
    config, out = load() | (config or {}), out.rstrip("/")
    for name, (schema, part) in TABLES.items():  # every table exists, if only as an empty folder
        spark.createDataFrame([], schema).write.mode("append").partitionBy(part).parquet(f"{out}/{name}")
    timed = spark.read.parquet(events).withColumn("at", seconds("ts"))
    for given, compare in ((since, "__ge__"), (until, "__le__")):
        if given:
            timed = timed.filter(getattr(F.expr("CAST(CAST(ts AS TIMESTAMP_NTZ) AS DATE)"), compare)(F.lit(given).cast("date")))
    log.info("%s: %d rows read", events, timed.count())
    write(rollups.daily(timed), f"{out}/days", "day", 1)
    write(rollups.daily_queries(*logs(timed, config)), f"{out}/queries", "day", config["files_per_day"])

    month = F.date_format("day", "yyyy-MM")
    days, queries = (read(spark, out, name) for name in ("days", "queries"))
    for given, compare in ((since, "__ge__"), (until, "__le__")):
        if given:
            days, queries = (d.filter(getattr(month, compare)(given[:7])) for d in (days, queries))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    totals = queries.groupBy(F.col("day").alias("of_day")).agg(F.sum("searches").alias("day_searches"))
    joined = queries.join(totals, F.col("day") == F.col("of_day"))
    report = joined.select(
        "day", "query", "searches", F.round(F.when(F.col("searches") > 0, F.col("results") / F.col("searches")).otherwise(0.0), 6).alias("avg_results"), "clicks",
        share(F.col("clicks"), F.col("searches")).alias("click_share"), "day_searches", share(F.col("searches"), F.col("day_searches")).alias("day_share"), month.alias("month"),
    )
    write(report, f"{out}/report", "month", config["files_per_day"])
    write(rollups.figures(rollups.merged(days, month.alias("month")), *config["shares"]), f"{out}/months", "month", 1)
    for name in TABLES:
        log.info("%s/%s: %d rows written", out, name, read(spark, out, name).count())


def read(spark: SparkSession, out: str, name: str = "report") -> DataFrame:
    """A table of the report as it stands."""
    return spark.read.schema(TABLES[name][0]).parquet(f"{out.rstrip('/')}/{name}")


def load(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--events", required=True, help="a Parquet table")
    parser.add_argument("--out", required=True)
    parser.add_argument("--since", help="first day, as 2024-01-31")
    parser.add_argument("--until", help="last day")
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from sparkloom.session import session

    spark = session("usage-report")
    try:
        run(spark, given.events, given.out, given.since, given.until, load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
