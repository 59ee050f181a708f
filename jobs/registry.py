"""The jobs as named queries: each runs twice into one new folder, and the whole output as it then stands is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import catalog, stored

from . import document_index, usage_report


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{stored.folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        # a pattern, as Spark streams a folder or what a pattern finds, and the table may be one file
        document_index.run(spark, f"{sf_dir}/documents.parque[t]", out, f"{out}/_checkpoint")
    return document_index.read(spark, out)


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{stored.folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        usage_report.run(spark, f"{sf_dir}/events.parquet", out)
    return usage_report.read(spark, out)


QUERIES = {"job1_document_index": job1, "job2_usage_report": job2}

ORACLES = {
    "job1_document_index": f"""WITH {catalog.TERMS}, dictionary AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY term
)
SELECT chunk_id AS doc_id, lang AS folder, term, tf, dl, df, cf FROM postings JOIN documents ON chunk_id = doc_id JOIN dictionary USING (term)""",
    "job2_usage_report": """WITH used AS (
  SELECT ts::DATE AS day, lower('key ' || (props->>'$.k')) AS query, event_type, user_id FROM events WHERE event_type IN ('view', 'click') AND ts IS NOT NULL AND (props->>'$.k') IS NOT NULL
), summed AS (
  SELECT day, query, count(*) FILTER (event_type = 'view') AS searches, sum(user_id) FILTER (event_type = 'view') AS results, count(*) FILTER (event_type = 'click') AS clicks FROM used GROUP BY ALL
), shared AS (
  SELECT *, (sum(searches) OVER (PARTITION BY day))::BIGINT AS day_searches FROM summed
)
SELECT day, query, searches, round(CASE WHEN searches > 0 THEN results / searches ELSE 0 END, 6)::DOUBLE AS avg_results, clicks,
  round(CASE WHEN searches > 0 THEN clicks / searches ELSE 0 END, 6)::DOUBLE AS click_share, day_searches,
  round(CASE WHEN day_searches > 0 THEN searches / day_searches ELSE 0 END, 6)::DOUBLE AS day_share, strftime(day, '%Y-%m') AS month
FROM shared""",
}
