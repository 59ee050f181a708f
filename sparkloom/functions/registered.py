"""The text and vector functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: SQL functions: parameters and body; they are expanded into the plan, so nothing runs outside the JVM.
SQL_FUNCTIONS = {
    "index_terms": ("t STRING", "ARRAY<STRING>", r"filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+', 0), x -> octet_length(x) <= 40)"),
    "word_tokens": ("t STRING", "ARRAY<STRING>", r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+', 0)"),
    "dot_product": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"),
    "rrf_part": ("weight DOUBLE, rnk INT", "DOUBLE", "weight / (60D + rnk)"),
    "recency_boost": ("modified DOUBLE, now DOUBLE", "DOUBLE", "1 + 0.08D * exp(-greatest(0D, (now - modified) / 86400D) / 30D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
