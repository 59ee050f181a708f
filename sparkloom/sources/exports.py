"""Results written for others: CSV, text, JSON, script filters, chat blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signs for file types.
SIGNS = {
    "pdf": "📄", "py": "🐍", "js": "📜", "ts": "📜", "md": "📝", "txt": "📝", "docx": "📃", "doc": "📃",
    "json": "⚙️", "yaml": "⚙️", "yml": "⚙️", "ipynb": "📊", "sh": "🖥️", "csv": "📊", "html": "🌐", "rs": "🦀",
}
OTHER_SIGN = "📁"
# End of fixed values.


def sign(file_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SIGNS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(file_type)), F.lit(OTHER_SIGN))


def quoted(value: Column) -> Column:
    """A field as RFC 4180 has it: quoted where it must be."""
    text = value.cast("string")
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def csv_lines(rows: DataFrame, columns: tuple[str, ...] = ("path", "score", "snippet")) -> DataFrame:
    return rows.select(F.concat_ws(",", *(quoted(F.col(c)) for c in columns)).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select("path", "score", "snippet").write.option("header", True).option("escape", '"').csv(path)


def write_paths(rows: DataFrame, path: str) -> None:
    rows.select("path").write.text(path)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def script_filter(rows: DataFrame) -> DataFrame:
    """A launcher's items as JSON. ``no_results`` stands in where there are none."""
    title = F.concat(sign(F.col("file_type")), F.lit(" "), F.col("filename"))
    subtitle = F.when(F.coalesce(F.col("snippet"), F.lit("")) != "", F.substring("snippet", 1, 120)).otherwise(F.col("path"))
    return rows.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("uid"), title.alias("title"), subtitle.alias("subtitle"), F.col("path").alias("arg"), F.col("filename").alias("autocomplete"))).alias("item"))


def no_results(query: str) -> dict:
    return {"uid": "no-results", "title": "No results found", "subtitle": f"No matches for “{query}”", "valid": False}


def chat_block(rows: DataFrame) -> DataFrame:
    """A section of a chat message per result, with the snippet's marks as the chat's own."""
    snippet = F.substring(F.coalesce("snippet", F.lit("")), 1, 280)
    for old, new in (("**", "*"), ("<em>", "_"), ("</em>", "_"), ("<b>", "*"), ("</b>", "*")):
        snippet = F.replace(snippet, F.lit(old), F.lit(new))
    share = F.format_string("%.1f", F.round(F.col("score") * 100, 1))
    text = F.concat(sign(F.col("file_type")), F.lit(" *"), F.col("filename"), F.lit("*\n"), snippet, F.lit("\n_Score: "), share, F.lit("% · `"), F.col("path"), F.lit("`_"))
    return rows.select("doc_id", text.alias("block"))


def write_vectors(embeddings: DataFrame, path: str) -> None:
    """All vectors of an index with their ids: ``vector`` is the components as little-endian 16-bit floats."""

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, "<f2").tobytes() for v in vectors], dtype=object)

    embeddings.select("chunk_id", packed("embedding").alias("vector")).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of such a dump."""

    @F.pandas_udf("array<float>")
    def unpacked(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.frombuffer(v, "<f2").astype("<f4") for v in vectors], dtype=object)

    return spark.read.parquet(path).select("chunk_id", unpacked("vector").alias("embedding"))
