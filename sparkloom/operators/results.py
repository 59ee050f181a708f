"""From ranked chunks to answers for a user: enrichment, one row per file, filters, order, pages, projections."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def enrich(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk's and document's columns; hits without either go. Hits are few: AQE broadcasts them."""
    return hits.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(documents.withColumnRenamed("id", "doc_id"), "doc_id")


def best_per_file(hits: DataFrame) -> DataFrame:
    """Each file's best chunk, with the number of its other chunks among the hits."""
    per_file = Window.partitionBy("query_id", "doc_id")
    numbered = hits.withColumns({"place": F.row_number().over(per_file.orderBy(F.desc("score"), F.asc("chunk_id"))), "other_chunk_count": F.count(F.lit(1)).over(per_file) - 1})
    return numbered.filter("place = 1").drop("place")


# ------------------------------------------------------------- filters


def type_set(types: str) -> list[str]:
    return [t for t in (part.strip().lower().lstrip(".") for part in types.split(",")) if t]


def bare_extension(extension: Column) -> Column:
    return F.lower(F.ltrim(extension, F.lit(".")))


def of_types(df: DataFrame, types: str | None) -> DataFrame:
    wanted = type_set(types or "")
    return df.filter(bare_extension(F.col("extension")).isin(*wanted)) if wanted else df


def of_exact_type(df: DataFrame, file_type: str | None) -> DataFrame:
    return df.filter(F.ltrim("extension", F.lit(".")) == file_type) if file_type else df


def in_folder(df: DataFrame, folder: str | None) -> DataFrame:
    return df.filter(F.col("path").startswith(folder)) if folder else df


def day(text: str) -> float:
    """Seconds since the epoch at the start of a day, UTC."""
    return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp()


def in_dates(df: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Modified at or after the start of ``after``, and not after the start of ``before``."""
    if after is not None:
        df = df.filter(F.col("modified_time") >= day(after))
    return df if before is None else df.filter(F.col("modified_time") <= day(before))


def in_sizes(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    if least is not None:
        df = df.filter(F.col("size") >= least)
    return df if most is None else df.filter(F.col("size") <= most)


def filtered(df: DataFrame, types=None, folder=None, after=None, before=None, size_min=None, size_max=None) -> DataFrame:
    return in_sizes(in_dates(in_folder(of_types(df, types), folder), after, before), size_min, size_max)


def list_filter(df: DataFrame, file_type: str | None = None, text: str | None = None, folder: str | None = None) -> DataFrame:
    """Files of a type whose name or path holds a text, without regard to case."""
    df = in_folder(of_exact_type(df, file_type), folder)
    if text:
        df = df.filter(F.lower("filename").contains(text.lower()) | F.lower("path").contains(text.lower()))
    return df


# ------------------------------------------------------------- order and pages

# Other names of sort orders, the keys of the file list, and what ends a preview that is cut.
ALIASES = {"date": "date_modified", "size": "file_size", "name": "file_type"}
LIST_KEYS = ("filename", "extension", "size", "modified_time", "indexed_time", "num_chunks", "path")
TRUNCATED = "\n\n... (truncated)"
# End of fixed values.


def sort_columns(sort: str = "relevance") -> list[Column]:
    sort = ALIASES.get(sort, sort)
    columns = {
        "relevance": [F.desc("score")],
        "date_modified": [F.desc("modified_time")],
        "file_size": [F.desc("size")],
        "file_type": [F.asc(F.lower("filename"))],
    }
    if sort not in columns:
        raise ValueError(f"sort: {sort}")
    return [*columns[sort], F.asc("path")]


def list_order(key: str = "indexed_time", descending: bool = True) -> list[Column]:
    key = key if key in LIST_KEYS else "indexed_time"
    column = F.lower(key) if key in ("filename", "extension", "path") else F.col(key)
    return [column.desc() if descending else column.asc(), F.asc("id")]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes count from 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


# ------------------------------------------------------------- projections


def api_row(df: DataFrame) -> DataFrame:
    """The columns that a client gets. ``snippets`` is optional."""
    plain = F.substring("text", 1, 200)
    snippet = F.coalesce(F.get("snippets", F.lit(0))["highlighted"], plain) if "snippets" in df.columns else plain
    return df.select(
        "doc_id", "path", "filename", snippet.alias("snippet"), F.round("score", 4).alias("score"), F.ltrim("extension", F.lit(".")).alias("file_type"),
        F.timestamp_seconds("modified_time").alias("modified"), "other_chunk_count", F.col("size").alias("file_size"),
    )


def preview(chunks: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, preview): a document's chunks in order, cut after ``most`` characters."""
    joined = full_text(chunks)
    cut = F.when(F.length("full") > most, F.concat(F.substring("full", 1, most), F.lit(TRUNCATED))).otherwise(F.col("full"))
    return joined.select("doc_id", cut.alias("preview"))


def full_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, full): bounded by the document, not by the corpus."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n").alias("full"))


def rich_preview(texts: DataFrame, text_col: str = "full") -> DataFrame:
    """``preview``: 500 characters, ended at the last sentence if that leaves over 200; ``word_count``."""
    text = F.col(text_col)
    head = F.substring(text, 1, 500)
    cut = F.length(head) - F.locate(" .", F.reverse(head)) - 1  # place of the last ". ", from 0
    has = F.locate(" .", F.reverse(head)) > 0
    shown = F.when(F.length(text) <= 500, text).when(has & (cut > 200), F.substring(text, F.lit(1), cut + 1)).otherwise(F.concat(head, F.lit("…")))
    words = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    return texts.withColumn("preview", shown).withColumn("word_count", words)
