"""Analytics of search and click logs, dashboards, favourites, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import results

DAY = 86400.0


def since(df: DataFrame, column: str, now: float, days: int) -> DataFrame:
    return df.filter(F.col(column) >= F.lit(now - days * DAY))


def logged(searches: DataFrame) -> DataFrame:
    """Searches that are worth keeping: two characters at least."""
    return searches.filter(F.length(F.trim("query")) >= 2)


def clicked(clicks: DataFrame) -> DataFrame:
    return clicks.filter(F.trim("query") != "")


def recent(searches: DataFrame, limit: int = 20) -> DataFrame:
    """(query, last_at): each query once without regard to case, as last written, the latest first."""
    last = searches.groupBy(F.lower("query").alias("folded")).agg(F.max_by("query", F.struct("searched_at", "query")).alias("query"), F.max("searched_at").alias("last_at"))
    return last.orderBy(F.desc("last_at"), "folded").limit(limit).select("query", "last_at")


def frequent(searches: DataFrame, limit: int = 20) -> DataFrame:
    return searches.groupBy(F.lower("query").alias("query")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def recent_with_prefix(searches: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    return recent(searches.filter(F.lower("query").startswith(prefix.lower())), limit)


def top_searches(searches: DataFrame, now: float, days: int = 30, limit: int = 10) -> DataFrame:
    grouped = since(searches, "searched_at", now, days).groupBy(F.lower("query").alias("query")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("result_count"), F.lit(0.0)), 1).alias("avg_results"))
    return grouped.orderBy(F.desc("n"), "query").limit(limit)


def top_clicked(clicks: DataFrame, now: float, days: int = 30, limit: int = 10) -> DataFrame:
    grouped = since(clicks, "clicked_at", now, days).groupBy(F.col("doc_path").alias("path")).agg(F.max_by("doc_filename", F.struct("clicked_at", "doc_filename")).alias("filename"), F.count(F.lit(1)).alias("clicks"))
    return grouped.orderBy(F.desc("clicks"), "path").limit(limit)


def per_day(searches: DataFrame, now: float, days: int = 30) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("searched_at") / DAY).cast("int")).cast("string")  # UTC, whatever the session's zone
    return since(searches, "searched_at", now, days).groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("n")).orderBy("date")


def totals(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table; every scan counts where it reads."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def summary(searches: DataFrame, clicks: DataFrame, now: float, days: int = 30) -> dict[str, DataFrame]:
    return {
        "totals": totals(searches=searches, clicks=clicks),
        "top_searches": top_searches(searches, now, days),
        "top_clicked": top_clicked(clicks, now, days),
        "per_day": per_day(searches, now, days),
    }


# Categories of file types.
CATEGORIES = {
    "PDF": "pdf".split(),
    "Documents": "docx doc odt rtf".split(),
    "Code": "py js ts java c cpp h go rs rb sh bash zsh sql r ipynb jsx tsx".split(),
    "Text": "txt md rst org tex csv tsv log".split(),
    "Web/Config": "html htm xml json yaml yml toml css".split(),
}
# End of fixed values.


def category(extension: Column) -> Column:
    bare = F.ltrim(extension, F.lit("."))
    out = None
    for name, types in CATEGORIES.items():
        out = F.when(bare.isin(*types), name) if out is None else out.when(bare.isin(*types), name)
    return out.otherwise("Other")


def type_breakdown(documents: DataFrame) -> DataFrame:
    return documents.groupBy(category(F.coalesce("extension", F.lit(""))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def folder_stats(documents: DataFrame, folders: list[str]) -> DataFrame:
    """(folder, file_count, last_indexed) of each configured folder, also of empty ones. Documents are read once, and each task sends a row a folder."""
    matches = F.array(*(F.when(F.col("path").startswith(f), F.lit(f)) for f in folders))
    counted = documents.select(F.explode(F.array_compact(matches)).alias("folder"), "indexed_time").groupBy("folder").agg(F.count(F.lit(1)).alias("file_count"), F.max("indexed_time").alias("last_indexed"))
    named = documents.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
    return named.join(counted, "folder", "left").select("folder", F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"), "last_indexed")


def size_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"), F.round(F.avg(F.octet_length("text")), 2).alias("avg_chunk_bytes"))


# ------------------------------------------------------------- favourites, history


def add_favorite(favorites: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (doc_id, created_at) added unless already there; of several the first counts."""
    once = new.groupBy("doc_id").agg(F.min("created_at").alias("created_at"))
    return favorites.unionByName(once.join(favorites.select("doc_id"), "doc_id", "left_anti"))


def remove_favorite(favorites: DataFrame, gone: DataFrame) -> DataFrame:
    return favorites.join(gone.select("doc_id"), "doc_id", "left_anti")


def favorite_documents(favorites: DataFrame, documents: DataFrame) -> DataFrame:
    return favorites.join(documents, favorites["doc_id"] == documents["id"]).drop("id").orderBy(F.desc("created_at"), "doc_id")


def recently_opened(opens: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """Each document once, by its last opening; opens are grouped before the join."""
    last = opens.groupBy("doc_id").agg(F.max("opened_at").alias("opened_at"))
    return last.join(documents, last["doc_id"] == documents["id"]).drop("id").orderBy(F.desc("opened_at"), "doc_id").limit(limit)


def history(searches: DataFrame, limit: int = 50) -> DataFrame:
    return searches.orderBy(F.desc("searched_at"), "query").limit(limit)


def activity(documents: DataFrame, limit: int = 20) -> DataFrame:
    return documents.orderBy(F.desc("indexed_time"), "id").limit(limit)


# ------------------------------------------------------------- suggestions


def title_suggestions(documents: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """(suggestion, place): file names that begin with a text, then those that hold it; later names first, each once without regard to case."""
    folded = F.lower("filename")
    value = F.when(folded.startswith(text.lower()), 2.0).when(folded.contains(text.lower()), 1.0)
    found = documents.select("filename", value.alias("value")).filter("value IS NOT NULL").groupBy(F.lower("filename").alias("folded")).agg(F.max(F.struct("value", "filename")).alias("best"))
    top = found.orderBy(F.desc("best.value"), F.desc("best.filename")).limit(limit)
    return numbered(top.select(F.col("best.filename").alias("suggestion"), F.col("best.value").alias("a"), F.lit(None).cast("double").alias("b")), F.desc("a"), F.desc("suggestion"))


def numbered(few: DataFrame, *order: Column) -> DataFrame:
    """Places from 0 for rows whose number a limit bounds."""
    listed = few.groupBy().agg(F.collect_list("suggestion").alias("s")) if not order else few.orderBy(*order).groupBy().agg(F.collect_list("suggestion").alias("s"))
    return listed.select(F.posexplode("s").alias("place", "suggestion")).select("suggestion", "place")


def suggest(searches: DataFrame, documents: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(suggestion, place): recent searches, then file names; each once without regard to case."""
    recent_ones = recent_with_prefix(searches, text, 5)
    first = numbered(recent_ones.select(F.col("query").alias("suggestion"), "last_at"), F.desc("last_at"), F.lower("suggestion"))
    both = first.withColumn("part", F.lit(0)).unionByName(title_suggestions(documents, text).withColumn("part", F.lit(1)))
    once = both.groupBy(F.lower("suggestion").alias("folded")).agg(F.min(F.struct("part", "place", "suggestion")).alias("best"))
    top = once.select("best.*").orderBy("part", "place").limit(limit)
    return numbered(top, F.col("part"), F.col("place"))


def file_page(documents: DataFrame, file_type: str | None = None, text: str | None = None, folder: str | None = None, key: str = "indexed_time", descending: bool = True, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page of the file list, and the number of all files of the list."""
    kept = results.list_filter(documents, file_type, text, folder)
    return results.page(kept, results.list_order(key, descending), number, size), kept.agg(F.count(F.lit(1)).alias("total"))
