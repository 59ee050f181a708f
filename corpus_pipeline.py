"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on every document that the one before
kept and returns a DataFrame; all but the last return the columns of ``documents``.
A stage's result is to be written as Parquet and read again before the next one, as
``run`` does, since stages read their input more than once.

Defined results, for every stage: columns beside doc_id and text are kept, whatever their
names, and an empty table gives an empty result. A null or empty text has no words, so the
quality stage drops it; the later stages keep it (null stays null), the near-dedup stage one of
all such texts, and packing gives it its end id. Very long texts are read whole. A null doc_id is
kept; it comes before all others in line dedup, whose first place stays, and after all
others in near dedup, whose smallest id stays. Repeated rows are alike to every filter, count as one
document in line dedup, and are one group in near dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import line_chunks, near_copies, quality_ledger, retrieval_packing, toxicity_nbsvm
from sparkloom.llm._shared import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1 of the rule ledger."""
    return quality_ledger.filter_documents(docs, "v1")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labelled ones among them."""
    return toxicity_nbsvm.filter_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line chunks and passages that an earlier one has; n_chars follows the text."""
    done = line_chunks.deduplicate(docs, passages=True)
    text = F.col(f"{done.columns[-1]}.text")
    new = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), F.col("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return done.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_copies.representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in their sequences."""
    return retrieval_packing.pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("packing", packing)]

#: Toxicity, line chunks, fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
