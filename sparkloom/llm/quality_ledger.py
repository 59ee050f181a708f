"""Quality rules as a bitmask ledger.

``measure`` reads each text once; ``ledger`` turns the measurements into one
long of failure bits per document (bit *i* is rule *i* of ``RULES``). Policies
are versioned masks over those bits, so a new policy, or the question what a
rule costs, never reads a text again: ``apply_policy`` and ``ablation`` work on
the ledger by bitwise operations only.

Words are maximal runs of anything but the six ASCII white-space characters.

Defined results: a null text has no words, symbols or lines; an empty text is
the same; a very long one is measured whole. A null doc_id is kept as it is. Repeated rows each get their own
ledger row. An empty table gives an empty ledger. Extra columns are left out of
the ledger; ``filter_documents`` keeps them all, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, fresh, small_batches, staged, table

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure_text(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES``; n_lines counts the lines that have a word."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    word_chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        covered = bytearray(n)
        for i, window in enumerate(windows):
            j = first.setdefault(window, i)
            if j != i:
                covered[i : i + 3] = b"\1\1\1"
                covered[j : j + 3] = b"\1\1\1"
        repeated = covered.count(1)
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines)


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measure(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in text], columns=list(MEASURES), dtype="int64")


@dataclass(frozen=True)
class Rule:
    """Fails where ``test`` holds; ``test`` is SQL over the measurements."""

    name: str
    test: str


#: The place of a rule is its bit. New rules go at the end; a rule never moves.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("many_words", "n_words > 100000"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_words")),
        Policy("v1", ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")),
        Policy("strict", tuple(BIT)),
    )
}


def failure_bits(at: str = "") -> Column:
    """The bits of every rule over measurement columns (with the prefix ``at``) as one long."""
    total = F.lit(0).cast("long")
    for rule in RULES:
        test = rule.test
        for m in MEASURES:
            test = test.replace(m, f"{at}{m}")
        total = total + F.when(F.expr(test), F.lit(BIT[rule.name]).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``failed`` (bits)."""
    small_batches(docs.sparkSession)
    measured = docs.select(column(id_col).alias("doc_id"), measure(column(text_col)).alias("m")).select("doc_id", "m.*")
    return measured.withColumn("failed", failure_bits())


def passes(policy: Policy, failed: Column | None = None) -> Column:
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    return rows.withColumn("kept", passes(POLICIES[version]))


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    One pass over the ledger: documents are counted by their failure bits under the policy's
    mask, of which there are no more than two to the number of its rules; all figures are
    bitwise sums over those counts.
    """
    policy = POLICIES[version]
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("hit")
    patterns = rows.groupBy(hit).agg(F.count(F.lit(1)).alias("n"))
    per_rule = patterns.select("hit", "n", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in policy.rules))).alias("r")).select("hit", "n", "r.*")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    left = F.col("hit").bitwiseAND(F.bitwise_not("bit"))
    return per_rule.groupBy("rule").agg(
        total(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(F.col("hit") == F.col("bit")).alias("n_alone"),
        total(left == 0).alias("n_kept_without"), F.sum("n").alias("n_docs"), total(F.col("hit") == 0).alias("n_kept"),
    )


def filter_documents(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that pass the policy, with the columns they came with."""
    small_batches(docs.sparkSession)
    m = fresh("measured", docs.columns)
    return docs.withColumn(m, measure(column(text_col))).filter(passes(POLICIES[version], failure_bits(f"{m}."))).select(*map(column, docs.columns))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are read here and never again: policies work on what is stored
    rows = apply_policy(staged(ledger(table(spark, sf_dir, "documents")), "ledger"), "v1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(POLICIES["base"])).alias("base_failed"), "kept", "n_lines", "failed",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid
), ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN ln USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 100000 THEN 64 ELSE 0 END)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
  (failed & 63) = 0 AS kept, n_lines, failed FROM f
"""

QUERIES = {"op2_quality_ledger": op2_quality_ledger}
ORACLES = {"op2_quality_ledger": ORACLE_SQL}
