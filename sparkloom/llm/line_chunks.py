"""Line deduplication over content-defined chunks.

1. A text's lines are hashed; a rolling hash over ``WINDOW`` line hashes ends a
   chunk where it is even, so an inserted or deleted line moves no boundary beyond
   its neighbourhood. A chunk has 2 lines at least and ``MOST_LINES`` at most.
2. With ``passages`` also each two neighbouring lines (blank ones aside) are looked at,
   and each line of ``PASSAGE_WORDS`` words or more: chunk edges depend on the lines
   around a passage, these don't.
3. Hashes are counted over all texts, without bytes. Places whose hash occurs more than
   once are joined back to their texts, which send the bytes of these places only; they are
   grouped by the bytes themselves, so two places are the same only if every byte is.
4. Of each repeated chunk the first (by doc_id, then the hash of the text, then line)
   stays; the others' lines are taken out of their texts. With ``passages``, where repeated
   pairs follow one another without a gap over ``PASSAGE_WORDS`` words or more, all their
   lines go, and so do repeated lines of as many words.

Only chunks of two or more lines that have a word, and such passages, are ever removed;
of each line the first place stays. Defined results: a null text stays null and takes no
part; an empty one has no chunk; a very long one is read whole. Rows of the same doc_id
and text are one document and are treated alike. A null doc_id sorts before all others.
Repetition inside a text counts. A text that loses every line becomes empty; its row
stays. An empty table gives an empty result. ``deduplicate`` keeps all other columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, fresh, join_counted, small_batches, staged, table

WINDOW = 2
FEWEST_LINES, MOST_LINES = 2, 16
#: Words of a repeated line, or of a run of repeated pairs of lines, that make it a passage.
PASSAGE_WORDS = 50
#: A place is its first line times ``KINDS`` plus what begins there.
KINDS = 4
CHUNK, PAIR, LINE = range(3)
FACTOR = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def chunks(raw: bytes) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, whether it may be removed) of every chunk, in order."""
    if not raw:
        return []
    lines = raw.split(b"\n")
    hashes = list(map(xxhash.xxh3_64_intdigest, lines))
    leaving = pow(FACTOR, WINDOW, 1 << 64)
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * FACTOR + h - (hashes[i - WINDOW] * leaving if i >= WINDOW else 0)) & M64
        n = i + 1 - start
        if i + 1 == len(lines) or n >= FEWEST_LINES and (n >= MOST_LINES or not (rolling ^ rolling >> 32) & 1):
            out.append((start, i + 1, sum(1 for line in lines[start : i + 1] if line.strip()) >= 2))
            start = i + 1
    return out


def places(text: str | None, passages: bool) -> list[tuple[int, bytes]]:
    """(place, bytes) of what may be removed; bytes of different kinds are never the same, as no text has the bytes FE and FF."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    out = [(a * KINDS + CHUNK, b"\n".join(lines[a:b])) for a, b, may in chunks(raw) if may]
    if passages:
        said = [(i, line) for i, line in enumerate(lines) if line.strip()]
        out += [(i * KINDS + PAIR, b"\xff" + a + b"\n" + b) for (i, a), (_, b) in zip(said, said[1:])]
        out += [(i * KINDS + LINE, b"\xfe" + a) for i, a in said if len(a) >= 2 * PASSAGE_WORDS - 1 and len(a.split()) >= PASSAGE_WORDS]
    return out


def hash_of(content: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(content)
    return h - (1 << 64) if h >> 63 else h


def passages_of(lines: list[bytes], gone: set[int]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the passages that the repeated pairs and lines among the places ``gone`` make up."""
    out, begin, end, words = [], 0, 0, 0
    said = [i for i, line in enumerate(lines) if line.strip()]
    for i, following in zip(said, said[1:]):
        if i * KINDS + PAIR not in gone:
            continue
        if i + 1 != end:  # no pair before this one ends in its first line
            if words >= PASSAGE_WORDS:
                out.append((begin, end))
            begin, words = i, len(lines[i].split())
        end = following + 1
        words += len(lines[following].split())
    if words >= PASSAGE_WORDS:
        out.append((begin, end))
    return out + [(i, i + 1) for i in said if i * KINDS + LINE in gone]


def without(text: str, gone: set[int]) -> tuple[str, int]:
    """``text`` less the chunks and passages at the places ``gone``, and how many lines went."""
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    cut = np.zeros(len(lines), bool)
    for a, b in [(a, b) for a, b, _ in chunks(raw) if a * KINDS + CHUNK in gone] + passages_of(lines, gone):
        cut[a:b] = True
    return b"\n".join(line for line, c in zip(lines, cut) if not c).decode("utf-8", "surrogatepass"), int(cut.sum())


PLACE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("place", T.LongType())])
#: As Python gives it: ids as text, since pandas would make floats of numbers with nulls.
META = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc_id", T.StringType()), *PLACE.fields[1:]])
SENT = T.StructType([*META.fields, T.StructField("bytes", T.BinaryType())])


def _hashed(passages: bool):
    """The hash of every place."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(hash_of(c), i, h, p) for i, h, text in zip(frame["doc_id"], frame["text_hash"], frame["text"]) for p, c in places(text, passages)]
            yield pd.DataFrame(rows, columns=META.names)

    return emit


def _sent(passages: bool):
    """The bytes of the places in ``wanted``."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, h, text, wanted in zip(frame["doc_id"], frame["text_hash"], frame["text"], frame["wanted"]):
                wanted = set(wanted.tolist())
                rows += [(hash_of(c), i, h, p, c) for p, c in places(text, passages) if p in wanted]
            yield pd.DataFrame(rows, columns=SENT.names)

    return emit


def removals(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(doc_id, text_hash, gone): the places to take out. ``docs`` has doc_id, text_hash and text."""
    small_batches(docs.sparkSession)
    number = F.col("doc_id").cast("long")
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    meta = staged(named.mapInPandas(_hashed(passages), META).withColumn("doc_id", number), "places")
    counts = staged(meta.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    repeated = staged(join_counted(meta, counts, "h").drop("n"), "repeated")
    wanted = repeated.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"), "wanted")
    on = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))
    texts = docs.join(wanted.hint("merge"), on).select(F.col("doc_id").cast("string").alias("doc_id"), "text_hash", "text", "wanted")
    sent = texts.mapInPandas(_sent(passages), SENT).withColumn("doc_id", number)

    # one row per hash and bytes; what is equal in a task collapses before the shuffle
    place = F.struct(*PLACE.names)
    classes = staged(sent.groupBy("h", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")), "classes")
    per_hash = staged(classes.groupBy("h").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n"), F.min("kept").alias("kept")), "perhash")
    # all places of the hash have the same bytes: places are enough
    going = join_counted(repeated, per_hash.filter("n_classes = 1").select("h", "n", "kept"), "h").filter(place != F.col("kept")).select(*PLACE.names)
    several = per_hash.filter("n_classes > 1").select("h")
    if not several.isEmpty():  # one hash, different bytes: place by place
        mixed = classes.join(several, "h").filter("n > 1").select("h", "bytes", "kept")
        going = going.unionAll(sent.join(mixed, ["h", "bytes"]).filter(place != F.col("kept")).select(*PLACE.names))
    return going.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("gone"))


CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("n_lines", T.LongType())])


@F.pandas_udf(CUT)
def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    rows = []
    for t, g in zip(text, gone):
        n_lines = t.count("\n") + 1 if t else 0
        rows.append((*(without(t, set(g.tolist())) if t and g is not None and len(g) else (t, 0)), n_lines))
    return pd.DataFrame(rows, columns=CUT.names)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """``docs`` with repeated chunks (and ``passages``) taken out of the text, and a struct column with line counts.

    The name of the struct column (text, n_removed, n_lines) is the last one.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(column(id_col).cast("long").alias("doc_id"), F.xxhash64(column(text_col)).alias("text_hash"), column(text_col).alias("text"))
    gone = staged(removals(keyed, passages), "removals")
    other = {n: fresh(n, docs.columns) for n in PLACE.names[:2] + ["gone"]}
    gone = gone.select(*(F.col(n).alias(new) for n, new in other.items()))
    on = column(id_col).cast("long").eqNullSafe(gone[other["doc_id"]]) & (F.xxhash64(column(text_col)) == gone[other["text_hash"]])
    joined = docs.join(gone.hint("merge"), on, "left")  # one plan at every size
    return joined.select(*(column(c) for c in docs.columns), cut(column(text_col), F.col(other["gone"])).alias(fresh("deduplicated", docs.columns)))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)
    return rows.select("doc_id", F.col("deduplicated.n_lines").alias("n_lines"), F.col("deduplicated.n_removed").alias("n_removed"), F.col("deduplicated.text").alias("text"))


QUERIES = {"op9_line_chunks": op9_line_chunks}
ORACLES: dict[str, str] = {}
