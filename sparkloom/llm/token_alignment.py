"""Alignment of two tokenizers' tokens over the bytes of a text.

Tokenizer A is a byte-level BPE that reads a space and the text, B a SentencePiece
model that puts the space there itself, so both cut the same bytes. Every byte has a
label: none, the end of an A token, the end of a B token, or both. A regular
expression scans this label string for spans up to the next *both*; such a span is a
group, and the labels counted in it say how many tokens of A and of B it holds.
Between two neighbouring ends of either kind lies one piece of one A token and of one
B token: these pieces are the links.

``linked`` writes each text's groups and its distinct id pairs once. Pairs are then
counted over the corpus and the counts joined back. Fewer than ``FREQUENT`` pairs can
hold more than one in ``FREQUENT`` of all links; they are sent to every task, which
settles most links where they lie, and only the links of other pairs are shuffled,
by pairs of which none is frequent.

Defined results: a null or empty text, and one whose tokens don't spell a space and
the text (one with U+2581, which B reads as a space), has no tokens: zeros and ''.
Texts are read whole, however long. Repeated rows each get a row and count each.
A null doc_id is kept. An empty table gives an empty result. Columns other than id and
text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import piece_encode
from ._shared import column, small_batches, staged, table
from .retrieval_packing import default_vocabulary, vocabulary

NONE, A_END, B_END, BOTH = 0, 1, 2, 3
SPAN = re.compile(rb"[^\x03]*\x03")
#: A pair with more than one in so many of all links is joined where its links lie; there are fewer such pairs than this.
FREQUENT = 1 << 17


def label_string(a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The label of every byte; both tokenizations cover the same bytes."""
    labels = np.zeros(int(a_sizes.sum()), np.uint8)
    labels[np.cumsum(a_sizes) - 1] = A_END
    labels[np.cumsum(b_sizes) - 1] += B_END
    return labels


class SpanCounts(dict):
    """Label string of a span -> its A ends times 2**32 plus its B ends; starts anew when it holds ``most`` strings."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, span: bytes) -> int:
        both = span.count(BOTH)
        value = (span.count(A_END) + both << 32) + span.count(B_END) + both
        if len(span) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[span] = value
        return value


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = vocabulary(a_path), piece_encode.encoder(b_path)
        known = self.a.fast
        self.a_sizes = np.zeros(self.a.size, np.int64)
        for token, i in known._mergeable_ranks.items():
            self.a_sizes[i] = len(token)
        pieces = (self.b.whole.id_to_piece(i) for i in range(len(self.b.sizes)))
        self.b_bytes = [p.replace(piece_encode.SPACE, " ").encode() if byte is None else bytes([byte]) for p, byte in zip(pieces, self.b.bytes_of)]
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.n_b = len(self.b_bytes)
        #: Decimal ids with what follows them: inside a group's list, after its A list, after the group.
        ids = range(max(self.a.size, self.n_b))
        self.inside, self.after_a, self.after_group = (np.array([f"{i}{end}" for i in ids], object) for end in ",|;")
        self.spans = SpanCounts()

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, if both spell a space and the text."""
        if not text:
            return None
        raw = b" " + text.encode("utf-8", "surrogatepass")
        b = self.b.whole.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a = self.a.fast.encode_to_numpy(" " + text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        # a byte-level BPE cuts the bytes it is given, so their number says that all are there
        return (a, np.array(b, np.int64)) if self.a_sizes[a].sum() == len(raw) else None

    def groups(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B each group holds."""
        spans = SPAN.findall(labels.tobytes())
        counts = np.fromiter(map(self.spans.__getitem__, spans), np.int64, len(spans))
        return counts >> 32, counts & 0xFFFFFFFF

    def links(self, labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id pair, ``a * n_b + b``, of every link."""
        ends = labels[labels != NONE]
        a_end, b_end = ends & A_END, ends >> 1
        return a[np.cumsum(a_end, dtype=np.int64) - a_end] * self.n_b + b[np.cumsum(b_end, dtype=np.int64) - b_end]

    def listing(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        till_a, till_b = np.cumsum(in_a), np.cumsum(in_b)
        a_text, b_text = self.inside[a], self.inside[b]
        a_text[till_a - 1] = self.after_a[a[till_a - 1]]
        b_text[till_b - 1] = self.after_group[b[till_b - 1]]
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.repeat(till_b - in_b, in_a)] = a_text
        out[np.arange(len(b)) + np.repeat(till_a, in_b)] = b_text
        return "".join(out.tolist())[:-1]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# ------------------------------------------------------------- operators


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or default_vocabulary(), b_path or piece_encode.default_model()


def _numbers(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, group_ends, group_a, group_b): the tokens, and for each group the byte of the text after its last
    and its numbers of A and B tokens; the arrays are empty for a text without tokens."""
    paths = _paths(a_path, b_path)
    small_batches(docs.sparkSession)
    names = ("a_ids", "b_ids", "group_ends", "group_a", "group_b")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.ArrayType(T.LongType())) for n in names)])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = aligner(*paths)
        none = (np.zeros(0, np.int64),) * len(names)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if (found := use.tokens(text)) is None:
                    rows.append(none)
                    continue
                a, b = found
                labels = label_string(use.a_sizes[a], use.b_sizes[b])
                rows.append((a, b, np.flatnonzero(labels == BOTH), *use.groups(labels)))  # the space before the text shifts ends by one
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", *names])

    return docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).mapInArrow(aligned, schema)


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``row`` (its number), doc_id, sizes, the digest of its groups, and ``pairs``, its distinct id pairs
    (``a * size of B + b``) with the number of links of each."""
    paths = _paths(a_path, b_path)
    small_batches(docs.sparkSession)
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    pairs = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([*_numbers("row"), T.StructField("doc_id", docs.schema[id_col].dataType), *_numbers(*numbers), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", pairs)])

    def linked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = aligner(*paths)
        for batch in batches:
            sizes, digests, distinct, counts, ends = [], [], [], [], [0]
            for text in batch.column(2).to_pylist():
                if (found := use.tokens(text)) is None:
                    sizes.append((0, 0, 0, 0))
                    digests.append("")
                    ends.append(ends[-1])
                    continue
                a, b = found
                labels = label_string(use.a_sizes[a], use.b_sizes[b])
                in_a, in_b = use.groups(labels)
                links = use.links(labels, a, b)
                ids, n = np.unique(links, return_counts=True)
                sizes.append((len(a), len(b), len(in_a), len(links)))
                digests.append(hashlib.sha256(use.listing(a, b, in_a, in_b).encode()).hexdigest())
                distinct.append(ids)
                counts.append(n)
                ends.append(ends[-1] + len(ids))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(distinct or [np.zeros(0, np.int64)])), pa.array(np.concatenate(counts or [np.zeros(0)]).astype(np.int32))], names=["pair", "n"])
            columns = [pa.array([s[i] for s in sizes], pa.int64()) for i in range(len(numbers))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["row", "doc_id", *numbers, "groups_sha256", "pairs"]
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(linked_batches, schema)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): a pair's links over the corpus, and whether no other pair of its B id has more. ``links`` has (pair, n)."""
    counted = staged(links.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counted.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("highest"))  # as many rows as B has ids, at most
    joined = counted.join(F.broadcast(highest), F.col("pair") % n_b == F.col("b"))
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best and count_sum (by the pairs' counts over all ``docs``), groups_sha256."""
    a_path, b_path = _paths(a_path, b_path)
    rows = staged(linked(docs, a_path, b_path, id_col, text_col), "links")
    links = rows.select("row", F.inline("pairs"))
    counts = pair_counts(links, len(piece_encode.encoder(b_path).sizes))
    limit = (rows.agg(F.sum("n_links")).first()[0] or 0) // FREQUENT
    frequent = F.broadcast(counts.filter(F.col("count") > limit))
    rest = links.join(frequent.select("pair"), "pair", "left_anti").join(counts.filter(F.col("count") <= limit), "pair")
    known = links.join(frequent, "pair").unionByName(rest)
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
