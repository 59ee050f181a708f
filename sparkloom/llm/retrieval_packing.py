"""Packing by lexical retrieval.

1. ``tokenise``: byte-level BPE ids of every whole text and an end id. A document's whole
   windows of ``window`` ids are sequences by themselves and leave the job there, as
   places and checksums; only what is left over (its *rest*) is moved and packed with
   other documents'.
2. Document frequencies of all ids over all documents; the vocabulary bounds that table,
   so it is sent to every task.
3. The index is cut in shards of about ``SHARD`` rests at any corpus size: first by cells,
   whose centres are fitted to the sketches (projected term weights) of a bounded sample
   of ``SAMPLE`` rests and which every rest is assigned to, then by falling length. Seeds
   are the longest unused rests, and BM25 prefers long texts in the seed's language, so a
   seed's neighbours lie near it in this order. Counts per cell and length (``window``
   times ``CELLS`` numbers at most) fix the shards; a large count is dealt out by a hash.
4. In each shard an inverted index answers BM25 queries: the longest unused rest
   seeds a window, all its ids are the query, and unused neighbours fill the window in
   order of score; the last one is cut where the window ends and what is left of it
   seeds the next. Only a shard's last window has padding.

A seed asks its own shard, not the whole corpus: every seed against every rest is quadratic.
README states which share of a seed's neighbours over the whole corpus its shard holds.

Defined results: a null or empty text has one id, the end id. A null doc_id is
kept. Repeated rows are packed each. A very long text is read whole; its windows are
never held together with other documents'. An empty table gives an empty result.
Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, small_batches, staged, table

END = 1
WINDOW = 2048
#: Rests in a shard.
SHARD = 2048
K1, B = 1.2, 0.75
#: Neighbours that are ranked at first.
FEW = 64
#: Width of a sketch, rests that the cells are fitted to, and cells at most.
WIDTH, SAMPLE, CELLS = 64, 4096, 12
#: How much farther the next cell must lie than the own one (silhouette), or there is one cell for all.
APART = 0.2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A byte-level BPE in the format of the tokenizers library, with ids as that gives them.

    Plain texts go through a BPE that hands out arrays; texts that contain an added
    token's own string go to the tokenizers library, which knows it.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        added = [t["content"] for t in stored["added_tokens"]]
        vocabulary = stored["model"]["vocab"]
        self.size = max(*vocabulary.values(), *(t["id"] for t in stored["added_tokens"]), END) + 1
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in added}
        self.added = added
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        """The tokenizers library's own, loaded by the few workers that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Rows of kind ``WHOLE`` are whole windows (start, crc), those of kind ``REST`` rests (start, ids, sketch), and those of kind
#: ``SUMMARY`` what a task has seen: documents in ``n``, ids in all in ``start``, documents per id in ``ids``.
TOKENS = T.StructType(
    [T.StructField("doc_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("n", "start", "length", "crc", "spread")), T.StructField("ids", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("kind", T.StringType())]
)
WHOLE, REST, SUMMARY = "whole", "rest", "summary"


@lru_cache(maxsize=1)
def projection(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, WIDTH), np.float32)


def sketch(terms: np.ndarray, tf: np.ndarray, size: int) -> np.ndarray:
    """Unit vector of the projected term weights. A BPE numbers its pieces by falling frequency, so the logarithm of the id stands for the idf, which isn't known yet."""
    weight = (np.log1p(terms) * tf / (tf + K1)).astype(np.float32)
    vector = weight @ projection(size)[terms]
    return vector / (np.linalg.norm(vector) or 1)


def tokenise(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as at ``TOKENS``; ``spread`` is a number that spreads rows evenly, copies and repeated rows too.

    Every task adds a row of kind ``SUMMARY``, so that corpus statistics need no second
    pass. Ids of documents travel as text, as pandas would make floats of numbers with nulls.
    """
    path = path or default_vocabulary()

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = vocabulary(path)
        df = np.zeros(use.size, np.int64)
        n = total = 0
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(use.ids(text or ""), np.uint32(END)).astype("<u4")
                terms, tf = np.unique(ids, return_counts=True)
                df[terms] += 1
                n, total = n + 1, total + len(ids)
                spread = xxhash.xxh3_64_intdigest(f"{doc_id} {n}") >> 1
                start = len(ids) // window * window
                rows += [(doc_id, len(ids), at, window, zlib.crc32(ids[at : at + window].tobytes()), spread, None, None, WHOLE) for at in range(0, start, window)]
                if start < len(ids):
                    rest = ids[start:]
                    if start:
                        terms, tf = np.unique(rest, return_counts=True)
                    rows.append((doc_id, len(ids), start, len(rest), 0, spread, pack_ids(rest, use.size), sketch(terms, tf, use.size).astype("<f2").tobytes(), REST))
            yield pd.DataFrame(rows, columns=TOKENS.names)
        yield pd.DataFrame([(None, n, total, 0, 0, 0, zlib.compress(df.tobytes()), None, SUMMARY)], columns=TOKENS.names)

    return docs.select(column(id_col).cast("string").alias("doc_id"), column(text_col).alias("text")).mapInPandas(tokens, TOKENS)


def pack_ids(ids: np.ndarray, size: int) -> bytes:
    """Little-endian numbers of two bytes where the vocabulary allows it, else of four."""
    return ids.astype(_number(size)).tobytes()


def unpack_ids(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(packed, _number(size)).astype("<u4")


def _number(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for n, total, packed in zip(frame["n"], frame["start"], frame["ids"]):
            df = np.frombuffer(zlib.decompress(packed), np.int64)
            used = np.flatnonzero(df)
            yield pd.DataFrame({"id": np.concatenate([used, [-1, -2]]), "n": np.concatenate([df[used], [n, total]])})


def corpus_statistics(tokens: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """idf of every id of the vocabulary, and the documents' mean length, over all documents."""
    counted = tokens.filter(F.col("kind") == SUMMARY).select("n", "start", "ids").mapInPandas(_summed, T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())]))
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row per id of the vocabulary at most
    known = dict(zip(rows["id"], rows["n"]))
    n = int(known.pop(-1, 0))
    total = int(known.pop(-2, 0))
    df = np.zeros(size)
    df[list(known)] = list(known.values())
    return np.log1p((n - df + 0.5) / (df + 0.5)), total / max(n, 1)


def weights(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their BM25 weights in a text."""
    terms, tf = np.unique(ids, return_counts=True)
    return terms, idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))


def fit_cells(sketches: np.ndarray, rounds: int = 12, tries: int = 5) -> np.ndarray:
    """Centres of the cells (unit vectors): of k-means with 2 to ``CELLS`` centres, tried from several starts, the one whose cells lie farthest apart."""
    rng = np.random.default_rng(5)
    best, apart = np.zeros((1, sketches.shape[1])), APART
    for k in [k for k in range(2, min(CELLS, len(sketches)) + 1) for _ in range(tries)]:
        centres = sketches[rng.integers(len(sketches), size=1)]
        while len(centres) < k:  # the next centre is drawn from those far from all centres so far
            far = np.clip(1 - (sketches @ centres.T).max(axis=1), 1e-12, None) ** 2
            centres = np.vstack([centres, sketches[rng.choice(len(sketches), p=far / far.sum())]])
        for _ in range(rounds):
            nearest = np.argmax(sketches @ centres.T, axis=1)
            sums = np.stack([np.bincount(nearest, column, k) for column in sketches.T], axis=1)
            centres = np.where(sums.any(axis=1, keepdims=True), sums, centres)
            centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
        two = np.partition(sketches @ centres.T, k - 2, axis=1)[:, -2:]
        if (gap := float(((two[:, 1] - two[:, 0]) / (1 - two[:, 0] + 1e-9)).mean())) > apart:
            best, apart = centres, gap
    return best


def _sketches(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f2").reshape(-1, WIDTH).astype(np.float64)


def cells(rests: DataFrame):
    """A column function: the cell of a sketch. Centres are fitted to a bounded sample; every row gets a cell."""
    one_in = max(1, rests.count() // SAMPLE)  # first by number, so that tasks don't send SAMPLE rows each
    sample = rests.select("sketch", "spread").filter(F.pmod("spread", F.lit(one_in)) == 0).orderBy("spread", "sketch").limit(SAMPLE).toPandas()["sketch"]
    shared = rests.sparkSession.sparkContext.broadcast(fit_cells(_sketches(sample)))

    @F.pandas_udf(T.LongType())
    def cell(packed: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(_sketches(packed) @ shared.value.T, axis=1) if len(packed) else [], dtype="int64")

    return cell


def plan_shards(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """(cell, length) -> the place of its first rest in the order of cells and falling lengths; each cell begins a shard."""
    out, at, last = {}, 0, None
    for cell, length in sorted(counts, key=lambda x: (x[0], -x[1])):
        if cell != last:
            at, last = -(-at // SHARD) * SHARD, cell
        out[cell, length] = at
        at += counts[cell, length]
    return out


class Index:
    """Inverted index of one shard: for each id the texts that have it and its BM25 weight there.

    Ids of many texts are rows of a matrix, those of few are lists.
    """

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        pairs = [weights(t, idf, mean) for t in texts]
        self.n = len(texts)
        ids = np.concatenate([p[0] for p in pairs])
        weight = np.concatenate([p[1] for p in pairs]).astype(np.float32)
        owner = np.repeat(np.arange(self.n), [len(p[0]) for p in pairs])
        order = np.argsort(ids, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.ids, first = np.unique(ids[order], return_index=True)
        self.ends = np.append(first, len(ids))
        self.terms = [np.searchsorted(self.ids, p[0]) for p in pairs]
        size = np.diff(self.ends)
        common = np.flatnonzero(size * 32 >= self.n)
        self.row = np.full(len(self.ids), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        for r, t in enumerate(common):
            a, b = self.ends[t], self.ends[t + 1]
            self.matrix[r, self.owner[a:b]] = self.weight[a:b]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused texts by falling score against the seed, all of whose ids are the query; ties and texts without a score by place."""
        terms = self.terms[seed]
        rows = self.row[terms]
        score = self.matrix[rows[rows >= 0]].sum(axis=0)
        if len(lists := terms[rows < 0]):
            first, size = self.ends[lists], self.ends[lists + 1] - self.ends[lists]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            score = score + np.bincount(self.owner[at], self.weight[at], self.n)
        found = np.flatnonzero(unused)
        score = -score[found]
        if len(found) > 4 * FEW:  # most windows are full after a few
            few = np.argpartition(score, FEW)[:FEW]
            few = few[np.lexsort((few, score[few]))]
            yield from found[few].tolist()
            score[few] = np.inf
            yield from found[np.argsort(score, kind="stable")[: len(found) - FEW]].tolist()
        else:
            yield from found[np.argsort(score, kind="stable")].tolist()


def fill_windows(lengths: list[int], neighbours, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (text, first id, number of ids). ``neighbours(seed, unused)`` ranks the unused texts."""
    unused = np.ones(len(lengths), bool)
    windows = []
    begun: tuple[int, int] | None = None  # a text of which the last window took the first part
    for seed in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        while begun or unused[seed]:
            if begun is None:
                begun = seed, 0
                unused[seed] = False
            text, at = begun
            room = window
            take = min(room, lengths[text] - at)
            row = [(text, at, take)]
            room -= take
            begun = (text, at + take) if at + take < lengths[text] else None
            if room:
                for other in neighbours(text, unused):
                    take = min(room, lengths[other])
                    unused[other] = False
                    row.append((other, 0, take))
                    room -= take
                    if take < lengths[other]:
                        begun = other, take
                    if not room:
                        break
            windows.append(row)
    return windows


PIECES = T.StructType([T.StructField(n, T.StringType() if n == "doc_id" else T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: Sequences of a shard have the odd ids from 2 * shard * SHARD_IDS on, whole windows have even ones.
SHARD_IDS = 1 << 32


def _pack(shared, window: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        idf, mean = shared.value
        frame = frame.sort_values(["spread", "n", "doc_id"], kind="stable", na_position="first")
        rests = [(doc_id, n, start, unpack_ids(ids, len(idf))) for doc_id, n, start, ids in zip(frame["doc_id"], frame["n"], frame["start"], frame["ids"])]
        rows, sequence = [], int(frame["shard"].iloc[0]) * SHARD_IDS
        index = Index([r[3] for r in rests], idf, mean)
        for filled in fill_windows([len(r[3]) for r in rests], index.neighbours, window):
            offset = 0
            for text, at, length in filled:
                doc_id, n, start, ids = rests[text]
                rows.append((doc_id, start + at, length, zlib.crc32(ids[at : at + length].tobytes()), n, 2 * sequence + 1, offset))
                offset += length
            sequence += 1
        return pd.DataFrame(rows, columns=PIECES.names)

    return pack


def sharded(tokens: DataFrame) -> DataFrame:
    """The rests among ``tokens`` with their ``shard``."""
    spark = tokens.sparkSession
    rests = tokens.filter(F.col("kind") == REST)
    rests = rests.withColumn("cell", cells(rests)(F.col("sketch")))
    # at most CELLS * window rows
    counts = {(r["cell"], r["length"]): r["n"] for r in rests.groupBy("cell", "length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    plan = spark.createDataFrame([(*k, at, counts[k]) for k, at in plan_shards(counts).items()], "cell long, length long, first long, count long")
    place = F.col("first") + F.pmod("spread", "count")
    return rests.join(F.broadcast(plan), ["cell", "length"]).withColumn("shard", F.floor(place / SHARD))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: which ids of which document lie where in which sequence."""
    spark = small_batches(docs.sparkSession)
    path = path or default_vocabulary()
    tokens = staged(tokenise(docs, path, window, id_col, text_col), "tokens")
    shared = spark.sparkContext.broadcast(corpus_statistics(tokens, vocabulary(path).size))
    pieces = sharded(tokens).select("shard", "doc_id", "n", "start", "ids", "spread").groupBy("shard").applyInPandas(_pack(shared, window), PIECES)
    whole = tokens.filter(F.col("kind") == WHOLE).select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return pieces.unionByName(whole).withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_retrieval_packing": op6_retrieval_packing}
ORACLES: dict[str, str] = {}
