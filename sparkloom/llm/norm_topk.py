"""Exact top-k inner products over norm-sorted vectors.

1. Vectors become integers and are stored by falling length, many to a row.
2. An SVD of a bounded sample (``SAMPLE`` rows) turns the axes so that the first
   ones hold most of the length. It only steers pruning; results don't depend on it.
   The sample also gives every query a first lower bound for its k-th score.
3. Queries are stored in blocks of about ``QUERY_BLOCK``, on the executors as the vectors
   are. The vectors are dealt out over parts of ``PART`` or fewer, and each block of queries meets
   each part in a task of its own, which reads the block first and then the part's rows by falling
   length, one at a time. A vector is moved once a block, so the more queries a block has, the
   fewer bytes. Nothing but the sample comes to the driver.
4. When length times length is under every query's bound, the rest of a part's vectors
   are skipped. Otherwise the partial sum over the first half of the turned axes, plus the
   Cauchy-Schwarz bound of what is left, strikes out pairs; the others get their exact
   integer product.

Ties go to the smaller vec_id. Defined results: null vectors, and vectors with a
null or non-finite component, take no part; nor do rows with a null vec_id. A shorter
vector counts as ended by zeros. Rows that share a query's vec_id are the query's
own. Repeated query rows each get their results once. An empty table, or one
without queries, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import column, small_batches, staged, table

SAMPLE = 4096
QUERY_BLOCK = 32768
#: Vectors that a task reads at most, but for chance; it holds one stored row of them at a time.
PART = 1 << 20
#: Vectors in a stored row, and queries that are multiplied at once.
ROW = 1024
STEP = 1024
SCALE = 256


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, length): floor(256 x) of every usable vector, as doubles that hold integers."""
    x = column(vector_col)
    usable = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = vectors.filter(usable & column(id_col).isNotNull()).select(
        column(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double")).alias("v")
    )
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


STORED = T.StructType([T.StructField("longest", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("v", T.BinaryType())])


def _store(width: int):
    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), ROW):
                part = frame.iloc[at : at + ROW]
                ids, v = part["vec_id"].to_numpy(np.int64), _matrix(part["v"].tolist(), width)
                yield pd.DataFrame({"longest": [float(part["length"].max())], "n": [len(part)], "ids": [ids.tobytes()], "v": [v.tobytes()]})

    return store


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``, which hold integers as doubles."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2**53:
        return a @ b.T  # every partial sum is an integer that a double holds
    return np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T


class Block:
    """A block of queries with the k best that a task has found for each."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.v, self.turn, self.floor, self.k = ids, v, turn, floor.copy(), k
        self.half = v.shape[1] // 2
        turned = v @ turn
        self.head, self.rest = turned[:, : self.half], np.linalg.norm(turned[:, self.half :], axis=1)
        self.length = np.linalg.norm(v, axis=1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def reachable(self, longest: float) -> bool:
        return bool((self.length * longest * (1 + 1e-9) + 1 >= self.floor).any())

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        turned = v @ self.turn
        head, rest = turned[:, : self.half], np.linalg.norm(turned[:, self.half :], axis=1)
        length = np.linalg.norm(v, axis=1)
        for at in range(0, len(self.ids), STEP):
            part = slice(at, at + STEP)
            slack = 1 + 1e-9 * self.length[part].max(initial=0) * length.max(initial=0)  # of rounding in the turned sums
            possible = self.head[part] @ head.T + np.outer(self.rest[part], rest) + slack >= self.floor[part, None]
            possible &= self.ids[part, None] != ids[None, :]
            rows = np.flatnonzero(possible.any(axis=1))
            columns = np.flatnonzero(possible[rows].any(axis=0))
            if not len(columns):
                continue
            scores = products(self.v[part][rows], v[columns])
            good = possible[np.ix_(rows, columns)] & (scores >= self.floor[part][rows][:, None])
            for i in np.flatnonzero(good.any(axis=1)):
                found = np.flatnonzero(good[i])
                self.add(at + int(rows[i]), scores[i, found], ids[columns[found]])

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[keep], ids[keep]
        best = self.best[query] + [(int(s), int(i)) for s, i in zip(scores, ids)]
        best.sort(key=lambda x: (-x[0], x[1]))
        self.best[query] = best = best[: self.k]
        if len(best) == self.k:
            self.floor[query] = max(self.floor[query], best[-1][0])


#: A block of queries (``longest`` null, with their first bounds) or a row of vectors.
MEETING = T.StructType([T.StructField("block", T.LongType()), *STORED.fields, T.StructField("floor", T.BinaryType())])
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("block", "query_row", "query_id", "score", "vec_id")])


def _blocks(shared, k: int, width: int):
    """One row per block of queries, with what the sample says about each k-th score."""

    def block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, seed_ids, seeds = shared.value
        frame = frame.sort_values("vec_id", kind="stable")
        ids, v = frame["vec_id"].to_numpy(np.int64), _matrix(frame["v"].tolist(), width)
        floor = np.full(len(ids), -np.inf)
        for at in range(0, len(ids), STEP):
            scores = products(v[at : at + STEP], seeds).astype(float)
            scores[ids[at : at + STEP, None] == seed_ids[None, :]] = -np.inf
            if scores.shape[1] >= k:
                floor[at : at + STEP] = np.partition(scores, -k, axis=1)[:, -k]
        row = (int(key[0]), None, len(ids), ids.tobytes(), v.tobytes(), floor.tobytes())
        return pd.DataFrame([row], columns=MEETING.names)

    return block


def _search(shared, k: int, width: int):
    """Rows come sorted by (block, part), the block's queries first, then the part's vectors by falling length."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = shared.value[0]
        block, number, over = None, 0, False

        def done() -> pd.DataFrame:
            rows = [(number, q, block.ids[q], s, i) for q, best in enumerate(block.best) for s, i in best] if block else []
            return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 5), columns=FOUND.names)

        for frame in frames:
            for at, longest, n, ids, v, floor in zip(*(frame[c] for c in MEETING.names)):
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(n, width)
                if floor is not None:
                    yield done()
                    block, number, over = Block(ids, v, turn, np.frombuffer(floor), k), at, False
                    continue
                if block is None or at != number:  # a block without queries
                    continue
                over = over or not block.reachable(longest)  # what follows is no longer
                if not over:
                    block.meet(ids, v)
        yield done()

    return search


def meetings(stored: DataFrame, blocks: DataFrame, n_blocks: int, n_parts: int) -> DataFrame:
    """Every block of queries with every part of the vectors: a partition each, the block's row first."""
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    part = F.pmod(F.xxhash64("ids"), F.lit(n_parts))
    rows = stored.withColumn("floor", F.lit(None).cast("binary")).withColumn("part", part).select("part", each(n_blocks).alias("block"), *MEETING.names[1:])
    both = blocks.select(each(n_parts).alias("part"), *MEETING.names).unionByName(rows)
    placed = both.repartitionById(n_blocks * n_parts, (F.col("block") * n_parts + F.col("part")).cast("int"))
    return placed.sortWithinPartitions("block", "part", F.desc_nulls_first("longest"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``."""
    spark = small_batches(vectors.sparkSession)
    usable = staged(integers(vectors, id_col, vector_col), "vectors")
    asked = staged(integers(queries, id_col, vector_col), "queries")
    width, n = usable.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    asked_width, n_asked = asked.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    width = max(width or 0, asked_width or 0, 2)

    spread = F.xxhash64("vec_id", "v")
    one_in = max(1, n // SAMPLE)  # first by number, so that tasks don't send SAMPLE rows each
    sample = usable.filter(F.pmod(spread, F.lit(one_in)) == 0).orderBy(spread).limit(SAMPLE).select("vec_id", "v").toPandas()
    seeds = _matrix(sample["v"].tolist(), width)
    turn = np.linalg.svd(seeds, full_matrices=len(seeds) <= width)[2].T
    shared = spark.sparkContext.broadcast((turn, sample["vec_id"].to_numpy(np.int64), seeds))

    # equal lengths are dealt out by id, so that many equal vectors don't meet in one partition
    by_length = usable.repartitionByRange(F.desc("length"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id")
    stored = staged(by_length.mapInPandas(_store(width), STORED), "bylength")
    n_blocks = -(-n_asked // QUERY_BLOCK) or 1
    blocks = staged(asked.withColumn("block", F.pmod(spread, F.lit(n_blocks))).groupBy("block").applyInPandas(_blocks(shared, k, width), MEETING), "queryblocks")

    # few blocks meet many parts, many blocks meet few: enough tasks either way, and none with more than a part
    n_parts = max(-(-n // PART), min(-(-n // ROW), -(-2 * spark.sparkContext.defaultParallelism // n_blocks)), 1)
    found = meetings(stored, blocks, n_blocks, n_parts).select(*MEETING.names).mapInPandas(_search(shared, k, width), FOUND)
    best = Window.partitionBy("block", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


QUERIES = {"op8_norm_topk": op8_norm_topk}
ORACLES = {
    "op8_norm_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
