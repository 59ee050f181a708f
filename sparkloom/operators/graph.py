"""A neighbour graph of vectors: adjacency rows, made by joins, searched by joins over a frontier.

Building: vectors meet in buckets (the signs of their products with a few random axes, several
times over), which gives each its first neighbours; then the neighbours of each vector
meet, round by round, and each keeps its nearest. Both kinds of meeting are products of matrices and
bounded: a bucket is dealt out in parts of about ``MEET`` vectors, and no vector has more
than ``degree`` neighbours either way. Work and rows grow in proportion to the vectors.

Searching: every query starts from the entry vectors and keeps a beam of the best vectors seen. A hop
joins the beam's new members with the graph and scores what hasn't been seen; the search ends
when no beam has a new member, or after ``hops``. Results are approximate; ``dense.topk`` is exact.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as vx

DEGREE, TABLES, MEET, ROUNDS = 16, 16, 8192, 1
BEAM, HOPS, ENTRIES = 96, 8, 16
DIGITS = 4
#: Products made at once (8 MB), and neighbours whose vectors a task of a round has.
PRODUCTS, AROUND = 1 << 20, 1 << 16
PAIRS = "a long, b long, score double"

Cut = Callable[[DataFrame], DataFrame]


def _in_buckets(rows: DataFrame, dim: int, n_axes: int, tables: int) -> DataFrame:
    """(chunk_id, embedding, buckets): in each table, the signs of products with random axes as one number."""
    rngs = [random.Random(1000 + table) for table in range(tables)]
    axes = np.array([[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n_axes)] for rng in rngs]).reshape(tables * n_axes, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vx.matrix(batch.column("embedding"))
            above = (vectors @ axes[:, : vectors.shape[1]].T > 0).reshape(len(vectors), tables, n_axes)
            buckets = pa.array((above @ (1 << np.arange(n_axes))).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, buckets], ["chunk_id", "embedding", "buckets"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("buckets", T.ArrayType(T.LongType()))]))


def _nearest(pairs: DataFrame, degree: int) -> DataFrame:
    """(a, b, score): the ``degree`` nearest of each ``a``; a pair given twice counts once."""
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score")).withColumn("place_", F.row_number().over(best)).filter(F.col("place_") <= degree).drop("place_")


def _pairs(ids: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"a": ids[i], "b": ids[j], "score": score})


def _met(degree: int) -> Callable[[pa.Table], pa.Table]:
    """(a, b, score): the ``degree`` nearest of each vector (chunk_id, embedding) among those that are given."""

    def met(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk_id")
        ids, vectors = rows["chunk_id"].to_numpy(), vx.matrix(rows["embedding"])
        n, k = len(ids), min(degree, len(ids) - 1)
        found = [_pairs(ids, *(np.empty(0, int),) * 2, np.empty(0))]
        at_once = max(1, PRODUCTS // n)
        for start in range(0, n, at_once) if k > 0 else ():
            products = vectors[start : start + at_once] @ vectors.T
            own = np.arange(len(products))
            products[own, start + own] = -np.inf
            j = np.argpartition(-products, k - 1, axis=1)[:, :k].ravel()
            i = own.repeat(k)
            found.append(_pairs(ids, start + i, j, products[i, j]))
        return pa.concat_tables(found)

    return met


def _around(rows: pa.Table) -> pa.Table:
    """(a, b, score) of neighbours (chunk_id, embedding) of a vector ``m`` for each other, where that is nearer than an ``a`` has had (``least``)."""
    rows = rows.sort_by([("m", "ascending"), ("chunk_id", "ascending")])
    ids, vectors = rows["chunk_id"].to_numpy(), vx.matrix(rows["embedding"])
    m, least = rows["m"].to_numpy(), rows["least"].to_numpy()
    ends = [*(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
    found = [_pairs(ids, *(np.empty(0, int),) * 2, np.empty(0))]
    for start, end in zip([0, *ends], ends):
        own = vectors[start:end]
        products = own @ own.T
        i, j = np.nonzero(products > least[start:end, None])
        apart = i != j
        found.append(_pairs(ids, start + i[apart], start + j[apart], products[i, j][apart]))
    return pa.concat_tables(found)


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs (query_id, chunk_id, embedding, vector) with their inner products, rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(vx.dots(vx.matrix(batch.column("embedding")), vx.matrix(batch.column("vector"))))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), score], ["query_id", "chunk_id", "score"])

    return pairs.select("query_id", "chunk_id", "embedding", "vector").mapInArrow(run, "query_id long, chunk_id long, score double").withColumn("score", F.round("score", DIGITS))


def both_ways(edges: DataFrame, degree: int) -> DataFrame:
    """Edges and their reverses, of which a vector keeps its nearest: one that is everybody's neighbour stays bounded."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")
    return _nearest(edges.unionByName(back), degree)


def build(rows: DataFrame, cut: Cut, degree: int = DEGREE, rounds: int = ROUNDS, tables: int = TABLES) -> DataFrame:
    """(a, b, score): the graph of (chunk_id, embedding). ``cut`` stores what a round gives, so that the next doesn't do it again."""
    rows = rows.filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    dim, n = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], PAIRS)
    n_axes = max(0, math.ceil(math.log2(max(n / MEET, 1))))
    placed = cut(_in_buckets(rows, dim, n_axes, min(tables, 1 << n_axes)))  # more tables would be more work than all pairs
    dealt = placed.select("chunk_id", "embedding", F.posexplode("buckets").alias("table", "bucket"))
    sizes = dealt.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("parts"))  # tables * 2 ** n_axes rows at most
    met = dealt.join(F.broadcast(sizes), ["table", "bucket"]).withColumn("part", F.pmod(F.xxhash64("chunk_id", "table"), "parts"))
    edges = cut(_nearest(met.drop("parts").groupBy("table", "bucket", "part").applyInArrow(_met(degree), PAIRS), degree))
    parts = max(1, -(-n * degree // AROUND))
    for _ in range(rounds):
        least = edges.groupBy("a").agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
        known = rows.join(least.withColumnRenamed("a", "chunk_id"), "chunk_id")
        members = both_ways(edges, degree).select(F.col("a").alias("m"), F.col("b").alias("chunk_id")).join(known, "chunk_id")
        new = members.groupBy(F.pmod(F.xxhash64("m"), F.lit(parts)).alias("part")).applyInArrow(_around, PAIRS)
        edges = cut(_nearest(new.unionByName(edges), degree))
    return cut(both_ways(edges, 2 * degree))


def entries(rows: DataFrame, n: int = ENTRIES) -> DataFrame:
    """(chunk_id, embedding) of ``n`` vectors spread by the hashes of their ids."""
    return rows.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n)


def search(
    edges: DataFrame, rows: DataFrame, queries: DataFrame, cut: Cut, k: int = 10, beam: int = BEAM, hops: int = HOPS, first: DataFrame | None = None, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, rank) of the ``k`` best found for each query (query_id, vector), and (query_id, chunk_id, score) of all vectors scored.

    ``known``, what an earlier search has scored for the queries, is gone on from.
    """
    rows = rows.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    queries = queries.filter(F.col("vector").isNotNull())
    if known is None:
        first = entries(rows) if first is None else first
        known = cut(_scored(queries.join(F.broadcast(first.select("chunk_id", "embedding")), how="cross")))  # ENTRIES rows a query
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")

    def placed(scored: DataFrame) -> DataFrame:
        return scored.withColumn("place_", F.row_number().over(best)).filter(F.col("place_") <= max(beam, k))

    seen, beams = known, cut(placed(known.withColumn("hop", F.lit(0))))
    for hop in range(1, hops + 1):
        ends = beams.filter((F.col("place_") <= beam) & (F.col("hop") == hop - 1))
        near = ends.join(edges, F.col("chunk_id") == F.col("a")).select("query_id", F.col("b").alias("chunk_id")).distinct()
        new = near.join(seen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        found = cut(_scored(new.join(rows, "chunk_id").join(queries, "query_id")))
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        beams = cut(placed(beams.drop("place_").unionByName(found.withColumn("hop", F.lit(hop)))))
    return beams.filter(F.col("place_") <= k).select("query_id", "chunk_id", "score", F.col("place_").alias("rank")), seen


def reaching(edges: DataFrame, rows: DataFrame, queries: DataFrame, wanted: DataFrame, cut: Cut, share: float = 0.9, k: int = 10, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """What ``search`` finds where an exact result, ``wanted`` (query_id, chunk_id), is there to check it.

    Queries that have less than ``share`` of it are searched on with twice the beam and hops, until none
    is short or the beam has room for every vector; the others' results stay.
    """
    n, short, found, known = rows.count(), queries, None, None
    while True:
        now, seen = search(edges, rows, short, cut, k, beam, hops, known=known)
        now = cut(now)
        found = now if found is None else found.join(short.select("query_id"), "query_id", "left_anti").unionByName(now)
        hits = wanted.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
        behind = hits.groupBy("query_id").agg((F.count("hit") < share * F.count(F.lit(1))).alias("behind")).filter("behind")
        short = cut(queries.join(behind, "query_id", "left_semi"))
        if beam >= n or short.isEmpty():
            return found
        known = cut(seen.join(short.select("query_id"), "query_id", "left_semi"))
        beam, hops = 2 * beam, 2 * hops
