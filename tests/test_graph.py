"""The neighbour graph: bounded degree, recall against exact search, ties and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dense, graph
from sparkloom.plans import stored


@pytest.fixture
def cut(spark, tmp_path):
    return stored.cutter(spark, str(tmp_path / "rounds"))


def test_recall_and_degree(spark, cut):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(5000, None)]  # a very common vector, and none
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").cache()
    edges = graph.build(df, cut, degree=8, rounds=2, tables=3).cache()
    assert edges.groupBy("a").count().agg({"count": "max"}).first()[0] <= 16
    assert edges.filter("a = b").count() == 0 and edges.count() == edges.dropDuplicates(["a", "b"]).count()
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 400, 40)], "query_id long, vector array<double>")
    found, seen = graph.search(edges, df, asked, cut, k=10, beam=48)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = (r["rank"], r["score"])
    good = 0
    for i in range(0, 400, 40):
        exact = {r["chunk_id"]: r["score"] for r in dense.topk(df, rows[i][1], 10).collect()}
        good += len(set(exact) & set(got[i]))
        assert all(got[i][c][1] == exact[c] for c in set(exact) & set(got[i])) and sorted(p for p, _ in got[i].values()) == list(range(1, 11))
    assert good >= 0.9 * 100
    assert seen.count() < 0.9 * 550 * 10 and seen.count() == seen.dropDuplicates(["query_id", "chunk_id"]).count()


def test_empty(spark, cut):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    assert graph.build(none, cut).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    edges = graph.build(one, cut)
    found, _ = graph.search(edges, one, spark.createDataFrame([(7, [0.5, 0.5])], "query_id long, vector array<double>"), cut)
    assert [tuple(r) for r in found.collect()] == [(7, 1, 0.5, 1)]


def test_wider_beams_where_the_first_falls_short(spark, cut):
    """A narrow beam misses neighbours of some queries; an exact check has these searched on."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(300)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").cache()
    edges = graph.build(df, cut, degree=4, rounds=1, tables=2).cache()
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 300, 30)], "query_id long, vector array<double>")
    exact = {i: {r["chunk_id"] for r in dense.topk(df, rows[i][1], 10).collect()} for i in range(0, 300, 30)}
    wanted = spark.createDataFrame([(q, c) for q, own in exact.items() for c in own], "query_id long, chunk_id long")

    def least(found):
        got = {q: set() for q in exact}
        for r in found.collect():
            got[r["query_id"]].add(r["chunk_id"])
        assert all(len(own) <= 10 for own in got.values())
        return min(len(exact[q] & got[q]) for q in exact)

    assert least(graph.search(edges, df, asked, cut, beam=12)[0]) < 9
    assert least(graph.reaching(edges, df, asked, wanted, cut, beam=12)) >= 9


def test_neighbours_of_vectors_without_groups(spark, cut, monkeypatch):
    """Where vectors form no groups, each must meet many others to find its nearest; buckets of two parts are still bounded."""
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").cache()
    asked = df.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    wanted = dense.topk_many(df, asked, 10).filter("query_id <> chunk_id").cache()

    def share():
        edges = graph.build(df, cut).cache()
        assert edges.groupBy("a").count().agg({"count": "max"}).first()[0] <= 2 * graph.DEGREE
        return wanted.join(edges, (F.col("query_id") == F.col("a")) & (F.col("chunk_id") == F.col("b"))).count() / wanted.count()

    assert share() > 0.95
    monkeypatch.setattr(graph, "MEET", 1024)  # buckets, and what has not met there meets at common neighbours
    monkeypatch.setattr(graph, "AROUND", 5000)
    assert share() > 0.8


def test_going_on_from_what_was_scored(spark, cut):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(500)], "chunk_id long, embedding array<double>").cache()
    edges = graph.build(df, cut, degree=3, rounds=0, tables=1).cache()
    asked = df.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    _, narrow = graph.search(edges, df, asked, cut, beam=10, hops=2)
    found, wide = graph.search(edges, df, asked, cut, beam=500, hops=20, known=narrow)
    assert narrow.exceptAll(wide).count() == 0 and wide.count() == wide.dropDuplicates(["query_id", "chunk_id"]).count()
    reached = graph.search(edges, df, asked, cut, beam=500, hops=20)[0]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, reached.collect()))


@pytest.mark.parametrize(("block", "part"), [(1 << 15, 1 << 14), (3, 70)])
def test_many_queries_give_what_one_gives(spark, block, part):
    """Ties, halves, copies, components and vectors that are missing, not numbers or of another length; fewer vectors than asked for."""
    rng = random.Random(8)
    rows = [(1000 - i, [rng.choice((-1.0, -0.5, 0.0, 0.5, 1.0)) * rng.choice((1.0, 0.0001, 0.01)) for _ in range(6)]) for i in range(150)]
    rows += [(2000 + i, [0.00005, -0.00015, 1.0, 0.0, 0.0, 0.0]) for i in range(100)] + [(5, None), (6, [None, 1.0, None, 0.5, 0.5, 0.0]), (7, [1e20, 0.0, 1e-20, 0.0, 0.0, 1.0])]
    queries = [(i, [rng.choice((-1.0, 0.5, 1.0, 3.0)) for _ in range(6)]) for i in range(12)] + [(50, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (51, [0.0, -1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").cache()
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    for of, k in ((df, 10), (df, 120), (df.filter("chunk_id > 2094 OR chunk_id < 6"), 10)):
        got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in dense.topk_many(of, asked, k, block, part).filter("score IS NOT NULL").collect())
        expected = [(q, place, r["chunk_id"], r["score"]) for q, v in queries for place, r in enumerate(dense.topk(of, v, k).collect(), 1)]
        assert got == sorted(expected)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [math.nan, 0.0]), (3, None), (4, [3.0]), (0, [1.0, 5.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in dense.topk_many(odd, asked, 4, block, part).collect())
    assert got == [(1, 1, 2), (1, 2, 4), (1, 3, 0), (1, 4, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]
    assert dense.topk_many(odd.limit(0), asked.limit(0), 4).collect() == []
    assert [tuple(r) for r in dense.topk_many(odd.filter("chunk_id = 3"), asked, 4).orderBy("query_id").collect()] == [(1, 3, None, 1), (2, 3, None, 1)]
