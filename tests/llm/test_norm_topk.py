import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import norm_topk as m


def brute(rows, k):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(n=700, width=9, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (5 if i % 90 == 0 else 1) for _ in range(width)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * width) for i in range(150)]  # a very common vector
    return rows + [(2000, None), (2050, [None] * width), (2100, [float("nan")] * width), (2150, [float("inf")] * width), (None, [1.0] * width), (2200, [1.0]), (2250, []), (2300, [-1.0] * width)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")


@pytest.mark.parametrize("block, row, part", [(8192, 1024, 1 << 20), (4, 16, 128)])
def test_same_as_brute_force(spark, monkeypatch, block, row, part):
    monkeypatch.setattr(m, "QUERY_BLOCK", block)
    monkeypatch.setattr(m, "PART", part)
    monkeypatch.setattr(m, "ROW", row)
    monkeypatch.setattr(m, "SAMPLE", 20)
    df = frame(spark, vectors())
    got = m.top_k(df, df.filter("vec_id % 50 = 0"), 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(vectors(), 5)


def test_a_task_has_one_block_and_one_part(spark):
    """However many blocks of queries there are, none of the tasks reads more than about a part of the vectors."""
    stored = spark.range(640).select(F.rand(1).alias("longest"), F.lit(16).cast("long").alias("n"), F.col("id").cast("string").cast("binary").alias("ids"), F.lit(b"").alias("v"))
    blocks = spark.range(40).select(F.col("id").alias("block"), F.lit(None).cast("double").alias("longest"), F.lit(4).cast("long").alias("n"), *(F.lit(b"").alias(c) for c in ("ids", "v", "floor")))
    met = m.meetings(stored, blocks, 40, 8).groupBy(F.spark_partition_id().alias("task")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("block").alias("blocks"), F.count_distinct("part").alias("parts"), F.count("floor").alias("queries")
    )
    got = met.collect()
    assert len(got) == 320 and sum(r["rows"] for r in got) == 40 * (640 + 8)
    assert all((r["blocks"], r["parts"], r["queries"]) == (1, 1, 1) and r["rows"] < 2 * 640 / 8 for r in got)


def test_same_as_sql(spark, oracle, same, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    same(m.op8_norm_topk(spark, sf_dir), oracle(m.ORACLES["op8_norm_topk"], embeddings=df))


def test_fewer_rows_than_k(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 1.0]), (3, [0.0, 0.0])]
    df = frame(spark, rows)
    got = m.top_k(df, df.filter("vec_id % 50 = 0"), 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(rows, 5)
    assert m.top_k(df.limit(0), df.limit(0), 5).collect() == []
    assert m.top_k(df, df.limit(0), 5).collect() == []


def test_products_beyond_doubles():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [1.0, 2.0**45]])
    assert m.products(a, b).tolist() == [[2**60 + 3, 2**40 + 2**45]]


def test_pruning_skips_what_cannot_win():
    rng = np.random.default_rng(0)
    v = rng.integers(-50, 50, (40, 8)).astype(float)
    block = m.Block(np.arange(40), v, np.eye(8), np.full(40, 1e9), 5)
    assert not block.reachable(1.0) and block.reachable(1e9)
