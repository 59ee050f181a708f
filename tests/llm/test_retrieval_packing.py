import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import retrieval_packing as m
from sparkloom.llm._shared import staged


def texts():
    words = [f"term{i % 37} of {i % 11} herons" for i in range(400)]
    return [None, "", " ", "<|endoftext|> in a text", "a" * 9000, "long " * 6000, "é中😀\x00\n\n  x"] + [" ".join(words[i : i + 60 + i % 90]) for i in range(300)] + ["copy of one text"] * 40


def test_pieces_are_exact(spark):
    from tokenizers import Tokenizer

    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts())] + [(1, ""), (2**62 + 1, "a large number")]
    library = Tokenizer.from_file(m.default_vocabulary())
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, n string, shard int")
    pieces = m.pack(df).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for (doc_id, _), own in zip(rows, ids):
        if doc_id == 1:
            continue
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own) and p["length"] > 0
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : at], "<u4").tobytes())
        assert at == len(own)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= m.WINDOW
        padding += m.WINDOW - at
    shards = {p["sequence_id"] // 2 // m.SHARD_IDS for p in pieces if p["sequence_id"] % 2}
    assert padding <= len(shards) * m.WINDOW


def test_vocabulary_as_the_library(sf_dir):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(m.default_vocabulary()), m.vocabulary(m.default_vocabulary())
    for t in [*pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist(), *filter(None, texts()), "\x1c!  x  \t y\r\n\r\n", "I'll we've 12½ ²"]:
        assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_bm25_against_plain_formula(monkeypatch):
    monkeypatch.setattr(m, "FEW", 5)
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(0, 50, rng.integers(5, 60)), [50 + i % 40] * 2).astype(np.uint32) for i in range(40)]
    df = np.array([sum(t in d for d in docs) for t in range(90)])
    idf, mean = np.log1p((40 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    index = m.Index(docs, idf, mean)
    unused = np.ones(40, bool)
    unused[3] = False
    got = list(index.neighbours(7, unused))

    def score(d):
        return sum(idf[t] * (tf := (docs[d] == t).sum()) * (m.K1 + 1) / (tf + m.K1 * (1 - m.B + m.B * len(docs[d]) / mean)) for t in np.unique(docs[7]))

    assert (index.row >= 0).any() and (index.row < 0).any()
    assert sorted(got) == [i for i in range(40) if i != 3]
    scores = [score(d) for d in got]
    assert all(a >= b - 1e-4 for a, b in zip(scores, scores[1:]))


def test_seed_takes_its_neighbours():
    windows = m.fill_windows([1000, 900, 800, 700], lambda seed, unused: [i for i in (2, 3, 1) if unused[i]], 2048)
    assert windows[0] == [(0, 0, 1000), (2, 0, 800), (3, 0, 248)]
    assert windows[1] == [(3, 248, 452), (1, 0, 900)]


def test_places_follow_cells_and_lengths():
    plan = m.plan_shards({(0, 5): 3, (0, 9): 2, (1, 7): 10})
    assert plan == {(0, 9): 0, (0, 5): 2, (1, 7): m.SHARD}


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD", 64)
    rows = [(i, " ".join(["short"] * (i % 40))) for i in range(700)] + [(7, "one and the same text")] * 1500
    shards = m.sharded(staged(m.tokenise(spark.createDataFrame(rows, "doc_id long, text string")), "tokens")).groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == 2200 and len(shards) >= 30
    assert max(r["count"] for r in shards) < 130  # copies are dealt out by a hash


def test_cells_are_the_languages_of_a_mixed_corpus():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1000 * (i % 3), 1000 * (i % 3) + 300, 250).astype(np.uint32) for i in range(300)]
    sketches = np.array([m.sketch(*np.unique(t, return_counts=True), 5000) for t in texts], float)
    centres = m.fit_cells(sketches)
    assert len(centres) == 3
    cell = np.argmax(sketches @ centres.T, axis=1)
    assert all(len(set(cell[i::3])) == 1 for i in range(3))
    assert len(m.fit_cells(sketches[:1])) == 1


def neighbour_recall(spark, docs, n_seeds=100, k=10):
    """Share of the k best neighbours over all rests, by plain BM25 with all ids, that lie in the shard of a seed, for seeds among the longest quarter."""
    use = m.vocabulary(m.default_vocabulary())
    tokens = staged(m.tokenise(docs), "tokens")
    idf, mean = m.corpus_statistics(tokens, use.size)
    rows = m.sharded(tokens).select("shard", "ids").collect()
    shard = np.array([r["shard"] for r in rows])
    rests = [m.unpack_ids(bytes(r["ids"]), use.size) for r in rows]
    rng = np.random.default_rng(0)
    longest = np.argsort([-len(r) for r in rests], kind="stable")[: max(1, len(rests) // 4)]
    seeds = rng.choice(longest, min(n_seeds, len(longest)), replace=False)
    length = np.array([len(r) for r in rests])
    owner, ids = np.repeat(np.arange(len(rests)), length), np.concatenate(rests)
    both, tf = np.unique(owner.astype(np.int64) * use.size + ids, return_counts=True)
    owner, ids = both // use.size, both % use.size
    weight = idf[ids] * tf * (m.K1 + 1) / (tf + m.K1 * (1 - m.B + m.B * length[owner] / mean))
    shares = []
    for seed in seeds:
        asked = np.zeros(use.size, bool)
        asked[rests[seed]] = True
        hit = asked[ids]
        score = np.bincount(owner[hit], weight[hit], len(rests))
        score[seed] = -1
        best = np.argsort(-score, kind="stable")[:k]
        shares.append(np.mean(shard[best] == shard[seed]))
    return float(np.mean(shares))


def test_neighbours_lie_in_the_shard(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    assert neighbour_recall(spark, spark.read.parquet(f"{folder}/documents.parquet")) >= 0.9


def test_statistics_cover_all_documents(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    use = m.vocabulary(m.default_vocabulary())
    idf, mean = m.corpus_statistics(m.tokenise(df), use.size)
    ids = [np.append(use.ids(t or ""), 1) for t in texts()]
    assert m.tokenise(df).filter("start + length = n").count() == len(ids)
    n = sum(int(1 in i) for i in ids)
    assert mean == pytest.approx(np.mean([len(i) for i in ids]))
    assert idf[1] == pytest.approx(np.log1p((len(ids) - n + 0.5) / (n + 0.5)))


def test_empty(spark):
    assert m.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
