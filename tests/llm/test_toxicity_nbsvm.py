import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkloom.llm import toxicity_nbsvm as m


def made(n=600, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Vilegrub", "vilegrubs,", "snarkgrubby"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in m.score_documents(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_labels_of_the_held_out_fold_are_never_read(spark):
    rows = made(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    both = [spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 5 else flip(y)) for i, _, y in rows], "doc_id long, toxic int") for flip in (lambda y: y, lambda y: 1 - y)]
    a, b = (sorted((r["doc_id"], r["score"]) for r in m.score_documents(docs, labels).collect()) for labels in both)
    assert a == b


def test_score_is_the_plain_sum_over_ngrams():
    rows = made(120)
    model = m.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    words = ["vilegrub", "é😀x", "a", ""]
    got = model.of_words(words)
    for w, s in zip(words, got):
        marked = f"<{w}>"
        n_grams = [marked[i : i + n] for n in m.ORDERS for i in range(len(marked) - n + 1)]
        assert len(m.hashed_ngrams([w])[0]) == len(n_grams)
        assert s == pytest.approx(model.weight[m.hashed_ngrams([w])[0]].sum(), abs=1e-4)
    # equal n-grams of different words share a bucket
    x, y = (dict(zip([f"<{w}>"[i : i + 3] for i in range(len(w))], m.hashed_ngrams([w])[0])) for w in ("herons", "heron"))
    assert all(x[g] == y[g] for g in ("<he", "her", "ero", "ron"))


def plain_fit(texts, toxic, rounds=4000, rate=2.0):
    """The same model by dense matrices and plain gradient descent: weights by n-gram, and the bias."""
    grams = []
    for text in texts:
        count = {}
        for w in set(text.lower().split()):
            marked = f"<{w}>"
            for g in {marked[i : i + n] for n in m.ORDERS for i in range(len(marked) - n + 1)}:
                count[g] = count.get(g, 0) + sum(marked[i : i + len(g)] == g for i in range(len(marked) - len(g) + 1))
        grams.append(count)
    names = sorted({g for c in grams for g in c})
    x = np.array([[c.get(g, 0) for g in names] for c in grams], float)
    y = np.array(toxic, float)
    p, q = 1 + (x[y == 1] > 0).sum(0), 1 + (x[y == 0] > 0).sum(0)
    ratio = np.log(p / (2 + y.sum())) - np.log(q / (2 + (1 - y).sum()))
    x, w, bias = x * ratio, np.zeros(len(names)), np.log(y.mean() / (1 - y.mean()))
    rate /= (x**2).sum(axis=1).mean()
    for _ in range(rounds):
        wrong = (1 / (1 + np.exp(-(x @ w + bias))) - y) / len(y)
        w, bias = w - rate * (x.T @ wrong + m.PENALTY * w), bias - rate * wrong.sum()
    return dict(zip(names, w * ratio)), bias, x @ w + bias


def test_fit_is_the_plain_regression():
    rows = made(48, seed=9)
    texts, toxic = [" ".join(t.split()[:14]) for _, t, _ in rows], [y for _, _, y in rows]
    weights, bias, scores = plain_fit(texts, toxic)
    model = m.fit(texts, toxic, rounds=400)
    got = np.array([model.of_words(sorted(m.words_of(t))).sum() + model.bias for t in texts])
    assert np.abs(1 / (1 + np.exp(-got)) - 1 / (1 + np.exp(-scores))).max() < 0.02
    words = ["vilegrub", "snarkgrubby", "heron"]
    plain = [sum(weights.get(f"<{w}>"[i : i + n], 0) for n in m.ORDERS for i in range(len(w) + 3 - n)) for w in words]
    assert min(model.of_words(words)[0], plain[0]) > 1 and np.argsort(model.of_words(words)).tolist() == np.argsort(plain).tolist()


def test_sample_is_of_documents_that_are_there(spark):
    """Labels of absent documents use nothing up, and long texts count."""
    rows = made(200)
    docs = spark.createDataFrame([(i, t + " filler" * (9000 if y else 0)) for i, t, y in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 0) for i in range(10_000, 12_000)], "doc_id long, toxic int")
    model = m.train(docs, labels, max_rows=150)
    alike = m.fit([t + (" filler" if y else "") for i, t, y in rows if zlib.crc32(str(i).encode()) % 5], [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5])
    assert model.of_words(["vilegrub"])[0] > 1 and alike.of_words(["vilegrub"])[0] > 1


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "again"), (None, "x"), (3, "word " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in m.score_documents(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, None)], "doc_id long, toxic int")
    assert all(r["score"] < 1e-6 for r in m.score_documents(docs, one).collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert m.score_documents(docs, labels).count() == 5
    assert m.score_documents(docs.limit(0), labels).collect() == []
    assert m.filter_documents(docs, one).count() == 5


def test_on_the_test_tables(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = m.op4_toxicity_nbsvm(spark, sf).filter("held_out").collect()
    hits = [r["predicted"] == toxic[r["doc_id"]] for r in got if r["doc_id"] in toxic]
    assert np.mean(hits) > 0.9
