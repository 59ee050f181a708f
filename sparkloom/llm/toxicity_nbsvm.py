"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (``ORDERS``) of its distinct
lower-cased words, each word between two marks, hashed to ``BUCKETS``; a feature's
value is the number of distinct words that hold it. Each is scaled by the log ratio
of its frequencies in toxic and other training texts, and a logistic regression with
an L2 penalty is fitted to the scaled features.

The fit takes a bounded sample of labelled documents, ``max_rows`` of those that are
there, with the smallest hashes of their ids and whatever their lengths; a text comes to
the driver as its distinct words. Scoring is a sum over a text's distinct words, takes
every text whole and needs no shuffle; the model is one array of ``BUCKETS`` numbers,
whatever the corpus.

Defined results: a null text counts as empty; an empty text gets the score of the
intercept. Labels that are null are ignored; of several labels for an id the largest
counts, of several texts the smallest. If the sample lacks one of the two classes every score is that class's share,
0 or 1 (0.5 without any label). Repeated rows are scored each; a null doc_id is
held out (its remainder isn't known) and scored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, fresh, small_batches, table
from .piece_encode import Segments

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 18
MAX_ROWS = 4000
#: Words whose scores a worker remembers; it works others out again.
KNOWN_WORDS = 100_000
ALPHA = 1.0
PENALTY = 1e-3
FOLDS = 5


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def hashed_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every word, and the place of its word."""
    marked = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters of the word from here on
    buckets, owners = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in ORDERS:
            inside = np.flatnonzero(left[: len(rolling)] >= n)
            mixed = rolling[inside] * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(n)
            mixed ^= mixed >> np.uint64(33)
            mixed *= np.uint64(0xC4CEB9FE1A85EC53)
            buckets.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """Score of a text: the logistic function of bias plus the weights of its distinct words' n-grams."""

    weight: np.ndarray
    bias: float

    def of_words(self, words: list[str]) -> np.ndarray:
        buckets, owner = hashed_ngrams(words)
        return np.bincount(owner, self.weight[buckets], len(words))


def fit(texts: list[str | None], toxic: list[int], penalty: float = PENALTY, rounds: int = 80) -> Model:
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), float({0.0: -40.0, 0.5: 0.0, 1.0: 40.0}[share]))
    places: dict[str, int] = {}
    word_at, doc_at = [], []
    for d, text in enumerate(texts):
        for w in sorted(words_of(text)):
            word_at.append(places.setdefault(w, len(places)))
            doc_at.append(d)
    word_at, doc_at = np.array(word_at, np.int32), np.array(doc_at, np.int32)
    buckets, owner = hashed_ngrams(list(places))
    n_docs, n_words = len(y), len(places)
    del places
    used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    n_features = len(used)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(n_features, dtype=np.int32)
    # in the order of the words, so that a word's n-grams are a slice
    order = np.argsort(owner, kind="stable").astype(np.int32)
    buckets, owner = place[buckets[order]], owner[order].astype(np.int32)
    del order
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_words))])

    # log-count ratios over documents that hold a feature
    holds = np.zeros((2, n_features))
    cut = np.concatenate([[0], np.cumsum(np.bincount(doc_at, minlength=n_docs))])
    for d in range(n_docs):
        own = word_at[cut[d] : cut[d + 1]]
        if len(own):
            seen = np.unique(np.concatenate([buckets[first[w] : first[w + 1]] for w in own]))
            holds[int(y[d]), seen] += 1
    p, q = ALPHA + holds[1], ALPHA + holds[0]
    ratio = np.log(p / (2 * ALPHA + y.sum())) - np.log(q / (2 * ALPHA + (1 - y).sum()))
    starts = first[:-1]

    def scores(w: np.ndarray) -> np.ndarray:
        of_word = np.add.reduceat((w[:-1] * ratio)[buckets], starts)  # every word has an n-gram
        return np.bincount(doc_at, of_word[word_at], n_docs) + w[-1]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = scores(w)
        loss = np.mean(np.logaddexp(0, s) - y * s) + penalty / 2 * w[:-1] @ w[:-1]
        wrong = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y) / n_docs
        of_word = np.bincount(word_at, wrong[doc_at], n_words)
        gradient = np.bincount(buckets, of_word[owner], n_features) * ratio + penalty * w[:-1]
        return loss, np.append(gradient, wrong.sum())

    w = minimise(value, np.append(np.zeros(n_features), np.log(y.mean() / (1 - y.mean()))), rounds)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = w[:-1] * ratio
    return Model(weight, float(w[-1]))


def minimise(value, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    loss, gradient = value(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction = gradient.copy()
        kept = []
        for s, g, inverse in reversed(steps):
            a = inverse * (s @ direction)
            direction -= a * g
            kept.append(a)
        if steps:
            s, g, _ = steps[-1]
            direction *= (s @ g) / (g @ g)
        for (s, g, inverse), a in zip(steps, reversed(kept)):
            direction += s * (a - inverse * (g @ direction))
        slope = gradient @ direction
        if slope <= 0 or np.abs(gradient).max() < 1e-7:
            break
        size = 1.0 if steps else min(1.0, 1 / np.abs(gradient).sum())
        while size > 1e-10:
            new = x - size * direction
            new_loss, new_gradient = value(new)
            if new_loss <= loss - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, g = new - x, new_gradient - gradient
        if s @ g > 1e-12:
            steps = [*steps[-memory + 1 :], (s, g, 1 / (s @ g))]
        done = loss - new_loss < 1e-9
        x, loss, gradient = new, new_loss, new_gradient
        if done:
            break
    return x


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@F.pandas_udf(T.StringType())
def _distinct_words(text: pd.Series) -> pd.Series:
    return pd.Series([" ".join(sorted(words_of(t))) for t in text], dtype=object)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled documents outside the held-out fold; the sample is chosen by ids alone, among those that are there."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    spread = F.xxhash64("doc_id")
    one_in = max(1, there.count() // (2 * max_rows))  # first by number, so that tasks don't send max_rows ids each
    chosen = there.filter(F.pmod(spread, F.lit(one_in)) == 0).orderBy(spread, "doc_id").limit(max_rows)
    # at most max_rows ids, and one text for each
    words = _distinct_words(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = rows.select("doc_id", "toxic", words.alias("words")).toPandas().sort_values("doc_id", kind="stable")
    return fit(sample["words"].tolist(), sample["toxic"].tolist())


def scorer(spark: SparkSession, model: Model):
    """A column function: the score of a text column."""
    shared = spark.sparkContext.broadcast((model.weight, model.bias))

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        model, known = _cached(shared)
        sets = [words_of(t) for t in text]
        missing = list({w for s in sets for w in s if w not in known})
        if len(known) + len(missing) > known.most:
            known.clear()
            missing = list({w for s in sets for w in s})
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            known.update(zip(part, model.of_words(part).tolist()))
        sums = np.array([sum(map(known.__getitem__, sorted(s))) for s in sets]) + model.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -500, 500))))

    return score


_scorers: dict[int, tuple[Model, Segments]] = {}


def _cached(shared) -> tuple[Model, Segments]:
    """A worker keeps the words that it has met under one model."""
    key = id(shared.value[0])  # the model that is kept holds on to the array, so no other can have its place
    if key not in _scorers:
        _scorers.clear()
        model = Model(*shared.value)
        _scorers[key] = model, Segments(lambda w: float(model.of_words([w])[0]), KNOWN_WORDS)
    return _scorers[key]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    score = scorer(small_batches(docs.sparkSession), train(docs, labels))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def filter_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with the columns they came with."""
    score = scorer(small_batches(docs.sparkSession), model or train(docs, labels))
    s = fresh("score", docs.columns)
    return docs.withColumn(s, score(column("text"))).filter(column(s) < 0.5).select(*map(column, docs.columns))


def op4_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity_nbsvm": op4_toxicity_nbsvm}
ORACLES: dict[str, str] = {}
