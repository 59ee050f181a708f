import random

import numpy as np

from sparkloom.llm import near_copies as m
from sparkloom.llm import simhash_bitslice


def shingled(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = shingled(a), shingled(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def corpus():
    rng = random.Random(8)
    rows = [None, "", " \n", "One", "one", "two words"]
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5, 8, 12):
            copy = list(words)
            for at in rng.sample(range(200), changes):
                copy[at] = "changed"
            rows.append(" ".join(copy))
    return [(500 - i, t) for i, t in enumerate(rows)] + [(None, rows[6]), (500 - 7, "a second row of this id")]


def grouping(rows):
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similar(rows[i][1], rows[j][1]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def by_row(rows):
    group, smallest = grouping(rows), {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            smallest[g] = min(i, smallest.get(g, i))
    return [(i, smallest.get(g)) for (i, _), g in zip(rows, group)]


def components(rows):
    return sorted(by_row(rows), key=str)


def test_components_by_jaccard(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keys string")
    expected = components(rows)
    for split in (m.SPLIT, 3):  # and buckets that are dealt out
        monkeypatch.setattr(m, "SPLIT", split)
        assert sorted(((r["doc_id"], r["component_id"]) for r in m.assign(df).collect()), key=str) == expected
    three_bits = {r["component_id"] for r in simhash_bitslice.assign(df).collect()}
    assert len(three_bits) > 1.5 * len({c for _, c in expected})


def test_pipeline_drops_copies_at_four_fifths(spark):
    import corpus_pipeline

    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    # a component whose smallest row has an id that another component's smallest row has too keeps its own row
    assert ids == sorted(c for c in {g: c for g, c in zip(grouping(rows), [c for _, c in by_row(rows)])}.values())


def test_large_group_of_near_copies(spark):
    """Copies of one text that are not all alike pairwise, and another text that shares half of them."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 6)):
            copy[at] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy if i % 4 else copy[:60] + [f"o{k}" for k in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in m.assign(df).collect()), key=str)
    assert got == components(rows)


def test_pivots_and_bit_planes_find_different_links():
    """A chain in which only neighbours are alike: the smallest node is like few, the planes find the others."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 10 : i * 10 + 150]) for i in range(20)]
    sets = [np.unique((m.shingles(t) >> np.uint64(32)).astype("<u4")) for t in texts]
    prints = np.array([m.print_of(m.shingles(t)) for t in texts], np.int64).view(np.uint64)
    nodes = np.arange(20)
    assert m.alike(sets[0], sets[1]) and not m.alike(sets[0], sets[2])
    found = m.bucket_links(nodes, prints, nodes, sets, np.zeros(20, int), np.zeros(20, int))
    assert {tuple(sorted(x)) for x in found} == {(i, i + 1) for i in range(19)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.assign(df).collect() == [] and m.representatives(df).collect() == []
