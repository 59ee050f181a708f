import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import simhash_bitslice as m


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    smallest = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            smallest[g] = min(i, smallest.get(g, i))
    return sorted(((i, f"{p:016x}", smallest.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=str)


def corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(50)) for _ in range(200)) for _ in range(12)]
    texts = [None, "", "  \n", "One", "one", "Two words", "ÄÖ ä"] + base
    for t in base:
        words = t.split()
        for _ in range(12):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += base[:3]
    return [(1000 - i, t) for i, t in enumerate(texts)] + [(1000, base[0]), (None, base[1]), (None, "nothing like it at all")]


def test_components(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = m.op10_simhash_bitslice.__globals__["assign"](df)
    found = sorted(((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got.collect()), key=str)
    expected = brute(rows)
    assert found == expected
    assert any(c is not None and c != i for i, _, c in expected)

    kept = m.representatives(df)
    assert kept.columns == df.columns
    named = sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect())
    assert named == sorted({c for _, _, c in expected if c is not None})
    # a null id stays only where its component has no other
    assert [r["text"] for r in kept.filter("doc_id IS NULL").collect()] == ["nothing like it at all"]


def test_representatives_of_repeated_ids(spark):
    """Rows that share an id but not the text are told apart, whatever the order of the rows."""
    a, b = "one two three four five six seven", "quite another text than the one before it"
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (None, a), (None, "alone " * 9), (None, "alone " * 9)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, m.representatives(df).collect()), key=str) == sorted([(1, a), (5, b), (None, "alone " * 9)], key=str)


def test_very_long_text(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.assign(df).collect()}
    assert got[2]["component_id"] == 1 and got[1]["fp"] == m._signed(plain(" ".join(words)))


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(m, "SPLIT", 4)
    rng = random.Random(1)
    center = rng.getrandbits(64)
    values = {center}
    while len(values) < 120:
        v = rng.choice(list(values))
        for _ in range(rng.randrange(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    signed = [m._signed(v) for v in values]
    roots = {r["node"]: r["root"] for r in m.components(m.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    group = {v: v for v in signed}
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = group[m._signed(a)], group[m._signed(b)]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    assert {v: roots.get(v, v) for v in signed} == group


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 40), st.integers(1, 70))
def test_bit_sliced_distance(values, radius, by):
    values = values + [v ^ 7 for v in values[:20]] + [v ^ 0xFFFFFF0F for v in values[:20]]
    planes = m.bit_planes(np.array(values, np.uint64))
    reach = np.pad(np.arange(len(values)) + by < len(values), (0, -len(values) % 64))
    live = np.packbits(reach, bitorder="little").view(np.uint64)
    got = set(m._places(m.near_at(planes, by, live, radius)).tolist())
    assert got == {i for i in range(len(values) - by) if (values[i] ^ values[i + by]).bit_count() <= radius}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.assign(df).collect() == [] and m.representatives(df).collect() == []
