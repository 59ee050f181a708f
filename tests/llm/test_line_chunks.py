import random

from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm import line_chunks as m


def plain_chunks(lines):
    """(first line, line after the last) by the rule: a chunk of 2 to 16 lines ends where the hash of its last two lines is even."""
    mask, out, start = 2**64 - 1, [], 0
    hashes = [m.xxhash.xxh3_64_intdigest(line) for line in lines]
    for end in range(1, len(lines) + 1):
        two = hashes[end - 1] + (hashes[end - 2] * 0x9E3779B97F4A7C15 if end > 1 else 0) & mask
        even = ((two & mask) ^ (two & mask) >> 32) % 2 == 0
        if end == len(lines) or end - start >= 16 or (end - start >= 2 and even):
            out.append((start, end))
            start = end
    return out


def chunked(text):
    """As m.chunks, without it."""
    lines = text.encode().split(b"\n") if text else []
    return [(a, b, sum(bool(x.strip()) for x in lines[a:b]) >= 2) for a, b in plain_chunks(lines)]


def brute(rows):
    """Keeps the first chunk of each sort in the order of id (null first), text hash being a tie's order only."""
    seen, out = {}, {}
    for i, t in rows:
        if t is None:
            out[i, t] = None
            continue
        lines, kept = t.encode().split(b"\n"), []
        for a, b, may in chunked(t):
            chunk = b"\n".join(lines[a:b])
            if may and seen.setdefault(chunk, (i, t, a)) != (i, t, a):
                continue
            kept += lines[a:b]
        out[i, t] = b"\n".join(kept).decode()
    return out


def corpus():
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["heron", "reed", "lock", "river"]) + str(rng.randrange(99)) for _ in range(rng.randrange(3, 12)))
    shared = [line() for _ in range(12)]
    long = " ".join(f"passage{i}" for i in range(60))
    rows = [(None, "\n".join(shared)), (0, None), (1, ""), (2, "\n\n\n\n"), (3, "one line")]
    for i in range(4, 60):
        own = [line() for _ in range(rng.randrange(4, 30))]
        at = rng.randrange(len(own))
        rows.append((i, "\n".join([*own[:at], *(shared if i % 2 else [long]), *own[at:]])))
    rows += [(60, rows[10][1]), (61, "same\n" * 200), (62, "\n".join(shared + shared)), (60, rows[10][1]), (2**62 + 1, rows[11][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, text_hash string, deduplicated int")


def test_same_as_brute_force(spark, monkeypatch):
    df = frame(spark, corpus())
    expected = brute(corpus())
    assert sum(t != e for (_, t), e in expected.items()) > 30
    for real in (m.hash_of, lambda c, real=m.hash_of: real(c) % 50):  # and one hash for many chunks
        monkeypatch.setattr(m, "hash_of", real)
        got = m.deduplicate(df)
        assert got.columns == [*df.columns, "deduplicated_1"]
        rows = got.select("doc_id", "text", "deduplicated_1.text", "deduplicated_1.n_lines", "deduplicated_1.n_removed").collect()
        assert len(rows) == len(corpus())
        for i, t, new, n_lines, n_removed in rows:
            assert new == expected[i, t]
            assert n_lines == (t.count("\n") + 1 if t else 0)


def test_long_line_goes_as_a_passage(spark):
    """A repeated line of 60 words between lines of one's own: no chunk can hold it alone."""
    long = " ".join(f"passage{i}" for i in range(60))
    rows = m.deduplicate(frame(spark, corpus()), passages=True).select("doc_id", "deduplicated_1.text").collect()
    assert sum(long in (r["text"] or "") for r in rows) == 1


def passages_corpus(n_lines, fewest, most, n=30):
    """Passages of over 50 words in two documents each, between lines that no other document has."""
    rng = random.Random(n_lines)
    line = lambda a, b: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(a, b)))
    rows, found = [], []
    for k in range(n):
        passage = [line(fewest, most) for _ in range(n_lines)]
        found.append(passage)
        for copy in (0, 1):
            own = [line(3, 12) for _ in range(20)]
            at = rng.randrange(21)
            rows.append((2 * k + copy, "\n".join([*own[:at], *passage, *own[at:]])))
    return rows, found


def test_passages_of_short_lines_go_whole(spark):
    shapes = [(4, 13, 15), (6, 9, 12), (8, 7, 9), (10, 6, 8)]
    rows, found, expected = [], [], {}
    for shape in shapes:
        more, passages = passages_corpus(*shape)
        for (i, t), copy in zip(more, range(len(more))):
            going = set(passages[copy // 2]) if copy % 2 else set()
            expected[len(rows)] = "\n".join(x for x in t.split("\n") if x not in going)
            rows.append((len(rows), t))
        found += passages
    assert min(sum(len(x.split()) for x in p) for p in found) >= m.PASSAGE_WORDS - 2
    got = {r["doc_id"]: r[-1] for r in m.deduplicate(frame(spark, rows), passages=True).select("doc_id", "deduplicated_1.text").collect()}
    whole = [i for i, t in expected.items() if got[i] == t]
    # passages that happen to be under 50 words go as their chunks do
    short = {2 * k + 1 for k, p in enumerate(found) if sum(len(x.split()) for x in p) < m.PASSAGE_WORDS}
    assert set(expected) - set(whole) <= short


def deduplicated(rows):
    """(doc_id, text) -> text without repeated chunks and passages, by plain loops."""
    first, seen = {}, {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, ""))
    expected = {}
    for i, t in order:
        lines, gone, repeated = t.split("\n") if t else [], set(), set()
        for a, b, may in chunked(t):
            if may and seen.setdefault("\n".join(lines[a:b]), (i, t, a)) != (i, t, a):
                gone |= set(range(a, b))
        said = [k for k, x in enumerate(lines) if x.strip()]
        for a, b in zip(said, said[1:]):
            if first.setdefault((lines[a], lines[b]), (i, t, a)) != (i, t, a):
                repeated.add((a, b))
        gone |= {k for k in said if len(lines[k].split()) >= m.PASSAGE_WORDS and first.setdefault((lines[k],), (i, t, k)) != (i, t, k)}
        runs = []
        for a, b in sorted(repeated):
            if runs and runs[-1][-1] == a:
                runs[-1].append(b)
            else:
                runs.append([a, b])
        for run in runs:
            if sum(len(lines[k].split()) for k in run) >= m.PASSAGE_WORDS:
                gone |= set(range(run[0], run[-1] + 1))
        expected[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return expected


def test_passages_same_as_brute_force(spark):
    rows = corpus()
    expected = deduplicated(rows)
    got = {(r[0], r[1]): r[2] for r in m.deduplicate(frame(spark, rows), passages=True).select("doc_id", "text", "deduplicated_1.text").collect()}
    assert {k: v for k, v in got.items() if k[1] is not None} == expected
    assert expected != {k: v for k, v in brute(rows).items() if k[1] is not None}
    kept = {x for t in expected.values() for x in t.split("\n")}
    assert {x for _, t in rows for x in (t or "").split("\n") if x.strip()} <= kept


@given(st.lists(st.sampled_from(["a", "b", "", "long " * 60, "c d"]), max_size=60))
def test_chunks_tile_the_lines(lines):
    text = "\n".join(lines)
    found = m.chunks(text.encode())
    assert found == chunked(text)
    at = 0
    for a, b, may in found:
        assert a == at and b > a and b - a <= m.MOST_LINES
        assert not may or b - a >= 2
        at = b
    assert at == (len(lines) if text else 0)


def test_boundaries_resist_shifts():
    rng = random.Random(4)
    lines = [f"line {rng.random()}" for _ in range(300)]
    chunk = lambda ls: {b"\n".join(x.encode() for x in ls[a:b]) for a, b, _ in m.chunks("\n".join(ls).encode())}
    before, after = chunk(lines), chunk(["inserted"] + lines)
    assert len(before & after) > 0.9 * len(before)


def test_very_long_text(spark):
    lines = [f"line {i} of a text" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["first", *lines[30_000:], "last"]))]
    got = {r["doc_id"]: r["deduplicated_1"] for r in m.deduplicate(frame(spark, rows), passages=True).select("doc_id", "deduplicated_1").collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "first\nlast"


def test_frequent_keys_are_joined_apart(spark):
    """Three in five rows have one key; the join gives what a plain one does."""
    from sparkloom.llm import _shared

    rows = spark.range(5000).selectExpr("id", "if(id % 5 < 3, 0, id) AS h")
    per_key = rows.groupBy("h").count().withColumnRenamed("count", "n").filter("n > 1 OR h % 2 = 1")
    got = _shared.join_counted(rows, per_key, "h")
    assert sorted(map(tuple, got.select("h", "id", "n").collect())) == sorted(map(tuple, rows.join(per_key, "h").select("h", "id", "n").collect()))


def test_empty(spark):
    assert m.deduplicate(frame(spark, [])).collect() == []
