import random
import re

import duckdb
import pytest

from sparkloom.llm import license_join as m

NOTICE = dict(m.TEMPLATES[::-1])["gpl"], m.TEMPLATES[1][1], m.TEMPLATES[3][1], m.TEMPLATES[6][1]


def plain(rows, scan):
    """Every block against every template, every place against every phrase, in words of the text."""
    out = []
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        base, places = set(), []
        for label, phrase in scan.phrases:
            found = [i for i in range(len(words)) if words[i : i + len(phrase)] == [w.decode() for w in phrase]]
            places += found
            base |= {label} if found else set()
        labels, best = set(base), 0.0
        for t in scan.templates:
            for start in range(0, len(words), t.size):
                block = set(words[start : start + 2 * t.size])
                share = sum(w.decode() in block for w in t.words)
                if share >= t.need:
                    labels.add(t.label)
                    best = max(best, share / len(t.words))
        out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best))
    return out


def cases():
    rng = random.Random(3)
    filler = "the of and to in a is for this work under version file you may 2 0 heron marsh reed étang straße".split()
    rows = [
        (1, None), (2, ""), (3, "  \n"), (None, "Released under the MIT-license"), (5, "mit LICENSE mit license; Apache\nLicense. The general public license"),
        (6, "İ MIT license é"), (7, "general public licenses mit licenseé"), (8, "Licensed under CC BY-NC 4.0."), (9, "mit"), (9, "mit"), (10, "x" * 100_000 + " mit license"),
        (11, "word " * 30_000 + NOTICE[0]),
    ]
    for i in range(150):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 300))]
        notice = re.findall(r"\S+", rng.choice(m.TEMPLATES)[1])
        kept = [w.upper() if rng.random() < 0.3 else w for w in notice if rng.random() > rng.choice([0, 0.1, 0.25])]
        if rng.random() < 0.3:
            rng.shuffle(kept)
        at = rng.randrange(len(words) + 1)
        rows.append((100 + i, " ".join(words[:at] + kept + words[at:])))
    return rows


@pytest.mark.parametrize("threshold", [0.8, 0.55, 1.0])
def test_every_contained_template(spark, threshold):
    scan = m.Scan.of(threshold=threshold)
    df = spark.createDataFrame([(i, t, 7, "b") for i, t in cases()], "doc_id long, text string, row long, blocks string").repartition(3)
    got = m.scan_documents(df, scan)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(cases(), scan), key=str)


def test_sql_form(spark, oracle, same):
    df = spark.createDataFrame(cases(), "doc_id long, text string")
    same(m.scan_documents(df), oracle(m.ORACLES["op12_license_join"], documents=df))


def test_query(spark, sf_dir, same):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.execute(m.ORACLES["op12_license_join"])
    names = [d[0] for d in expected.description]
    same(m.op12_license_join(spark, sf_dir), [dict(zip(names, r)) for r in expected.fetchall()])


def test_notices_are_found_and_prose_is_not(spark):
    prose = "The heron stood in the reeds, and you may use this file of the work under the terms that any person is free to copy. " * 40
    rows = [(i, f"{prose}\n{n.replace(' ', chr(10), 3)}\n{prose}") for i, n in enumerate(NOTICE)] + [(9, prose)]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in m.scan_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i][0] for i in range(4)] == ["gpl", "mit", "apache", "bsd"] and got[9] == ("", "") and got[1][1] == ""


def test_matches_say_where(spark):
    scan = m.Scan.of([("own", "alpha beta gamma delta")], {}, 0.75)
    rows = m.scanned(spark.createDataFrame([(1, "x " * 20 + "gamma beta alpha")], "doc_id long, text string"), scan).cache()
    found = sorted((r["label"], r["start"], r["shared"], r["containment"]) for r in m.contained(rows, scan).collect())
    assert found == [("own", 8, 3, 0.75), ("own", 16, 3, 0.75)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.scan_documents(df).collect() == []
    with pytest.raises(ValueError):
        m.Scan.of([("none", " - ")])
