import random

import pytest

from sparkloom.llm import host_reputation as m

URLS = [
    None, "", "no scheme/x", "http://", "HTTP://WWW.Example.ORG/es/a?b#c", "https://example.org/en/12", "https://x.example.org/en/2", "https://notexample.com/fr/", "https://a.com/de/x",
    "https://a.com/en", "://host", "http://a.org", "http://a.org/", "http://x://y.com/de/", "http://É.com/fr/?q=://z", "http://u@h.co.uk:80/p\nq?x", "http://org/x", "http://myorg/x", "ftp://...//", "http://10.0.0.12:80/x", "http://me@w.gov.au/",
]


def tables(spark, urls, seed=0):
    rng = random.Random(seed)
    hosts = [f"http://h{i}.d{i % 7}.{'net' if i % 2 else 'info'}/p" for i in range(60)]
    urls = urls + [hosts[min(int(rng.expovariate(0.1)), 59)] for _ in range(900)]
    pages = spark.createDataFrame([(None if i == 4 else i, u, "x", 1) for i, u in enumerate(urls)] + [(7, "http://dup.net/", "y", 2)], "page_id long, url string, host string, n int")
    bad = [".d3." in (u or "") or "//h1." in (u or "") for u in urls]
    labels = [(i, int(rng.random() > (0.95 if bad[i] else 0.1)), int(rng.random() < 0.1)) for i in range(len(urls)) if rng.random() < 0.5]
    return pages, spark.createDataFrame(labels + [(5, 1, 0), (5, 0, 0), (99_999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")


def outcomes(labels):
    return labels.selectExpr("doc_id AS page_id", "CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad")


def test_same_as_sql(spark, oracle, same):
    pages, labels = tables(spark, URLS)
    got = m.judge(pages, outcomes(labels))
    same(got, oracle(m.ORACLES["op7_host_reputation"], pages=pages, labels=labels))
    assert {r["verdict"] for r in got.filter("rule IS NULL").collect()} == {"allow", "block"}


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: r for r in m.judge(df, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (4, 5, 6, 7, 8, 9, 11, 12, 16, 17)] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("org/", "allow"), (None, "allow"),
    ]
    assert (got[4]["host"], got[4]["path"]) == ("www.example.org", "/es/a")
    assert (got[14]["host"], got[13]["host"]) == ("É.com", "x:")


def test_domains(spark):
    names = ["a.b.example.org", "example.org", "org", "", "x.y.co.uk", "co.uk", "h.co.uk", "u:p@a.b.ac.nz:80", "example.com:8080", "10.0.0.12:80", "a.com.example", "x.github.io"]
    df = spark.createDataFrame([(n,) for n in names], "h string")
    domain, suffix = m.domain_and_suffix(df["h"])
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [
        ("example.org", "org"), ("example.org", "org"), ("org", "org"), ("", ""), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"), ("h.co.uk", "co.uk"),
        ("b.ac.nz", "ac.nz"), ("example.com", "com"), ("10.0.0.12", "10.0.0.12"), ("com.example", "example"), ("github.io", "io"),
    ]
    domain, suffix = m.domain_and_suffix(df["h"], ("github.io",))
    assert tuple(df.filter("h = 'x.github.io'").select(domain, suffix).first()) == ("x.github.io", "github.io")


def test_strength_by_moments():
    # two groups far apart: a weak prior; like ones: the strongest
    assert m.strength(200, 100, 2, 95**2 / 100 + 5**2 / 100) == m.WEAKEST
    assert m.strength(200, 100, 2, 50**2 / 100 * 2) == m.STRONGEST
    n, bad, k, s = 1000, 300, 10, sum(b * b / 100 for b in (10, 50, 30, 30, 20, 40, 25, 35, 30, 30))
    share, spread = 0.3, s / 1000 - 0.09
    assert m.strength(n, bad, k, s) == pytest.approx((0.21 - spread) / (spread - 0.21 * 10 / 1000), abs=1e-6)
    assert share * n == bad


def test_empty(spark):
    pages, labels = tables(spark, [])
    assert m.judge(pages.limit(0), outcomes(labels)).collect() == []
