"""The jobs: two runs over growing input, on copies; interrupted batches; the registered queries against their SQL."""

import json
import logging
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import document_index, registry, usage_report
from sparkloom.operators import bm25, rollups

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, extra int"


def put(spark, folder, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def index(spark, out):
    return sorted((r["doc_id"], r["folder"], r["term"], r["tf"], r["dl"], r["df"], r["cf"]) for r in document_index.read(spark, str(out)).collect())


def expected(docs):
    words = {i: (t or "").lower().replace(".", "").split() for i, (t, _) in docs.items()}
    rows = []
    for i, own in words.items():
        for term in set(own):
            rows.append((i, docs[i][1], term, own.count(term), len(own), sum(term in w for w in words.values()), sum(w.count(term) for w in words.values())))
    return sorted(rows)


@pytest.fixture
def library(spark, tmp_path):
    folder, out = tmp_path / "documents", tmp_path / "out"

    def run(rows=None, **config):
        if rows is not None:
            put(spark, folder, rows)
        return document_index.run(spark, str(folder), str(out), str(tmp_path / "checkpoint"), config)

    return run, out


def test_index_takes_only_what_is_new(spark, library, caplog):
    run, out = library
    with caplog.at_level(logging.INFO):
        assert run([(1, "Red fish. blue fish", "en", 0), (2, "Blue heron", "de", 0), (3, None, "en", 0), (None, "lost", "en", 0)]) == 1
    docs = {1: ("Red fish. blue fish", "en"), 2: ("Blue heron", "de"), 3: (None, "en")}
    assert index(spark, out) == expected(docs)
    assert any("4 rows read, 1 without an id" in r.getMessage() for r in caplog.records)
    assert any("postings: 5 rows written" in r.getMessage() for r in caplog.records)

    # nothing new: nothing changes, not even a file of a batch
    files = sorted((p, p.stat().st_mtime_ns) for p in out.rglob("*.parquet") if "dictionary" not in str(p))
    assert run() == 0
    assert index(spark, out) == expected(docs)
    assert files == sorted((p, p.stat().st_mtime_ns) for p in out.rglob("*.parquet") if "dictionary" not in str(p))

    # a changed text, one that is the same, a new one, one that is emptied, another folder
    assert run([(1, "green heron", "en", 1), (2, "Blue heron", "de", 1), (4, "fish fish", "fr", 1), (4, "a fish", "fr", 1)]) == 1
    docs |= {1: ("green heron", "en"), 4: ("fish fish", "fr")}
    assert index(spark, out) == expected(docs)
    assert spark.read.parquet(str(out / "postings")).filter("batch = 1 AND doc_id = 2").count() == 0
    assert run([(4, None, "fr", 2), (2, "Blue heron", "en", 2)]) == 1
    docs |= {4: (None, "fr"), 2: ("Blue heron", "en")}
    assert index(spark, out) == expected(docs)
    assert {r["term"] for r in spark.read.parquet(str(out / "dictionary")).collect()} == {"green", "blue", "heron"}


def test_interrupted_batch_is_done_again(spark, library, monkeypatch):
    run, out = library
    run([(1, "red fish", "en", 0)])
    write = document_index.Tables.write

    def dies(self, name, rows, mode="dynamic"):
        if name == "changes":
            raise RuntimeError("lost")
        return write(self, name, rows, mode)

    monkeypatch.setattr(document_index.Tables, "write", dies)
    with pytest.raises(Exception, match="lost"):
        run([(1, "blue heron", "en", 0), (2, "red", "en", 0)])
    monkeypatch.undo()
    assert run() == 1
    assert index(spark, out) == expected({1: ("blue heron", "en"), 2: ("red", "en")})


def test_many_files_a_batch_each(spark, library, tmp_path):
    run, out = library
    for i in range(3):
        put(spark, tmp_path / "documents", [(7, f"version {i} x", "en", 0), (10 + i, "same words", "en", 0)])
    assert run(files_per_batch=1) == 3
    got = index(spark, out)
    assert {r[0] for r in got} == {7, 10, 11, 12} and [r[2] for r in got if r[0] == 7 and r[2].isdigit()] in (["0"], ["1"], ["2"])
    assert {r[5] for r in got if r[2] == "same"} == {3}


def test_a_file_with_an_old_date_is_not_passed_over(spark, library, tmp_path):
    run, out = library
    run([(1, "red fish", "en", 0)])
    before = set((tmp_path / "documents").glob("*.parquet"))
    put(spark, tmp_path / "documents", [(2, "blue heron", "en", 0)])
    for file in set((tmp_path / "documents").glob("*.parquet")) - before:
        os.utime(file, (1e9, 1e9))
    assert run() == 1
    assert {r[0] for r in index(spark, out)} == {1, 2}


def test_empty_folder_of_documents(spark, library):
    run, out = library
    run([])
    assert index(spark, out) == []


def test_larger_batches_have_more_files_not_larger_tasks(spark, library, monkeypatch):
    run, out = library
    monkeypatch.setattr(document_index, "TEXT_PER_FILE", 200)
    docs = {i: (f"w{i} x{i % 7} common y{i % 3} common", "en") for i in range(40)}
    run([(i, *doc, 0) for i, doc in docs.items()], buckets=4)
    assert index(spark, out) == expected(docs)
    for folder in (out / "postings").glob("batch=0/bucket=*"):
        files = list(folder.glob("*.parquet"))
        assert len(files) > 1
        for file in files:
            terms = [r["term"] for r in spark.read.parquet(str(file)).select("term").collect()]
            assert terms == sorted(terms)


def test_a_bucket_is_a_task(spark):
    rows = spark.range(64).selectExpr("concat('t', id) AS term", "CAST(id % 16 AS INT) AS bucket")
    dealt = document_index.spread(rows, {"buckets": 16, "files_per_bucket": 1}, by="term").selectExpr("spark_partition_id() AS task", "bucket").distinct().collect()
    assert len(dealt) == 16 and len({r["task"] for r in dealt}) == 16


def test_reading_moves_no_postings_for_their_documents(spark, library):
    run, out = library
    docs = {1: ("red fish", "en"), 2: ("blue heron", "de"), 3: ("fish", None)}
    run([(i, *doc, 0) for i, doc in docs.items()])
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = document_index.read(spark, str(out))
        assert {tuple(r) for r in rows.select("doc_id", "folder", "term", "tf", "dl", "df", "cf").collect()} == {(1, "en", "red", 1, 2, 1, 1), (1, "en", "fish", 1, 2, 2, 2), (2, "de", "blue", 1, 2, 1, 1), (2, "de", "heron", 1, 2, 1, 1), (3, None, "fish", 1, 1, 2, 2)}
        assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_many_doubled_and_changed_documents(spark, library, monkeypatch, few):
    run, out = library
    monkeypatch.setattr(document_index, "FEW", few)
    run([(i, text, "en", 0) for i in range(20) for text in (f"a{i} same", f"b{i} same")] + [(None, "lost", "en", 0), (None, "lost", "en", 0), (90, "one", "en", 0)])
    docs = {i: (f"b{i} same", "en") for i in range(20)} | {90: ("one", "en")}
    assert index(spark, out) == expected(docs)
    run([(i, f"c{i} same", "de", 0) for i in range(10)] + [(19, "b19 same", "en", 0), (50, "new", "fr", 0), (50, "a new", "fr", 0)])
    docs |= {i: (f"c{i} same", "de") for i in range(10)} | {50: ("new", "fr")}
    assert index(spark, out) == expected(docs)
    lengths = {r["doc_id"]: r["n_terms"] for r in spark.read.parquet(str(out / "documents")).filter("batch = 1").collect()}
    assert lengths == {i: 2 for i in range(10)} | {50: 1}


def test_terms_counted_by_batch_are_those_counted_by_row(spark):
    texts = ["Red fish, red FISH", "", None, "Ünïcode ſtraße İ ΣΑΣ 東京 x² ٣", "z" * 40 + " " + "z" * 41 + " a_b a b", " \n\t.", "fish " * 500]
    rows = spark.createDataFrame([(i, t, "f" if i % 2 else None) for i, t in enumerate(texts)], "chunk_id long, text string, folder string").na.fill("", ["text"])
    counted = bm25.batch_postings(rows, keep=("folder",))
    got = sorted(map(tuple, counted.select("term", "chunk_id", "tf", "dl").collect()))
    assert got == sorted(map(tuple, bm25.build_postings(rows).collect())) and len(got) > 10
    assert {(r["chunk_id"], r["folder"]) for r in counted.collect()} == {(r["chunk_id"], "f" if r["chunk_id"] % 2 else None) for r in counted.collect()}


# ------------------------------------------------------------- usage

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, ts, user, kind, value, key):
    from datetime import datetime

    return (i, ts and datetime.fromisoformat(ts), user, kind, value, None if key is None else json.dumps({"k": key}))


FIRST = [
    event(1, "2024-01-30T10:00:00", 1, "view", 1.0, 5), event(2, "2024-01-30T23:59:59", 2, "view", 3.0, 5), event(3, "2024-01-30T11:00:00", 2, "click", 9.0, 5),
    event(4, "2024-01-31T00:00:00", 1, "view", 2.0, 6), event(5, None, 1, "view", 2.0, 6), event(6, "2024-01-31T01:00:00", 1, "view", 2.0, None), event(7, "2024-01-31T01:00:00", 1, "error", None, 7),
]
LATER = [event(8, "2024-01-31T05:00:00", 3, "click", 4.0, 8), event(9, "2024-02-01T05:00:00", 3, "view", 4.0, 5)]


def report(spark, out):
    return sorted((str(r["day"]), r["query"], r["searches"], r["avg_results"], r["clicks"], r["click_share"], r["day_searches"], r["day_share"], r["month"]) for r in usage_report.read(spark, str(out)).collect())


def test_usage_by_day(spark, tmp_path):
    log, out = tmp_path / "events", tmp_path / "out"
    put(spark, log, FIRST, EVENTS)
    usage_report.run(spark, str(log), str(out))
    first = [("2024-01-30", "key 5", 2, 1.5, 1, 0.5, 2, 1.0, "2024-01"), ("2024-01-31", "key 6", 1, 1.0, 0, 0.0, 1, 1.0, "2024-01")]
    assert report(spark, out) == first
    put(spark, log, LATER, EVENTS)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    usage_report.run(spark, str(log), str(out), since="2024-01-31")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    both = sorted([*first, ("2024-01-31", "key 8", 0, 0.0, 1, 0.0, 1, 0.0, "2024-01"), ("2024-02-01", "key 5", 1, 3.0, 0, 0.0, 1, 1.0, "2024-02")])
    assert report(spark, out) == both
    usage_report.run(spark, str(log), str(out), since="2024-01-30", until="2024-01-30")
    usage_report.run(spark, str(log), str(out))
    assert report(spark, out) == both
    months = {r["month"]: r for r in spark.read.parquet(str(out / "months")).collect()}
    january = next(m for k, m in months.items() if str(k).startswith("2024-01"))
    assert (january["n"], january["users"], january["low"], january["high"], january["total"], january["p50"]) == (7, 3, 1.0, 9.0, 21.0, 2.0)


def test_usage_of_an_empty_log(spark, tmp_path):
    put(spark, tmp_path / "events", [], EVENTS)
    usage_report.run(spark, str(tmp_path / "events"), str(tmp_path / "out"))
    assert report(spark, tmp_path / "out") == []


def test_rolled_up_days_are_as_good_as_the_log(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", usage_report.seconds("ts"))
    days = rollups.daily(log).cache()
    shares = (0.05, 0.5, 0.95)
    got = rollups.figures(rollups.merged(days), *shares).first()
    values = sorted(r["value"] for r in log.select("value").collect() if r["value"] is not None)
    users = log.select("user_id").distinct().count()
    assert got["n"] == log.count() and math.isclose(got["total"], sum(values)) and (got["low"], got["high"]) == (values[0], values[-1])
    assert abs(got["users"] - users) <= 0.05 * users + 1
    for share in shares:  # by rank, as values may repeat
        at = got[f"p{round(share * 100)}"]
        low, high = (sum(test(v) for v in values) / len(values) for test in (lambda v: v < at, lambda v: v <= at))
        assert low - 0.0133 <= share <= high + 0.0133


# ------------------------------------------------------------- command line and queries


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = registry.QUERIES[name](spark, sf_dir).toArrow()
    expected = con.execute(registry.ORACLES[name]).to_arrow_table()
    assert sorted(rows.column_names) == sorted(expected.column_names) and rows.num_rows
    con.register("got", rows)
    con.register("expected", expected)
    columns = ", ".join(f'"{c}"' for c in expected.column_names)
    for a, b in (("got", "expected"), ("expected", "got")):
        assert con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_command_line(sf_dir, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps(usage_report.load() | {"shares": [0.5]}))
    command = [sys.executable, "-m", "jobs.usage_report", "--events", f"{sf_dir}/events.parquet", "--out", str(tmp_path / "out"), "--config", str(config)]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows read" in done.stderr and "rows written" in done.stderr
    assert (tmp_path / "out/months/_SUCCESS").exists()
