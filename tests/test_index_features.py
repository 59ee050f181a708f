"""The stored index, cells in the engine, crash recovery, discovery, dumps and plugins."""

import io
import json
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom import __main__ as cli
from sparkloom.extensions import Registry
from sparkloom.functions import vectors as vx
from sparkloom.operators import bm25, collections, dense, embedder
from sparkloom.plans import stored
from sparkloom.plans.engine import Engine, SearchConfig
from sparkloom.sources import discovery, exports, parsers
from sparkloom.streaming import changes as stream


def files(spark, n, start=0):
    rows = [(f"/notes/f{i}.txt", f"heron number {i} nests by lock {i % 7}", 1.0, 40) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "path string, text string, modified_time double, size long")


def test_stored_index_is_built_once_and_anew_when_the_table_changes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 5} common text") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    index = stored.of(spark, path, "doc_id")
    assert stored.of(spark, path, "doc_id") is index
    plain = bm25.build_postings(docs, "doc_id")
    assert sorted(map(tuple, index.postings(spark).collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, index.term_stats(spark).collect())) == sorted(map(tuple, bm25.term_stats(plain).collect())) and index.stats == (50, 3.0)
    queries = spark.createDataFrame([(1, "word3 common"), (2, "common common text"), (3, "nothing")], "query_id long, query string")
    got = bm25.topk(index.postings(spark), queries, 5, index.stats, index.term_stats(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.topk(plain, queries, 5).collect()))
    docs.limit(10).write.mode("overwrite").parquet(path)
    assert stored.of(spark, path, "doc_id").stats[0] == 10


def test_engine_with_cells_gives_the_same_rows(spark, tmp_path):
    exact, celled = Engine(spark, str(tmp_path / "a")), Engine(spark, str(tmp_path / "b"), SearchConfig(cells_from=100))
    for engine in (exact, celled):
        engine.index(files(spark, 150), 2.0)
    assert exact.table("cells") is None and celled.table("cells").count() == 150 and celled.table("centres").count() == dense.n_cells(150)
    for query in ("heron 12", "lock nests"):
        a, b = (sorted(map(tuple, e.candidates(query, None, 20).collect())) for e in (exact, celled))
        assert a == b
    celled.remove(folder="/notes/f1.txt")
    assert celled.table("cells").count() == 149
    celled.remove(celled.table("documents").limit(100))
    assert celled.table("cells") is None


def test_interrupted_indexing_is_found_and_done_again(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path))
    engine.index(files(spark, 3), 2.0)

    def dies(*_):
        raise RuntimeError("the power went")

    monkeypatch.setattr(Engine, "_commit", dies)
    with pytest.raises(RuntimeError):
        engine.index(files(spark, 4, start=1).withColumn("modified_time", F.lit(5.0)).withColumn("text", F.concat("text", F.lit(" again"))), 6.0)
    monkeypatch.undo()
    states = engine.status()["states"]
    assert states == {"indexing": 4, "done": 1}
    assert cli.doctor(engine) == 1
    done = engine.index(files(spark, 4, start=1).withColumn("modified_time", F.lit(5.0)).withColumn("text", F.concat("text", F.lit(" again"))), 7.0)
    assert done["indexed"] == 4 and engine.status()["states"] == {"done": 5} and cli.doctor(engine) == 0
    assert engine.table("chunks").filter("text LIKE '%again'").count() == 4 and engine.table("chunks").count() == 5


def test_status_folders_and_context(spark, tmp_path):
    with Engine(spark, str(tmp_path)) as engine:
        engine.index(files(spark, 5), 2.0)
        status = engine.status()
        assert status["health"] == "healthy" and status["bytes"]["postings"] > 0 and 0 <= status["fragmentation"] < 1
        assert engine.folders() == [{"folder": "/notes", "files": 5, "bytes": 200}]
        engine.reindex(files(spark, 2), 3.0)
        assert engine.info() == {"documents": 5, "chunks": 5}
    assert not (tmp_path / "_work").exists() or not list((tmp_path / "_work").iterdir())


def test_distance_is_one_less_the_product(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    assert [tuple(r) for r in dense.nearest(rows, [1.0, 0.0], 3).collect()] == [(1, 0.0), (2, 0.4), (3, 1.0)]
    assert dense.strategy(10, 100) == "exact" and dense.strategy(100, 100) == "cells"


def test_vectors_linear_and_means(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    got = df.select("id", embedder.hash_embedding(F.col("text"), 64).alias("v")).collect()
    import hashlib

    for r in got:
        digest = hashlib.sha256((df.collect()[r["id"] - 1]["text"] or "").encode()).digest()
        raw = [(digest[j % 32] - 128) / 128 for j in range(64)]
        length = sum(x * x for x in raw) ** 0.5 + vx.TINY
        assert r["v"] == pytest.approx([x / length for x in raw], abs=1e-6)
    chunks = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (2, None)], "doc_id long, embedding array<float>")
    assert {r["doc_id"]: r["embedding"] for r in collections.document_vectors(chunks).collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}


def test_debounce_of_a_table_and_of_a_stream(spark, tmp_path):
    """Cells and the stream's state find the same bursts, at the border too and over a restart, and the last event of each path counts."""
    events = [
        ("/a/x", "created", 0, 1), ("/a/x", "modified", 1999, 2), ("/a/y", "created", 1500, 3), ("/a/y", "deleted", 1500, 4), ("/a/x", "deleted", 3999, 5),
        ("/a/z", "created", 5999, 6), ("/a/z", "modified", 20000, 7), ("/b/x", "created", 21999, 8), ("/b/x", "modified", 23999, 9), ("/b/w", "created", 26000, 10),
    ]
    schema = "path string, event_type string, ms long, seq long"
    timed = lambda df: df.selectExpr("path", "event_type", "timestamp_millis(ms + 1700000000123) AS ts", "seq")
    source, rows = tmp_path / "in", []
    source.mkdir()

    def run(n, some, late=0):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "event_type", "ms", "seq"), e))) for e in some))
        read = timed(spark.readStream.schema(schema).json(str(source))).withWatermark("ts", "40 seconds")
        keep = lambda df, _: rows.extend(map(tuple, df.collect()))
        query = stream.debounced(read).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(keep).start()
        query.processAllAvailable()
        query.stop()

    run(1, events[::2])
    run(2, events[1::2])
    run(3, [("/c/end", "created", 90000, 11)])
    run(4, [("/c/end", "created", 180000, 12), ("/a/x", "created", 1000, 13)])  # the last one is too late
    by_cells = timed(spark.createDataFrame(events, schema))
    expected = sorted(tuple(r) for r in stream.debounced(by_cells).collect())
    assert sorted(r for r in rows if r[0] != "/c") == expected and len(expected) >= 5


def test_a_bursts_state_holds_one_event_a_path():
    bursts = []
    for i in range(1000):
        bursts = stream.add_event(bursts, f"p{i % 3}", "modified", i * 10, i, 100)
    assert len(bursts) == 1 and bursts[0]["start"] == 0 and bursts[0]["last"] == 9990
    assert {p: e[1] for p, e in bursts[0]["events"].items()} == {"p0": 999, "p1": 997, "p2": 998}
    # one that comes late and lies between two bursts makes them one
    two = stream.add_event(stream.add_event([], "a", "created", 0, 0, 100), "b", "created", 150, 1, 100)
    assert len(two) == 2 and len(stream.add_event(two, "c", "created", 80, 2, 100)) == 1


def test_discovery_lists_by_type_and_reads_ignore_files(spark, tmp_path):
    for name in ("a.txt", "B.MD", "c.mp4", "node_modules/d.txt", "sub/e.py", "sub/skip.log", "sub/deep/f.txt", "keep.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    (tmp_path / ".gitignore").write_text("# notes\n/keep.log\n")
    (tmp_path / "sub" / ".gitignore").write_text("*.log\n/deep/\n")
    lines = discovery.ignore_lines(spark, str(tmp_path))
    rules = discovery.Discovery(ignore=lines)
    found = {r["path"].removeprefix(str(tmp_path) + "/") for r in discovery.discover(spark, str(tmp_path), rules).collect()}
    assert found == {"a.txt", "B.MD", "sub/e.py"}
    assert {r["reason"]: r["n"] for r in discovery.skipped(spark, str(tmp_path), rules).collect()} == {"path": 5}
    assert discovery.name_glob((".r", ".md")) == "*{.[mM][dD],.[rR]}"


def test_one_damaged_member_does_not_lose_the_archive():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("first.txt", "one " * 50)
        archive.writestr("second.txt", "two")
    content = bytearray(buffer.getvalue())
    at = content.index(b"one one")
    content[at : at + 3] = b"XXX"  # the checksum no longer fits
    text = parsers.parse(bytes(content), "x.zip")
    assert text is not None and "two" in text and "one" not in text


def test_vector_dump(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, -0.25]), (2, None)], "chunk_id long, embedding array<float>")
    exports.write_vectors(rows, str(tmp_path / "dump"))
    assert sorted(map(tuple, exports.read_vectors(spark, str(tmp_path / "dump")).collect())) == [(1, [0.5, -0.25]), (2, None)]


def test_process_embedder(tmp_path):
    program = tmp_path / "embed.py"
    program.write_text(
        "import json, sys\n"
        "for line in sys.stdin:\n"
        "    asked = json.loads(line)\n"
        "    if asked['cmd'] == 'shutdown': break\n"
        "    answer = {'ok': True} if asked['cmd'] == 'ping' else {'embeddings': [[float(len(t))] for t in asked['texts']]}\n"
        "    print(json.dumps(answer), flush=True)\n"
    )
    embed = embedder.ProcessEmbedder([sys.executable, str(program)])
    assert embed.ping() and embed(["ab", "abc"]) == [[2.0], [3.0]]
    embed.shutdown()


def test_plugins_of_a_folder(tmp_path):
    (tmp_path / "good.py").write_text("from sparkloom.extensions import Plugin\ndef plugin():\n    return Plugin(name='good')\n")
    (tmp_path / "bad.py").write_text("raise ValueError('no')\n")
    (tmp_path / "_private.py").write_text("raise ValueError('never read')\n")
    registry = Registry()
    assert registry.discover_folder(str(tmp_path)) == ["good"] and "no" in registry.failed["bad"]
    assert Registry().discover_folder(str(tmp_path), enabled=["other"]) == []


def test_command_line_status(spark, tmp_path, capsys):
    Engine(spark, str(tmp_path)).index(files(spark, 2), 2.0)
    assert cli.main(["status", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["states"] == {"done": 2}
    assert cli.main(["compact", str(tmp_path)]) == 0 and cli.main(["doctor", str(tmp_path)]) == 0


def test_paused_indexing_waits_and_deletes_go_on(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.index(files(spark, 2), 2.0)
    batch = spark.sql("SELECT * FROM VALUES ('/notes/f0.txt', 'deleted'), ('/notes/f9.txt', 'created') AS t(path, event_type)").withColumn("start", F.current_timestamp())
    asked = []

    def pause():
        asked.append(engine.table("documents").count())
        return len(asked) < 3

    stream.apply_batch(batch, engine, lambda paths: paths.selectExpr("path", "'new' AS text", "3.0D AS modified_time", "3L AS size"), 4.0, pause, wait=0.01)
    assert asked == [1, 1, 1]
    assert sorted(r["path"] for r in engine.table("documents").collect()) == ["/notes/f1.txt", "/notes/f9.txt"]


def test_stored_index_sees_files_in_nested_partitions(spark, tmp_path):
    from sparkloom.plans import stored

    path = str(tmp_path / "table")
    put = lambda rows: spark.createDataFrame(rows, "x int, y int, doc_id long, text string").write.mode("append").partitionBy("x", "y").parquet(path)
    put([(1, 2, 1, "red fish"), (1, 3, 2, "blue fish")])
    first = stored.of(spark, path, "doc_id")
    assert stored.of(spark, path, "doc_id") is first
    put([(1, 2, 3, "green heron")])
    assert {r["chunk_id"] for r in stored.of(spark, path, "doc_id").postings(spark).collect()} == {1, 2, 3}
