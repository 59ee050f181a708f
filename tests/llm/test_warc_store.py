import gzip
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import warc_store as m
from sparkloom.llm._shared import staging_path

BIG = "é" * 700
PAGES = [
    (1, "http://a.example/\r\nX: y", BIG), (2, "u", BIG), (9, "u2", BIG), (3, "v", "short"), (4, "v", "short"), (5, None, None), (6, "", ""),
    (None, "n", BIG), (7, "w", "x\r\n\r\nWARC/1.1\r\n" * 100), (8, "w", "x\r\n\r\nWARC/1.1\r\n" * 100), (9, "again", BIG), (10, "edge", "a" * 1000), (11, "edge", "a" * 1000), (12, "edge", "b" * 999), (13, "edge", "b" * 999), (2**62 + 1, "large", "c" * 2000), (2**62 + 2, "large", "c" * 2000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha256 string, payload int")


def test_same_as_sql(spark, oracle, same):
    path = staging_path(spark, "test")
    m.write(pages(spark), path)
    same(m.read(spark, path, False).drop("url"), oracle(m.ORACLES["op3_warc_store"], pages=pages(spark)))


def test_payloads_once_and_records_exact(spark):
    path = staging_path(spark, "test")
    m.write(pages(spark), path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({(h or "") for _, _, h in PAGES}) == stored.select("sha256").distinct().count()
    got = {(r["page_id"], r["url"]): bytes(r["payload"]) for r in m.read(spark, path).collect()}
    for page_id, url, html in PAGES:
        assert got[page_id, url or ""] == (html or "").encode()


def test_warc_files(spark):
    path = staging_path(spark, "test")
    m.write(pages(spark), path)
    m.write_warc(spark, path, f"{path}/warc", records_per_file=4)
    whole = {(r["page_id"], r["url"]): r for r in m.read(spark, path).collect()}
    read = m.read_warc(spark, f"{path}/warc").collect()
    assert len(read) == len(PAGES)
    for r in read:
        expected = whole[r["page_id"], r["url"]]
        assert bytes(r["payload"]) == (bytes(expected["payload"]) if r["record_type"] == "response" else b"")
        assert r["payload_digest"] == hashlib.sha1(bytes(expected["payload"])).hexdigest()
        assert r["refers_to"] == expected["refers_to"]
    content = b"".join(f.read_bytes() for f in sorted(pathlib.Path(f"{path}/warc".removeprefix("file:")).glob("*.gz")))
    assert gzip.decompress(content).count(b"WARC-Record-ID: ") == len(PAGES)  # the standard library reads the members too


def test_files_of_other_makers(spark, tmp_path):
    """A member a record, no fields of ours, other record types, HTTP messages, bytes that aren't text."""
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xff\x00\r\n\r\nWARC/1.0\r\nend\n"
    blocks = [("warcinfo", "application/warc-fields", b"software: x\r\n"), ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n"), ("response", "application/http; msgtype=response", page), ("resource", "image/png", bytes(range(256)) * 9), ("metadata", "text/plain", b"")]
    members = [
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:{i}>\r\nWARC-Target-URI: http://e.org/{i}\r\nContent-Type: {of}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        for i, (kind, of, block) in enumerate(blocks)
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(members[:2])))
    rows = m.read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 7 and all(r["page_id"] is None for r in rows)
    got = {r["url"]: bytes(r["payload"]) for r in rows}
    assert got["http://e.org/2"] == page.partition(b"\r\n\r\n")[2] and got["http://e.org/3"] == blocks[3][2] and got["http://e.org/1"] == b""
    assert {r["record_type"] for r in rows} == {kind for kind, _, _ in blocks} and rows[0]["header"]["content-type"]
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(members[3][:-200]))
    with pytest.raises(Exception, match="ends inside a record"):
        m.read_warc(spark, str(tmp_path)).collect()


def test_changed_payload_stops(spark):
    path = staging_path(spark, "test")
    m.write(pages(spark), path)
    changed = spark.read.parquet(f"{path}/payloads").withColumn("deflated", m.deflated(F.lit(b"something else")))
    changed.write.parquet(f"{path}/other")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/new/headers")
    spark.read.parquet(f"{path}/other").write.parquet(f"{path}/new/payloads")
    with pytest.raises(Exception, match="is another one"):
        m.read(spark, f"{path}/new").collect()


def test_shared_payload_and_very_long_one(spark):
    rows = [(i, f"u{i}", BIG if i % 3 else f"own {i}") for i in range(3000)] + [(3000, "long", "long " * 600_000)]
    path = staging_path(spark, "test")
    m.write(pages(spark, rows), path)
    got = {r["page_id"]: r for r in m.read(spark, path).collect()}
    assert len(got) == 3001 and all(bytes(got[i]["payload"]) == h.encode() for i, _, h in rows)
    assert [i for i, r in got.items() if r["record_type"] == "response" and i % 3 and i < 3000] == [2999]


def test_empty(spark):
    path = staging_path(spark, "test")
    m.write(pages(spark, []), path)
    assert m.read(spark, path).collect() == []
