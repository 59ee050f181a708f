"""Content-addressed WARC archive.

``write`` makes a WARC record of every page and stores it in two tables: payload
bytes once per SHA-256, and the exact record headers with the digest they belong
to. ``read`` verifies every stored payload once (length, SHA-256, SHA-1) and puts the
original records together again by a join on the digest; a payload that isn't what its
record says stops the job. ``write_warc`` and ``read_warc`` exchange records with WARC
files, one gzip member a record; files of other makers are read too.

Among records whose payloads are equal and have ``SHARED`` bytes or more, the one
with the largest id is the response; the others are revisits that name it. A join
decides this on digests alone, so payload bytes are moved once, deflated. Payloads that
very many records share are joined apart from the others.

Defined results: a null html is an empty payload. A null url becomes an empty
target URI; a url with line ends is kept exactly in a field of its own, as JSON, with
the line ends escaped in the target URI. Rows with a null page_id are records without an
id: they are responses, never referred to. Rows with the same page_id are records of
their own; those with equal payloads as well that are the largest of their group are each
a response. Very long payloads are kept whole. An empty table gives an empty archive.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, join_counted, join_salted, small_batches, staged, staging_path, table

SHARED = 1000
DATE = "2024-01-31T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def header() -> Column:
    """The exact WARC header of a record: what comes before its block."""
    eol = F.lit("\r\n")
    is_revisit = F.col("record_type") == "revisit"

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, eol)

    return F.concat(
        F.lit("WARC/1.1"), eol,
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.when(F.col("url").rlike("[\r\n]"), line("X-Target", F.to_json(F.struct("url")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        eol,
    )


@F.pandas_udf(T.BinaryType())
def deflated(payload: pd.Series) -> pd.Series:
    return pd.Series([zlib.compress(p, 3) for p in payload], dtype=object)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """The archive of ``pages``: ``path``/payloads and ``path``/headers, both Parquet."""
    spark = small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(column(html_col), F.lit("")), "UTF-8")
    rows = pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).alias("url"), payload.alias("payload"))
    digested = rows.withColumns({"sha256": F.sha2("payload", 256), "payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})

    # bytes once per digest; equal ones of a task collapse before the shuffle
    once = digested.select("sha256", "payload_bytes", "payload_digest", "page_id", deflated("payload").alias("deflated"))
    (
        once.groupBy("sha256").agg(F.any_value("deflated").alias("deflated"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"), F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
        .write.parquet(f"{path}/payloads")
    )
    known = spark.read.parquet(f"{path}/payloads").select("sha256", "last_id", "n")
    responsible = F.col("page_id").isNull() | (F.col("payload_bytes") < SHARED) | (F.col("page_id") == F.col("last_id"))
    typed = join_counted(digested.drop("payload"), known, "sha256").withColumns(
        {"record_type": F.when(responsible, "response").otherwise("revisit"), "refers_to": F.when(~responsible, F.col("last_id"))}
    )
    typed.select("page_id", "sha256", header().alias("header")).write.parquet(f"{path}/headers")


RECORD = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())]
)


def parse_header(text: str) -> dict[str, str]:
    """The fields of a record's header by name in lower case; a line that begins with white space goes on with the one before."""
    first, *lines = text.split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields, name = {}, ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            fields[name := name.strip().lower()] = value.strip()
    return fields


def page_of(record_id: str | None) -> int | None:
    """The page's id in a record id of ours; none in any other."""
    number = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.isascii() and number.removeprefix("-").isdigit() else None


def _url(head: dict[str, str]) -> str:
    return json.loads(head["x-target"])["url"] if "x-target" in head else head.get("warc-target-uri", "")


def _row(head: dict[str, str]) -> tuple:
    length = head.get("x-payload-length")
    digest = head.get("warc-payload-digest")
    return (
        page_of(head.get("warc-record-id")), _url(head), int(length) if length else None,
        digest.removeprefix("sha1:") if digest else None, head.get("warc-type"), page_of(head.get("warc-refers-to")),
    )


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Columns of their own types: numbers with nulls don't pass through floats."""
    columns = dict(zip(names, zip(*rows))) if rows else {n: () for n in names}
    kinds = {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}
    return pd.DataFrame({n: pd.array(list(v), dtype=kinds.get(n, object)) for n, v in columns.items()})


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each stored payload is; one that isn't its SHA-256 stops the job."""
    for frame in frames:
        rows = []
        for sha256, packed, n in zip(frame["sha256"], frame["deflated"], frame["n"]):
            payload = zlib.decompress(packed)
            if hashlib.sha256(payload).hexdigest() != sha256:
                raise ValueError(f"the payload {sha256} is another one")
            rows.append((sha256, n, len(payload), hashlib.sha1(payload).hexdigest()))
        yield pd.DataFrame(rows, columns=["sha256", "n", "found_bytes", "found_digest"])


def _heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield _frame([(*_row(parse_header(text)), sha256) for text, sha256 in zip(frame["header"], frame["sha256"])], [*RECORD.names, "sha256"])


@F.pandas_udf(T.BinaryType())
def inflated(packed: pd.Series) -> pd.Series:
    return pd.Series([zlib.decompress(p) for p in packed], dtype=object)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The archive's records, put together and verified; ``payload`` only if asked for."""
    payloads = spark.read.parquet(f"{path}/payloads")
    found = staged(payloads.select("sha256", "deflated", "n").mapInPandas(_verify, "sha256 string, n long, found_bytes long, found_digest string"), "verified")
    heads = spark.read.parquet(f"{path}/headers").select("header", "sha256").mapInPandas(_heads, T.StructType([*RECORD.fields, T.StructField("sha256", T.StringType())]))
    joined = join_counted(heads, found, "sha256")
    right = (F.col("found_bytes") == F.col("payload_bytes")) & (F.col("found_digest") == F.col("payload_digest"))
    wrong = F.raise_error(F.concat(F.lit("not the payload that its record says: "), F.col("sha256"))).cast("string")
    rows = joined.withColumn("payload_digest", F.when(right, F.col("payload_digest")).otherwise(wrong))
    if not with_payload:
        return rows.select(*RECORD.names)
    spread = F.xxhash64("page_id", "url")
    return join_salted(rows.select(*RECORD.names, "sha256"), payloads.select("sha256", "n", "deflated"), "sha256", spread).select(*RECORD.names, inflated("deflated").alias("payload"))


#: A gzip member without content. It stands between the records' members, where Spark's text writer needs a line end.
NOTHING = bytes.fromhex("1f8b0800000000000003") + b"\x03\x00" + bytes(8)


def write_warc(spark: SparkSession, path: str, out: str, records_per_file: int = 10_000) -> None:
    """The archive as gzip WARC files of whole records, a member each; revisits have no block."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "n", "deflated")

    @F.pandas_udf(T.BinaryType())
    def member(text: pd.Series, packed: pd.Series) -> pd.Series:
        members = []
        for t, p in zip(text, packed):
            block = b"" if t.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n") else zlib.decompress(p)
            gzip = zlib.compressobj(6, wbits=31)
            members.append(gzip.compress(t.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + gzip.flush())
        return pd.Series(members, dtype=object)

    whole = join_salted(headers, payloads, "sha256", F.xxhash64("header")).select(member("header", "deflated").cast("string").alias("value"))
    whole.write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(out)
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):  # names only; Spark has no option for a file's ending here
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.split(".")[0] + ".warc.gz"))


class Records:
    """Records from the lines of one file, as they come: (header's fields, block)."""

    def __init__(self, file: str) -> None:
        self.file = file
        self.head: list[bytes] = []
        self.fields: dict[str, str] | None = None
        self.block: list[bytes] = []
        self.size = self.got = 0

    def take(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        if self.fields is None:
            if line.strip() or self.head:
                self.head.append(line)
            if not self.head or line.strip():
                return None
            self.fields = parse_header(b"\n".join(self.head).replace(b"\r\n", b"\n").replace(b"\n", b"\r\n").decode("utf-8", "surrogatepass").rstrip())
            self.head, self.size = [], int(self.fields.get("content-length", "0"))
        else:
            self.block.append(line)
            self.got += len(line) + 1
        if self.got < self.size:
            return None
        found = self.fields, (b"\n".join(self.block) + b"\n")[: self.size]
        self.fields, self.block, self.size, self.got = None, [], 0, 0
        return found

    def end(self) -> None:
        if self.fields is not None or self.head:
            raise ValueError(f"{self.file} ends inside a record")


READ = T.StructType([*RECORD.fields, T.StructField("record_id", T.StringType()), T.StructField("header", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())])


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    """The block, or what follows the header of an HTTP message in it."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block
    return block.partition(b"\r\n\r\n")[2]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the gzip WARC files at ``path``, ours or others': the fields of ``RECORD`` as far as they are
    there, ``record_id``, all fields as ``header`` (names in lower case), and ``payload``.

    A file is read as a stream, member after member, and a task holds one record at a time.
    A file that ends inside a record stops the job.
    """
    names = READ.names

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, rows, held = None, [], 0
        for frame in frames:
            for file, line in zip(frame["file"], frame["value"]):
                if records is None or records.file != file:
                    if records:
                        records.end()
                    records = Records(file)
                if found := records.take(line):
                    fields, block = found
                    rows.append((*_row(fields), fields.get("warc-record-id"), fields, _payload(fields, block)))
                    held += len(block)
                    if len(rows) == 1000 or held > 1 << 24:
                        yield _frame(rows, names)
                        rows, held = [], 0
        if records:
            records.end()
        if rows:
            yield _frame(rows, names)

    small_batches(spark)
    # gzip files are not split, so a task sees a file's lines in order
    lines = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInPandas(parse, READ)


def op3_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc_store": op3_warc_store}
ORACLES = {
    "op3_warc_store": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS strong FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY strong) AS last_id FROM d
), t AS (
  SELECT *, page_id IS NULL OR payload_bytes < 1000 OR page_id = last_id AS own FROM g
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT own THEN last_id END AS refers_to FROM t
"""
}
