"""SimHash near-duplicates compared on vertical bit planes.

1. ``fingerprints``: 64 bits per text; a bit is 1 if it is set in over half of
   the XXH64 hashes (seed 42) of the text's shingles.
2. Equal fingerprints collapse before anything is compared.
3. ``links``: a fingerprint is cut in five blocks. Two that differ in at most
   three bits agree in two blocks at least, so each of the ten pairs of blocks
   is a table whose buckets hold every pair of interest. Within a bucket the
   fingerprints lie as 64 bit planes; for each offset *s* the planes are XORed
   with themselves moved by *s* places, and two carry-save counters add up the
   distances of all rows to their *s*-th neighbour at once. A block of offsets is
   abandoned as soon as every counter has passed the radius.
   A bucket yields a spanning forest of its links, never all its pairs.
   Buckets larger than ``SPLIT`` are dealt out as pairs of sub-blocks, so that
   no task compares more than ``2 * SPLIT`` fingerprints with each other.
4. ``components``: alternating large-star and small-star steps over the links
   of distinct fingerprints, each cut off by a checkpoint in the shared folder.

Defined results: a null or blank text has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle. Ties at exactly half
give 0. Rows with the same doc_id stay rows of their own; a null doc_id is kept
and is never a component's id unless the component has no other (then null).
Very long texts are read whole, their hashes in pieces of fixed size. An empty table
gives an empty result. Other columns are ignored by ``assign`` and kept by
``representatives``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import column, fresh, shared_dir, small_batches, staged, table

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Bits of the five blocks, highest first.
BLOCKS = (13, 13, 13, 13, 12)
SPLIT = 2048


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # lower-cases A-Z only
    words = raw.split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    half = len(hashes) / 2
    counts = np.zeros(64, np.int64)
    all_hashes = np.array(hashes, dtype="<u8")
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(all_hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts > half, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def fingerprint_column(text: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(t)) for t in text], dtype="int64")


# ---------------------------------------------------------------- bit slices


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of 64-bit words: bit i of row b is bit b of value i."""
    n = -len(values) % 64
    padded = np.concatenate([values, np.zeros(n, np.uint64)]) if n else values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def moved(planes: np.ndarray, by: int) -> np.ndarray:
    """The planes with place i holding what was at i + by; zeros come in at the end."""
    words, bits = divmod(by, 64)
    kept = planes[:, words:]
    if not bits:
        return kept
    out = kept >> np.uint64(bits)
    out[:, :-1] |= kept[:, 1:] << np.uint64(64 - bits)
    return out


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Words whose bit is set where the number in the counter's planes (lowest first) is over ``radius``."""
    over, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            over |= equal & counter[k]
            equal &= ~counter[k]
    return over


def near_at(planes: np.ndarray, by: int, live: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Words whose bit i is set where value i and value i + by differ in at most ``radius`` (under 64) bits.

    Carry-save counters: level k is a plane of weight 2**k; a full adder takes two
    inputs at a time into it and hands a carry to the next level. A carry out of the
    last level, or a count over the radius, strikes a place off ``live`` for good, and
    once none is live the remaining planes are not looked at.
    """
    other = moved(planes, by)
    width = other.shape[1]
    live = live[:width].copy()
    levels = max(1, radius.bit_length())
    counter = [np.zeros(width, np.uint64) for _ in range(levels)]
    waiting: list[np.ndarray | None] = [None] * levels
    for b in range(64):
        carry = planes[b, :width] ^ other[b]
        for k in range(levels):
            if (x := waiting[k]) is None:
                waiting[k] = carry
                break
            waiting[k] = None
            half = counter[k] ^ x
            carry, counter[k] = (counter[k] & x) | (half & carry), half ^ carry
        else:
            live &= ~carry
        if b % 8 == 7 and b >= radius:
            if radius + 1 < 1 << levels:
                live &= ~_over(counter, radius)
            if not live.any():
                break
    return live


def _places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def bucket_links(values: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal ``group``.

    ``side`` is 0 throughout, or 1 and 2 for the halves of a pair of sub-blocks, of
    which only links across count. Values of a run are distinct.
    """
    n = len(values)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    planes = bit_planes(values)
    cuts = np.flatnonzero(np.diff(group)) + 1
    size = np.diff(np.concatenate([[0], cuts, [n]]))
    left = np.repeat(np.concatenate([cuts, [n]]), size) - np.arange(n)  # rows of the run from this one on
    out_a, out_b = [], []
    for by in range(1, int(size.max(initial=0))):
        reach = left > by
        if not reach.any():
            break
        live = np.packbits(np.pad(reach, (0, -n % 64)), bitorder="little").view(np.uint64)
        for i in _places(near_at(planes, by, live)):
            j = i + by
            if side[i] and side[i] == side[j]:
                continue
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out_a.append(values[i])
                out_b.append(values[j])
    return np.array(out_a, np.uint64).view(np.int64), np.array(out_b, np.uint64).view(np.int64)


#: Rows that are compared in one go; whole buckets only.
BATCH = 4096


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets come sorted by (key, part); a run may go on in the next batch."""
    rest: pd.DataFrame | None = None

    def done(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        change = (df["key"].to_numpy()[1:] != df["key"].to_numpy()[:-1]) | (df["part"].to_numpy()[1:] != df["part"].to_numpy()[:-1])
        group = np.concatenate([[0], np.cumsum(change)]) if len(df) else np.zeros(0, np.int64)
        values, side = df["fp"].to_numpy().view(np.uint64), df["side"].to_numpy()
        sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        # runs of like size go together, so that short runs don't wait for long ones
        order = np.argsort(sizes[group], kind="stable")
        order = order[sizes[group][order] > 1]
        values, side, group = values[order], side[order], group[order]
        at = 0
        while at < len(values):
            end = min(at + BATCH, len(values))
            while end < len(values) and group[end] == group[end - 1]:
                end += 1
            a, b = bucket_links(values[at:end], group[at:end], side[at:end])
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})
            at = end

    for frame in frames:
        if rest is not None and len(rest):
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame.iloc[-1]
        open_run = (frame["key"] == last["key"]) & (frame["part"] == last["part"])
        rest = frame[open_run]
        yield from done(frame[~open_run])
    if rest is not None and len(rest):
        yield from done(rest)


# ---------------------------------------------------------------- distributed steps


def _block_values(fp):
    at, out = 64, []
    for width in BLOCKS:
        at -= width
        out.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return out


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links of the distinct fingerprints ``fp`` that join up every component of near ones."""
    blocks = _block_values(F.col("fp"))
    keys = [
        F.lit(t).cast("long") * (1 << 26) + blocks[i] * (1 << 13) + blocks[j]
        for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # most buckets hold one fingerprint; those and the sizes of the rest
    sizes = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "buckets")
    sized = rows.join(sizes, "key")
    n_blocks = F.ceil(F.col("n") / F.lit(SPLIT))
    block = F.pmod(F.xxhash64("fp"), n_blocks)
    # a sub-block meets itself and each other one: part numbers a pair, side tells the halves apart
    partner = F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))
    dealt = (
        sized.select("fp", "key", n_blocks.alias("nb"), block.alias("block"), partner.alias("other"))
        .select(
            "fp", "key",
            (F.least("block", "other") * F.col("nb") + F.greatest("block", "other")).alias("part"),
            F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        )
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "fp")
    )
    return dealt.mapInPandas(_compare, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Large-star then small-star until the edges stay the same; each holds at most as
    many edges as there were. Rounds grow with the logarithm of the longest path.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct().checkpoint()
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).checkpoint()
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = large.checkpoint()
        # small-star: each node's smaller neighbours meet at the smallest of them
        small_low = large.groupBy("b").agg(F.min("a").alias("m")).checkpoint()
        joined = large.join(small_low, "b")
        edges = (
            joined.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .filter("a < b").unionAll(small_low.select(F.col("m").alias("a"), "b")).distinct().checkpoint()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(doc_id, text_hash, more): what tells the rows of ``docs`` apart."""
    return docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("text_hash"), *more)


def first_of_each(prints: DataFrame, *more) -> DataFrame:
    """One row per ``fp`` of ``prints``: ``first``, its row with the smallest id (nulls last), then text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash"))).alias("first")
    return prints.groupBy("fp").agg(first, *more)


def rooted(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, first, root) for every row of ``distinct`` (fp, first)."""
    roots = components(edges)
    found = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return staged(found, "rooted")


def grouped(prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``prints``."""
    smallest = staged(rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id")), "smallest")
    by_print = staged(rooted.join(smallest, "root").select("fp", "component_id"), "byprint")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def first_rows(docs: DataFrame, prints: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each root: the one with the smallest id (nulls last), then the smallest hash of its text."""
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    names = [fresh("keep_id", docs.columns), fresh("keep_text", docs.columns)]
    keep = staged(kept.toDF(*names), "kept")
    on = column(id_col).eqNullSafe(keep[names[0]]) & (F.xxhash64(column(text_col)) == keep[names[1]])
    rows = docs.join(keep, on, "left_semi")
    repeated = prints.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return rows
    # rows that share id and text: one of them
    h = fresh("text_hash", docs.columns)
    return rows.withColumn(h, F.xxhash64(column(text_col))).dropDuplicates([id_col, h]).drop(h)


def _prints(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    small_batches(docs.sparkSession)
    prints = staged(keyed(docs, id_col, text_col, fingerprint_column(column(text_col)).alias("fp")), "prints")
    distinct = staged(first_of_each(prints), "distinct")
    return prints, rooted(distinct, links(distinct))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return grouped(*_prints(docs, id_col, text_col))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate component of ``docs``, all its columns kept.

    It is the row with the smallest id, of rows that share it the one with the smallest
    hash of its text, so the choice doesn't depend on the order of the rows. A null id
    comes after all others. Of rows that share id and text any one stays.
    """
    return first_rows(docs, *_prints(docs, id_col, text_col), id_col, text_col)


def op10_simhash_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_bitslice": op10_simhash_bitslice}
ORACLES: dict[str, str] = {}
