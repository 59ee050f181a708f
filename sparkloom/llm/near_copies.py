"""SimHash near-duplicates at a wide radius: texts whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` or more.

Texts at 0.8 differ in 10 of 64 bits on average and seldom in more than ``RADIUS``; no
tables of bit blocks hold all pairs at such a distance. So the buckets are made of
min-hashes here, and what is near on the bit planes is checked on the sets.

1. A text's shingles of ``WIDTH`` words are hashed; texts with the same set are one node.
   A node has a fingerprint of 64 majority bits and a key for each of ``BANDS`` bands of
   ``ROWS`` min-hashes: two nodes at 0.8 share no key with a chance of about 1 in 4600.
2. Buckets with the same members count once. Each member is compared with its bucket's
   smallest node on the sets. This is linear in the members and joins up most of a
   large group.
3. Buckets whose members are still in several components are compared on bit planes by
   ``simhash_bitslice.near_at``, only across components: what the smallest node is joined
   to is never compared with itself. Pairs within ``RADIUS`` bits are checked on the sets,
   unless they have been joined meanwhile. Large buckets are dealt out as pairs of
   sub-blocks. A bucket yields a spanning forest, never its pairs.
4. Components as in ``simhash_bitslice``.

Words are separated by ASCII white space; A-Z count as a-z. A text of fewer words than a
shingle is one shingle; null and blank texts are copies of each other. Very long texts are
read whole; a set holds 32 bits a shingle, so a collision can change a similarity by one
shingle. Ids, null ids, repeated rows, empty tables and other columns are treated as in
``simhash_bitslice``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash_bitslice
from ._shared import column, small_batches, staged

WIDTH = 5
SIMILAR = 0.8
#: Bits of 64. By the angle between the sets a pair at 0.8 differs in 9.7 on average (standard deviation 2.9); sets of four and five in 12 (3.1).
RADIUS = 24
BANDS, ROWS = 16, 4
#: Nodes of a sub-block, and rows that are compared in one go (whole buckets only).
SPLIT = 1024
BATCH = 4096
_random = np.random.default_rng(42)
TURNS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + WIDTH])) for i in range(max(1, len(words) - WIDTH + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def node_of(hashes: np.ndarray) -> int:
    return simhash_bitslice._signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))


def keys_of(hashes: np.ndarray) -> list[int]:
    """One key a band; a text without words has none."""
    if not len(hashes):
        return []
    least = np.array([(((hashes ^ t) * f) ^ (hashes >> np.uint64(32))).min() for t, f in zip(TURNS, FACTORS)])
    return [simhash_bitslice._signed(xxhash.xxh3_64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]


def print_of(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return simhash_bitslice._signed(int(np.packbits(counts > len(hashes) / 2, bitorder="little").view("<u8")[0]))


SKETCH = T.StructType([T.StructField("fp", T.LongType()), T.StructField("print", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("members", T.BinaryType())])


@F.pandas_udf(SKETCH)
def sketch_column(text: pd.Series) -> pd.DataFrame:
    """Node, fingerprint, keys, and the sorted 32-bit hashes of the set."""
    sets = [shingles(t) for t in text]
    members = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets]
    return pd.DataFrame({"fp": [node_of(s) for s in sets], "print": [print_of(s) for s in sets], "keys": [keys_of(s) for s in sets], "members": members})


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``SIMILAR`` or more."""
    small, large = sorted((len(a), len(b)))
    if small < SIMILAR * large:
        return False
    joined = np.sort(np.concatenate([a, b]))
    both = int(np.count_nonzero(joined[1:] == joined[:-1]))
    return both >= SIMILAR * (small + large - both)


@F.pandas_udf(T.BooleanType())
def alike_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(a, b)], dtype=bool)


def bucket_links(nodes: np.ndarray, prints: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], group: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join up what isn't joined inside each run of equal ``group``; ``side`` as in ``simhash_bitslice.bucket_links``."""
    n = len(nodes)
    label = np.unique(comps, return_inverse=True)[1]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    planes = simhash_bitslice.bit_planes(prints)
    cuts = np.flatnonzero(np.diff(group)) + 1
    size = np.diff(np.concatenate([[0], cuts, [n]]))
    left = np.repeat(np.concatenate([cuts, [n]]), size) - np.arange(n)
    out = []
    for by in range(1, int(size.max(initial=0))):
        reach = np.zeros(n, bool)
        reach[: n - by] = (left[: n - by] > by) & (label[: n - by] != label[by:]) & ((side[: n - by] == 0) | (side[: n - by] != side[by:]))
        if not reach.any():
            continue
        live = np.packbits(np.pad(reach, (0, -n % 64)), bitorder="little").view(np.uint64)
        for i in simhash_bitslice._places(simhash_bitslice.near_at(planes, by, live, RADIUS)).tolist():
            a, b = root(label[i]), root(label[i + by])
            if a != b and alike(sets[i], sets[i + by]):
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[i + by])))
    return out


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets come sorted by (key, part) and may go on in the next batch; whole ones of like size are compared together."""
    runs: list[list[tuple]] = []
    held = 0

    def done(runs: list[list[tuple]]) -> pd.DataFrame:
        runs = sorted((r for r in runs if len(r) > 1), key=len)
        found, at = [], 0
        while at < len(runs):
            rows, group = [], []
            while at < len(runs) and (not rows or len(rows) + len(runs[at]) <= BATCH):
                group += [at] * len(runs[at])
                rows += runs[at]
                at += 1
            node, prints, comp, side, sets = zip(*rows)
            found += bucket_links(
                np.array(node, np.int64), np.array(prints, np.int64).view(np.uint64), np.array(comp, np.int64), [np.frombuffer(s, "<u4") for s in sets], np.array(group), np.array(side)
            )
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    last = None
    for frame in frames:
        for key, part, *row in zip(*(frame[c] for c in ("key", "part", "fp", "print", "comp", "side", "members"))):
            if (key, part) != last:
                if held >= 4 * BATCH:
                    yield done(runs)
                    runs, held = [], 0
                last = key, part
                runs.append([])
            runs[-1].append(tuple(row))
            held += 1
    yield done(runs)


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def buckets(distinct: DataFrame) -> DataFrame:
    """(key, fp, print, pivot, n): the members of every bucket of two or more, once for buckets with the same members."""
    rows = distinct.select("fp", "print", F.explode("keys").alias("key"))
    same = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("pivot"), *same).filter("n > 1")
    once = counted.groupBy("n", "pivot", "x0", "x1").agg(F.min("key").alias("key")).select("key", "pivot", "n")
    return staged(rows.join(staged(once, "keys"), "key").select("key", "fp", "print", "pivot", "n"), "buckets")


def pivot_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): members that are like their bucket's smallest node, which is sent to many tasks if it has many."""
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / F.lit(SPLIT))).alias("salt")
    pairs = members.filter("fp <> pivot").groupBy(F.col("pivot").alias("a"), F.col("fp").alias("b")).agg(F.max("n").alias("n"))
    pairs = staged(pairs.select("a", "b", salt), "pairs")
    first = pairs.select("a", "salt").distinct().join(sets.select(F.col("fp").alias("a"), F.col("members").alias("x")), "a")
    with_b = pairs.join(sets.select(F.col("fp").alias("b"), F.col("members").alias("y")), "b")
    return with_b.join(first, ["a", "salt"]).filter(alike_column("x", "y")).select("a", "b")


def other_links(members: DataFrame, joined: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): further links of buckets that ``joined`` (a, b) leaves in several components."""
    known = simhash_bitslice.components(joined)
    comp = F.coalesce("root", "fp").alias("comp")
    placed = staged(members.join(known, members["fp"] == known["node"], "left").select("key", "fp", "print", "pivot", comp), "placed")
    # the component of the smallest node is the bucket's main one
    main = F.min_by("comp", "fp")
    mixed = placed.groupBy("key").agg(main.alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("key", "main", "n")
    rows = staged(placed.join(staged(mixed, "mixed"), "key").withColumn("own", F.col("comp") == F.col("main")), "mixedrows")
    sizes = staged(rows.groupBy("key").agg(F.count_if("own").alias("n_main")), "sizes")
    n_main, n_rest = (F.ceil(c / F.lit(SPLIT)).cast("long") for c in (F.col("n_main"), F.col("n") - F.col("n_main")))
    sized = rows.join(sizes, "key").select("key", "fp", "print", "comp", "own", n_main.alias("nm"), (n_main + n_rest).alias("nb"))
    block = F.when(F.col("own"), F.pmod(F.xxhash64("fp"), "nm")).otherwise(F.col("nm") + F.pmod(F.xxhash64("fp"), F.col("nb") - F.col("nm")))
    # sub-blocks of the main component meet those of the rest; those of the rest meet all
    partner = F.explode(F.sequence(F.when(F.col("own"), F.col("nm")).otherwise(F.lit(0).cast("long")), F.col("nb") - 1))
    dealt = sized.select("*", block.alias("block")).select("*", partner.alias("other")).select(
        "key", "fp", "print", "comp",
        (F.least("block", "other") * F.col("nb") + F.greatest("block", "other")).alias("part"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    together = dealt.join(sets, "fp").repartition("key", "part").sortWithinPartitions("key", "part")
    return together.mapInPandas(_compare, PAIR)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join up every component. ``distinct`` has fp, print, keys and members."""
    members = buckets(distinct)
    sets = staged(distinct.select("fp", "members").join(members.select("fp").distinct(), "fp", "left_semi"), "sets")
    joined = staged(pivot_links(members, sets), "pivotlinks")
    return joined.unionAll(staged(other_links(members, joined, sets), "otherlinks"))


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    small_batches(docs.sparkSession)
    keyed = simhash_bitslice.keyed(docs, id_col, text_col, sketch_column(column(text_col)).alias("sketch"))
    prints = staged(keyed.select("doc_id", "text_hash", "sketch.*"), "sketches")
    # exact copies collapse in each task before anything is moved
    distinct = staged(simhash_bitslice.first_of_each(prints, *(F.any_value(c).alias(c) for c in ("print", "keys", "members"))), "nodes")
    return prints, simhash_bitslice.rooted(distinct, links(distinct))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; ``fp`` is the node."""
    return simhash_bitslice.grouped(*_nodes(docs, id_col, text_col))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, as in ``simhash_bitslice.representatives``."""
    return simhash_bitslice.first_rows(docs, *_nodes(docs, id_col, text_col), id_col, text_col)
