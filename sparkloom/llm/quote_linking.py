"""Quotation linking: conversations in reply order, without quotes.

1. A line's quote level is the number of ``>`` that it begins with. Lines of one level
   up to a blank line or a change of level are a passage; its text is normalised
   (white space to single spaces, lower case) and hashed.
2. A quoted passage belongs to the last earlier message of its conversation that has
   the same passage of its own; if there is none, to the first message anywhere that
   has it (a link only, which doesn't order anything).
3. A message answers the message that its least deeply quoted passage comes from (of
   several the latest). Messages that answer none begin a thread. Threads come in
   order of their first turn, the messages of a thread in order of their turns, so
   each message stands after the one that it answers.
4. A message's text is its own lines, without quotes and the line that introduces one
   (a line that ends in "wrote:" before a line of a deeper level, at any level).

A text is split into lines once and its passages are found by a pass over the lines, so
the work is in proportion to its length.

Only DataFrame functions are used. Thread roots are found by pointer doubling over
the messages that have links. "Last earlier" and the position in the conversation
are worked out in two steps, within a bucket and over buckets, so that a conversation
that holds a large part of all messages isn't one task's.

Defined results: a null text has no passage and stays null; an empty one stays empty;
a very long one is parsed whole.
Text without quotes is left exactly as it is. Messages are told apart by (conv_id, turn):
rows that share both keep a row each, in order of role and text, and share their links.
A message with a null conv_id or turn links to nothing and is a conversation of its own,
at position 1. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import column, join_counted, shared_dir, staged, table

MARK = r"^(?:[ \t]*>)+"
QUOTED = r"(?m)^[ \t]*>"
#: A line that introduces a quote.
INTRODUCES = r"(wrote|écrit|escribió|schrieb)[ \t]*:[ \t\r]*$"
TURNS = 1024


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    """The lines as structs: level, content (without marks and white space around), own (the line as it is), intro (whether it says who wrote the quote after it)."""
    plain = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(F.regexp_replace(line, MARK, ""), r"^[ \t\r]+|[ \t\r]+$", "").alias("content"),
            line.alias("own"),
        ),
    )

    def told(lines: Column) -> Column:
        deeper = lambda x, i: F.coalesce(F.get(lines, i + 1)["level"] > x["level"], F.lit(False))
        return F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["content"].alias("content"), x["own"].alias("own"), (deeper(x, i) & x["content"].rlike(INTRODUCES)).alias("intro")))

    return _let(plain, told)


def _passages(lines: Column) -> Column:
    """Structs: level, and normalised text, of every passage."""
    # a line that is in no passage has no level here; get() is null outside the lines
    levels = F.transform(lines, lambda x: F.when((x["content"] != "") & ~x["intro"], x["level"]))

    def cut(level: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(level) - 1)
        edges = lambda step: F.filter(places, lambda i: F.get(level, i).isNotNull() & ~F.get(level, i).eqNullSafe(F.get(level, i + step)))
        return F.zip_with(edges(-1), edges(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.transform(
        _let(levels, cut),
        lambda x: F.struct(
            F.get(lines, x["a"])["level"].alias("level"),
            F.lower(F.trim(F.regexp_replace(F.array_join(F.transform(F.slice(lines, x["a"] + 1, x["b"] - x["a"] + 1), lambda y: y["content"]), " "), r"[ \t\r]+", " "))).alias("passage"),
        ),
    )


def _own_text(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: (x["level"] == 0) & ~x["intro"])
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["own"]), "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text without quotes, passages as structs of level and hash); a text's lines are read once."""
    said = F.col("said")
    base = messages.select(
        column(conv_col).cast("long").alias("conv_id"), column(turn_col).cast("long").alias("turn"), column(role_col).alias("role"), column(text_col).alias("said")
    )

    def taken_apart(lines: Column) -> Column:
        text = F.when(said.rlike(QUOTED), _own_text(lines)).otherwise(said)
        hashed = F.transform(_passages(lines), lambda x: F.struct(x["level"].alias("level"), F.unhex(F.sha2(x["passage"], 256)).alias("hash")))
        return F.struct(text.alias("text"), hashed.alias("passages"))

    return base.withColumn("parts", F.when(said.isNotNull(), _let(_lines(said), taken_apart))).select("conv_id", "turn", "role", "parts.text", "parts.passages")


def _last_earlier(quotes: DataFrame, owned: DataFrame) -> DataFrame:
    """``quotes`` (conv_id, turn, level, hash) with source_turn: the last turn below theirs in ``owned`` (conv_id, turn, hash)."""
    bucket = F.floor(F.col("turn") / TURNS).alias("bucket")
    wanted = quotes.select("conv_id", "hash").distinct()
    owned = staged(owned.join(wanted, ["conv_id", "hash"], "left_semi").distinct(), "owned")
    events = owned.select("conv_id", "hash", bucket, "turn", F.col("turn").alias("own"), F.lit(None).cast("int").alias("level")).unionAll(
        quotes.select("conv_id", "hash", bucket, "turn", F.lit(None).cast("long").alias("own"), "level")
    )
    key = ["conv_id", "hash"]
    inside = Window.partitionBy(*key, "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("own").over(inside)).filter("level IS NOT NULL")
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = events.groupBy(*key, "bucket").agg(F.max("own").alias("last")).withColumn("far", F.max("last").over(before)).select(*key, "bucket", "far")
    return near.join(far, [*key, "bucket"]).select(*key, "turn", "level", F.coalesce("near", "far").alias("source_turn"))


def passages_of(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash) of every passage of a message that has both ids."""
    rows = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode_outer("passages").alias("p"))
    return rows.select("conv_id", "turn", "p.level", "p.hash").filter("hash IS NOT NULL")


def link(passages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, source_conv, source_turn): quoted passages and where they come from (or null).

    Only owned passages that somebody quotes go on, one row per hash where the whole corpus is meant.
    """
    quotes = staged(passages.filter("level > 0").distinct(), "quotes")
    owned = passages.filter("level = 0").select("conv_id", "turn", "hash")
    within = staged(_last_earlier(quotes, owned), "within")
    missing = staged(within.filter("source_turn IS NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "missing")
    # a task adds up its own before anything is moved, so a common passage is one row a task
    first = owned.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    first = staged(missing.join(first, "hash", "left").select("hash", "n", F.col("first.conv_id").alias("first_conv"), F.col("first.turn").alias("first_turn")), "first")
    elsewhere = join_counted(within.filter("source_turn IS NULL"), first, "hash").drop("n")
    nothing = F.lit(None).cast("long")
    found = within.filter("source_turn IS NOT NULL").select("*", nothing.alias("first_conv"), nothing.alias("first_turn")).unionByName(elsewhere)
    inside = F.col("source_turn").isNotNull()
    self = (F.col("first_conv") == F.col("conv_id")) & (F.col("first_turn") == F.col("turn"))
    return found.select(
        "conv_id", "turn", "level", "hash",
        F.when(inside, F.col("conv_id")).when(~self, F.col("first_conv")).alias("source_conv"),
        F.when(inside, F.col("source_turn")).when(~self, F.col("first_turn")).alias("source_turn"),
    )


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, thread_turn, depth, n_quotes, n_linked) of every message that quotes."""
    shared_dir(links.sparkSession)
    inside = (F.col("source_conv") == F.col("conv_id")) & (F.col("source_turn") < F.col("turn"))
    best = F.min(F.when(inside, F.struct(F.col("level"), (-F.col("source_turn")).alias("back"))))
    messages = links.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("source_turn").alias("n_linked"), (-best["back"]).alias("parent_turn")
    ).checkpoint()
    reach = messages.filter("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        reach = reach.checkpoint()
        higher = reach.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = reach.join(higher, ["conv_id", "up"], "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            break
        reach = joined.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return messages.join(reach, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "parent_turn", F.coalesce("up", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", "n_linked"
    )


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, text, parent_turn, thread_turn, depth, n_quotes, n_linked): a row per message, ordered by position."""
    parsed = parse(messages, conv_col, turn_col, role_col, text_col)
    # hashes are stored, texts are not: they are parsed again where they are placed
    found = staged(threads(link(staged(passages_of(parsed), "passages"))), "threads")
    zero = F.lit(0).cast("long")
    rows = parsed.drop("passages").join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", zero).alias("depth"), F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
    )
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    order = ["thread_turn", "turn", "role", "text"]
    dealt = staged(rows.filter(~alone).repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(dealt.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    offsets = counts.select("part", "conv_id", F.coalesce(F.sum("n").over(before), zero).alias("offset"))
    placed = dealt.withColumn("here", F.row_number().over(inside)).join(offsets, ["part", "conv_id"]).withColumn("position", F.col("offset") + F.col("here"))
    names = ["conv_id", "position", "turn", "role", "text", "parent_turn", "thread_turn", "depth", "n_quotes", "n_linked"]
    return placed.select(*names).unionAll(rows.filter(alone).withColumn("position", F.lit(1).cast("long")).select(*names))


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_quote_linking": op1_quote_linking}
ORACLES = {
    "op1_quote_linking": r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations
), l0 AS (
  SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS own, unnest(range(len(string_split(text, chr(10))))) AS i FROM m
), l1 AS (
  SELECT *, length(regexp_replace(regexp_extract(own, '^(?:[ \t]*>)+', 0), '[^>]', '', 'g')) AS level,
    regexp_replace(regexp_replace(own, '^(?:[ \t]*>)+', ''), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS content FROM l0
), l2 AS (
  SELECT *, regexp_matches(content, '(wrote|écrit|escribió|schrieb)[ \t]*:[ \t\r]*$')
    AND coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i) > level, false) AS intro FROM l1
), l3 AS (
  SELECT *, content <> '' AND NOT intro AS speaks FROM l2
), l4 AS (
  SELECT *, speaks AND NOT coalesce(lag(speaks) OVER w AND lag(level) OVER w = level, false) AS opens FROM l3 WINDOW w AS (PARTITION BY rid ORDER BY i)
), l5 AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY rid ORDER BY i) AS g FROM l4
), p AS (
  SELECT DISTINCT conv_id, turn, level, sha256(lower(trim(regexp_replace(string_agg(content, ' ' ORDER BY i), '[ \t\r]+', ' ', 'g')))) AS hash
  FROM l5 WHERE speaks AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn, level, g
), q AS (
  SELECT q.conv_id, q.turn, q.level, q.hash, (SELECT max(o.turn) FROM p o WHERE o.level = 0 AND o.hash = q.hash AND o.conv_id = q.conv_id AND o.turn < q.turn) AS inside,
    (SELECT min(row(o.conv_id, o.turn)) FROM p o WHERE o.level = 0 AND o.hash = q.hash) AS anywhere
  FROM p q WHERE q.level > 0
), k AS (
  SELECT conv_id, turn, count(*) AS n_quotes,
    count(*) FILTER (inside IS NOT NULL OR (anywhere IS NOT NULL AND anywhere <> row(conv_id, turn))) AS n_linked,
    -(min(row(level, -inside)) FILTER (inside IS NOT NULL))[2] AS parent_turn
  FROM q GROUP BY conv_id, turn
), r AS (
  SELECT conv_id, turn, turn AS up, 0 AS depth FROM k
  UNION ALL SELECT r.conv_id, r.turn, k.parent_turn, depth + 1 FROM r JOIN k ON k.conv_id = r.conv_id AND k.turn = r.up WHERE k.parent_turn IS NOT NULL
), root AS (
  SELECT conv_id, turn, arg_max(up, depth) AS thread_turn, max(depth) AS depth FROM r GROUP BY conv_id, turn
), own AS (
  SELECT rid, regexp_replace(coalesce(string_agg(own, chr(10) ORDER BY i) FILTER (level = 0 AND NOT intro), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS stripped FROM l2 GROUP BY rid
), out AS (
  SELECT m.conv_id, m.turn, m.role, CASE WHEN regexp_matches(m.text, '(?m)^[ \t]*>') THEN stripped ELSE m.text END AS text, k.parent_turn,
    coalesce(root.thread_turn, m.turn) AS thread_turn, coalesce(root.depth, 0)::BIGINT AS depth, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked
  FROM m LEFT JOIN own USING (rid) LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
)
SELECT conv_id, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY thread_turn, turn, role NULLS FIRST, text NULLS FIRST) END::BIGINT AS position,
  turn, role, text, parent_turn::BIGINT AS parent_turn, thread_turn, depth, n_quotes, n_linked FROM out
"""
}
