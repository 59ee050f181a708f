"""File changes as a stream: debounced, then applied batch by batch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..schemas import EVENTS
from ..sources.discovery import Discovery, wanted_path

CREATED, MODIFIED, DELETED = "created", "modified", "deleted"


def moves_as_pairs(events: DataFrame) -> DataFrame:
    """Events (path, new_path, event_type, ts): a move becomes the old path's deletion and the new one's creation."""
    pair = F.array(
        F.struct(F.col("path").alias("path"), F.lit(DELETED).alias("event_type")), F.struct(F.col("new_path").alias("path"), F.lit(CREATED).alias("event_type"))
    )
    same = F.array(F.struct(F.col("path").alias("path"), F.col("event_type").alias("event_type")))
    return events.select("ts", F.explode(F.when(F.col("event_type") == "moved", pair).otherwise(same)).alias("e")).select("e.path", "e.event_type", "ts")


def watched(events: DataFrame, rules: Discovery = Discovery()) -> DataFrame:
    return events.filter(wanted_path(F.col("path"), rules))


def debounced(events: DataFrame, gap: str = "2 seconds", root_col: str | None = None) -> DataFrame:
    """(root, start, end, path, event_type): the last event of each path in a burst; a burst ends after a quiet ``gap``.

    A burst is that of one watched root, as any event there puts the flush off. Over a table,
    events are first summed up in cells as wide as the gap, all of whose events are in one
    burst; borders are found between cells, and each path's last event by a plain aggregate,
    so that no row holds a burst. In a stream a root's state holds its open bursts, the last
    event of each path in them, and a timer; the watermark says when a burst is over.
    """
    root = F.col(root_col) if root_col else F.regexp_extract("path", "^(/?[^/]*)", 1)
    if "seq" not in events.columns:
        events = events.withColumn("seq", F.lit(0))
    events = events.withColumn("root", root)
    if events.isStreaming:
        return _bursts(events, gap)
    events = events.filter(F.col("ts").isNotNull()).withColumn("cell", F.window("ts", gap)["start"])
    cells = events.groupBy("root", "cell").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    order = Window.partitionBy("root").orderBy("cell")
    quiet = F.col("first") > F.lag("last").over(order) + F.expr(f"INTERVAL '{gap}'")
    opens = F.when(F.coalesce(quiet, F.lit(True)), F.col("first"))
    bursts = cells.withColumn("start", F.last(opens, ignorenulls=True).over(order))
    ends = bursts.groupBy("root", "start").agg((F.max("last") + F.expr(f"INTERVAL '{gap}'")).alias("end"))
    placed = events.join(bursts.select(F.col("root").alias("r"), F.col("cell").alias("c"), "start"), F.col("root").eqNullSafe(F.col("r")) & (F.col("cell") == F.col("c")))
    last = F.max_by("event_type", F.struct("ts", "seq", "event_type")).alias("event_type")
    found = placed.groupBy("root", "start", "path").agg(last)
    ends = ends.select(F.col("root").alias("r"), F.col("start").alias("s"), "end")
    return found.join(ends, F.col("root").eqNullSafe(F.col("r")) & (F.col("start") == F.col("s"))).select("root", "start", "end", "path", "event_type")


def add_event(bursts: list[dict], path: str, event_type: str, ts: int, seq: int, gap: int) -> list[dict]:
    """Open bursts of a root with one event more; those that it joins become one. Of a path only the last event is kept."""
    joined = {"start": ts, "last": ts, "events": {path: [ts, seq, event_type]}}
    apart = []
    for burst in bursts:
        if burst["start"] > ts + gap or ts > burst["last"] + gap:
            apart.append(burst)
            continue
        joined["start"], joined["last"] = min(joined["start"], burst["start"]), max(joined["last"], burst["last"])
        for other, event in burst["events"].items():
            joined["events"][other] = max(event, joined["events"].get(other, event))
    return [*apart, joined]


def _bursts(events: DataFrame, gap: str) -> DataFrame:
    """Bursts of a stream. The state of a root is its open bursts, each with the last event of every path, and a timer at the
    first one's end: a path's size there doesn't grow with its events."""
    import pandas as pd

    width = int(pd.Timedelta(gap).total_seconds() * 1e6)

    def follow(key, frames, state):
        watermark = state.getCurrentWatermarkMs() * 1000
        bursts = json.loads(state.get[0]) if state.exists else []
        for frame in frames:
            for path, event_type, ts, seq in zip(frame["path"], frame["event_type"], frame["us"], frame["seq"]):
                if ts + width > watermark:  # a later event's burst has been given out already
                    bursts = add_event(bursts, path, event_type, int(ts), int(seq), width)
        over = [b for b in bursts if b["last"] + width <= watermark]
        bursts = [b for b in bursts if b["last"] + width > watermark]
        if bursts:
            state.update((json.dumps(bursts),))
            state.setTimeoutTimestamp(min(b["last"] for b in bursts) // 1000 + width // 1000 + 1)
        elif state.exists:
            state.remove()
        rows = [(key[0], b["start"], b["last"] + width, path, event[2]) for b in over for path, event in b["events"].items()]
        yield pd.DataFrame(rows, columns=["root", "start", "end", "path", "event_type"])

    timed = events.filter(F.col("ts").isNotNull() & F.col("path").isNotNull()).select("root", "path", "event_type", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"))
    out = "root string, start long, end long, path string, event_type string"
    found = timed.groupBy("root").applyInPandasWithState(follow, out, "bursts string", "append", "EventTimeTimeout")
    return found.select("root", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "path", "event_type")


def tumbling_last(events: DataFrame, width: str = "2 seconds") -> DataFrame:
    """The other policy: fixed windows, each path's last event in each."""
    return events.groupBy(F.window("ts", width).alias("w"), "path").agg(F.max_by("event_type", "ts").alias("event_type")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "path", "event_type")


def event_stream(spark: SparkSession, directory: str, delay: str = "10 seconds", most_files: int | None = None) -> DataFrame:
    """Events from JSON files that appear in a folder, ``most_files`` of them a batch at most."""
    reader = spark.readStream.schema(EVENTS)
    if most_files is not None:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.json(directory).withWatermark("ts", delay)


def apply_stream(
    events: DataFrame, engine, read: Callable[[DataFrame], DataFrame], checkpoint: str, now: Callable[[], float], gap: str = "2 seconds", root_col: str | None = None,
    throttle: str = "0 seconds", pause: Callable[[], bool] | None = None,
) -> StreamingQuery:
    """Debounced events applied to an engine: deleted files go, created and modified ones are read by ``read`` (path -> files) and indexed.

    Batches begin ``throttle`` apart at least; ``pause`` is as for ``apply_batch``.
    """
    stream = debounced(events, gap, root_col).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=throttle)
    return stream.foreachBatch(lambda df, _: apply_batch(df, engine, read, now(), pause)).start()


def apply_batch(batch: DataFrame, engine, read: Callable[[DataFrame], DataFrame], now: float, pause: Callable[[], bool] | None = None, wait: float = 0.5) -> None:
    """One batch; a path's latest burst counts. Doing it twice changes nothing, so a batch may be repeated after a failure.

    Deletions are applied at once. While ``pause()`` says so (when memory is short, say)
    indexing waits, and with it the stream: the batch isn't done, so nothing of it is lost.
    """
    last = batch.groupBy("path").agg(F.max_by("event_type", "start").alias("event_type")).persist()
    try:
        gone, new = last.filter(F.col("event_type") == DELETED), last.filter(F.col("event_type") != DELETED)
        if engine.table("documents") is not None and not gone.isEmpty():
            engine.remove(gone)
        if not new.isEmpty():
            while pause is not None and pause():
                time.sleep(wait)
            engine.index(read(new.select("path")), now)
    finally:
        last.unpersist()


def new_texts(texts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of texts (text, ts), each digest once within the delay: the state is bounded by it."""
    return texts.withColumn("digest", F.sha2("text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["digest"])
