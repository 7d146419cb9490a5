"""Change streams: debounced sessions with coalesced changes, and alerts on unbroken failures. Each works on a batch as on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stateful

GAP = "5 seconds"


def debounce(events: DataFrame, gap: str = GAP, keys: tuple[str, ...] = (), watermark: str | None = None) -> DataFrame:
    """(keys, start, last, changed, deleted) of events (ts, path, kind): a session ends when its gap passes quietly.

    A path whose last event isn't its removal is changed; a path that was removed at any time is deleted, even if it came back. Events without
    a time or a path count for no path. On a stream a watermark is needed, and the state is one entry per path of an open session. On a table,
    events are first put together by path and stretches of the gap, in part before they are shuffled: however many a key has, only its
    stretches are put in order.
    """
    keys = tuple(keys)
    gap_us = int(events.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {gap})").first()[0])
    if events.isStreaming:
        return stateful.sessions(events.withWatermark("ts", watermark) if watermark else events, gap_us, keys)
    us, gone = F.unix_micros(F.col("ts").cast("timestamp")), F.coalesce(F.col("kind") == "unlink", F.lit(False))
    rows = events.where("ts is not null").select(*keys, us.alias("us"), "path", gone.alias("gone")).withColumn("stretch", F.floor(F.col("us") / gap_us))
    # Two events of one stretch are never further apart than the gap.
    each = rows.groupBy(*keys, "stretch", "path").agg(F.min("us").alias("start"), F.max(F.struct("us", "gone")).alias("end"), F.bool_or("gone").alias("ever"))
    each = each.groupBy(*keys, "stretch").agg(F.min("start").alias("start"), F.max("end.us").alias("last"), F.collect_list(F.struct("path", "end", "ever")).alias("paths"))
    order = Window.partitionBy(*keys).orderBy("stretch")
    new = F.coalesce(F.col("start") - F.lag("last").over(order) > gap_us, F.lit(True)).cast("int")
    each = each.withColumn("new", new).withColumn("session", F.sum("new").over(order))
    each = each.select(*keys, "session", "start", "last", F.explode("paths").alias("p")).groupBy(*keys, "session", "p.path").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.max("p.end").alias("end"), F.bool_or("p.ever").alias("ever")
    )
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("path"))))
    out = each.groupBy(*keys, "session").agg(F.min("start").alias("start"), F.max("last").alias("last"), named(~F.col("end.gone")).alias("changed"), named(F.col("ever")).alias("deleted"))
    return out.select(*keys, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "changed", "deleted")


def session_counts(events: DataFrame, gap: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    if watermark:
        events = events.withWatermark("ts", watermark)
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.select(*keys, F.col("w.start").alias("start"), "last", "n")


def _streak(threshold_s: float):
    """Per key: the first failure of the unbroken run so far; a row each time a failure finds it older than the threshold."""

    def run(key, frames, state):
        first, out = (state.get[0] if state.exists else None), []
        for frame in frames:
            for ts, ok in sorted(zip(frame["ts"], frame["ok"])):
                if ok:
                    first = None
                    continue
                first = ts.value if first is None else first
                if (ts.value - first) / 1e9 >= threshold_s:
                    out.append((*key, pd.Timestamp(first, unit="ns"), ts, (ts.value - first) / 1e9))
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((first,))
        yield pd.DataFrame(out, columns=["key", "start", "ts", "age_seconds"])

    return run


def streak_alerts(events: DataFrame, threshold_s: float) -> DataFrame:
    """(key, start, ts, age_seconds): on a stream of events (key, ts, ok), each failure that comes so long after the first of its unbroken run.

    The state is one instant per key with a failure under way; a success drops it. Events of a key count in the order of their batches.
    """
    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "ok")
    return rows.groupBy("key").applyInPandasWithState(_streak(threshold_s), f"key {kind}, start timestamp, ts timestamp, age_seconds double", "first long", "append", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str, per_batch=None):
    """Take all that a stream has now: into a memory table, or batch by batch into a function, one after the other."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(per_batch) if per_batch else w.format("memory").queryName(name)).start()
    q.awaitTermination()
    return q
