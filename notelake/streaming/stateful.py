"""Stateful operators on streams, with timers by event time: coalesced change sessions, and failures that are overdue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_map_state(spark: SparkSession) -> None:
    """Maps and timers in a state need the store that keeps them outside the heap; it is set for this session's streams."""
    if "RocksDB" not in spark.conf.get(_STORE):
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(us: int) -> int:
    return -(-us // 1000)


class Sessions(StatefulProcessor):
    """Per key the open sessions, and of each the last event of every path: the state grows with paths, not with events.

    A session closes when the watermark passes its last event by the gap: an event that could still extend it would be late.
    """

    def __init__(self, gap_us: int, keys: tuple[str, ...]):
        self.gap, self.keys = gap_us, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "made long, ids array<long>, starts array<long>, lasts array<long>")
        self.paths = handle.getMapState("paths", "id long, path string", "ts long, gone boolean, ever boolean")

    def _open(self) -> tuple[int, dict[int, list[int]]]:
        if not self.open.exists():
            return 0, {}
        made, ids, starts, lasts = self.open.get()
        return made, {i: [a, z] for i, a, z in zip(ids, starts, lasts)}

    def _keep(self, made: int, sessions: dict[int, list[int]]) -> None:
        if sessions:
            self.open.update((made, list(sessions), [a for a, _ in sessions.values()], [z for _, z in sessions.values()]))
            self.handle.registerTimer(_ms(min(z for _, z in sessions.values()) + self.gap))
        else:
            self.open.clear()

    def _put(self, id: int, path, ts: int, gone: bool, ever: bool) -> None:
        held = self.paths.getValue((id, path)) if self.paths.exists() else None
        if held is not None:
            (ts, gone), ever = max((ts, gone), (held[0], held[1])), ever or held[2]
        self.paths.updateValue((id, path), (int(ts), bool(gone), bool(ever)))

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        frame = frame.sort_values(["us", "gone"])
        frame["run"] = (frame["us"].diff() > self.gap).cumsum()
        made, sessions = self._open()
        for _, run in frame.groupby("run"):
            first, last = int(run["us"].iloc[0]), int(run["us"].iloc[-1])
            met = [i for i, (a, z) in sessions.items() if a <= last + self.gap and z >= first - self.gap]
            if not met:
                made += 1
                met = [made]
                sessions[made] = [first, last]
            for other in met[1:]:  # what lay apart is one session now
                for (id, path), value in list(self.paths.iterator()):
                    if id == other:
                        self._put(met[0], path, *value)
                        self.paths.removeKey((id, path))
                first, last = min(first, sessions[other][0]), max(last, sessions[other][1])
                del sessions[other]
            sessions[met[0]] = [min(first, sessions[met[0]][0]), max(last, sessions[met[0]][1])]
            per_path = run.groupby("path", dropna=False, sort=False).agg(us=("us", "last"), gone=("gone", "last"), ever=("gone", "any"))
            for path, us, gone, ever in per_path.itertuples():
                self._put(met[0], path if isinstance(path, str) else None, us, gone, ever)
        self._keep(made, sessions)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        made, sessions = self._open()
        done = {i: s for i, s in sessions.items() if s[1] + self.gap <= now}
        if not done:
            return
        held: dict[int, list] = {i: [] for i in done}
        for (id, path), (_, gone, ever) in list(self.paths.iterator()):
            if id in done:
                held[id].append((path, gone, ever))
                self.paths.removeKey((id, path))
        self._keep(made, {i: s for i, s in sessions.items() if i not in done})
        out = []
        for i, (first, last) in done.items():
            named = sorted((p, g, e) for p, g, e in held[i] if p is not None)
            out.append((*key, first, last, [p for p, g, _ in named if not g], [p for p, _, e in named if e]))
        yield pd.DataFrame(out, columns=[*self.keys, "start", "last", "changed", "deleted"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap_us: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, start, last, changed, deleted) of a stream of events (keys, ts, path, kind) with a watermark on ts; see watch.debounce."""
    with_map_state(events.sparkSession)
    own = keys or ("one",)
    rows = events if keys else events.withColumn("one", F.lit(0))
    rows = rows.select(*own, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "path", F.coalesce(F.col("kind") == "unlink", F.lit(False)).alias("gone"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in own) + ", start long, last long, changed array<string>, deleted array<string>"
    out = rows.groupBy(*own).transformWithStateInPandas(Sessions(gap_us, own), schema, "append", "EventTime")
    return out.select(*keys, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "changed", "deleted")


class Overdue(StatefulProcessor):
    """Per key the start of the unbroken run of failures, and the events that the watermark hasn't passed, which may still come out of order.

    One timer a key, at the next event to take in or at the moment the run is overdue, so that silence is noticed too.
    """

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, told boolean, us array<long>, ok array<boolean>")

    def _held(self):
        if not self.run.exists():
            return None, False, []
        first, told, us, ok = self.run.get()
        return first, told, list(zip(us, ok))

    def _taken_in(self, key, first, told, waiting, now):
        """Take in what the watermark has passed, in order; then what is left waits for the next timer."""
        out = []

        def overdue_at(us):
            nonlocal told
            if first is not None and not told and us - first >= self.limit:
                out.append((*key, first, first + self.limit))
                told = True

        waiting = sorted(waiting)
        for us, ok in waiting:
            if us > now:
                break
            overdue_at(us)
            if ok:
                first, told = None, False
            elif first is None:
                first = us
        overdue_at(now)
        waiting = [w for w in waiting if w[0] > now]
        if first is None and not waiting:
            self.run.clear()
        else:
            self.run.update((first, told, [us for us, _ in waiting], [ok for _, ok in waiting]))
            next_ = [us for us, _ in waiting[:1]] + ([first + self.limit] if first is not None and not told else [])
            if next_:
                self.handle.registerTimer(max(_ms(min(next_)), now // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "ts"])

    def handleInputRows(self, key, rows, timerValues):
        first, told, waiting = self._held()
        for frame in rows:
            waiting += [(int(us), bool(ok)) for us, ok in zip(frame["us"], frame["ok"])]
        yield from self._taken_in(key, first, told, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        first, told, waiting = self._held()
        yield from self._taken_in(key, first, told, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def overdue(events: DataFrame, limit_s: float, watermark: str) -> DataFrame:
    """(key, start, ts): on a stream of events (key, ts, ok), each unbroken run of failures once, when it has lasted limit_s at ts by the
    watermark, whether or not its key says anything more. Events may come out of order within the watermark. Rows with a null are left out."""
    with_map_state(events.sparkSession)
    kind = events.schema["key"].dataType.simpleString()
    rows = events.where("key is not null and ts is not null and ok is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = rows.select("key", "ts", F.unix_micros("ts").alias("us"), "ok")
    out = rows.groupBy("key").transformWithStateInPandas(Overdue(int(limit_s * 1e6)), f"key {kind}, start long, ts long", "append", "EventTime")
    return out.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("ts").alias("ts"))
