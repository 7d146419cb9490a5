"""Streams against batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from notelake.functions import schedule
from notelake.operators import sync
from notelake.streaming import stateful, watch

AT = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def stream(spark, folder, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_debounce(spark, tmp_path):
    schema = "ts timestamp, path string, kind string"
    events = [(AT(0), "a", "change"), (AT(3), "b", "change"), (AT(8), "a", "unlink"), (AT(9), "b", "unlink"), (AT(10), "b", "add"), (AT(30), "c", "add")]
    want = {(AT(0), AT(10), ("b",), ("a", "b")), (AT(30), AT(30), ("c",), ())}
    seen = lambda df: {(r["start"], r["last"], tuple(r["changed"]), tuple(r["deleted"])) for r in df.collect()}
    assert seen(watch.debounce(spark.createDataFrame(events, schema))) == want
    source = stream(spark, tmp_path, schema, events[:3], events[3:], [(AT(10_000), "end", "add")])  # the last one closes the sessions before it
    watch.run_once(watch.debounce(source, watermark="1 second"), "sessions", "append", f"{tmp_path}/check")
    assert seen(spark.table("sessions").where("start < '2026-01-01 01:00:00'")) == want


def test_debounce_out_of_order_with_keys(spark, tmp_path):
    """Sessions that late events join to one; the stream's rows are the table's, and those of sorting all events."""
    schema = "who string, ts timestamp, path string, kind string"
    batches = [
        [("x", AT(0), "a", "add"), ("x", AT(9), "b", "add"), ("y", AT(1), "a", "unlink"), ("x", AT(0), "n", None)],
        [("x", AT(5), "a", "unlink"), ("x", AT(14), "c", "change"), ("y", AT(1), "a", "add")],  # 0..14 is one session of x, its middle came late
        [("x", AT(40), "a", "add"), ("y", AT(39), None, "unlink"), ("x", AT(36), "z", "unlink"), ("x", AT(36), "z", "add")],
        [("x", AT(90_000), "e", "add"), ("y", AT(90_000), "e", "add")],
    ]
    rows = lambda df: sorted((r["who"], r["start"], r["last"], tuple(r["changed"]), tuple(r["deleted"])) for r in df.collect())
    want = [
        ("x", AT(0), AT(14), ("b", "c", "n"), ("a",)), ("x", AT(36), AT(40), ("a",), ("z",)), ("x", AT(90_000), AT(90_000), ("e",), ()), ("y", AT(1), AT(1), (), ("a",)),
        ("y", AT(39), AT(39), (), ()), ("y", AT(90_000), AT(90_000), ("e",), ()),
    ]
    assert rows(watch.debounce(spark.createDataFrame(sum(batches, []), schema), keys=("who",))) == want
    source = stream(spark, tmp_path, schema, *batches)
    watch.run_once(watch.debounce(source, keys=("who",), watermark="60 seconds"), "joined", "append", f"{tmp_path}/check")
    assert rows(spark.table("joined")) == [r for r in want if r[1] < AT(80_000)]  # the last ones are still open


def test_debounce_state_is_of_paths(spark, tmp_path):
    """Many events on few paths: the state has a row per path, and the rows are the table's."""
    events = spark.range(1_000_000).select((F.lit(AT(0)) + F.make_dt_interval(secs=F.col("id") / 1000)).alias("ts"), F.concat(F.lit("p"), F.col("id") % 10).alias("path"), F.when(F.col("id") % 77 == 3, "unlink").otherwise("add").alias("kind"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in/b0")
    spark.createDataFrame([(AT(100_000), "end", "add")], events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b1")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = watch.run_once(watch.debounce(source, watermark="1 second"), "many", "append", f"{tmp_path}/check")
    assert 10 <= max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 60
    rows = lambda df: [(r["start"], r["last"], r["changed"], r["deleted"]) for r in df.collect()]
    assert rows(spark.table("many")) == rows(watch.debounce(events)) and len(rows(spark.table("many"))) == 1


def test_overdue(spark, tmp_path):
    """A key that falls silent while it fails is told of; so is one whose success comes too late; events out of order are put in order."""
    schema = "key string, ts timestamp, ok boolean"
    batches = [
        [("quiet", AT(0), False), ("late", AT(0), False), ("fine", AT(0), False), ("odd", AT(50), True), (None, AT(0), False)],
        [("late", AT(130), True), ("fine", AT(99), True), ("odd", AT(20), False), ("odd", AT(60), False), ("late", AT(140), False)],
        [("other", AT(700), True)],
        [("other", AT(1100), False)],
    ]
    want = {("quiet", AT(0), AT(100)), ("late", AT(0), AT(100)), ("late", AT(140), AT(240)), ("odd", AT(60), AT(160))}
    source = stream(spark, tmp_path, schema, *batches)
    watch.run_once(stateful.overdue(source, 100, "200 seconds"), "overdue", "append", f"{tmp_path}/check")
    got = spark.table("overdue").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    table = spark.createDataFrame(sum(batches, []), schema).where("key is not null").withColumn("seq", F.lit(0))
    assert {tuple(r) for r in sync.overdue(table, 100, F.lit(AT(900))).collect()} == want
    assert {(r["key"], r["start"]) for r in sync.streaks(table).collect()} >= {(k, s) for k, s, _ in want}


def test_streak_alerts(spark, tmp_path):
    schema = "key string, ts timestamp, ok boolean"
    first = [("a", AT(0), False), ("a", AT(50), False), ("b", AT(0), False), ("b", AT(10), True)]
    second = [("a", AT(100), False), ("b", AT(200), False), ("b", AT(250), False)]
    source = stream(spark, tmp_path, schema, first, second)
    watch.run_once(watch.streak_alerts(source, 100), "alerts", "append", f"{tmp_path}/check")
    assert [tuple(r) for r in spark.table("alerts").collect()] == [("a", AT(0), AT(100), 100.0)]


def test_batches_in_order(spark, tmp_path):
    done = []
    source = stream(spark, tmp_path, "n long", [(1,)], [(2,)], [(3,)])
    watch.run_once(source, "", "append", f"{tmp_path}/check", lambda df, i: done.append((i, df.agg(F.count("*")).first()[0])))
    assert [i for i, _ in done] == sorted(i for i, _ in done) and sum(n for _, n in done) == 3


def test_schedule(spark):
    ask = lambda e, *at: schedule.next_tick(e, datetime.datetime(*at))
    assert ask("*/15 * * * *", 2026, 1, 1, 0, 14, 59) == datetime.datetime(2026, 1, 1, 0, 15)
    assert ask("30 8 1 * 1", 2026, 1, 1) == datetime.datetime(2026, 6, 1, 8, 30)  # a first of the month that is a Monday
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *", "* * * * 7"):
        with pytest.raises(ValueError):
            schedule.parse(bad)
    with pytest.raises(ValueError):
        ask("0 0 30 2 *", 2026, 1, 1)
    rows = spark.createDataFrame([(AT(i * 8_111),) for i in range(200)], "ts timestamp")
    for e in ("*/15 * * * *", "30 8 1 * 1", "5 4-10/3 * 2,5 *", "0 0 30 2 *"):
        for r in rows.select("ts", schedule.next_tick_of(F.col("ts"), e).alias("next")).collect():
            try:
                assert r["next"] == schedule.next_tick(e, r["ts"])
            except ValueError:
                assert r["next"] is None


def test_schedule_by_row(spark):
    """Each row's own expression, against the instants' search; texts that are no expression have no tick."""
    import random

    rng = random.Random(6)
    good = ["*/15 * * * *", "30 8 1 * 1", "5 4-10/3 * 2,5 *", "0 0 30 2 *", "59 23 31 12 *", "0 0 29 2 *", "5/7 20/10 * * 0", " 1  2 3\t4 * ", "0-59 0-23 1-31 1-12 0-6", "0,0,5-6 * * * *", "0 12 * * 6"]
    bad = ["* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "x * * * *", "* * * * 7", "", "1, * * * *", "* * 0 * *", "* * * * * *", "-1 * * * *", "1-2-3 * * * *", "99999999999 * * * *", "*/x * * * *", None]
    rows = [(e, datetime.datetime(2023, 1, 1) + datetime.timedelta(seconds=rng.randrange(4 * 365 * 86_400))) for e in good + bad for _ in range(12)]
    rows += [(e, datetime.datetime(2024, 2, 28, 23, 59)) for e in good] + [("* * * * *", None)]
    got = spark.createDataFrame(rows, "e string, ts timestamp").select("e", "ts", schedule.next_tick_by(F.col("ts"), F.col("e")).alias("next")).collect()
    for e, ts, found in got:
        try:
            want = schedule.next_tick(e, ts)
        except (ValueError, AttributeError):
            want = None
        assert found == want, (e, ts)


def test_run_on_schedule():
    slept, now = [], [datetime.datetime(2026, 1, 1, 0, 0, 30)]

    class Late(Exception):
        pass

    runs = schedule.run_on_schedule("*/5 * * * *", lambda: "ok", 3, now=lambda: now[0], sleep=slept.append)
    assert runs == ["ok"] * 3 and slept == [270.0, 270.0] and schedule.run_on_schedule(None, lambda: 1) == [1]

    def escalate():
        raise Late("x")

    with pytest.raises(Late):
        schedule.run_on_schedule("* * * * *", escalate, 2, now=lambda: now[0], sleep=slept.append, escalation=Late)
    assert len(slept) == 3
    with pytest.raises(Late):
        schedule.run_on_schedule(None, escalate, escalation=Late)
