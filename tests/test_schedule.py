"""Next ticks of tables: the same as of columns, each expression and day read once."""

import datetime

from pyspark.sql import functions as F

from notelake.functions import schedule

CRONS = ["*/15 * * * *", "0 0 1 * *", "0 0 30 2 *", "*/0 * * * *", None, "7,37 */6 * 2-3 1-5", " 5  4 29 2 * ", "x"]


def test_next_ticks_are_those_of_columns(spark):
    start = datetime.datetime(2027, 12, 30, 22, 58, 31)
    rows = [(i, CRONS[i % len(CRONS)], None if i % 50 == 7 else start + datetime.timedelta(minutes=37 * i)) for i in range(3000)]
    rows = spark.createDataFrame(rows, "id long, cron string, ts timestamp")
    got = schedule.next_ticks(rows, "ts", "cron", "next")
    want = rows.withColumn("next", schedule.next_tick_by(F.col("ts"), F.col("cron")))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("next is not null").count() > 1000
    # No row searches days or reads an expression: what is left for rows has no function that loops.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "sequence(" not in plan
