"""Digests of daily logs: lines, importance, type, the best of them, and their summary."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.sources import shared

MAX_INSIGHTS = 50
PIECE = 1 << 17  # characters of a section that are compressed together


def insights(logs: DataFrame) -> DataFrame:
    """(source, date, line_no, text, importance, type) of the lines of logs (source, date, content) that say something."""
    lines = logs.select("source", "date", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("text", T.trim(F.col("line")))
    rows = lines.where((T.utf16_length(F.col("text")) >= 10) & ~F.col("text").startswith("#") & ~F.col("text").startswith("---"))
    # No line scores below 0.3, so a threshold of 0.3 needs no filter.
    return rows.select("source", "date", "line_no", "text", T.importance(F.col("text")).alias("importance"), T.line_type(F.col("text")).alias("type"))


def top_insights(rows: DataFrame, n: int = MAX_INSIGHTS) -> DataFrame:
    return rows.orderBy(F.desc("importance"), F.desc("date"), "source", "line_no").limit(n)


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg("importance").alias("mean_importance"), F.min("date").alias("first"), F.max("date").alias("last"))


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.avg("importance").alias("mean_importance"))


def _line() -> F.Column:
    return F.concat(F.lit("- **"), "type", F.lit("** ("), F.format_string("%.2f", "importance"), F.lit("): "), "text")


def markdown(rows: DataFrame) -> DataFrame:
    """(date, text): a digest's section for each day, which must fit in a row; section_hashes() is for days of any size."""
    per = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "source", "line_no", _line().alias("line")))).alias("l"))
    return per.select("date", F.concat(F.lit("## "), F.date_format("date", "yyyy-MM-dd"), F.lit("\n\n"), F.array_join(F.col("l.line"), "\n")).alias("text"))


def _pieces(batches):
    """Sorted lines (date, line) as compressed pieces of sections, in order."""
    at, n, held, size, date = TaskContext.get().partitionId(), 0, [], 0, None
    names = ["date", "at", "n", "piece"]

    def piece():
        packed = zlib.compress("\n".join(held).encode(), 1)
        return pa.RecordBatch.from_arrays([pa.array([date], pa.date32()), pa.array([at], pa.int32()), pa.array([n]), pa.array([packed], pa.binary())], names=names)

    for batch in batches:
        for d, line in zip(batch.column("date").to_pylist(), batch.column("line").to_pylist()):
            if held and (d != date or size > PIECE):
                yield piece()
                n, held, size = n + 1, [], 0
            date = d
            held.append(line)
            size += len(line)
    if held:
        yield piece()


def _hashed(batches):
    """The SHA-256 of each section of sorted pieces, carried from piece to piece."""
    date, run = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([date], pa.date32()), pa.array([date and run.hexdigest()], pa.string())], names=["date", "sha256"])

    for batch in batches:
        for d, packed in zip(batch.column("date").to_pylist(), batch.column("piece")):
            if run is not None and d == date:
                run.update(b"\n")
            else:
                if run is not None:
                    yield row()
                date, run = d, hashlib.sha256(f"## {d}\n\n".encode())
            run.update(zlib.decompress(packed.as_py()))
    if run is not None:
        yield row()


def section_hashes(rows: DataFrame) -> DataFrame:
    """(date, sha256): the hash of markdown()'s text. All days' lines are sorted together over all tasks and packed in pieces; one task reads the
    packed pieces of a day, as a hash is a chain, and holds some of them at a time."""
    lines = shared.written(rows.select("date", (-F.col("importance")).alias("i"), "source", "line_no", _line().alias("line")), "digest-lines")
    order = ["date", "i", "source", "line_no"]
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("date", "line").mapInArrow(_pieces, "date date, at int, n long, piece binary")
    pieces = shared.written(pieces, "digest-pieces")
    return pieces.repartitionByRange(n, "date").sortWithinPartitions("date", "at", "n").select("date", "piece").mapInArrow(_hashed, "date date, sha256 string")


def counts_by_type(rows: DataFrame) -> DataFrame:
    """(by_type): one map from type to count."""
    per = rows.groupBy("type").agg(F.count("*").alias("n"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
