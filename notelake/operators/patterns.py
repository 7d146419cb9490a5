"""Many patterns over many texts, without trying each on each."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import patterns as P
from notelake.sources import shared

NEEDLE_CHARS = 1 << 20  # of needles in one automaton, some 50 MB; more are looked for in further passes over the texts
PATTERNS = 100_000  # patterns, of at most 200 characters each, are broadcast to what may match them up to this number
CHUNK = 64  # patterns without a needle that a text is tried on at once


def runnable(patterns: DataFrame) -> DataFrame:
    """(p, pattern, needles) of the distinct patterns (p) that may run; the others are left out."""
    rows = patterns.where(F.coalesce("p", F.lit("")) != "").select("p").distinct().where(P.is_safe(F.col("p")))
    return rows.withColumn("x", P.parsed(F.col("p"))).select("p", "x.*").where(P.compiles(F.col("pattern")))


def _automata(needles: DataFrame):
    """Automata of the distinct needles, of a bounded size each."""
    held, size = ahocorasick.Automaton(), 0
    for r in needles.toLocalIterator():
        held.add_word(r["needle"], r["needle"])
        size += len(r["needle"])
        if size > NEEDLE_CHARS:
            yield held
            held, size = ahocorasick.Automaton(), 0
    if size:
        yield held


def _with_needles(texts: DataFrame, automaton, schema: str) -> DataFrame:
    automaton.make_automaton()
    words = texts.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        for batch in batches:
            at, needle = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = {n for _, n in words.value.iter(text)}
                at += [i] * len(found)
                needle += found
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(needle, pa.string())], names=[*batch.schema.names, "needle"])

    return texts.mapInArrow(run, schema)


def search(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(qid, p): the patterns (p) found in each text (qid, text); those that may not run are found nowhere.

    One pass of an automaton over the texts finds which hold a text that some pattern can't match without; only these meet that pattern, by an
    equi-join on the text found. Patterns that name no such text (`.*`, `\\d+`) meet every text, in chunks. Null texts match nothing.
    """
    texts = texts.select("qid", "text").where("text is not null")
    rows = shared.written(runnable(patterns), "patterns")
    keyed = rows.where("needles is not null").select("p", "pattern", F.explode("needles").alias("needle"))
    schema = f"qid {texts.schema['qid'].dataType.simpleString()}, text string, needle string"
    met = None
    for automaton in _automata(keyed.select("needle").distinct()):
        one = _with_needles(texts, automaton, schema)
        met = one if met is None else met.union(one)
    keyed = F.broadcast(keyed) if rows.count() <= PATTERNS else keyed
    found = met.join(keyed, "needle").where(F.rlike("text", F.col("pattern"))).select("qid", "p") if met is not None else None
    bare = rows.where("needles is null")
    n = bare.count()
    if n:
        chunks = -(-n // CHUNK)
        each = bare.groupBy(F.pmod(F.xxhash64("p"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("p", "pattern")).alias("of"))
        tried = texts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>"))).join(F.broadcast(each) if n <= PATTERNS else each, "chunk")
        tried = tried.select("qid", F.explode(F.filter("of", lambda x: F.rlike(F.col("text"), x["pattern"]))).alias("x")).select("qid", "x.p")
        found = tried if found is None else found.union(tried)
    if found is None:
        return texts.select("qid", F.lit(None).cast("string").alias("p")).limit(0)
    return found.distinct()
