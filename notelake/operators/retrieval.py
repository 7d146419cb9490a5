"""Hybrid retrieval over a batch of queries: gates, blending, ranking, k-NN, rendering and evaluation."""

from __future__ import annotations

import inspect
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.sources import corpus as C
from notelake.sources import shared

from . import patterns, sphere

#: Floors of the semantic score by provider, and by model where one was calibrated.
FLOORS, MODEL_FLOORS = {"openai": 0.5, "ollama": 0.78}, {"bge-m3": 0.78}


@dataclass
class Weights:
    """Blend weights; numbers that aren't finite and at least 0 fall back to the defaults."""

    topic_boost: float = 0.05
    recency: float = 0.05
    half_life_days: float = 30.0
    type_weight: float = 0.03
    k: int = 5

    @classmethod
    def of(cls, **over) -> "Weights":
        ok = lambda v: isinstance(v, (int, float)) and np.isfinite(v) and v >= 0
        out = cls(**{k: v for k, v in over.items() if ok(v)})
        out.half_life_days = out.half_life_days or 30.0
        return out

    @classmethod
    def of_settings(cls, settings: dict[str, str], prefix: str = "NOTELAKE_BLEND_") -> "Weights":
        """From texts such as environment variables; what is missing, blank or no number at least 0 is the default."""
        names = {"topic_boost": "TOPIC_BOOST", "recency": "RECENCY_WEIGHT", "half_life_days": "RECENCY_HALFLIFE_DAYS", "type_weight": "TYPE_WEIGHT", "k": "CANDIDATE_K"}
        return cls.of(**{k: v for k, n in names.items() if (v := strict_number(settings.get(prefix + n, ""))) is not None})


def strict_number(text: str) -> float | None:
    """A number that is the whole text; null otherwise."""
    return float(text) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text.strip()) and np.isfinite(float(text)) else None


def candidates(max_hits: int, k: float) -> int:
    """How many similar notes are asked for: never fewer than are shown."""
    return max(max_hits, int(k + 0.5))


def floor_of(provider: str | None, model: str | None = None, override: float | None = None) -> tuple[float, str]:
    """The least similarity that counts, and where it comes from: an override, the provider, a calibrated model, or a fallback."""
    if override is not None and np.isfinite(override) and override >= 0:
        return override, "env"
    if provider != "ollama":
        return FLOORS["openai"], "provider"
    name = (model or "").strip().lower().split(":")[0]
    return (MODEL_FLOORS[name], "map") if name in MODEL_FLOORS else (FLOORS["ollama"], "fallback")


def floor_by(provider: Column, model: Column, override: Column) -> Column:
    """floor_of() of columns: struct(floor, source)."""
    out = lambda floor, source: F.struct(floor.cast("double").alias("floor"), F.lit(source).alias("source"))
    name = F.split_part(F.lower(F.trim(F.coalesce(model, F.lit("")))), F.lit(":"), F.lit(1))
    known = F.coalesce(*(F.when(name == m, F.lit(f)) for m, f in MODEL_FLOORS.items()))
    fine = F.coalesce((override >= 0) & (override < float("inf")), F.lit(False))
    return (
        F.when(fine, out(override, "env")).when(~F.coalesce(provider == "ollama", F.lit(False)), out(F.lit(FLOORS["openai"]), "provider"))
        .when(known.isNotNull(), out(known, "map")).otherwise(out(F.lit(FLOORS["ollama"]), "fallback"))
    )


def floor_hint(candidates: int, survivors: int, floor: float, source: str, model: str | None) -> str | None:
    """What to tell when a floor that nobody calibrated has dropped all that was found."""
    if source != "fallback" or not candidates or survivors:
        return None
    name = re.sub(r"[\x00-\x1f\x7f]", "", (model or "").strip()) or "unknown"
    return f"the uncalibrated floor {floor} for model {name!r} dropped all {candidates} candidates"


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero or empty vector or another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def topk(queries: DataFrame, index: DataFrame, k: int, model: str | None = None) -> DataFrame:
    """(qid, id, sim01, rank): the k nearest of the index (id, embedding[, model]) for each query (qid, embedding).

    The similarity is (1 + cosine) / 2; ties go by id; zero vectors are left out; rows of another model are dropped after ranking.
    Both sides are dealt out by pivots (see sphere), whatever their sizes.
    """
    if "model" not in index.columns:
        index = index.withColumn("model", F.lit(None).cast("string"))
    found = sphere.nearest(queries, index.select("id", F.col("model").cast("string").alias("model"), "embedding"), k)
    if model is not None:
        found = found.where(F.col("model") == model)
    return found.select("qid", "id", F.greatest(F.lit(0.0), (1 + F.col("cosine")) / 2).alias("sim01"), "rank")


# ---------------------------------------------------------------- gates


def _first_of(owned: DataFrame, notes: DataFrame, key: str, most: int) -> DataFrame:
    """The ids of owned (id, <key>) that are, of any key, among its first so many by load_ord."""
    per = owned.join(notes.select("id", "load_ord"), "id").groupBy(key, "id").agg(F.min(F.struct("load_ord")).alias("at"))
    return per.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at", "id"))).where(F.col("n") <= most).select("id").distinct()


def topic_gate(queries: DataFrame, notes: DataFrame, vocabulary: dict = C.VOCABULARY, most: int | None = None) -> DataFrame:
    """(qid, id, gate, score, reason) of notes that share a topic with the prompt: an equi-join on topics, pre-exploded.

    With most, a query may lack notes that at least so many of its others precede by load_ord.
    """
    if most is not None:
        notes = notes.join(_first_of(notes.select("id", F.explode(F.array_distinct("topics")).alias("topic")), notes, "topic", most), "id", "left_semi")
    asked = queries.select("qid", F.explode(C.topics_of(F.col("prompt"), vocabulary)).alias("topic"))
    held = notes.select("id", F.posexplode(F.array_distinct("topics")).alias("ord", "topic"))
    both = asked.join(held, "topic").groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "topic"))).alias("t"))
    return both.select("qid", "id", F.lit("topic").alias("gate"), F.lit(1.0).alias("score"), F.concat(F.lit("topic match: "), F.array_join(F.col("t.topic"), ", ")).alias("reason"))


def shared_topics(pairs: DataFrame, queries: DataFrame, notes: DataFrame, vocabulary: dict = C.VOCABULARY) -> DataFrame:
    """(qid, id, topic_reason) of those pairs (qid, id) whose note has a topic of the prompt, as topic_gate tells it."""
    asked = queries.select("qid", C.topics_of(F.col("prompt"), vocabulary).alias("asked"))
    both = pairs.join(asked, "qid").join(notes.select("id", F.array_distinct("topics").alias("topics")), "id")
    met = both.withColumn("met", F.filter("topics", lambda t: F.array_contains("asked", t))).where("size(met) > 0")
    return met.select("qid", "id", F.concat(F.lit("topic match: "), F.array_join("met", ", ")).alias("topic_reason"))


def tool_gate(queries: DataFrame, notes: DataFrame, most: int | None = None) -> DataFrame:
    """Notes triggered by a query's tool name, or else, for the shell, by its command; patterns that may not run trigger nothing.

    Commands meet the distinct patterns that they can match, not the notes that have them: those follow by an equi-join.
    With most, a query may lack notes that at least so many of its others precede by load_ord.
    """
    if most is not None:
        by_tool = _first_of(notes.select("id", F.explode(F.array_distinct("triggers.tools")).alias("tool_name")), notes, "tool_name", most)
        by_pattern = _first_of(notes.select("id", F.col("triggers.command_pattern").alias("p")).where("p is not null"), notes, "p", most)
        kept = shared.written(by_tool.union(by_pattern).distinct(), "triggered")
        notes = notes.join(kept, "id", "left_semi")
    tools = notes.select("id", F.explode(F.array_distinct("triggers.tools")).alias("tool_name"))
    named = queries.join(tools, "tool_name").select("qid", "id", F.concat(F.lit("tool match: "), F.col("tool_name")).alias("reason"), F.lit(0).alias("by"))
    owned = notes.select("id", F.col("triggers.command_pattern").alias("p"))
    found = patterns.search(queries.where("tool_name = 'Bash'").select("qid", F.col("tool_command").alias("text")), owned.select("p")).join(owned, "p")
    by_command = found.select("qid", "id", F.concat(F.lit("command match: "), F.col("p")).alias("reason"), F.lit(1).alias("by"))
    return named.unionByName(by_command).groupBy("qid", "id").agg(F.lit("tool").alias("gate"), F.lit(1.0).alias("score"), F.min_by("reason", F.struct("by", "reason")).alias("reason"))


def dedupe_and_rank(hits: DataFrame, max_hits: int) -> DataFrame:
    """hits (qid, id, score, seq, ...): the best row per id, earlier first among equals, then by score and first appearance."""
    per = Window.partitionBy("qid", "id")
    rows = hits.withColumn("first", F.min("seq").over(per)).withColumn("n", F.row_number().over(per.orderBy(F.desc("score"), "seq"))).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max_hits).drop("n", "first")


def resolve(queries: DataFrame, notes: DataFrame, max_hits: int = 5, gates=(topic_gate, tool_gate)) -> DataFrame:
    """The resolver without similarity: every gate's hits score 1; notes come in load order (load_ord).

    As hits go by gate, then by load_ord, no more than max_hits of a gate can be shown: a gate that takes most (see topic_gate) is asked for
    those, so a topic or tool of many notes doesn't meet each of its queries with all of them. Other gates are asked for everything.
    """
    all_ = None
    for g, gate in enumerate(gates):
        bound = {"most": max_hits} if "most" in inspect.signature(gate).parameters else {}
        hits = gate(queries, notes, **bound).withColumn("g", F.lit(g))
        all_ = hits if all_ is None else all_.unionByName(hits)
    hits = all_.join(notes.select("id", "load_ord"), "id").withColumn("seq", F.struct("g", "load_ord"))
    return dedupe_and_rank(hits, max_hits).select("qid", "id", "gate", "score", "reason", "rank")


def type_modifier(kind: Column, weight: float) -> Column:
    return weight * F.when(kind == "feedback", 1.0).when(kind == "project", 0.5).when(kind == "reference", 0.25).otherwise(0.0)


def recency_modifier(age_days: Column, w: Weights) -> Column:
    return w.recency * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.coalesce(age_days, F.lit(0.0))) / w.half_life_days)


def blend(queries: DataFrame, notes: DataFrame, semantic: DataFrame, floor: float, max_hits: int = 5, weights: Weights | None = None, tools: DataFrame | None = None, vocabulary: dict = C.VOCABULARY) -> DataFrame:
    """semantic (qid, id, sim01) above the floor, joined with topics, plus recency and type; notes has (id, topics, type, age_days, load_ord).

    Queries without a similar note get the topic resolver's hits, all scoring 1. Tool hits come first, whatever they score.
    """
    w = weights or Weights()
    sem = semantic.where(F.col("sim01") >= floor).select("qid", "id", "sim01")
    speaking = shared.written(sem.groupBy("qid").agg(F.count("*").alias("n")), "speaking")
    most = max_hits + (speaking.agg(F.max("n")).first()[0] or 0)
    score = F.coalesce("sim01", F.lit(0.0)) + F.when(F.col("topic_reason").isNotNull(), w.topic_boost).otherwise(0.0) + type_modifier(F.col("type"), w.type_weight) + recency_modifier(F.col("age_days"), w)
    # Without similarity a note's score is its own, so of each topic only the best can be shown beside a query's similar notes.
    alone = notes.withColumns({"sim01": F.lit(None).cast("double"), "topic_reason": F.lit("")}).select("id", "load_ord", score.alias("score"), F.explode(F.array_distinct("topics")).alias("topic"))
    best = alone.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "load_ord"))).where(F.col("n") <= most).select("id").distinct()
    asked = queries.join(speaking.select("qid"), "qid", "left_semi")
    given = sem.select("qid", "id") if tools is None else sem.select("qid", "id").union(tools.select("qid", "id"))
    topic = topic_gate(asked, notes.join(best, "id", "left_semi"), vocabulary).select("qid", "id", F.col("reason").alias("topic_reason"))
    topic = topic.union(shared_topics(given.distinct(), asked, notes, vocabulary)).distinct()
    both = sem.join(topic, ["qid", "id"], "full_outer").join(notes.select("id", "type", "age_days", "load_ord"), "id")
    reason = F.concat_ws("; ", F.when(F.col("sim01").isNotNull(), F.concat(F.lit("semantic match (score="), T.fixed(F.col("sim01")), F.lit(")"))), "topic_reason")
    rows = both.select("qid", "id", F.when(F.col("sim01").isNotNull(), "confidence").otherwise("topic").alias("gate"), score.alias("score"), reason.alias("reason"), F.struct(F.lit(0).alias("g"), "load_ord").alias("seq"))
    # A silent query's hits all score 1, so the first notes of each of its topics are all that can be shown.
    quiet = queries.join(speaking.select("qid"), "qid", "left_anti")
    first = F.row_number().over(Window.partitionBy("topic").orderBy("load_ord"))
    held = notes.select("id", "load_ord", F.explode(F.array_distinct("topics")).alias("topic")).withColumn("n", first).where(F.col("n") <= max_hits).select("id").distinct()
    silent = topic_gate(quiet, notes.join(held, "id", "left_semi"), vocabulary).select("qid", "id", "reason")
    if tools is not None:  # a tool's note keeps the place that its topics give it
        silent = silent.union(shared_topics(tools.select("qid", "id").distinct(), quiet, notes, vocabulary)).distinct()
    silent = silent.join(notes.select("id", "load_ord"), "id")
    rows = rows.unionByName(silent.select("qid", "id", F.lit("topic").alias("gate"), F.lit(1.0).alias("score"), "reason", F.struct(F.lit(0).alias("g"), "load_ord").alias("seq")))
    rows = rows.withColumn("is_tool", F.lit(False))
    if tools is not None:
        extra = tools.join(notes.select("id", "load_ord"), "id").select("qid", "id", "gate", "score", "reason", F.struct(F.lit(1).alias("g"), "load_ord").alias("seq"), F.lit(True).alias("is_tool"))
        rows = rows.unionByName(extra)
    per = Window.partitionBy("qid", "id")
    rows = rows.withColumn("tool", F.max("is_tool").over(per)).withColumn("first", F.min("seq").over(per))
    rows = rows.withColumn("n", F.row_number().over(per.orderBy(F.desc("score"), "seq"))).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("tool"), F.desc("score"), "first"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max_hits).select("qid", "id", "gate", "score", "reason", "rank")


def confidence_resolve(queries: DataFrame, semantic: DataFrame, max_hits: int = 3) -> DataFrame:
    """The older resolver: similar notes over a threshold that falls with the prompt's ambiguity."""
    t = queries.select("qid", T.ambiguity(F.col("prompt")).alias("ambiguity")).withColumn("threshold", T.confidence_threshold(F.col("ambiguity")))
    reason = F.concat(F.lit("semantic match (ambiguity="), T.fixed(F.col("ambiguity")), F.lit(", threshold="), T.fixed(F.col("threshold")), F.lit(")"))
    rows = semantic.join(t, "qid").where("sim01 >= threshold")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim01"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max_hits).select("qid", "id", F.col("sim01").alias("score"), "rank", reason.alias("reason"))


def render(hits: DataFrame, notes: DataFrame, title: str = "notelake", stale: DataFrame | None = None) -> DataFrame:
    """(qid, context): the hits of a query as one text, each with its gate and score; a note that stale (id, reason) has is marked, never left out."""
    rows = hits.join(notes.select("id", "name", "body"), "id")
    rows = rows.join(stale.select("id", F.col("reason").alias("stale")), "id", "left") if stale is not None else rows.withColumn("stale", F.lit(None).cast("string"))
    mark = F.concat(F.lit("> ⚠️ **stale:** "), F.col("stale"), F.lit("\n>\n> This memory references something that no longer exists. Verify before acting.\n\n"))
    block = F.concat(F.lit("### "), "name", F.lit("  _("), "gate", F.lit(" · "), T.fixed(F.col("score")), F.lit(")_\n"), F.coalesce(mark, F.lit("")), T.trim(F.col("body")))
    per = rows.select("qid", "rank", block.alias("block")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    count = F.when(F.size("b") == 1, F.lit("1 relevant memory applies:")).otherwise(F.concat(F.size("b").cast("string"), F.lit(" relevant memories apply:")))
    return per.select("qid", F.concat_ws("\n\n", F.concat(F.lit(f"**{title}** — "), count), F.array_join(F.col("b.block"), "\n\n")).alias("context"))


def envelope(contexts: DataFrame, event: str) -> DataFrame:
    """(qid, json): what a hook prints for each query with a context; queries without one print nothing, so have no row."""
    inner = F.struct(F.lit(event).alias("hookEventName"), F.col("context").alias("additionalContext"))
    return contexts.where("context <> ''").select("qid", F.to_json(F.struct(inner.alias("hookSpecificOutput"))).alias("json"))


def requests(payloads: DataFrame) -> DataFrame:
    """payloads (qid, payload), JSON texts, as queries (qid, prompt, cwd, tool_name, tool_command); over MAX_REQUEST bytes is an error, blank is no prompt."""
    size = F.assert_true(F.octet_length("payload") <= C.MAX_REQUEST, F.lit(f"a payload exceeds {C.MAX_REQUEST} bytes"))
    body = F.from_json(F.nullif(F.trim("payload"), F.lit("")), "prompt string, cwd string, tool_name string, tool_input struct<command:string>", {"mode": "FAILFAST"})
    return payloads.withColumn("fine", size).withColumn("r", body).where("fine is null").select("qid", "r.prompt", "r.cwd", "r.tool_name", F.col("r.tool_input.command").alias("tool_command"))


# ---------------------------------------------------------------- evaluation


def prompt_metrics(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """golden (qid, expect array), hits (qid, id, rank, gate): precision, recall and reciprocal rank; no expectation is a negative control."""
    got = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("got"), F.max((F.col("gate") == "confidence").cast("int")).alias("semantic"))
    rows = golden.join(got, "qid", "left").withColumn("got", F.coalesce("got", F.array().cast(hits.schema["id"].dataType.simpleString().join(["array<", ">"]))))
    relevant = F.size(F.array_intersect("got", "expect"))
    negative = F.size("expect") == 0
    first = F.array_min(F.filter(F.transform("expect", lambda e: F.array_position("got", e)), lambda p: p > 0))
    return rows.select(
        "qid", negative.alias("negative"), F.when(negative, (F.size("got") == 0).cast("double")).otherwise(F.coalesce(F.try_divide(relevant, F.size("got")), F.lit(0.0))).alias("precision"),
        F.when(negative, (F.size("got") == 0).cast("double")).otherwise(F.try_divide(relevant, F.size("expect"))).alias("recall"),
        F.when(~negative, F.coalesce(1.0 / first, F.lit(0.0))).alias("reciprocal_rank"), F.coalesce(F.col("semantic") == 1, F.lit(False)).alias("semantic"), (F.size("got") == 0).alias("silent"),
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    pos, neg = ~F.col("negative"), F.col("negative")
    mean = lambda c: F.coalesce(F.avg(F.when(pos, F.col(c))), F.lit(0.0))
    return metrics.agg(
        mean("precision").alias("precision"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), F.count_if(pos).alias("positives"),
        F.count_if(neg).alias("negatives"), F.count_if(neg & F.col("silent")).alias("negatives_passed"), F.try_divide(F.count_if(neg & F.col("silent")), F.count_if(neg)).alias("negative_rate"),
        F.count_if("semantic").alias("semantic_prompts"),
    )


def evaluate(golden: DataFrame, notes: DataFrame, semantic: DataFrame, floor: float, **blend_options) -> dict[str, DataFrame]:
    """A whole evaluation of prompts (qid, prompt, expect): per_prompt, aggregate, and unknown, the expected ids that no note has."""
    hits = shared.written(blend(golden, notes, semantic, floor, **blend_options), "hits")
    per = shared.written(prompt_metrics(golden, hits), "per_prompt")
    return {"hits": hits, "per_prompt": per, "aggregate": aggregate_metrics(per), "unknown": unknown_ids(golden, notes)}


def coverage(prompts: DataFrame, hits: DataFrame) -> DataFrame:
    """Of labelled prompts (qid, must array, must_not array): how many got a hit, hits per prompt, and labels missed or wrongly met."""
    got = hits.groupBy("qid").agg(F.collect_set("id").alias("got"))
    kind = prompts.schema["must"].dataType.simpleString()
    rows = prompts.join(got, "qid", "left").withColumn("got", F.coalesce("got", F.array().cast(kind)))
    return rows.agg(
        F.count("*").alias("prompts"), F.try_divide(F.count_if(F.size("got") > 0), F.count("*")).alias("match_rate"), F.avg(F.size("got")).alias("mean_hits"),
        F.sum(F.size(F.array_except("must", "got"))).alias("missed"), F.sum(F.size("must")).alias("musts"),
        F.sum(F.size(F.array_intersect("must_not", "got"))).alias("wrong"), F.sum(F.size("must_not")).alias("must_nots"),
    )


def unknown_ids(golden: DataFrame, notes: DataFrame) -> DataFrame:
    return golden.select(F.explode("expect").alias("id")).distinct().join(notes, "id", "left_anti")
