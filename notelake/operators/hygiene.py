"""Corpus hygiene: duplicates, schema metrics, drift, topic, conflict and staleness lint, tagging and migration."""

from __future__ import annotations

import datetime
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import frontmatter
from notelake.functions import text as T
from notelake.sources import corpus as C
from notelake.sources import shared

from . import edits, retrieval, sphere

MAX_LINES, MAX_DESCRIPTION = 200, 150
JACCARD_FLOOR, COSINE_FLOOR = 0.15, 0.85
MAX_AGE_DAYS = 90


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """(hash, n, first, ids): notes (id, body) whose bodies are equal but for case and white space; empty ones are left out."""
    rows = notes.select("id", T.body_hash(F.col("body")).alias("hash"))
    groups = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.array_sort(F.collect_list("id")).alias("ids"))
    return groups.where((F.col("n") > 1) & (F.col("hash") != T.EMPTY_HASH))


def exact_duplicate_members(notes: DataFrame) -> DataFrame:
    """(id, hash, n, first): a row per note of a group, for groups of any size; counts are made in part before the shuffle."""
    rows = shared.written(notes.select("id", T.body_hash(F.col("body")).alias("hash")), "hashes")  # texts are read once
    groups = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first")).where((F.col("n") > 1) & (F.col("hash") != T.EMPTY_HASH))
    return rows.join(groups, "hash").select("id", "hash", "n", "first")


def empty_bodies(notes: DataFrame) -> DataFrame:
    return notes.where(T.normal_hash(F.col("body")).isNull()).select("id")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(a, b, similarity) of vectors (id, embedding) with cosine >= threshold, a < b: exact, each vector dealt to the cells that can hold its like."""
    return sphere.near_pairs(vectors, threshold)


def near_report(notes: DataFrame, index: DataFrame | None, model: str | None, threshold: float = 0.95, problem: str | None = None) -> dict:
    """The near-duplicate pass over an index (id, model, embedding): status ok or skipped with a reason, pairs, how many notes have a vector of
    the model, and how many entries are of other models, if some notes lack one. Ids are numbers."""
    total = notes.count()
    if problem or index is None or model is None:
        why = problem or ("there is no embedding index" if index is None else "no embedding provider is configured")
        return {"status": "skipped", "reason": why, "threshold": threshold, "indexed": 0, "total": total, "pairs": None}
    held = shared.written(index.where(F.col("model") == model).join(notes.select("id"), "id", "left_semi").select("id", "embedding"), "held")
    indexed = held.count()
    stale = index.where(~F.col("model").eqNullSafe(F.lit(model))).count() if indexed < total else 0
    pairs = near_duplicates(held, threshold).orderBy(F.desc("similarity"), "a", "b")
    return {"status": "ok", "reason": None, "threshold": threshold, "indexed": indexed, "total": total, "pairs": pairs} | ({"stale_model_rows": stale} if stale else {})


def schema_metrics(notes: DataFrame, lists: bool = False) -> DataFrame:
    """Counts over scanned notes: all, accepted, rejected, without topics, with the type in metadata only, and with topics of a wrong shape.

    With lists, also the ids of each kind, sorted: a report's, of a corpus whose faults fit in one row.
    """
    ok = F.col("ok")
    legacy = ok & F.col("own_type").isNull() & F.col("meta_type").isNotNull()
    bad = ok & F.col("topics_shape").startswith("<")
    untagged = ok & ~F.col("topics_shape").startswith("<") & (F.coalesce(F.size("topics"), F.lit(0)) <= 0)
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    more = [ids(untagged).alias("untagged_ids"), ids(legacy).alias("legacy_ids"), ids(bad).alias("bad_shape_ids"), ids(~ok).alias("rejected_ids")] if lists else []
    return notes.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(untagged).alias("untagged"),
        F.count_if(legacy).alias("legacy"), F.count_if(bad).alias("bad_shape"), F.coalesce(F.try_divide(F.count_if(legacy), F.count_if(ok)), F.lit(0.0)).alias("legacy_rate"), *more,
    )


def unknown_topics(notes: DataFrame, vocabulary: list[str] | DataFrame) -> DataFrame:
    """(id, topic, suggestion): topics that the vocabulary, a list or a table (ord, word), hasn't, with the nearest within two edits, the
    first of equals; topics that are no list are one hit, without a suggestion."""
    if not isinstance(vocabulary, DataFrame):
        vocabulary = notes.sparkSession.createDataFrame(list(enumerate(vocabulary)), "ord long, word string")
    shape = F.col("topics_shape") if "topics_shape" in notes.columns else F.lit("list")
    rows = notes.withColumn("shape", shape)
    odd = rows.where(F.col("shape").startswith("<")).select("id", F.col("shape").alias("topic"), F.lit(None).cast("string").alias("suggestion"))
    each = rows.where(~F.col("shape").startswith("<")).select("id", F.explode("topics").alias("topic")).where("topic is not null")
    each = each.join(vocabulary.select(F.col("word").alias("topic")).distinct(), "topic", "left_anti")
    near = edits.nearest(each.select(F.col("topic").alias("word")), vocabulary).select(F.col("word").alias("topic"), F.col("near").alias("suggestion"))
    return each.join(near, "topic", "left").select("id", "topic", "suggestion").unionByName(odd)


def directives(notes: DataFrame) -> DataFrame:
    """(id, topics, line, polarity, tokens) of feedback notes with topics, written: their first lines are read once, whatever is compared."""
    rows = notes.where("type = 'feedback'").select("id", F.filter(F.col("topics"), lambda t: t != "").alias("topics"), T.first_line(F.col("body")).alias("line")).where("size(topics) > 0")
    rows = shared.written(rows, "lines")
    return shared.written(rows.select("id", "topics", "line", T.polarity(F.col("line")).alias("polarity"), T.content_tokens(F.col("line")).alias("tokens")), "directives")


def conflicts(notes: DataFrame, vectors: DataFrame | None = None, opposite_only: bool = False) -> DataFrame:
    """(a, b, topic, severity, overlap, reason): pairs of feedback notes that share a topic, a before b by id; the topic is the first of b's.

    A pair is high if the notes point in opposite directions and their first lines share enough words, or, with vectors (id, embedding),
    if they are as similar; any other pair is info. A report of all pairs grows as a topic's notes squared; opposite_only reports the
    opposite pairs alone: positive notes are joined with negative ones by topic, so like notes never meet.
    """
    rows = directives(notes)
    side = lambda r, s: r.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("topics", "polarity", "tokens")), F.explode(F.array_distinct("topics")).alias("topic"))
    if opposite_only:
        p, n = side(rows.where("polarity = 'positive'"), "p"), side(rows.where("polarity = 'negative'"), "n")
        met = p.join(n, "topic")
        later = lambda c: F.when(F.col("p") > F.col("n"), F.col(f"{c}_p")).otherwise(F.col(f"{c}_n"))
        earlier = lambda c: F.when(F.col("p") > F.col("n"), F.col(f"{c}_n")).otherwise(F.col(f"{c}_p"))
        kept = [x for c in ("topics", "polarity", "tokens") for x in (earlier(c).alias(f"{c}_a"), later(c).alias(f"{c}_b"))]
        met = met.select("topic", F.least("p", "n").alias("a"), F.greatest("p", "n").alias("b"), *kept)
    else:
        met = side(rows, "a").join(side(rows, "b"), "topic").where("a < b")
    met = met.where(F.col("topic") == F.get(F.array_intersect("topics_b", "topics_a"), F.lit(0)))
    opposite = F.coalesce((F.array_sort(F.array("polarity_a", "polarity_b")) == F.array(F.lit("negative"), F.lit("positive"))), F.lit(False))
    overlap = T.jaccard(F.col("tokens_a"), F.col("tokens_b"))
    high = F.concat(F.lit("opposite imperatives ("), "polarity_a", F.lit("/"), "polarity_b", F.lit(") and subject vocabulary overlap "), F.round(overlap * 100).cast("int").cast("string"), F.lit("%"))
    clash = opposite & (overlap >= JACCARD_FLOOR)
    out = met.select(
        "a", "b", "topic", F.when(clash, "high").otherwise("info").alias("severity"), F.when(opposite, overlap).otherwise(0.0).alias("overlap"),
        F.when(clash, high).otherwise("two feedback memories share this topic").alias("reason"), opposite.alias("opposite"),
    )
    if vectors is None:
        return out.drop("opposite")
    v = lambda s: vectors.select(F.col("id").alias(s), F.col("embedding").alias(f"e_{s}"))
    near = out.join(v("a"), "a", "left").join(v("b"), "b", "left").withColumn("cosine", F.coalesce(retrieval.cosine(F.col("e_a"), F.col("e_b")), F.lit(0.0)))
    up = (F.col("severity") == "info") & F.col("opposite") & (F.col("cosine") >= COSINE_FLOOR)
    said = F.concat(F.lit("opposite imperatives + semantic similarity "), F.round(F.col("cosine") * 100).cast("int").cast("string"), F.lit("%"))
    return near.withColumn("reason", F.when(up, said).otherwise(F.col("reason"))).withColumn("severity", F.when(up, "high").otherwise(F.col("severity"))).drop("e_a", "e_b", "opposite")


def conflicts_with_embeddings(notes: DataFrame, embed, stored: DataFrame | None = None, opposite_only: bool = False) -> DataFrame:
    """conflicts() with similarities of the notes' embeddings: stored ones (id, embedding) where there are any; the others are made for
    the notes of opposite pairs alone. embed maps (id, text) to (id, embedding); None leaves the pairs as they are."""
    plain = conflicts(notes, opposite_only=opposite_only)
    if embed is None and stored is None:
        return plain
    asked = conflicts(notes, opposite_only=True).where("severity = 'info'")
    ids = shared.written(asked.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    have = stored.join(ids, "id", "left_semi").select("id", "embedding") if stored is not None else None
    lacking = ids if have is None else ids.join(have, "id", "left_anti")
    if embed is not None:
        texts = notes.join(lacking, "id", "left_semi").select("id", T.embed_input(F.col("name"), F.col("description"), F.col("body")).alias("text"))
        fresh = embed(texts)
        have = fresh if have is None else have.unionByName(fresh.select("id", F.col("embedding").cast(have.schema["embedding"].dataType)))
    return conflicts(notes, shared.written(have, "vectors"), opposite_only)


def stale_dates(notes: DataFrame, now: datetime.datetime, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """(id, newest, age_days): notes whose newest date in the body is over the limit, unless updated_at, where there is one, is within it."""
    updated = F.try_to_timestamp("updated_at") if "updated_at" in notes.columns else F.lit(None).cast("timestamp")
    rows = notes.select("id", F.array_max(T.iso_dates(F.col("body"))).alias("newest"), updated.alias("updated")).where("newest is not null")
    cut = F.lit(now - datetime.timedelta(days=max_age_days))
    age = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 86_400).cast("int")
    return rows.where((F.col("newest").cast("timestamp") < cut) & ~F.coalesce(F.col("updated") >= cut, F.lit(False))).select("id", "newest", age.alias("age_days"))


def stale_references(notes: DataFrame, inventory: DataFrame, symbols: DataFrame, roots: list[str] | None = None, searchable: list[str] | None = None, scan_body: bool = True) -> DataFrame:
    """(id, kind, value, source, status): references that no root has. inventory (root, path), symbols (root, word).

    Declared paths and symbols are looked for; with scan_body those of the body if a note declares none. roots are all roots, by default
    those of the inventory; searchable those whose symbols are known, by default all of them. Status is missing, no-matches, skipped (no
    root could be searched), or malformed: an entry without a value, one that is no entry, or a symbol that is no identifier. Flags
    aren't looked at. A relative path that leads out of its root is missing.
    """
    searchable = roots if searchable is None else searchable
    some = bool(searchable) if searchable is not None else not inventory.where("root is not null").isEmpty()
    declared = notes.where("size(verify) > 0").select("id", F.explode("verify").alias("r"))
    whole = F.col("r.whole") if "whole" in notes.schema["verify"].dataType.elementType.names else F.lit(True)
    declared = shared.written(declared.select("id", whole.alias("whole"), "r.kind", "r.value"), "declared")
    checked = F.col("kind").isin("path", "symbol")
    bad = declared.where(~F.col("whole") | (checked & (F.coalesce("value", F.lit("")) == "")))
    bad = bad.select("id", F.when(F.col("kind") == "symbol", "symbol").otherwise("path").alias("kind"), F.lit("").alias("value"), F.lit("verify").alias("source"), F.lit("malformed").alias("status"))
    refs = declared.where(F.col("whole") & checked & (F.coalesce("value", F.lit("")) != "")).select("id", "kind", "value", F.lit("verify").alias("source"))
    if scan_body:
        body = notes.join(refs.select("id").distinct(), "id", "left_anti").select("id", F.explode(T.references(F.col("body"))).alias("r"))
        refs = refs.unionByName(body.select("id", "r.kind", "r.value", F.lit("body-regex").alias("source")))
    refs = shared.written(refs.distinct(), "references")
    known = inventory.select(F.col("path").alias("at")).union(inventory.select(F.concat_ws("/", F.regexp_replace("root", "/$", ""), "path"))).distinct()
    clean = F.regexp_replace(F.regexp_replace("value", r"/+$", ""), r"(^|/)(\./)+", "$1")
    out_of = clean.rlike(r"^\.\.(/|$)")
    paths = refs.where("kind = 'path'").withColumn("at", clean).withColumn("out", out_of)
    gone = paths.where("not out").join(known, "at", "left_anti").unionByName(paths.where("out")).select("id", "kind", "value", "source", F.lit("missing").alias("status"))
    word = refs.where("kind = 'symbol'")
    odd = word.where(~F.col("value").rlike(T.SYMBOL_VALUE)).select("id", "kind", "value", "source", F.lit("malformed").alias("status"))
    fine = word.where(F.col("value").rlike(T.SYMBOL_VALUE)).withColumn("word", T.symbol_word(F.col("value")))
    if searchable is None:
        held = symbols.join(inventory.select("root").distinct(), "root", "left_semi").select("word").distinct()
    else:
        held = symbols.where(F.col("root").isin(searchable) if searchable else F.lit(False)).select("word").distinct()
    status = F.lit("no-matches" if some else "skipped")
    lost = fine.join(held, "word", "left_anti").select("id", "kind", "value", "source", status.alias("status"))
    return bad.unionByName(gone).unionByName(odd).unionByName(lost)


def stale_report(references: DataFrame, dates: DataFrame, checked: int, scanned: int) -> DataFrame:
    """One row: references looked at, notes scanned, hits by whether they count against a run (missing, no-matches, malformed), are possibly
    stale by date, or were skipped; and how many notes have any."""
    rows = references.select("id", "status").unionByName(dates.select("id", F.lit("possibly-stale").alias("status")))
    fails = F.col("status").isin("missing", "no-matches", "malformed")
    return rows.agg(
        F.lit(checked).cast("long").alias("refs_checked"), F.lit(scanned).cast("long").alias("scanned"), F.count_if(fails).alias("stale"),
        F.count_if(F.col("status") == "possibly-stale").alias("possibly_stale"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_distinct("id").alias("notes"),
    )


def stale_by_note(references: DataFrame, dates: DataFrame) -> DataFrame:
    """(id, stale, possibly_stale, skipped, hits): the hits of each note that has any, of stale_references() and stale_dates(), as structs
    (status, kind, value, source, age_days) in order; a note is stale if any of its references is missing, matches nothing or is malformed."""
    refs = references.select("id", F.struct("status", "kind", "value", "source", F.lit(None).cast("int").alias("age_days")).alias("hit"))
    old = dates.select("id", F.struct(F.lit("possibly-stale").alias("status"), F.lit("date").alias("kind"), F.col("newest").cast("string").alias("value"), F.lit("date").alias("source"), F.col("age_days").cast("int").alias("age_days")).alias("hit"))
    of = lambda *names: F.count_if(F.col("hit.status").isin(*names))
    return refs.unionByName(old).groupBy("id").agg(of("missing", "no-matches", "malformed").alias("stale"), of("possibly-stale").alias("possibly_stale"), of("skipped").alias("skipped"), F.array_sort(F.collect_list("hit")).alias("hits"))


def inline_stale(notes: DataFrame, inventory: DataFrame, root: str = ".") -> DataFrame:
    """(id, reason) of notes with a declared path that isn't there, in its own root or in the given one; symbols and flags aren't looked at."""
    refs = notes.where("size(verify) > 0").select("id", F.posexplode("verify").alias("n", "r")).where("r.kind = 'path' and r.value is not null")
    at = F.regexp_replace(F.coalesce("r.repoRoot", F.lit(root)), "/$", "")
    refs = refs.select("id", "n", F.col("r.value").alias("value"), F.when(F.col("r.value").startswith("/"), F.col("r.value")).otherwise(F.concat_ws("/", at, "r.value")).alias("full"))
    known = inventory.select(F.concat_ws("/", F.regexp_replace("root", "/$", ""), "path").alias("full")).distinct()
    out = F.col("value").rlike(r"^\.\.(/|$)")
    lost = refs.where(~out).join(known, "full", "left_anti").unionByName(refs.where(out))
    detail = F.when(out, F.concat(F.lit("path '"), "value", F.lit("' escapes repoRoot"))).otherwise(F.concat(F.lit("path '"), "value", F.lit("' not found at "), "full"))
    per = lost.select("id", F.struct("n", detail.alias("d")).alias("d")).groupBy("id").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    every = F.concat(F.size("ds").cast("string"), F.lit(" referenced item(s) missing: "), F.array_join(F.col("ds.d"), "; "))
    return per.select("id", F.when(F.size("ds") == 1, F.get("ds", F.lit(0))["d"]).otherwise(every).alias("reason"))


def dead_links(notes: DataFrame, url_status: DataFrame) -> DataFrame:
    """(id, url, result): ok, missing (4xx), or skipped (5xx, or no answer); url_status (url, status) has what was found out."""
    rows = notes.select("id", F.explode(T.urls(F.col("body"))).alias("url")).join(url_status, "url", "left")
    return rows.select("id", "url", F.when(F.col("status").between(400, 499), "missing").when(F.col("status").isNull() | (F.col("status") >= 500), "skipped").otherwise("ok").alias("result"))


def drift(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """(kind_ord, kind, subject, fixable): the seven kinds of drift between scanned notes (with validation_errors) and an index document's lines.

    Five kinds read the notes and three the links, so both are parsed once and written.
    """
    links = shared.written(C.index_links(lines).select("line_no", "link_no", "target"), "links")
    notes = shared.written(notes.select("file", "name", "description", "validation_errors"), "notes")
    valid = F.size("validation_errors") == 0
    kind = lambda n, name, df, subject, fixable=F.lit(False): df.select(F.lit(n).alias("kind_ord"), F.lit(name).alias("kind"), subject.cast("string").alias("subject"), fixable.alias("fixable"))
    again = links.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("line_no", "link_no"))).where("n > 1")
    low = F.lower(T.trim(F.col("name")))
    same = notes.where(valid & (low != "")).withColumn("n", F.row_number().over(Window.partitionBy(low).orderBy("file"))).where("n > 1")
    faults = notes.select("file", F.explode("validation_errors").alias("fault"))
    parts = [
        kind(1, "length_warning", lines.agg(F.count("*").alias("n")).where(F.col("n") > MAX_LINES), F.col("n")),
        kind(2, "duplicate_entry", again, F.col("target"), F.lit(True)),
        kind(3, "orphan_pointer", links.select("target").distinct().join(notes, F.col("target") == F.col("file"), "left_anti"), F.col("target")),
        kind(4, "missing_pointer", notes.join(links, F.col("target") == F.col("file"), "left_anti"), F.col("file"), valid),
        kind(5, "invalid_frontmatter", faults, F.concat_ws(": ", "file", "fault")),
        kind(6, "description_too_long", notes.where(valid & (T.utf16_length(F.col("description")) > MAX_DESCRIPTION)), F.col("file")),
        kind(7, "duplicate_name", same, F.col("file")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("kind_ord", "subject")


def drift_fix(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """(ord, line): the index without lines whose links are all repeats, and a line for each valid note that it lacks."""
    links = C.index_links(lines).withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("line_no", "link_no")))
    gone = links.groupBy("line_no").agg(F.min("n").alias("n")).where("n > 1")
    kept = lines.join(gone, "line_no", "left_anti").select(F.struct(F.col("line_no").cast("long").alias("a"), F.lit("").alias("b")).alias("ord"), "line")
    new = notes.join(links, F.col("target") == F.col("file"), "left_anti").where("size(validation_errors) = 0")
    line = F.concat(F.lit("- ["), "name", F.lit("]("), "file", F.lit(") — "), "description")
    return kept.unionByName(new.select(F.struct(F.lit(2**40).alias("a"), F.col("file").alias("b")).alias("ord"), line.alias("line")))


def index_text(fixed: DataFrame, eol: str = "\n") -> DataFrame:
    """(content): drift_fix()'s lines as one document, with the end of line that the index had."""
    rows = fixed.agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return rows.select(F.concat(F.array_join(F.col("l.line"), eol), F.lit(eol)).alias("content"))


def failing(report: DataFrame, kind: str) -> bool:
    """Whether a report's run has failed: any drift or unknown topic, a high conflict, or a reference that is missing or malformed."""
    bad = {"drift": "true", "topics": "true", "conflicts": "severity = 'high'", "stale": "status in ('missing', 'no-matches', 'malformed')"}[kind]
    return not report.where(bad).isEmpty()


# ---------------------------------------------------------------- tagging and migration

#: Signals of a critical rule, and commands worth a hint; case is ignored.
CRITICAL = [r"\bnever\b", r"\bmust\s+never\b", r"\bmust\s+not\b", r"\bsilently\s+(drops?|lose?s?|fails?)\b", r"\bdata\s+loss\b", r"\bwill\s+destroy\b", r"\bdestructive\b", r"\bblocker\b", r"\boverwrites?\b"]
COMMAND_HINT = r"(?i)`((?:git\s+(?:push|reset|rebase)\s+[^`]+|rm\s+-rf[^`]+|drop\s+table[^`]+))`"


def tag_proposals(notes: DataFrame, vocabulary: dict = C.VOCABULARY) -> DataFrame:
    """(id, topics, severity, hints): the two best topics of score 3 or more, not for user notes; severity for feedback alone."""
    scores = C.topic_scores(F.col("name"), F.col("description"), F.col("body"), vocabulary)
    order = F.array(*map(F.lit, vocabulary))
    ranked = F.array_sort(F.transform(F.filter(F.map_entries(scores), lambda e: e["value"] >= 3), lambda e: F.struct((-e["value"]).alias("s"), F.array_position(order, e["key"]).alias("o"), e["key"].alias("t"))))
    topics = F.transform(F.slice(ranked, 1, 2), lambda e: e["t"])
    whole = F.concat_ws("\n", "name", "description", "body")
    signals = sum((F.when(T.matches(whole, p, True), 1).otherwise(0) for p in CRITICAL), F.lit(0))
    hints = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(T.java(COMMAND_HINT)), F.lit(1)), T.trim))
    none = F.array().cast("array<string>")
    return notes.select("id", F.when(F.col("type") == "user", none).otherwise(topics).alias("topics"), F.when(F.col("type") == "feedback", F.when(signals >= 2, "critical").otherwise("normal")).alias("severity"), hints.alias("hints"))


def tag_plan(notes: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, add_topics, add_severity, skip): what tagging would add to scanned notes, never a field that a note already has."""
    p = proposals.select("id", F.col("topics").alias("new_topics"), F.col("severity").alias("new_severity"))
    why = F.coalesce("reason", F.lit(""))
    named = F.col("name").isNotNull() & F.col("own_type").isNotNull()
    add_t = named & ~F.col("has_topics") & (F.size("new_topics") > 0)
    add_s = named & ~F.col("has_severity") & F.col("new_severity").isNotNull()
    skip = F.when(why == C.NO_FRONT, "no frontmatter").when(why.startswith(C.NOT_YAML), "YAML parse error").when(~named, "frontmatter missing name/type").when(~add_t & ~add_s, "no new fields to add")
    some = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.col(v))
    return notes.join(p, "id").select("id", some(add_t, "new_topics").alias("add_topics"), some(add_s, "new_severity").alias("add_severity"), skip.alias("skip"))


def _edited(changes: Column, comments: dict[str, str] | None = None) -> Column:
    """A scanned note's source with keys of its frontmatter set; what stands before and after the frontmatter is as it was."""
    before = F.length(F.regexp_extract("source", r"\A---\r?\n", 0))
    after = F.substring(F.col("source"), before + F.length("front") + 1, F.length("source"))
    return F.concat(F.left("source", before), frontmatter.with_keys(F.col("front"), F.to_json(changes, {"ignoreNullFields": "true"}), comments), after)


def tag_apply(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, path, content): the files that tagging rewrites; notes are scan()'s. A blank line stands between frontmatter and body."""
    rows = notes.join(plan.where("skip is null").select("id", "add_topics", "add_severity"), "id")
    text = _edited(F.struct(F.col("add_topics").alias("topics"), F.col("add_severity").alias("severity")))
    eol = F.when(F.col("source").contains("\r\n"), "\r\n").otherwise("\n")
    body = F.regexp_replace("raw_body", r"\A\r?\n", "")
    head = F.regexp_replace(F.left(text, F.length(text) - F.length("raw_body")), r"(?:\r?\n)?\z", "")
    return rows.select("id", "path", F.concat(head, eol, eol, body).alias("content"))


def mapped_topics(id_: Column, rules: list[dict]) -> Column:
    """The topics of the first rule that fits an id; null if none does."""
    out = F.lit(None).cast("array<string>")
    for r in reversed(rules):
        fits = id_ == r["id"] if r.get("id") else id_.startswith(r["prefix"])
        out = F.when(fits, F.array(*map(F.lit, r["topics"]))).otherwise(out)
    return out


def migration_plan(notes: DataFrame, rules: list[dict], vocabulary: dict = C.VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, path, skipped, reason, changed, type, topics, created) of scanned notes: each field kept, set (with its source) or missing.

    keep names further columns of the notes to carry along; with source and front, migrated() needs no join.
    """
    field = lambda action, value, source: F.struct(F.lit(action).alias("action"), value.alias("value"), F.lit(source).cast("string").alias("source"))
    null_s, null_a = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    meta = T.trim(none("meta_type"))
    kind = F.when(T.trim(none("own_type")) != "", field("kept", F.col("own_type"), None)).when(meta.isin(C.TYPES), field("set", meta, "metadata.type")).otherwise(field("missing", null_s, None))
    shape = F.coalesce("own_shape", F.lit("none"))
    mapped, found = mapped_topics(F.col("id"), rules), C.topics_of(F.concat_ws(" ", "name", none("description")), vocabulary)
    blank = shape.rlike(r"^<non-list string: \"\\s*\">$")
    topics = (
        F.when((shape == "list") & (F.size("own_topics") > 0), field("kept", F.col("own_topics"), None)).when(shape.startswith("<") & ~blank, field("kept", null_a, "invalid-shape"))
        .when(F.size("meta_topics") > 0, field("set", F.col("meta_topics"), "metadata.topics")).when(F.size(mapped) > 0, field("set", mapped, "mapping"))
        .when(F.size(found) > 0, field("set", found, "vocabulary-pattern")).otherwise(field("missing", null_a, None))
    )
    created = F.when(T.trim(none("created")) != "", field("kept", F.col("created"), None)).otherwise(field("set", F.date_format("mtime", "yyyy-MM-dd"), "mtime (approx)"))
    # A list has no name for a reader; here it is no object to begin with.
    listed = F.array_contains("validation_errors", "frontmatter is not a YAML mapping")
    reason = F.when(listed, C.NOT_OBJECT).when(F.col("reason").startswith("missing required field 'type'") | F.col("reason").startswith("unknown type"), None).otherwise(F.col("reason"))
    reason = F.when(reason.isNull() & (T.trim(none("name")) == ""), "missing required field 'name'").otherwise(reason)
    rows = notes.select("id", "path", reason.alias("reason"), kind.alias("type"), topics.alias("topics"), created.alias("created"), *keep)
    rows = rows.withColumn("skipped", F.col("reason").isNotNull())
    for c, null in (("type", null_s), ("topics", null_a), ("created", null_s)):
        rows = rows.withColumn(c, F.when(F.col("skipped"), field("missing", null, None)).otherwise(F.col(c)))
    changed = ~F.col("skipped") & ((F.col("type.action") == "set") | (F.col("topics.action") == "set") | (F.col("created.action") == "set"))
    return rows.select("id", "path", "skipped", "reason", changed.alias("changed"), "type", "topics", "created", *keep)


def migration_summary(plan: DataFrame) -> DataFrame:
    """Counts of a plan, and of its notes that need a hand: untagged, without a type, and with topics of a wrong shape."""
    ok = ~F.col("skipped")
    return plan.agg(
        F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.count_if(ok & ~F.col("changed")).alias("unchanged"), F.count_if("skipped").alias("skipped"),
        F.count_if(ok & (F.col("topics.action") == "missing")).alias("untagged"), F.count_if(ok & (F.col("type.action") == "missing")).alias("missing_type"),
        F.count_if(ok & (F.col("topics.source") == "invalid-shape")).alias("bad_shape"),
    )


def migration_lists(plan: DataFrame) -> DataFrame:
    """(list, id): the notes of a plan that changed, that were skipped, and that need a hand: untagged, without a type, with topics of a wrong shape."""
    ok = ~F.col("skipped")
    lists = {
        "changed": F.col("changed"), "skipped": F.col("skipped"), "untagged": ok & (F.col("topics.action") == "missing"), "missing-type": ok & (F.col("type.action") == "missing"),
        "bad-shape": ok & F.coalesce(F.col("topics.source") == "invalid-shape", F.lit(False)),
    }
    named = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in lists.items())))
    return plan.select(F.explode(named).alias("list"), "id")


def migrated(plan: DataFrame) -> DataFrame:
    """(id, path, content): the files that a plan which keeps source and front rewrites; a creation date taken from a file's time says so."""
    value = lambda c: F.when(F.col(f"{c}.action") == "set", F.col(f"{c}.value"))
    text = _edited(F.struct(*(value(c).alias(c) for c in ("type", "topics", "created"))), {"created": "approx (mtime)"})
    return plan.where("changed").select("id", "path", text.alias("content"))


def migration_apply(notes: DataFrame, plan: DataFrame) -> DataFrame:
    """migrated() of a plan without the notes' texts."""
    return migrated(plan.drop("path").join(notes.select("id", "path", "source", "front"), "id"))


def write_files(files: DataFrame, keep: str = "path") -> int:
    """Write (path, content) to local files, each beside the old one and then in its place: for a workspace on the driver, not for a corpus."""
    n = 0
    for r in files.select(keep, "content").toLocalIterator():
        target = Path(re.sub(r"^file:/+", "/", r[keep]))
        if r["content"] is None:
            target.unlink(missing_ok=True)
        else:
            target.parent.mkdir(parents=True, exist_ok=True)
            new = target.with_name(f"{target.name}.{uuid.uuid4().hex}.tmp")
            new.write_text(r["content"], encoding="utf-8", newline="")
            new.replace(target)
        n += 1
    return n


# ---------------------------------------------------------------- all of it


def consolidate(notes: DataFrame, inventory: DataFrame, symbols: DataFrame, now: datetime.datetime, index: DataFrame | None = None, model: str | None = None, threshold: float = 0.95) -> dict:
    """The report over scanned notes, read once: exact groups, empty bodies, near duplicates (or why not), stale references and dates, schema metrics."""
    scanned = shared.written(notes.drop("source", "front"), "scanned")
    loaded = scanned.where("ok")
    refs, dates = stale_references(loaded, inventory, symbols, scan_body=False), stale_dates(loaded, now)
    return {
        "scanned": loaded.count(), "exact": exact_duplicates(loaded), "empty": empty_bodies(loaded), "near": near_report(loaded, index, model, threshold),
        "stale": refs, "stale_dates": dates, "schema": schema_metrics(scanned, lists=True),
    }
