"""The engine's queries, by name, over the shared test tables, and the SQL that must give the same rows.

Documents stand for notes (a kind by language, an age by id), embeddings for their vectors, events for logs and change streams.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import schedule
from notelake.functions import text as T
from notelake.operators import digest, hygiene, retrieval, sync
from notelake.sources import corpus as C
from notelake.sources import index, shared
from notelake.streaming import watch

from . import corpora
from . import values as V

_EVERY = 50


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind() -> F.Column:
    return F.when(F.col("lang") == "en", "feedback").when(F.col("lang") == "de", "project").when(F.col("lang") == "fr", "reference").otherwise("user")


_KIND = "CASE lang WHEN 'en' THEN 'feedback' WHEN 'de' THEN 'project' WHEN 'fr' THEN 'reference' ELSE 'user' END"

#: Topics over the tables' words; the built-in vocabulary's words hardly occur in them.
_VOCABULARY = {"common": [(r"\bthe\b", True), (r"\band\b", True)], "german": [(r"\bder\b", True)], "french": [(r"\bles?\b", True)], "secrets": [(r"\bpassword\b", True), (r"\btoken\b", True)], "licence": [(r"\blicense\b", True)]}


def _sql_topics(c: str) -> str:
    parts = [f"CASE WHEN {' OR '.join(f"regexp_matches({c}, '(?i){p}')" for p, _ in ps)} THEN '{t}' END" for t, ps in _VOCABULARY.items()]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _notes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("note "), "doc_id").alias("name"), F.lit("").alias("description"), F.col("text").alias("body"), _kind().alias("type"),
        C.topics_of(F.col("text"), _VOCABULARY).alias("topics"), (F.col("doc_id") % 90).cast("double").alias("age_days"), F.col("doc_id").alias("load_ord"),
    )


def exact_duplicates(spark, sf_dir):
    return hygiene.exact_duplicates(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))).select("hash", "n", "first", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def near_duplicates(spark, sf_dir):
    rows = hygiene.near_duplicates(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.4)
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"))


def topics(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", F.array_join("topics", ",").alias("topics"))


def _queries(spark, sf_dir) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding").where(F.col("qid") % _EVERY == 0)
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("prompt"))
    return vectors.join(docs, "qid")


def knn(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.topk(e.where(F.col("id") % _EVERY == 0).withColumnRenamed("id", "qid"), e, 5).select("qid", "id", F.round("sim01", 6).alias("sim01"), "rank")


def knn_join(spark, sf_dir):
    """Each vector's nearest, itself among them."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.topk(e.withColumnRenamed("id", "qid"), e, 4).select("qid", "id", F.round("sim01", 6).alias("sim01"), "rank")


def blend_resolve(spark, sf_dir):
    """The flagship: similar notes, topics, recency and type in one score, five notes for each query."""
    queries = _queries(spark, sf_dir)
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    similar = retrieval.topk(queries, vectors, 5)
    found = retrieval.blend(queries, _notes(spark, sf_dir), similar, 0.6, vocabulary=_VOCABULARY)
    return found.select("qid", "id", "gate", F.round("score", 6).alias("score"), "rank")


def confidence_resolve(spark, sf_dir):
    queries = _queries(spark, sf_dir)
    similar = retrieval.topk(queries, _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 5)
    return retrieval.confidence_resolve(queries, similar).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def evaluation(spark, sf_dir):
    """Precision, recall and MRR where a query should find the vectors of its own label among ids that follow it; every seventh is a control."""
    queries = _queries(spark, sf_dir)
    similar = retrieval.topk(queries, _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 5).where("sim01 >= 0.6").withColumn("gate", F.lit("confidence"))
    golden = queries.select("qid", F.when(F.col("qid") % 7 == 3, F.array().cast("array<bigint>")).otherwise(F.array("qid", F.col("qid") + 1)).alias("expect"))
    m = retrieval.aggregate_metrics(retrieval.prompt_metrics(golden, similar))
    return m.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "negative_rate")), "positives", "negatives", "negatives_passed", "semantic_prompts")


def ambiguity(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.ambiguity(F.col("text")).alias("a"))
    return rows.select("conv_id", "turn", F.round("a", 6).alias("ambiguity"), F.round(T.confidence_threshold(F.col("a")), 6).alias("threshold"))


def polarity(spark, sf_dir):
    line = T.first_line(F.concat(F.element_at(F.array(*map(F.lit, _DIRECTIVES)), (F.col("turn") % len(_DIRECTIVES) + 1).cast("int")), "text"))
    lines = shared.written(_t(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")), "lines")  # read once, looked at by many patterns
    return lines.select("conv_id", "turn", T.polarity(F.col("line")).alias("polarity"))


_DIRECTIVES = ["", "ALWAYS ", "never do ", "You must ", "Code is mandatory: never ", "avoid it, ", "You cannot "]


def digest_by_type(spark, sf_dir):
    logs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.lit("2026-01-01").cast("date").alias("date"), F.col("text").alias("content"))
    return digest.by_type(digest.insights(logs)).select("type", "n", F.round("mean_importance", 6).alias("mean_importance"))


def digest_top(spark, sf_dir):
    logs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.lit("2026-01-01").cast("date").alias("date"), F.col("text").alias("content"))
    return digest.top_insights(digest.insights(logs)).select("source", "line_no", F.round("importance", 6).alias("importance"), "type")


def _versions(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("notes/"), "doc_id").alias("path"), "doc_id", F.col("text").alias("content"))
    edit = lambda by: lambda c: F.when(F.col("doc_id") % by == 1, F.concat(c, F.lit(f"\nadded {by}"))).when(F.col("doc_id") % by == 2, F.lit(f"new {by}")).otherwise(c)
    base = d.where("doc_id % 11 <> 5").select("path", "content")
    local = d.where("doc_id % 13 <> 6").select("path", edit(3)(F.col("content")).alias("content"))
    remote = d.where("doc_id % 17 <> 7").select("path", edit(4)(F.col("content")).alias("content"))
    return base, local, remote


def pull_plan(spark, sf_dir):
    return sync.pull_plan(*_versions(spark, sf_dir)).select("path", F.sha2(F.coalesce("content", F.lit("<none>")), 256).alias("content"), "status", "conflict", "action")


def push_summary(spark, sf_dir):
    plan = sync.push_plan(*_versions(spark, sf_dir))
    return plan.groupBy("status", "action").agg(F.count("*").alias("n"))


def sessions(spark, sf_dir):
    return watch.session_counts(_t(spark, sf_dir, "events").select("user_id", "ts"), "1 hour", ["user_id"])


def failure_streaks(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("value") >= 50).alias("ok"))
    return sync.streaks(e)


def overdue_failures(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("value") >= 20).alias("ok"))
    now = e.agg(F.max("ts")).first()[0]
    return sync.overdue(e, 86_400, F.lit(now))


def next_ticks(spark, sf_dir):
    ticks = schedule.parse("5/20 * * * *")[0]
    return _t(spark, sf_dir, "events").select("event_id", schedule.next_minute_tick(F.col("ts"), ticks).alias("next"))


def tag_proposals(spark, sf_dir):
    rows = hygiene.tag_proposals(_notes(spark, sf_dir), _VOCABULARY)
    return rows.select("id", F.array_join("topics", ",").alias("topics"), "severity")


def conflicts_all_turns(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    lead = F.when(F.col("turn") % 2 == 0, "ALWAYS ").otherwise("NEVER ")
    notes = c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.lit("feedback").alias("type"), F.concat(lead, "text").alias("body"), F.array(F.concat(F.lit("t"), F.col("conv_id").cast("string"))).alias("topics"))
    return hygiene.conflicts(notes, opposite_only=True).select("a", "b", "topic", F.round("overlap", 6).alias("overlap"), "severity")


def index_changes(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    held = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("mtime"))
    notes = e.where("vec_id % 6 <> 0").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("vec_id") % 7).cast("long").alias("mtime"))
    new, gone = index.changes(held, notes)
    return new.select("id", F.lit("embed").alias("change")).unionByName(gone.select("id", F.lit("remove").alias("change")))


def cache_eviction(spark, sf_dir):
    """The ten prompts that were asked last, through the cache itself: each day's users ask, in order."""
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("accessed_at"))
    held = e.select(F.sha2(F.col("user_id").cast("string"), 256).alias("prompt_sha"), F.lit("m").alias("model"), F.array(F.lit(0.0).cast("float")).alias("embedding"), "accessed_at")
    last = e.agg(F.max("accessed_at")).first()[0]
    none = e.limit(0).select(F.col("user_id").cast("string").alias("prompt"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    kept = index.cache_put(held, none, last, "m", 10)
    return e.join(kept.select("prompt_sha"), F.sha2(F.col("user_id").cast("string"), 256) == F.col("prompt_sha")).select("user_id", "accessed_at")


def iso_dates(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", T.iso_dates(F.concat(F.lit("due "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" not 2026-02-30"))).alias("d"))
    return rows.select("event_id", F.size("d").cast("long").alias("n"), F.array_max("d").alias("newest"))


_NAMES = [
    exact_duplicates, near_duplicates, topics, knn, knn_join, blend_resolve, confidence_resolve, evaluation, ambiguity, polarity, digest_by_type, digest_top, pull_plan,
    push_summary, sessions, failure_streaks, overdue_failures, next_ticks, tag_proposals, conflicts_all_turns, index_changes, cache_eviction, iso_dates,
]


def queries():
    return {f.__name__: f for f in _NAMES} | corpora.queries()


_V = "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"
_KNN = f"""v AS ({_V}), q AS (SELECT v.id AS qid, e, text AS prompt FROM v JOIN documents d ON d.doc_id = v.id WHERE v.id % {_EVERY} = 0),
    k AS (SELECT * FROM (SELECT qid, id, prompt, greatest(0, (1 + list_cosine_similarity(q.e, v.e)) / 2) AS s,
          row_number() OVER (PARTITION BY qid ORDER BY greatest(0, (1 + list_cosine_similarity(q.e, v.e)) / 2) DESC, id) AS rank FROM q, v) WHERE rank <= 5)"""
_AMBIGUITY = r"""greatest(0.0, least(1.0, 0.5 + CASE WHEN regexp_matches(text, '(?:[\w.-]+/[\w./-]+|\b[\w-]+\.[a-z]{1,5}\b)') THEN -0.2 ELSE 0 END
    + CASE WHEN regexp_matches(text, '(?i)\b(function|class|method|file|test|spec|module|config|component|route|endpoint|schema|migration|commit|branch|PR|hook|gate)\b') THEN -0.2 ELSE 0 END
    + CASE WHEN regexp_matches(text, '(?i)\b(fix|add|remove|rename|refactor|update|delete|implement|write|create|bump|upgrade|migrate|extract|inline|move)\b') THEN -0.1 ELSE 0 END
    + CASE WHEN regexp_matches(text, '(?i)\b(check|schau|look|see|mal|irgendwie|kannst\s+du|can\s+you|überprüf)') THEN 0.3 ELSE 0 END
    + CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 5 THEN 0.2 ELSE 0 END))"""
_LINES = """lines AS (SELECT doc_id AS source, i - 1 AS line_no, regexp_replace(regexp_replace(l[i], '^\\s+', ''), '\\s+$', '') AS text FROM
    (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    kept AS (SELECT *, least(1.0, 0.3 + {imp}) AS importance, {kind} AS type FROM lines WHERE length(text) >= 10 AND NOT starts_with(text, '#') AND NOT starts_with(text, '---'))""".format(
    imp=" + ".join([f"CASE WHEN contains(text, '{m}') THEN {by} ELSE 0 END" for ms, by in V.IMPORTANCE for m in ms] + ["CASE WHEN length(text) > 100 THEN 0.1 ELSE 0 END", "CASE WHEN length(text) > 200 THEN 0.1 ELSE 0 END"]),
    kind="CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{m.lower()}')" for m in ms)} THEN '{k}'" for k, ms in V.LINE_TYPES.items()) + " ELSE 'insight' END",
)
_EDIT = lambda n: f"CASE WHEN doc_id % {n} = 1 THEN text || chr(10) || 'added {n}' WHEN doc_id % {n} = 2 THEN 'new {n}' ELSE text END"
_MERGE = f"""d AS (SELECT 'notes/' || doc_id AS path, * FROM documents),
    x AS (SELECT coalesce(b.path, l.path, r.path) AS path, b.c AS b, l.c AS l, r.c AS r, l.path AS lp, b.path AS bp FROM (SELECT path, text AS c FROM d WHERE doc_id % 11 <> 5) b
        FULL JOIN (SELECT path, {_EDIT(3)} AS c FROM d WHERE doc_id % 13 <> 6) l ON l.path = b.path
        FULL JOIN (SELECT path, {_EDIT(4)} AS c FROM d WHERE doc_id % 17 <> 7) r ON r.path = coalesce(b.path, l.path)),
    s AS (SELECT *, substr(l, length(b) + 1) AS mine, substr(r, length(b) + 1) AS theirs FROM x),
    m AS (SELECT *, CASE WHEN l IS NOT DISTINCT FROM r THEN 'unchanged' WHEN l IS NOT DISTINCT FROM b THEN 'remote' WHEN r IS NOT DISTINCT FROM b THEN 'local'
            WHEN starts_with(l, b) AND starts_with(r, b) THEN 'merged' ELSE 'conflict' END AS status FROM s),
    o AS (SELECT *, CASE status WHEN 'unchanged' THEN l WHEN 'remote' THEN r WHEN 'local' THEN l
            WHEN 'merged' THEN CASE WHEN contains(mine, theirs) THEN l WHEN contains(theirs, mine) THEN r ELSE b || theirs || mine END
            ELSE '<<<<<<< local' || chr(10) || coalesce(l, '') || chr(10) || '=======' || chr(10) || coalesce(r, '') || chr(10) || '>>>>>>> remote' END AS c,
            status = 'conflict' AS conflict FROM m)"""


#: Patterns with a look-ahead are searched for in texts without what it excludes.
_ANY = lambda c, patterns: "(" + " OR ".join(f"regexp_matches({_without(c, p)}, '{'(?i)' if i else ''}{_plain(p)}')" for p, i in patterns) + ")"
_SQUOTE = lambda p: p.replace("'", "''")


def _plain(pattern: str) -> str:
    return _SQUOTE(re.sub(r"\(\?![^)]*\)", "", pattern))


def _without(column: str, pattern: str) -> str:
    found = re.search(r"\(\?!([^)]*)\)", pattern)
    return column if not found else f"regexp_replace({column}, '(?i)\\b{re.match(r'.b([A-Za-z]+)', pattern)[1]}{found[1]}', '', 'g')" if pattern.islower() else f"regexp_replace({column}, '\\b{re.match(r'.b([A-Za-z]+)', pattern)[1]}{found[1]}', '', 'g')"


_POLARITY = rf"""WITH a AS (SELECT conv_id, turn, ['', 'ALWAYS ', 'never do ', 'You must ', 'Code is mandatory: never ', 'avoid it, ', 'You cannot '][turn % 7 + 1] || text AS body FROM conversations),
    b AS (SELECT conv_id, turn, trim(regexp_extract(body, '^\s*([^\n]*)', 1)) AS l FROM a), c AS (SELECT conv_id, turn, CASE WHEN length(l) > 200 THEN left(l, 200) || '...' ELSE l END AS x FROM b),
    d AS (SELECT *, array_to_string(list_slice(regexp_split_to_array(x, '\s+'), 1, 2), ' ') AS w FROM c), e AS (SELECT *, substr(x, length(w) + 1) AS rest FROM d),
    f AS (SELECT conv_id, turn, {_ANY("x", V.POSITIVE)} AS p, {_ANY("x", V.NEGATIVE)} AS n, {_ANY("w", V.POSITIVE + V.LEADING_POSITIVE)} AS lp, {_ANY("w", V.NEGATIVE + V.LEADING_NEGATIVE)} AS ln,
        {_ANY("rest", V.LEADING_POSITIVE)} AS rp, {_ANY("rest", V.LEADING_NEGATIVE)} AS rn FROM e)
    SELECT conv_id, turn, CASE WHEN lp AND ln THEN 'mixed' WHEN lp THEN CASE WHEN n OR rn THEN 'mixed' ELSE 'positive' END WHEN ln THEN CASE WHEN p OR rp THEN 'mixed' ELSE 'negative' END
        WHEN p AND n THEN 'mixed' WHEN p THEN 'positive' WHEN n THEN 'negative' END AS polarity FROM f"""
_COUNTS = ", ".join(f"{{'s': -({' + '.join(f"len(regexp_extract_all(text, '(?i){p}'))" for p, _ in ps)}), 'o': {i}, 't': '{t}'}}" for i, (t, ps) in enumerate(_VOCABULARY.items()))
_TAGS = f"""WITH s AS (SELECT doc_id AS id, {_KIND} AS type, list_sort(list_filter([{_COUNTS}], lambda x: x.s <= -3)) AS l, {" + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN 1 ELSE 0 END" for p in V.CRITICAL)} AS c FROM documents)
    SELECT id, CASE WHEN type = 'user' THEN '' ELSE array_to_string(list_transform(list_slice(l, 1, 2), lambda x: x.t), ',') END AS topics, CASE WHEN type = 'feedback' THEN CASE WHEN c >= 2 THEN 'critical' ELSE 'normal' END END AS severity FROM s"""


def oracle_sql():
    return corpora.oracle_sql() | {
        "polarity": _POLARITY, "tag_proposals": _TAGS,
        "exact_duplicates": r"""SELECT hash, count(*) AS n, min(id) AS first, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM
            (SELECT doc_id AS id, sha256(b) AS hash FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS b FROM documents) WHERE b <> '') GROUP BY hash HAVING count(*) > 1""",
        "near_duplicates": f"""WITH v AS ({_V}) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.4""",
        "topics": f"SELECT doc_id AS id, array_to_string({_sql_topics('text')}, ',') AS topics FROM documents",
        "knn": f"""WITH v AS ({_V}) SELECT qid, id, round(s, 6) AS sim01, CAST(rank AS INTEGER) AS rank FROM (SELECT q.id AS qid, v.id, greatest(0, (1 + list_cosine_similarity(q.e, v.e)) / 2) AS s,
            row_number() OVER (PARTITION BY q.id ORDER BY greatest(0, (1 + list_cosine_similarity(q.e, v.e)) / 2) DESC, v.id) AS rank FROM v q, v WHERE q.id % {_EVERY} = 0) WHERE rank <= 5""",
        "knn_join": f"""WITH v AS ({_V}), s AS (SELECT q.id AS qid, v.id, greatest(0, (1 + list_cosine_similarity(q.e, v.e)) / 2) AS s FROM v q, v)
            SELECT qid, id, round(s, 6) AS sim01, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 4""",
        "blend_resolve": f"""WITH {_KNN}, n AS (SELECT doc_id AS id, {_sql_topics('text')} AS t, {_KIND} AS type, doc_id % 90 AS age FROM documents),
            sem AS (SELECT qid, id, s FROM k WHERE s >= 0.6), asked AS (SELECT qid, {_sql_topics('prompt')} AS t FROM q),
            topic AS (SELECT qid, n.id FROM asked JOIN n ON list_has_any(asked.t, n.t)), speak AS (SELECT DISTINCT qid FROM sem),
            b AS (SELECT coalesce(sem.qid, topic.qid) AS qid, coalesce(sem.id, topic.id) AS id, s, topic.id IS NOT NULL AS hit FROM sem FULL JOIN (SELECT * FROM topic WHERE qid IN (SELECT qid FROM speak)) topic ON sem.qid = topic.qid AND sem.id = topic.id),
            r AS (SELECT qid, b.id, CASE WHEN s IS NULL THEN 'topic' ELSE 'confidence' END AS gate, coalesce(s, 0) + CASE WHEN hit THEN 0.05 ELSE 0 END
                + 0.03 * CASE type WHEN 'feedback' THEN 1 WHEN 'project' THEN 0.5 WHEN 'reference' THEN 0.25 ELSE 0 END + 0.05 * pow(0.5, age / 30.0) AS score FROM b JOIN n ON n.id = b.id
                UNION ALL SELECT qid, id, 'topic', 1.0 FROM topic WHERE qid NOT IN (SELECT qid FROM speak))
            SELECT qid, id, gate, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 5""",
        "confidence_resolve": f"""WITH {_KNN}, t AS (SELECT qid, greatest(0, 0.85 - 0.35 * {_AMBIGUITY}) AS th FROM (SELECT qid, trim(prompt) AS text FROM q))
            SELECT qid, id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT k.qid, id, s, row_number() OVER (PARTITION BY k.qid ORDER BY s DESC, id) AS rank FROM k JOIN t ON t.qid = k.qid WHERE s >= th) WHERE rank <= 3""",
        "evaluation": f"""WITH {_KNN}, g AS (SELECT q.qid, CASE WHEN q.qid % 7 = 3 THEN [] ELSE [q.qid, q.qid + 1] END AS ex, coalesce(list(k.id ORDER BY k.rank) FILTER (k.s >= 0.6), []) AS got FROM q LEFT JOIN k ON k.qid = q.qid GROUP BY q.qid),
            m AS (SELECT *, len(ex) = 0 AS neg, len(list_intersect(got, ex)) AS rel, list_min(list_filter(list_transform(ex, lambda e: list_position(got, e)), lambda p: p > 0)) AS first FROM g)
            SELECT round(coalesce(avg(CASE WHEN len(got) > 0 THEN rel / len(got) ELSE 0 END) FILTER (NOT neg), 0), 6) AS precision, round(coalesce(avg(rel / len(ex)) FILTER (NOT neg), 0), 6) AS recall,
                round(coalesce(avg(coalesce(1.0 / first, 0)) FILTER (NOT neg), 0), 6) AS mrr, round(CASE WHEN count(*) FILTER (neg) > 0 THEN count(*) FILTER (neg AND len(got) = 0) / count(*) FILTER (neg) END, 6) AS negative_rate,
                count(*) FILTER (NOT neg) AS positives, count(*) FILTER (neg) AS negatives, count(*) FILTER (neg AND len(got) = 0) AS negatives_passed, count(*) FILTER (len(got) > 0) AS semantic_prompts FROM m""",
        "ambiguity": f"SELECT conv_id, turn, round(CAST(a AS DOUBLE), 6) AS ambiguity, round(CAST(greatest(0, 0.85 - a * 0.35) AS DOUBLE), 6) AS threshold FROM (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 1.0 ELSE {_AMBIGUITY} END AS a FROM (SELECT conv_id, turn, trim(text) AS text FROM conversations))",
        "digest_by_type": f"WITH {_LINES} SELECT type, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM kept GROUP BY type",
        "digest_top": f"WITH {_LINES} SELECT source, CAST(line_no AS INTEGER) AS line_no, round(CAST(importance AS DOUBLE), 6) AS importance, type FROM kept ORDER BY round(importance, 9) DESC, source, line_no LIMIT 50",
        "pull_plan": f"""WITH {_MERGE} SELECT path, sha256(coalesce(c, '<none>')) AS content, status, conflict,
            CASE WHEN c IS NOT DISTINCT FROM l AND NOT conflict THEN 'none' WHEN conflict THEN 'conflict' WHEN c IS NULL THEN 'deleted' WHEN status = 'merged' THEN 'merged' ELSE 'applied' END AS action FROM o""",
        "push_summary": f"""WITH {_MERGE} SELECT status, action, count(*) AS n FROM (SELECT status, CASE WHEN c IS NOT DISTINCT FROM r THEN 'none' WHEN c IS NULL THEN 'deleted' ELSE 'written' END AS action FROM o WHERE lp IS NOT NULL OR bp IS NOT NULL) GROUP BY status, action""",
        "sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, g""",
        "failure_streaks": """WITH e AS (SELECT user_id AS key, ts, value >= 50 AS ok, sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
            SELECT key, min(ts) AS start, max(ts) AS last, count(*) AS failures FROM e WHERE NOT ok GROUP BY key, g""",
        "overdue_failures": """WITH e AS (SELECT user_id AS key, ts, value >= 20 AS ok, sum(CASE WHEN value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g,
                min(CASE WHEN value >= 20 THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS till FROM events)
            SELECT key, min(ts) AS start, min(ts) + INTERVAL 1 DAY AS ts FROM e WHERE NOT ok GROUP BY key, g HAVING coalesce(min(till), (SELECT max(ts) FROM events)) - min(ts) >= INTERVAL 1 DAY""",
        "next_ticks": "SELECT event_id, date_trunc('hour', ts) + to_minutes(CASE WHEN minute(ts) < 5 THEN 5 WHEN minute(ts) < 25 THEN 25 WHEN minute(ts) < 45 THEN 45 ELSE 65 END) AS next FROM events",
        "conflicts_all_turns": r"""WITH n AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(left(CASE turn % 2 WHEN 0 THEN 'ALWAYS ' ELSE 'NEVER ' END || split_part(text, chr(10), 1), 200)), '[^a-z0-9\s'']', ' ', 'g'), '\s+'),
                lambda w: length(w) >= 4 AND NOT w IN ('always', 'never'))) AS t FROM conversations),
            p AS (SELECT CAST(a.conv_id * 1000000 + least(a.turn, b.turn) AS BIGINT) AS a, CAST(a.conv_id * 1000000 + greatest(a.turn, b.turn) AS BIGINT) AS b, 't' || a.conv_id AS topic,
                len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(a.t || b.t))) AS overlap FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn % 2 = 0 AND b.turn % 2 <> 0)
            SELECT a, b, topic, round(overlap, 6) AS overlap, CASE WHEN overlap >= 0.15 THEN 'high' ELSE 'info' END AS severity FROM p""",
        "index_changes": """WITH h AS (SELECT vec_id AS id, vec_id % 7 AS m FROM embeddings WHERE vec_id % 5 <> 0), n AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE vec_id % 7 END AS m FROM embeddings WHERE vec_id % 6 <> 0)
            SELECT id, 'embed' AS change FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = n.id AND h.m = n.m) UNION ALL SELECT id, 'remove' FROM h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = h.id)""",
        "cache_eviction": "SELECT user_id, max(ts) AS accessed_at FROM events GROUP BY user_id ORDER BY accessed_at DESC, user_id LIMIT 10",
        "iso_dates": "SELECT event_id, CAST(1 AS BIGINT) AS n, CAST(ts AS DATE) AS newest FROM events",
    }
