"""Files, state and indexes: what the tables can't hold."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from notelake import api
from notelake.operators import hygiene, retrieval, sync
from notelake.sources import corpus as C
from notelake.sources import index
from notelake.sources.state import Store

NOW = datetime.datetime(2026, 3, 1, 12)


def note(folder, name, front, body="text"):
    (folder / f"{name}.md").write_text(f"---\n{front}\n---\n{body}\n" if front is not None else body)


@pytest.fixture
def folder(tmp_path):
    note(tmp_path, "Zulu", "name: Zulu\ndescription: last\ntype: feedback\ntopics: [workflow]\nupdatedAt: 2026-02-27", "ALWAYS rebase before 2020-01-01")
    note(tmp_path, "alpha", "name: alpha\ndescription: first\ntype: feedback\ntopics: [workflow, testing]\ntriggers:\n  tools: [Edit]\n  command_pattern: git push", "NEVER rebase; see `src/a.ts`")
    note(tmp_path, "legacy", "name: legacy\nmetadata:\n  type: project\n  topics: [testing]", "  same Body\n")
    note(tmp_path, "copy", "name: copy\ntype: reference\nverify:\n- {kind: path, value: src/gone.ts}\n- nonsense\n- {kind: flag, value: x}", "same   body")
    note(tmp_path, "none", None, "no frontmatter")
    note(tmp_path, "bad", "name: [")
    (tmp_path / "MEMORY.md").write_text("- [Zulu](Zulu.md) — last\r\n- [Zulu](Zulu.md) — again\r\n- [x](gone.md) - [alpha](alpha.md): two\r\n- [no](a b.md)\r\n")
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


def test_scan(spark, folder):
    rows = C.scan(spark, str(folder)).orderBy("load_ord").collect()
    assert [r["id"] for r in rows] == ["Zulu", "alpha", "bad", "copy", "legacy", "none"]
    why = {r["id"]: r["reason"] for r in rows}
    assert why["none"] == C.NO_FRONT and why["bad"].startswith(C.NOT_YAML) and why["Zulu"] is None
    kept = {r["id"]: r for r in C.load(spark, str(folder)).collect()}
    assert set(kept) == {"Zulu", "alpha", "copy", "legacy"} and kept["legacy"]["type"] == "project" and kept["legacy"]["topics"] == ["testing"]
    assert C.scan(spark, str(folder / "missing")).count() == 0
    with pytest.raises(ValueError):
        C.strict_scan(spark, str(folder / "missing"))
    strict = {r["id"]: r["validation_errors"] for r in C.strict_scan(spark, str(folder)).collect()}
    assert strict["Zulu"] == [] and strict["legacy"] == ["missing required field(s): description, type"]


def test_index_document(spark, folder):
    lines = C.index_lines(spark.createDataFrame([((folder / "MEMORY.md").read_bytes().decode(),)], "content string"))
    assert [(r["line_no"], r["eol"]) for r in lines.orderBy("line_no").collect()] == [(i, "\r\n") for i in range(1, 5)]
    links = [tuple(r) for r in C.index_links(lines).orderBy("line_no", "link_no").collect()]
    assert links == [(1, 0, "Zulu", "Zulu.md", "last"), (2, 0, "Zulu", "Zulu.md", "again"), (3, 0, "x", "gone.md", "[alpha](alpha.md): two"), (3, 1, "alpha", "alpha.md", "two")]
    notes = C.strict_scan(spark, str(folder))
    found = {(r["kind"], r["subject"].split(":")[0]) for r in hygiene.drift(notes, lines).collect()}
    assert {("duplicate_entry", "Zulu.md"), ("orphan_pointer", "gone.md"), ("missing_pointer", "legacy.md")} <= found and ("missing_pointer", "alpha.md") not in found
    text = hygiene.index_text(hygiene.drift_fix(lines, notes), "\r\n").first()["content"]
    assert text.count("Zulu.md") == 1 and text.endswith("\r\n") and "[no](a b.md)" in text
    assert hygiene.failing(hygiene.drift(notes, lines), "drift")


def test_tagging_and_migration_write_files(spark, folder):
    notes = C.scan(spark, str(folder))
    proposals = hygiene.tag_proposals(notes)
    files = {r["id"]: r["content"] for r in hygiene.tag_apply(notes, hygiene.tag_plan(notes, proposals)).collect()}
    assert "severity: normal" in files["Zulu"] and files["Zulu"].startswith("---\nname: Zulu\n") and files["Zulu"].endswith("\n---\n\nALWAYS rebase before 2020-01-01\n")
    plan = hygiene.migration_plan(notes, [{"id": "copy", "prefix": None, "topics": ["workflow"]}])
    out = hygiene.migration_apply(notes, plan)
    text = {r["id"]: r["content"] for r in out.collect()}
    assert "type: project" in text["legacy"] and "# approx (mtime)" in text["legacy"] and "topics:\n  - workflow" in text["copy"]
    assert hygiene.write_files(out) == 4
    again = hygiene.migration_plan(C.scan(spark, str(folder)), [])
    assert hygiene.migration_summary(again).first().asDict() | {"total": 6} == {"total": 6, "changed": 0, "unchanged": 4, "skipped": 2, "untagged": 0, "missing_type": 0, "bad_shape": 0}


def test_consolidate(spark, folder):
    notes = C.scan(spark, str(folder))
    inventory = spark.createDataFrame([("/r", "src/a.ts")], "root string, path string")
    symbols = spark.createDataFrame([], "root string, word string")
    r = hygiene.consolidate(notes, inventory, symbols, NOW)
    assert r["scanned"] == 4 and [x["ids"] for x in r["exact"].collect()] == [["copy", "legacy"]] and r["near"]["status"] == "skipped"
    assert {(x["id"], x["status"]) for x in r["stale"].collect()} == {("copy", "missing"), ("copy", "malformed")}
    assert r["stale_dates"].count() == 0  # updatedAt is recent
    schema = r["schema"].first()
    assert (schema["rejected"], schema["legacy_ids"], schema["untagged_ids"]) == (2, ["legacy"], ["copy"])
    from notelake.operators import report

    assert "exact duplicates:\n  copy, legacy" in report.consolidation(r) and report.as_json({"schema": r["schema"], "n": 1}).startswith("{")
    assert "copy" in report.stale(r["stale"]) and "drift" in report.as_yaml({"drift": 1})
    near = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [1.0, 0.01]), (3, "old", [1.0, 0.0])], "id long, model string, embedding array<float>")
    got = hygiene.near_report(near.select("id"), near, "m")
    assert (got["status"], got["indexed"], got["total"], got["stale_model_rows"], got["pairs"].count()) == ("ok", 2, 3, 1, 1)


def test_conflicts_with_embeddings(spark):
    notes = spark.createDataFrame([(1, "feedback", "a", "", "ALWAYS squash before merge", ["w"]), (2, "feedback", "b", "", "NEVER fold history together", ["w"]), (3, "feedback", "c", "", "plain words", ["w"])], "id long, type string, name string, description string, body string, topics array<string>")
    same = lambda texts: texts.select("id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    assert {(r["a"], r["b"]): r["severity"] for r in hygiene.conflicts(notes).collect()} == {(1, 2): "info", (1, 3): "info", (2, 3): "info"}
    up = {(r["a"], r["b"]): (r["severity"], r["reason"]) for r in hygiene.conflicts_with_embeddings(notes, same).collect()}
    assert up[1, 2][0] == "high" and "100%" in up[1, 2][1] and up[1, 3][0] == "info"
    assert hygiene.conflicts_with_embeddings(notes, None).where("severity = 'high'").count() == 0


def test_daily_logs_and_workspace(spark, tmp_path):
    for name in ("2026-02-28", "2026-02-01", "2026-02-30", "notes"):
        (tmp_path / f"{name}.md").write_text(name)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "2026-02-27.md").write_text("x")
    logs = C.log_scan(C.daily_logs(spark, str(tmp_path), NOW))
    assert [r["file"] for r in logs["files"].collect()] == ["2026-02-28.md"] and logs["errors"].count() == 1 and logs["total"].first()[0] == 3
    assert [r["file"] for r in C.daily_logs(spark, str(tmp_path), NOW, recursive=True).where("in_range").collect()] == ["2026-02-28.md", "2026-02-27.md"]
    root = tmp_path / "w"
    for path in ("mine/a.md", "mine/.git/x", "mine/deep/b.md", "one.md", "own/me.json", "own/peer.json"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    config = [{"source": "mine", "destination": "notes", "kind": "directory"}, {"source": "one.md", "destination": "x/1.md", "kind": "file"}, {"source": "own", "kind": "directory", "ownerScoped": True}, {"source": "absent", "kind": "directory"}]
    paths = lambda *a: [r["path"] for r in C.workspace(spark, str(root), *a).collect()]
    assert paths(config) == ["notes/a.md", "notes/deep/b.md", "own/me.json", "own/peer.json", "x/1.md"]
    assert paths(config, "me")[2:] == ["own/me.json", "x/1.md"]
    said = []
    assert paths(config, "nobody", said) == ["notes/a.md", "notes/deep/b.md", "x/1.md"] and len(said) == 1
    assert len(paths()) == 5
    with pytest.raises(ValueError):
        C.workspace(spark, str(root), [{"source": "absent", "required": True}])


def test_vocabulary_golden_mapping(tmp_path):
    at = lambda text: (tmp_path / "f.yml").write_text(text) and str(tmp_path / "f.yml")
    assert C.load_vocabulary(None).source == "default" and C.load_vocabulary(str(tmp_path / "no")).source == "default"
    v = C.load_vocabulary(at("- name: a\n  patterns: ['x+', '(a+)+', '[']\n- name: c++\n"))
    assert v.source == "custom" and v.topics["a"][0] == ("x+", True) and v.topics["a"][1] == v.topics["a"][2] and v.topics["c++"][0][0].endswith("(?![A-Za-z0-9_])")
    for bad in ("[]", "x: 1", "- {patterns: [a]}", "- name: a\n- name: a", "- name: a\n  description: 1", "- name: [", "- name: a\n  patterns: x"):
        assert C.load_vocabulary(at(bad)).error
        with pytest.raises(Exception):
            C.load_vocabulary(at(bad), strict=True)
    assert C.load_golden(at("prompts:\n- prompt: p\n  expect: [a, b, a]\n- prompt: q\n")) == [(0, "p", ["a", "b"]), (1, "q", [])]
    assert C.load_mapping(at("- id: a\n  topics: [' x ']\n- prefix: b\n  topics: [y, z]\n"))[0]["topics"] == ["x"]
    for bad in ("- id: a\n  prefix: b\n  topics: [x]", "- id: a\n  topics: []", "- topics: [x]", "x"):
        with pytest.raises(ValueError):
            C.load_mapping(at(bad))
    with pytest.raises(ValueError):
        C.load_golden(at("prompts: []"))


def test_state(spark, tmp_path):
    s = Store(spark, str(tmp_path), "me")
    assert s.load_state()["last_remote_head"] is None and s.base().count() == 0 and s.queue() == [] and s.head() is None
    s.save_state({"last_remote_head": "x"})
    s.save_state({"last_remote_head": "y"})
    assert s.load_state() == {"last_remote_head": "y"}
    files = spark.createDataFrame([("a", "1"), ("b", None)], "path string, content string")
    s.replace_base(files)
    s.replace_base(files.where("path = 'b'"))
    assert [tuple(r) for r in s.base().collect()] == [("b", None)]
    s.replace_base(files.limit(0))
    assert s.base().count() == 0
    late, early = s.enqueue(files, files, NOW), s.enqueue(files.limit(1), files, NOW - datetime.timedelta(hours=30))
    assert [q[0] for q in s.queue()] == [early, late] and s.queue()[1][1].count() == 2
    assert sync.queue_age(s.manifests(), NOW).first()["alert"] == "escalate"
    s.dequeue(early)
    assert [q[0] for q in s.queue()] == [late] and sync.queue_age(s.manifests(), NOW).first()["alert"] == "none"
    one = s.commit(files, "first", NOW)
    two = s.commit(spark.createDataFrame([("a", "2"), ("c", "3")], files.schema), "second", NOW, expect=one)
    assert s.head() == two and s.resolve(one[:8]) == one and sorted(r["path"] for r in s.files(one).collect()) == ["a"]
    assert {tuple(r) for r in s.files().collect()} == {("a", "2"), ("c", "3")} and s.log().count() == 2
    with pytest.raises(ValueError):
        s.commit(files, "late", NOW, expect=one)


def test_modes():
    run = lambda status, **more: lambda: {"status": status, "applied": [], "merged": [], "conflicts": []} | more

    def down():
        raise ConnectionError

    assert sync.execute("sync", run("applied", applied=["b"], notes=["x"]), run("queued", applied=["a", "b"], queued="7"))["applied"] == ["a", "b"]
    assert sync.execute("sync", run("applied"), run("queued"))["status"] == "queued" and sync.execute("sync", run("dry-run"), run("applied"))["status"] == "dry-run"
    assert sync.execute("sync", down, run("queued", queued="q"))["queued"] == "q" and sync.execute("pull", run("applied"), down)["status"] == "applied"
    with pytest.raises(ValueError):
        sync.execute("no", down, down)


def test_pull_and_apply(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    plan = sync.pull_plan(f(("a", "1"), ("b", "1")), f(("a", "1"), ("b", "2")), f(("a", "9")), strategy="local-wins")
    assert {r["path"]: r["action"] for r in plan.collect()} == {"a": "applied", "b": "none"}
    assert {tuple(r) for r in sync.apply_pull(plan, f(("a", "1"), ("b", "2"))).collect()} == {("a", "9"), ("b", "2")}


def test_search_resolve_get(spark, folder, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("index"))
    notes = api.corpus(spark, str(folder), NOW)
    embed, who = api.hashing_embedder(64), ("offline", "hash-64")
    assert api.build_index(notes, home, embed, *who) == {"total": 4, "embedded": 4, "removed": 0, "skipped": 0}
    assert api.build_index(notes, home, embed, *who)["embedded"] == 0
    assert api.build_index(notes.where("id <> 'copy'"), home, embed, *who) == {"total": 3, "embedded": 0, "removed": 1, "skipped": 3}
    with pytest.raises(ValueError):
        api.build_index(notes, home, embed, "offline", "another")
    with pytest.raises(ValueError):
        api.build_index(notes, home, api.hashing_embedder(8), *who)
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return embed(texts)

    similar = lambda q, k: api.semantic_search(q, notes, home, counted, *who, k, cache=f"{home}/cache", now=NOW)
    hits = api.search(notes, "NEVER rebase; see", similar, 2).collect()
    assert hits[0]["id"] == "alpha" and len(hits) == 2 and hits[0]["description"] == "first"
    assert [r["id"] for r in api.search(notes, "NEVER rebase; see", similar, 2).collect()] == [r["id"] for r in hits] and calls.value == 1  # the second time from the cache
    assert api.semantic_search(spark.createDataFrame([(1, "x")], "qid long, prompt string"), notes, f"{home}/none", embed, *who, 3).count() == 0
    for k, query in ((0, "x"), (21, "x"), (3, "")):
        with pytest.raises(ValueError):
            api.search(notes, query, similar, k)
    found = api.resolve(notes, "rebase the branch", similar, tool="Bash", command="git push -f").collect()
    assert found[0]["id"] == "alpha" and {r["id"] for r in found} >= {"Zulu", "alpha"}
    plain = api.resolve(notes, "run the tests").collect()
    assert {(r["id"], r["gate"], r["reason"]) for r in plain} == {("alpha", "topic", "topic match: testing"), ("legacy", "topic", "topic match: testing")}
    assert api.get(notes, "alpha.MD")["name"] == "alpha" and api.get(notes, "gone.md") == {"error": "not_found", "id": "gone"}
    with pytest.raises(Exception):
        api.embed_with(spark.createDataFrame([(1, "x")], "id long, text string"), lambda texts: []).collect()
    assert embed(["", "a b"])[0] == [0.0] * 64


def test_evaluate(spark, folder):
    notes = api.corpus(spark, str(folder), NOW)
    golden = spark.createDataFrame([(0, "rebase now", ["Zulu", "phantom"]), (1, "hello there", [])], "qid long, prompt string, expect array<string>")
    r = retrieval.evaluate(golden, notes, spark.createDataFrame([], "qid long, id string, sim01 double, rank int"), 0.5)
    a = r["aggregate"].first()
    assert (a["precision"], a["recall"], a["mrr"], a["negatives_passed"]) == (0.5, 0.5, 1.0, 1) and [x["id"] for x in r["unknown"].collect()] == ["phantom"]
    from notelake.operators import report

    assert "negative controls passed: 1 of 1 (100.0%)" in report.evaluation(r)


def test_written_tables_are_cleaned(spark):
    from notelake.sources import shared

    df = shared.written(spark.range(3).toDF("n"), "t")
    path = shared._PATHS[-1]
    assert df.count() == 3 and shared.exists(spark, path)
    shared.clean(spark)
    assert not shared.exists(spark, path)


def test_settings():
    w = retrieval.Weights.of_settings({"NOTELAKE_BLEND_TOPIC_BOOST": "0.5", "NOTELAKE_BLEND_RECENCY_HALFLIFE_DAYS": "0", "NOTELAKE_BLEND_TYPE_WEIGHT": "-1", "NOTELAKE_BLEND_CANDIDATE_K": "9x"})
    assert (w.topic_boost, w.half_life_days, w.type_weight, w.k) == (0.5, 30.0, 0.03, 5) and retrieval.candidates(5, 7.5) == 8 and retrieval.candidates(5, 2) == 5
    assert retrieval.strict_number("0.5abc") is None and retrieval.strict_number("1e3") == 1000.0
    assert retrieval.floor_hint(3, 0, 0.78, "fallback", "x\n") and not retrieval.floor_hint(3, 1, 0.78, "fallback", "x") and not retrieval.floor_hint(3, 0, 0.78, "map", "x")
    assert api.provider_of({}) is None and api.provider_of({}, auto=True).model == "nomic-embed-text" and api.provider_of({"NOTELAKE_EMBED_PROVIDER": "openai"}) is None
    assert api.provider_of({"NOTELAKE_API_KEY": "k", "NOTELAKE_EMBED_MODEL": "m"}).model == "m"


def test_texts(spark):
    from notelake.functions import patterns as P
    from notelake.functions import text as T

    rows = spark.createDataFrame([("a😀b",), ("  x ",), ("étask tasks",)], "t string")
    got = [tuple(r) for r in rows.select(T.utf16_length(F.col("t")), T.utf16_left(F.col("t"), 2), T.trim(F.col("t")), T.any_match(F.col("t"), [(r"\btasks?\b", True)]), T.clean_control(F.concat("t", F.lit("\x07")))).collect()]
    assert got[0][:2] == (4, "a") and got[1][2] == "x" and [g[3] for g in got] == [False, False, True] and got[0][4] == "a😀b"
    assert P.may_run("a+b") and not P.may_run("(a+)+") and not P.may_run("[") and not P.may_run("x" * 201)


def test_cache_is_touched(spark):
    rows = lambda *names: spark.createDataFrame([(n, [1.0]) for n in names], "prompt string, embedding array<float>")
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    none = spark.createDataFrame([], "prompt_sha string, model string, embedding array<float>, accessed_at timestamp")
    cache = index.cache_put(index.cache_put(none, rows("a"), at(1), "m", 2), rows("b"), at(2), "m", 2)
    found, cache = index.cache_get(cache, spark.createDataFrame([(1, "a"), (2, "z")], "qid long, prompt string"), "m", at(3))
    assert {r["prompt"]: r["embedding"] for r in found.collect()} == {"a": [1.0], "z": None}
    cache = index.cache_put(cache, rows("c"), at(4), "m", 2)  # b is the least recently used now
    kept = {r["prompt"] for r in index.cache_get(cache, spark.createDataFrame([(i, p) for i, p in enumerate("abc")], "qid long, prompt string"), "m").where("embedding is not null").collect()}
    assert kept == {"a", "c"} and index.cache_open(cache, "other").count() == 0
    with pytest.raises(Exception):
        retrieval.requests(spark.createDataFrame([(1, "x" * (C.MAX_REQUEST + 1))], "qid long, payload string")).collect()
    out = retrieval.envelope(spark.createDataFrame([(1, "c"), (2, "")], "qid long, context string"), "UserPromptSubmit").collect()
    assert len(out) == 1 and out[0]["json"] == '{"hookSpecificOutput":{"hookEventName":"UserPromptSubmit","additionalContext":"c"}}'


def test_section_hashes_are_those_of_the_sections(spark, monkeypatch):
    from notelake.operators import digest

    monkeypatch.setattr(digest, "PIECE", 40)
    logs = [(i, [datetime.date(2026, 1, 1 + i % 3), None][i % 8 == 7], "\n".join(f"DECISION: we will do {i} {k} ünd more" if k % 3 else "some plain line of words" for k in range(i % 6))) for i in range(60)]
    rows = digest.insights(spark.createDataFrame(logs, "source long, date date, content string"))
    want = {tuple(r) for r in digest.markdown(rows).select("date", F.sha2("text", 256)).collect()}
    hashes = digest.section_hashes(rows)
    assert {tuple(r) for r in hashes.collect()} == want and len(want) == 4
    assert "collect_list" not in hashes._jdf.queryExecution().executedPlan().toString()
    assert digest.section_hashes(rows.where("false")).collect() == []
