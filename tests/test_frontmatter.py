"""Frontmatter rewritten key by key."""

import pytest
import yaml
from pyspark.sql import functions as F

from notelake.functions import frontmatter as Y
from notelake.operators import hygiene
from notelake.sources import corpus as C

AMONG = """# who wrote this
name:   'Ann''s note'   # quoted
description: >
  folded
  text

metadata: &meta
  type: project   # inner
  topics: [a,   b]
copy: *meta
type:            # none yet
topics: []       # to come
created: ""
# the end"""


@pytest.mark.parametrize(
    "source, changes, comments, want",
    [
        (AMONG, {"type": "project"}, {}, AMONG.replace("type:            # none", "type: project            # none")),
        (AMONG, {"topics": ["a", "b c"]}, {}, AMONG.replace("topics: []       #", "topics: [a, b c]       #")),
        (AMONG, {"created": "2026-01-02"}, {"created": "approx (mtime)"}, AMONG.replace('created: ""', "created: 2026-01-02 # approx (mtime)")),
        (AMONG, {"severity": "high", "more": ["x", "- y"]}, {}, AMONG + "\nseverity: high\nmore:\n  - x\n  - '- y'"),
        (AMONG, {"metadata": "gone"}, {}, None),  # its anchor is used below
        ("a: 1\r\nb: |\r\n  text\r\n", {"c": "x"}, {}, "a: 1\r\nb: |\r\n  text\r\nc: x"),
        ("  a: 1\n  b: 2", {"a": "x", "c": "y"}, {}, "  a: x\n  b: 2\n  c: y"),
        ("{a: 1, b: [2]}", {"a": "x", "c": ["y"]}, {}, "{a: x, b: [2], c: [y]}"),
        ("{a: 1,}", {"c": "y"}, {}, "{a: 1, c: y}"), ("{}", {"c": "y"}, {}, "{c: y}"),
        ("a:\n- 1\n- 2\n\n# about b\nb: 3", {"a": "x"}, {}, "a:\nx\n\n# about b\nb: 3"),
        ("a:\n  k:\n    - deep\nb: 3", {"b": "true", "a": ["no"]}, {}, "a:\n  ['no']\nb: 'true'"),
        ("'type': ~ # x", {"type": "user"}, {}, "'type': user # x"), ("type: !!str\nb: 1", {"type": "user"}, {}, "type: user\nb: 1"),
        ("type: ''\ntype: x", {"type": "user"}, {}, None),  # the last of two counts
        ("- a", {"a": "b"}, {}, None), ("", {"a": "b"}, {}, "a: b"), ("a: [", {"a": "b"}, {}, None), ("? x\n: 1", {"x": "y"}, {}, "? x\n: y"),
    ],
)
def test_edits(source, changes, comments, want):
    got = Y.edited(source, changes, comments)
    if want is not None and want.startswith("a:\nx"):
        assert got is None or yaml.safe_load(got) == {"a": "x", "b": 3}
        return
    assert got == want
    if want is not None:
        assert Y._same(yaml.safe_load(got), {**(yaml.safe_load(source) or {}), **changes})


def test_all_anew_where_an_edit_cannot_be():
    assert yaml.safe_load(Y.rendered("type: ''\ntype: x\nd: 2020-01-02", {"type": "user"})) == {"type": "user", "d": __import__("datetime").date(2020, 1, 2)}


def test_files_keep_their_bytes(spark):
    """Outside the keys that are set, every byte of a migrated or tagged file is the old one's."""
    fronts = {
        "n1": ("---\r\n", "name: \"One\"  # keep\r\ntype: ''\r\nmetadata: {type: user, topics: [x]}", "\r\n---\r\nbody\r\n"),
        "n2": ("---\n", AMONG, "\n---\n\n\n  body  \n---\nmore"), "n3": ("---\n", "name: three\ntype: user\ntopics: [t]\ncreated: 2020-01-01", "\n---"),
    }
    import datetime

    rows = [(f"/x/{k}.md", datetime.datetime(2026, 1, 2), "".join(v), f"{k}.md") for k, v in fronts.items()]
    notes = C.parse_notes(spark.createDataFrame(rows, "path string, mtime timestamp, source string, file string"))
    files = {r["id"]: r["content"] for r in hygiene.migration_apply(notes, hygiene.migration_plan(notes, [])).collect()}
    assert files.keys() == {"n1", "n2"}
    a, _, z = fronts["n1"]
    assert files["n1"] == a + "name: \"One\"  # keep\r\ntype: user\r\nmetadata: {type: user, topics: [x]}\r\ntopics:\r\n  - x\r\ncreated: 2026-01-02 # approx (mtime)" + z
    a, _, z = fronts["n2"]
    edited = AMONG.replace("type:            #", "type: project            #").replace("topics: []  ", "topics: [a, b]  ").replace('created: ""', "created: 2026-01-02 # approx (mtime)")
    assert files["n2"] == a + edited + z
    plan = notes.select("id", F.array(F.lit("new")).alias("add_topics"), F.lit("high").alias("add_severity"), F.lit(None).cast("string").alias("skip"))
    tagged = {r["id"]: r["content"] for r in hygiene.tag_apply(notes, plan).collect()}
    assert tagged["n1"] == "---\r\n" + fronts["n1"][1] + "\r\ntopics:\r\n  - new\r\nseverity: high\r\n---\r\n\r\nbody\r\n"
    assert tagged["n3"] == "---\nname: three\ntype: user\ntopics: [new]\ncreated: 2020-01-01\nseverity: high\n---\n\n"


@pytest.mark.parametrize(
    "text",
    ["a: [x, y]", "a: {b: [c]}\r\nd: 2020-01-02", "x: {y:[1]}", "{a: b?c}", "{a: ?b}", "a: !\nb: 1", "a: >#\n", "a: [unclosed", "- a", "", "ä: «é»", "a: \u2028", "a: |\n  t\n\nb: 1", "[" * 99, "- " * 60 + "x", "a: &m {b: c}\nd: *m", "a: x\ta: y"],
)
def test_both_parsers_give_the_same(text, monkeypatch):
    def all_of():
        try:
            return repr(Y.loaded(text)), Y.edited(text, {"new": ["k", "- l"]})
        except yaml.YAMLError as e:
            return str(e)

    fast = all_of()
    monkeypatch.setattr(Y, "_FAST", None)
    assert fast == all_of()


def test_deep_nesting_is_left_to_the_parser_that_raises():
    for text in ("[" * 100_000, "- " * 100_000, "\n".join(" " * i + "a:" for i in range(2_000))):
        assert not Y._fast(text)
        with pytest.raises((yaml.YAMLError, RecursionError)):
            Y.loaded(text)


def test_a_filter_on_what_is_parsed_does_not_parse_again(spark):
    rows = spark.range(3).selectExpr("concat('/x/', id, '.md') path", "timestamp'2026-01-02' mtime", "concat('---\nname: ', id, '\ntype: user\n---\nbody') source", "concat(id, '.md') file")
    notes = C.parse_notes(rows)
    for df in (hygiene.migrated(hygiene.migration_plan(notes, [], keep=("source", "front"))), notes.where("ok").select("id", "type")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("_front(") == 1 and "Join [" not in plan
    one = {tuple(r) for r in hygiene.migrated(hygiene.migration_plan(notes, [], keep=("source", "front"))).collect()}
    assert one == {tuple(r) for r in hygiene.migration_apply(notes, hygiene.migration_plan(notes, [])).collect()} and len(one) == 3
