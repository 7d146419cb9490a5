"""Patterns that come as data: what may run, what must be held, and the search against trying each on each."""

import re

import pytest
from pyspark.sql import functions as F

from notelake.functions import patterns as P
from notelake.operators import patterns


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("git push", ["git push"]), (r"git\s+push", ["push"]), ("ab+c", ["ab"]), ("a(bc)?d", ["a"]), ("(cat|horse) x", ["cat", "horse"]), ("(cat|horse)", ["cat", "horse"]), ("x{0,2}yz", ["yz"]), ("(?!no)yes", ["yes"]),
        ("x|", None), (".*", None), (r"\d+", None), ("[ab]c", ["c"]), (r"a\.b", ["a.b"]), (r"\bword\b", ["word"]), ("(?:rm|del) -r(?:f|d)", [" -r"]), ("(?<x>git)", ["git"]), (r"(a)\1b", ["a"]), ("abc{2,}de", ["abc"]), ("(ab", None),
    ],
)
def test_needles(pattern, want):
    assert P.needles(pattern) == want


def test_needles_are_held_by_every_match():
    texts = ["git push --force", "abcc d", "aab.c", "rm -rf x", "xyzyz", "", "cat x horse"]
    for p in ["git.*force", "ab+c*", "a|b", "(rm|del) -r", "(xy)+z", "x?y", "(a(b|c))+", "[a-c]b", "c.t|h(o|i)rse", "b{1,3}"]:
        for t in texts:
            if (m := re.search(p, t)) and P.needles(p):
                assert any(n in m[0] for n in P.needles(p)), (p, t)


@pytest.mark.parametrize(
    "pattern, text, found",
    [
        ("(?<x>git)", "git", True), ("(?<a_b>g)it \\k<a_b>", "git g", True), ("a$", "a\n", False), ("a.b", "a\u0085b", True), ("a.b", "a b", False), (r"a\sb", "a b", True), (r"\bé", "é", False), (r"x{", "x{", True), ("[[]", "[", True),
        (r"[\s]x", "　x", True), ("[^]", "\n", True), ("a[]", "a", False), (r"\q", "q", True), (r"\v", "\x0b", True), (r"[\b]", "\x08", True), ("a]", "a]", True), (r"[a&&b]", "&", True), (r"A", "A", True),
    ],
)
def test_syntax(spark, pattern, text, found):
    got = P.translated(pattern)
    assert spark.createDataFrame([(text, got)], "t string, p string").select(F.rlike("t", F.col("p"))).first()[0] == found


@pytest.mark.parametrize("pattern", ["(?P<x>git)", "(?i)git", "a++", "a**", "*a", "(*a)", "[", "(a", "a)", "(?<1x>a)", r"\k<no>(?<x>a)", "(a+)+", "x" * 201, "[b-a]", "(?<a>x)(?<a>y)"])
def test_what_may_not_run(spark, pattern):
    assert not P.may_run(pattern)
    texts = spark.createDataFrame([(1, "git a b x"), (2, None)], "qid long, text string")
    assert patterns.search(texts, spark.createDataFrame([(pattern,), (None,), ("",)], "p string")).collect() == []


def test_search_is_each_on_each(spark, monkeypatch):
    monkeypatch.setattr(patterns, "NEEDLE_CHARS", 50)  # several passes
    monkeypatch.setattr(patterns, "CHUNK", 2)
    words = [f"w{i:02}" for i in range(40)]
    texts = [(i, " ".join(words[(i * k) % 40] for k in range(1, 8))) for i in range(200)] + [(900, ""), (901, None)]
    given = [f"{a} {b}" for a, b in zip(words, words[3:])] + [rf"{a}\s+.*{b}" for a, b in zip(words, words[7:])] + [f"(?:{a}|{b}) w" for a, b in zip(words, words[9:])] + [".", r"\d3$", "^w1", "[12]+ w", "(?P<x>w)", "w01|", "^$"]
    got = patterns.search(spark.createDataFrame(texts, "qid long, text string"), spark.createDataFrame([(p,) for p in given * 2], "p string")).collect()
    want = {(i, p) for i, t in texts if t is not None for p in given if p != "(?P<x>w)" and re.search(p.replace("$", r"\Z"), t)}
    assert {(r["qid"], r["p"]) for r in got} == want and len(got) == len(want)


def test_search_has_no_nested_loop(spark):
    texts = spark.range(1000).select(F.col("id").alias("qid"), F.concat(F.lit("run tool"), (F.col("id") % 300).cast("string"), F.lit(" now")).alias("text"))
    many = spark.range(300).select(F.concat(F.lit("tool"), F.col("id").cast("string"), F.lit(r"\s+now")).alias("p"))
    found = patterns.search(texts, many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 1000 and found.where(~F.col("p").startswith("tool")).isEmpty()
