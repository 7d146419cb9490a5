"""Queues replayed in one pass, trees and their differences, words near by edits: against step by step, outer joins and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from notelake.operators import edits, sync, trees
from notelake.sources import shared

MAP = "path string, content string"
CONFIG = [{"source": "mine", "destination": "notes", "kind": "directory"}]


def file_map(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), MAP)


def test_replay_is_step_by_step(spark):
    rng = random.Random(5)
    paths = [f"notes/{i}" for i in range(25)] + [f"other/{i}" for i in range(5)]
    text = lambda: rng.choice(["", "a", "a\nb", "a\nc", "<<<<<<< local\nx", "z" * rng.randint(1, 4)])
    some = lambda: {p: text() for p in paths if rng.random() < 0.7}
    remote = file_map(spark, some())
    queue = [(f"s{i}", file_map(spark, some()), file_map(spark, some())) for i in (3, 1, 2, 10)]
    for config in (None, CONFIG):
        for strategy in sync.STRATEGIES:
            want = remote
            for _, local, base in sorted(queue, key=lambda q: q[0]):
                want = sync.apply_push(sync.push_plan(base, local, want, config, strategy=strategy), want)
                want = spark.createDataFrame(want.collect(), MAP)
            got = sync.replay(queue, remote, config, strategy)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange ") == 1 and "Join" not in plan


def test_replay_of_nothing(spark):
    remote = file_map(spark, {"a": "x"})
    assert sync.replay([], remote).collect() == remote.collect()
    empty = spark.createDataFrame([], MAP)
    assert sync.replay([("s", empty, empty)], remote).collect() == remote.collect()
    assert sync.replay([("s", empty, remote)], remote).collect() == []


def by_join(before, after):
    return {(p, "added" if p not in before else "removed" if p not in after else "changed") for p in before.keys() | after.keys() if before.get(p) != after.get(p)}


@pytest.mark.parametrize("case", range(4))
def test_tree_difference(spark, case):
    rng = random.Random(case)
    before = {"/".join(["d"] * (i % 4) + [f"f{i % 7}", str(i)]): f"text {i}" for i in range(60)} | {"/abs": "x", "a//b": "y", "top": "z", "file": "1", "": "root"}
    after = dict(before)
    for p in list(after):
        if case and rng.random() < 0.15:
            after[p] = after[p] + "+"
        elif case > 1 and rng.random() < 0.1:
            del after[p]
    if case > 1:
        after |= {"new/deep/er/x": "1", "file/now/folder": "2"}
        after.pop("file", None)
    if case == 3:
        before = {}
    a, b = (trees.build(file_map(spark, m), shared.place(spark, "tree")) for m in (before, after))
    got = [tuple(r) for r in trees.difference(a, b).collect()]
    assert set(got) == by_join(before, after) and len(got) == len(set(got))


def test_tree_difference_reads_what_differs(spark):
    """One changed file of 2,000 in 200 folders: what is read are the buckets on its way, not the trees."""
    before = {f"n/{i % 20}/{i % 200}/{i}": str(i) for i in range(2000)}
    a, b = (trees.build(file_map(spark, m), shared.place(spark, "tree")) for m in (before, before | {"n/7/87/87": "changed"}))
    read = []
    entries = trees._entries

    def counted(tree, depth, frontier, buckets):
        read.append(tree.where((F.col("depth") == depth) & F.col("bucket").isin(buckets)).count())
        return entries(tree, depth, frontier, buckets)

    trees._entries = counted
    try:
        assert [tuple(r) for r in trees.difference(a, b).collect()] == [("n/7/87/87", "changed")]
    finally:
        trees._entries = entries
    assert sum(read) < 300 < 2 * a.count()


def test_words_near_by_edits(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abcDé") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 11, 12, 13, 14, 30])))
    known = [make() for _ in range(150)]

    def changed(w):
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]])
        return w

    words = [changed(w) for w in known for _ in range(2)] + [w.upper() for w in known[:30]] + [None, "a" * 3000]
    got = edits.nearest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([*enumerate(known), (999, None)], "ord long, word string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for w in {w for w in words if w is not None}:
        near = min((distance(w.lower(), k.lower()), i, k) for i, k in enumerate(known) if abs(len(w) - len(k)) <= 2) if any(abs(len(w) - len(k)) <= 2 for k in known) else (9,)
        if near[0] <= 2:
            want[w] = (near[2], near[0])
    assert {r["word"]: (r["near"], r["distance"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
