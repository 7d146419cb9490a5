"""Joins of vectors by angle against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import hygiene, retrieval, sphere

ODD = [None, [], [1.0, None, 0.0, 0.0], [math.nan, 1.0, 1.0, 1.0]]


def clustered(n, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims)) * 3
    x = [(centres[i % 6] + 0.3 * rng.standard_normal(dims)).round(3).tolist() for i in range(n)]
    x += [x[3]] * 20 + [[0.0] * dims, [1.0, 2.0], [2.0, 1.0]] + ODD  # copies, a zero vector, other lengths, odd ones
    return list(enumerate(x))


def fine(v):
    return bool(v) and None not in v and all(map(math.isfinite, v))


def cosine(v, w):
    n = math.sqrt(math.fsum(x * x for x in v) * math.fsum(x * x for x in w))
    return math.fsum(a * b for a, b in zip(v, w)) / n if n else 0.0


@pytest.mark.parametrize("bin, queries", [(8192, 4096), (40, 7)])
def test_nearest(spark, monkeypatch, bin, queries):
    monkeypatch.setattr(sphere, "BIN", bin)
    monkeypatch.setattr(sphere, "QUERIES", queries)
    rows = clustered(300)
    index = spark.createDataFrame([(i, v, "m") for i, v in rows], "id long, embedding array<double>, model string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in rows[::2]], "qid string, embedding array<double>")
    got = {}
    for r in retrieval.topk(asked, index, 6).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["sim01"]))
    for i, v in rows[::2]:
        want = sorted((-round(cosine(v, w), 12), j) for j, w in rows if fine(v) and fine(w) and any(w) and len(v) == len(w))[:6]
        found = sorted(got.get(f"q{i}", []))
        assert [n for n, _, _ in found] == list(range(1, len(want) + 1))
        assert [s for _, _, s in found] == pytest.approx([(1 - c) / 2 for c, _ in want], abs=1e-9), i
        if len({c for c, _ in want}) == len(want) or not any(v):  # all ties are those of a zero query: by id
            assert [j for _, j, _ in found] == [j for _, j in want]


def test_far_cells_are_not_visited(spark):
    rows = [(i, v) for i, v in clustered(600) if fine(v) and len(v) == 4 and any(v)]
    x = sphere.unit(np.array([v for _, v in rows]))
    cells = sphere.Cells(x[:12])
    cell, angle = cells.of(x)
    cells.fill({c: int((cell == c).sum()) for c in range(12)}, {c: float(angle[cell == c].max()) for c in range(12)}, 50)
    least = cells.least_angles(x)
    true = np.arccos(np.clip(x @ x.T, -1, 1))
    for c in range(12):
        assert (least[:, c] <= true[:, cell == c].min(1) + 1e-7).all()  # a bound
    assert (least > 0.3).mean() > 0.5  # that excludes most of what is far


@pytest.mark.parametrize("threshold", [0.95, 0.5, 1.0])
def test_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(sphere, "BIN", 50)
    monkeypatch.setattr(sphere, "QUERIES", 20)
    rows = clustered(200)
    got = {(r["a"], r["b"]): r["similarity"] for r in hygiene.near_duplicates(spark.createDataFrame(rows, "id long, embedding array<double>"), threshold).collect()}
    pairs = {(i, j): cosine(v, w) for i, v in rows for j, w in rows if i < j and fine(v) and fine(w) and any(v) and any(w) and len(v) == len(w)}
    sure = {p for p, c in pairs.items() if c >= threshold + 1e-12}
    assert sure <= got.keys() <= {p for p, c in pairs.items() if c >= threshold - 1e-12}
    assert all(abs(pairs[p] - s) < 1e-12 for p, s in got.items())


def test_nothing(spark):
    none = spark.createDataFrame([], "qid long, id long, embedding array<double>")
    assert retrieval.topk(none, none, 3).collect() == [] and hygiene.near_duplicates(none).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert retrieval.topk(one.withColumnRenamed("id", "qid"), spark.createDataFrame([(5, [1.0])], one.schema), 3).collect() == []
    assert [tuple(r) for r in retrieval.topk(one.withColumnRenamed("id", "qid"), one, 3).select("qid", "id", F.round("sim01", 9), "rank").collect()] == [(1, 1, 1.0, 1)]


def test_vectors_are_shuffled_by_blocks_and_held_by_slices(spark, monkeypatch):
    """However many rows: about eight bins and eight parts, batches no larger than HELD allows, and pairs given as they are found."""
    rng = np.random.default_rng(3)
    x = sphere.unit(rng.standard_normal((1200, 16)))
    monkeypatch.setattr(sphere, "BIN", 100)
    monkeypatch.setattr(sphere, "QUERIES", 10)
    monkeypatch.setattr(sphere, "HELD", 4096)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(2)
    ready = sphere._ready(rows, "t").drop("size")
    cells, table = sphere._partition(ready, 16, 1200, "c")
    assert len({b + k for b, _, _, n in cells.value.spans for k in range(n)}) <= 2 * sphere.BLOCKS
    batch = ready.limit(1000).toArrow().combine_chunks().to_batches()[0].append_column("bound", __import__("pyarrow").array(np.full(1000, np.nan)))
    out = list(sphere._visits(cells, "others", dict.fromkeys(range(99), 3))(iter([batch])))
    assert max(b.num_rows for b in out) <= sphere.HELD // 4 // len(cells.value.pivots) and sum(b.num_rows for b in out) > 1000 * 7
    got = {(r["a"], r["b"]) for r in sphere.near_pairs(rows, 0.3).collect()}
    assert got == {(i, j) for i, j in np.argwhere(np.triu(x @ x.T >= 0.3, 1)).tolist()}
