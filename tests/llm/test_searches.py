"""Nearest neighbours, hard negatives and conversation repair on small fixtures, against brute force."""

import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import conversations, kmeans_tree, pivot_negatives, queries, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, h int, u string, n int, rank int"  # the last four clash with names used inside
ODD = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5]
DIR = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "2", 3, 4) for i, v, lab in rows], SCHEMA).repartition(3)


def some(n=300, dims=6, seed=5):
    """Vectors of unequal lengths, exact copies, ties, repeated rows, rows of one id that differ, other lengths, and odd ones."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(dims) * (1 + i % 3)).round(2).tolist(), i % 4) for i in range(n)]
    rows += [(n + i, rows[20][1], i % 4) for i in range(60)]  # one vector in many rows
    rows += [(n + 100 + i, np.eye(dims)[i % dims].tolist(), 1) for i in range(40)]
    rows += [rows[40], rows[40], (40, [9.0] * dims, 2), (n + 200, [1.0, 2.0], 1), (n + 220, [2.0, 1.0], 1), (n + 240, [0.5, -1.0], 2)]
    rows += [(n + 300 + 20 * k, v, 1) for k, v in enumerate(ODD)]
    return [*rows, (None, [1.0] * dims, 1), (n + 500, [1.0] * dims, None)]


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def true_nearest(rows, k, every):
    rows = {(i, tuple(v)) for i, v, _ in rows if i is not None and fine(v) and any(v)}
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = sorted((-math.fsum(a * b for a, b in zip(v, w)), j) for j, w in rows if (j, w) != (i, v) and len(v) == len(w))
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


def listed(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_nearest_with_full_recall_is_brute_force(spark):
    rows = some()
    got = listed(kmeans_tree.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, recall=1.0))
    want = true_nearest(rows, 20, 20)
    assert got.keys() == {i for i, lists in want.items() if any(lists)}
    for i, lists in want.items():
        flat = sorted((n + 1, j) for ls in lists for n, (j, _) in enumerate(ls))
        assert sorted((n, j) for n, j, _ in got.get(i, [])) == flat, i
        if len(lists) == 1:
            assert [s for _, _, s in got[i]] == pytest.approx([s for _, s in lists[0]], abs=1e-12)


def test_nearest_reaches_its_recall_and_scores_exactly(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BIN", 64)
    monkeypatch.setattr(vectors, "REQUESTS", 4)  # many bins, split by rows and by requests
    rows = [(r["vec_id"], list(r["embedding"]), 0) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = listed(queries.op11_nearest_neighbours(spark, "/root/testdata/sf0.1"))
    x = np.array([v for _, v, _ in rows])
    ids, hit, total = np.array([i for i, _, _ in rows]), 0, 0
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        found = got[ids[at]]
        assert [n for n, _, _ in found] == list(range(1, 21)) and ids[at] not in {j for _, j, _ in found}
        assert [(-v, j) for _, j, v in found] == sorted((-v, j) for _, j, v in found)
        place = dict(zip(ids.tolist(), s))
        assert all(abs(place[j] - v) < 1e-12 for _, j, v in found)
        s[at] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & {j for _, j, _ in found})
        total += 20
    assert hit / total >= 0.9


def test_nearest_of_nothing_and_of_one(spark):
    ask = F.col("vec_id") % 20 == 0
    assert kmeans_tree.nearest(table(spark, []), ask).collect() == []
    assert kmeans_tree.nearest(table(spark, [(20, [1.0], 1), *((40, v, 1) for v in ODD)]), ask).collect() == []
    got = kmeans_tree.nearest(table(spark, [(20, [1.0], 1), (21, [-2.0], None)]), ask).collect()
    assert [tuple(r) for r in got] == [(20, 1, 21, -2.0)]


def test_tree_and_bins():
    x = np.random.default_rng(1).standard_normal((500, 3))
    tree = kmeans_tree.Tree(x, branch=4, most=20)
    leaf = tree.leaf_of(x)
    assert np.bincount(leaf, minlength=tree.leaves).max() <= 20 and sorted(tree.visit(tree.near(x[:1])[0].tolist(), 10**6)) == list(range(tree.leaves))
    assert kmeans_tree.Tree(np.ones((100, 3)), most=20).leaves == 1  # equal vectors can't be split
    bins = vectors.Bins({0: 5, 1: 4, 2: 25, 4: 1}, 5, most=10)
    assert bins.first.tolist() == [0, 0, 1, 4, 4] and bins.parts.tolist() == [1, 1, 3, 1, 1]
    assert bins.of_row(np.array([2, 2, 2]), np.array([0.0, 0.5, 0.999])).tolist() == [1, 2, 3]
    assert [(b, c.tolist()) for b, c in bins.of_visits(np.array([0, 1, 2]))] == [(0, [0, 1]), (1, [2]), (2, [2]), (3, [2])]


def true_negatives(rows, every, positives=5, negatives=10):
    rows = {(i, tuple(math.floor(256 * x) for x in v), lab) for i, v, lab in rows if i is not None and lab is not None and fine(v)}
    out = []
    for i, v, lab in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m == lab) for j, w, m in rows if (j, w, m) != (i, v, lab) and len(v) == len(w))
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [(-s, k) for s, k, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, n + 1, k, -p, s) for n, (s, k) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("bin, requests", [(8192, 4096), (32, 2)])
def test_negatives(spark, monkeypatch, bin, requests):
    monkeypatch.setattr(vectors, "BIN", bin)
    monkeypatch.setattr(vectors, "REQUESTS", requests)
    rows = some() + [(1000, [30_000.0] + [0.0] * 5, 1), (1100, [0.0] * 6, 1)]  # a long one, beyond 16 bits; a zero one
    got = pivot_negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == true_negatives(rows, 20)


def test_negatives_of_nothing(spark):
    ask = F.col("vec_id") % 20 == 0
    assert pivot_negatives.mine(table(spark, []), ask).collect() == []
    assert pivot_negatives.mine(table(spark, [(20, v, 1) for v in ODD if v != [0.0] * 6]), ask).collect() == []
    assert pivot_negatives.mine(table(spark, [(20, [1.0], 1), (21, [1.0], 2)]), ask).collect() == []  # no positive
    got = pivot_negatives.mine(table(spark, [(20, [1.0], 1), (21, [1.0], 1), (22, [0.5], 2), (23, [1.0], 2), (24, [2e6], 2)]), ask).collect()
    assert [tuple(r) for r in got] == [(20, 21, 1, 22, 65536, 32768)]  # 23 is too near; 24 is too long to be scored exactly


def test_brackets_hold():
    rng = np.random.default_rng(2)
    v = np.floor(rng.standard_normal((200, 5)) * 100)
    sq = (v**2).sum(1)
    table = pivot_negatives.Pivots(v, sq, sq.max(), pivots=6, rings=3)
    d = table.of_rows(v, sq).astype(np.float32).astype(float)
    low, high = table.bracket(sq, table.of_anchors(v), d, d)
    assert (low <= v @ v.T).all() and (v @ v.T <= high).all()
    assert (high < v @ v.T + sq.max()).mean() > 0.1  # they say something


# ---------------------------------------------------------------- conversations

CHATS = "conv_id long, turn long, role string, text string, kind int, h int, signature string"


def by_hand(rows, damage=True):
    """Rows (conv_id, turn, role, text) repaired by recursion over rows and last initial, the edits compared as strings."""
    some_space = lambda x: " " if x is None else x
    chats = {}
    for c, t, r, x in rows:
        chats.setdefault(c, [])
        what = zlib.crc32(f"{some_space(c)}:{some_space(t)}".encode()) % 20 if damage else 9
        r, x = some_space(r), some_space(x)
        if what:
            x = "" if what == 1 else re.sub("[.!?]", "", x) if what == 2 else x
            chats[c] += [(t, "user" if what == 4 else r, x)] * (1 + (what == 3))
    return {c: one_by_hand(rs) for c, rs in chats.items()}


def one_by_hand(rs):
    rs = sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
    turns = {t for t, _, _ in rs if t is not None}
    seen, faults = set(), []
    for _, r, x in rs:
        bare = re.sub("[\x20\x09-\x0d]", "", x)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))

    @functools.cache
    def best(i, last, inserts):
        due = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        options = [(0, "", ())] if i == len(rs) and last in ("", "a") else []

        def then(edit, cost, j, initial, n, row):
            rest = best(j, initial, n)
            if rest:
                options.append((cost + rest[0], edit + rest[1], row + rest[2]))

        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in due and inserts < 2:
                then("I", 5, i, initial, inserts + 1, ((role, ""),))
        if i < len(rs):
            _, role, text = rs[i]
            then("D", 2, i + 1, last, 0, ())
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in due:
                    then("K", more, i + 1, role[:1], 0, ((role, text),))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in due:
                        then("R", more + 1, i + 1, initial, 0, ((name, text),))
        return min(options, key=lambda o: o[:2]) if options else None

    for i in range(len(rs), 0, -50):  # so that the recursion isn't deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    cost, audit, kept = best(0, "", 0)
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in kept))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(found):
    return {r["conv_id"]: tuple(r[c] for c in RESULT) for r in found.collect()}


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CHATS).repartition(3)


def test_repair_of_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(queries.op12_conversation_repair(spark, "/root/testdata/sf0.01")) == by_hand(rows)


def test_repair_of_random_and_odd_conversations(spark):
    rng = np.random.default_rng(8)
    texts = ["yes.", "no!", "cut", "", " \n", None, "Ünï 😀?", "x" * 100_000 + "."]
    roles = ["system", "user", "assistant", "tool", "", None, "System"]
    rows = [(c, None if rng.random() < 0.1 else int(rng.integers(0, 12)), str(rng.choice(roles[:4])) if rng.random() < 0.8 else roles[rng.integers(4, 7)], texts[rng.integers(0, 8)]) for c in range(150) for _ in range(rng.integers(1, 9))]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (None, 1, "user", "a."), (500, 2**40, "user", "a."), (500, -3, "user", "b.")]
    rows += [(600, t, "user" if t % 2 else "assistant", "same.") for t in range(700)]  # long, and nearly all duplicates
    rows += [(700 + i, 0, "assistant", "only.") for i in range(60)]  # one signature in many conversations
    rows = [(int(c) if c is not None else None, t, r, x) for c, t, r, x in rows]
    assert repaired(conversations.repair(chats(spark, rows))) == by_hand(rows, damage=False)
    table = chats(spark, rows)
    assert repaired(conversations.repair(conversations.damaged(table), table.select("conv_id"))) == by_hand(rows)


def test_repair_of_nothing(spark):
    assert conversations.repair(chats(spark, [])).collect() == []
    none = ("zeros", hashlib.sha256(b"").hexdigest())
    got = repaired(conversations.repair(chats(spark, []), spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")))
    assert got == {k: (0, 0, 0, 0, 0, 0, "", none[1]) for k in (1, None)}


def test_shared_prefixes_give_the_same_layers():
    rng = np.random.default_rng(4)
    import pyarrow as pa

    signatures = sorted({"".join(rng.choice(list("SUAOsuaoX"), rng.integers(0, 9))) for _ in range(400)})
    out = pa.Table.from_batches(conversations._solved([pa.RecordBatch.from_pydict({"signature": s}) for s in (signatures[:150], signatures[150:])]))
    assert out.num_rows == len(signatures)
    for signature, cost, audit in zip(*(out.column(c).to_pylist() for c in out.column_names)):
        alone = pa.Table.from_batches(conversations._solved([pa.RecordBatch.from_pydict({"signature": [signature]})]))
        assert alone.to_pylist() == [{"signature": signature, "cost": cost, "audit": audit}]
