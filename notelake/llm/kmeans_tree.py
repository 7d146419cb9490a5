"""Largest inner products by a hierarchical k-means tree with best-bin-first traversal.

A vector x gets one more component, sqrt(M^2 - |x|^2), M being the table's largest length, and a query a zero: the largest inner product is
then the smallest Euclidean distance. The tree is fitted on a bounded sample of these vectors and every vector goes to the leaf of its
nearest centroids. A query visits leaves in the order of a priority queue over the nodes' distances. How many it visits is calibrated: a
bounded number of queries is searched in full, and the visits are widened until their neighbours are found often enough.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, spread_join
from .vectors import Bins, distinct, matrix, meet, packed

K = 20
SAMPLE = 65_536  # distinct vectors that the tree is fitted on, about; all rows are indexed
SAMPLE_BYTES = 64 << 20
BRANCH = 16
LEAF = 64  # sampled vectors in a leaf at most
ROUNDS = 6  # of k-means at a node
CALIBRATED = 256  # queries searched in full, about
RECALL = 0.95  # of their neighbours, to be found by the visits
COPIES = 500_000  # further ids of equal vectors are broadcast up to this number; beyond it they are joined


class Tree:
    """Nodes in depth-first order, children of a node at most BRANCH; leaves are numbered in that order, so near leaves have near numbers."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, most: int = LEAF, seed: int = 11):
        self.centre: list[np.ndarray] = []
        self.below: list[list[int]] = []  # empty for a leaf
        self.leaf: list[int] = []  # -1 for an inner node
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self._grow(sample, branch, most)
        self.centre = np.array(self.centre)
        self.half = 0.5 * (self.centre**2).sum(1)
        del self._rng

    def _grow(self, sample: np.ndarray, branch: int, most: int) -> None:
        """Depth-first with a stack of its own, as unbalanced data may make a deep tree."""
        open_: list[tuple[np.ndarray, int]] = [(np.arange(len(sample)), -1)]
        while open_:
            at, parent = open_.pop()
            node = len(self.centre)
            self.centre.append(sample[at].mean(0) if len(at) else np.zeros(sample.shape[1]))
            self.below.append([])
            self.leaf.append(-1)
            if parent >= 0:
                self.below[parent].append(node)
            parts = self._split(sample[at], min(branch, len(at))) if len(at) > most else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
            else:
                open_ += [(at[p], node) for p in reversed(parts)]

    def _split(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        c = x[self._rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
            order = np.argsort(near, kind="stable")
            cuts = np.searchsorted(near[order], np.arange(k + 1))
            some = np.flatnonzero(np.diff(cuts))
            c = np.add.reduceat(x[order], cuts[some]) / np.diff(cuts)[some][:, None]
            k = len(some)
        return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if b > a]

    def near(self, x: np.ndarray) -> np.ndarray:
        """Of each row and node, half the squared distance, but for a part that depends on the row alone."""
        return self.half - x @ self.centre.T

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to by the nearest child of each node."""
        out = np.zeros(len(x), np.int32)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, at = open_.pop()
            below = self.below[node]
            if not below:
                out[at] = self.leaf[node]
                continue
            nearest = (x[at] @ self.centre[below].T - self.half[below]).argmax(1)
            open_ += [(child, at[nearest == k]) for k, child in enumerate(below) if (nearest == k).any()]
        return out

    def visit(self, near: list[float], most: int) -> list[int]:
        """Leaves, best bin first, by a priority queue of nodes."""
        out: list[int] = []
        queue = [(near[0], 0)]
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            if self.below[node]:
                for child in self.below[node]:
                    heapq.heappush(queue, (near[child], child))
            else:
                out.append(self.leaf[node])
        return out


def _lifted(v: np.ndarray, sq: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(largest - sq, 0))[:, None]], 1)


def _asked(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.zeros((len(v), 1))], 1)


def _filed(tree, largest):
    """(leaf, rep, h, u, v) of each vector."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = tree.value.leaf_of(_lifted(matrix(batch.column("v")), batch.column("sq").to_numpy(), largest))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c) for c in ("rep", "h", "u", "v"))], names=["leaf", "rep", "h", "u", "v"])

    return run


def _best(scores: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) that can be among a row's k largest, given how far the scores may be off."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] - slack
    else:
        least = np.full(len(scores), -np.inf)
    return np.nonzero((scores >= least[:, None]) & (scores > -np.inf))


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs, the same for a pair wherever it is computed: extended precision, rounded once."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 15):
        s = slice(lo, lo + (1 << 15))
        out[s] = (q[i[s]].astype(np.longdouble) * x[j[s]]).sum(1)
    return out


def _top(i: np.ndarray, score: np.ndarray, id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each i, larger scores first, then smaller ids."""
    order = np.lexsort((id, -score, i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < k]


def _in_full(asked: np.ndarray, digests: list[bytes], k: int):
    """(q, score, rep, leaf): of one partition's vectors, the k nearest of each calibration query, itself left out."""

    def run(batches):
        scores, reps, leaves = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64), np.zeros((len(asked), k), np.int32)
        own = {d: i for i, d in enumerate(digests)}
        for batch in batches:
            if not batch.num_rows:
                continue
            s = asked @ matrix(batch.column("v")).T
            for j, d in enumerate(batch.column("h").to_pylist()):
                if d in own:
                    s[own[d], j] = -np.inf
            rep, leaf = (np.broadcast_to(batch.column(c).to_numpy(), s.shape) for c in ("rep", "leaf"))
            s, rep, leaf = np.concatenate([scores, s], 1), np.concatenate([reps, rep], 1), np.concatenate([leaves, leaf], 1)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            scores, reps, leaves = (np.take_along_axis(x, at, 1) for x in (s, rep, leaf))
        i, j = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(scores[i, j]), pa.array(reps[i, j]), pa.array(leaves[i, j])], names=["q", "score", "rep", "leaf"])

    return run


def _visits(tree, bins, most):
    """(bin, h, v, leaves) for each bin that a query visits, with its leaves there."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = tree.value.near(_asked(matrix(batch.column("v"))))
            who, where, what = [], [], []
            for i, row in enumerate(near.tolist()):
                for b, leaves in bins.value.of_visits(np.array(tree.value.visit(row, most), np.int32)):
                    who.append(i), where.append(b), what.append(leaves.astype(np.int32).tobytes())
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), batch.column("h").take(at), batch.column("v").take(at), pa.array(what, pa.binary())], names=["bin", "h", "v", "leaves"])

    return run


_FOUND = "q binary, score double, rep long, h binary"


def _searched(k: int):
    """The k nearest of each visiting query among the bin's vectors in leaves that it visits."""

    def answer(visits: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        if visits.num_rows and rows.num_rows:
            rows = rows.sort_by("leaf")
            leaf, rep, x = rows.column("leaf").to_numpy(), rows.column("rep").to_numpy(), matrix(rows.column("v"))
            here, cuts = np.unique(leaf, return_index=True)
            cuts = np.append(cuts, len(leaf))
            q, lists = matrix(visits.column("v")), [np.frombuffer(b, np.int32) for b in visits.column("leaves").to_pylist()]
            found = []
            for lo in range(0, len(q), 512):
                some = q[lo : lo + 512]
                sees = np.zeros((len(some), len(here)), bool)
                for i, leaves in enumerate(lists[lo : lo + 512]):
                    sees[i] = np.isin(here, leaves)
                scores = np.full((len(some), len(x)), -np.inf)
                for j in range(len(here)):
                    at = np.flatnonzero(sees[:, j])
                    scores[at, cuts[j] : cuts[j + 1]] = some[at] @ x[cuts[j] : cuts[j + 1]].T
                slack = 1e-12 * np.sqrt((some**2).sum(1) * (x**2).sum(1).max())
                i, j = _best(scores, k, slack)
                score = _exact(some, x, i, j)
                top = _top(i, score, rep[j], k)
                found.append((i[top] + lo, score[top], j[top]))
            out = [np.concatenate(c) for c in zip(*found)]
        i, score, j = (pa.array(c) for c in out)
        return pa.table({"q": visits.column("h").take(i), "score": score, "rep": rows.column("rep").take(j), "h": rows.column("h").take(j)})

    return answer


def _largest(found: DataFrame, by: str, id: str, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), id))
    return found.withColumn("n", nth).where(f"n <= {k}").drop("n")


def nearest(vectors: DataFrame, asks: Column, k: int = K, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which asks is true, the k found other rows of the largest inner product, the
    largest first, ties to the smaller vec_id; all others if they are fewer.

    Rows of vectors (vec_id, embedding) whose id or vector is null, and vectors that are empty, zero or hold a null or non-finite
    component, take no part. Vectors of different lengths aren't compared. Rows that repeat an id and a vector are one; rows of one id with
    different vectors are rows of their own. An empty table gives none; other columns aren't read. Equal vectors are searched once.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "nearest")
    rows = scratch.save(packed(vectors, asks, F.lit(0), zeros=False), "rows")
    classes, copies = distinct(rows, k + 1)
    classes = scratch.save(classes, "classes")
    copies = scratch.save(copies.drop("label"), "copies")
    found = None
    for of in classes.groupBy("size").agg(F.max("sq").alias("largest"), F.count("*").alias("n"), F.count_if(F.col("asking") > 0).alias("asking")).toLocalIterator():
        if of["asking"]:
            one = _of_one_length(classes.where(F.col("size") == of["size"]), of, k, recall, scratch)
            found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = scratch.save(_largest(found, "q", "rep", k + 1), "found")
    if not copies.isEmpty():
        more = found.join(small(copies, COPIES), "h").select("q", "score", F.col("vec_id").alias("rep"), "h")
        found = _largest(found.union(more), "q", "rep", k + 1)
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("rep").alias("vec_id"), "h", "score"))).alias("found"))
    lists = scratch.save(lists.withColumnRenamed("q", "own"), "lists")
    queries = scratch.save(rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("h").alias("own")).distinct(), "queries")
    out = spread_join(queries, lists, ["own"], ["query_id"])
    others = F.filter("found", lambda f: (f["vec_id"] != F.col("query_id")) | (f["h"] != F.col("own")))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "one"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))


def _of_one_length(classes: DataFrame, of, k: int, recall: float, scratch: Scratch) -> DataFrame:
    """(q, score, rep, h): for each asking vector, by its digest, what its visits find."""
    spark, tag = scratch.spark, str(of["size"])
    largest, width = of["largest"], 8 * (of["size"] + 1)
    share = min(SAMPLE, max(1024, SAMPLE_BYTES // width)) / of["n"]
    sample = classes.where(F.col("u") < share).select("v", "sq").toArrow() if share < 1 else classes.select("v", "sq").toArrow()
    x = matrix(sample.column("v")) if sample.num_rows else np.zeros((0, of["size"]))
    order = np.lexsort(x.T[:2]) if len(x) else []  # the same tree however the sample's rows arrive
    fitted = Tree(_lifted(x, sample.column("sq").to_numpy(), largest)[order])
    tree = spark.sparkContext.broadcast(fitted)
    index = scratch.save(classes.mapInArrow(_filed(tree, largest), "leaf int, rep long, h binary, u double, v binary"), f"index{tag}")
    bins = Bins({r["leaf"]: r["count"] for r in index.groupBy("leaf").count().toLocalIterator()}, fitted.leaves)
    asking = classes.where("asking > 0").select("h", "v", "u")
    most = _calibrated(asking, of["asking"], index, fitted, k, recall)
    bins = spark.sparkContext.broadcast(bins)
    visits = asking.mapInArrow(_visits(tree, bins, most), "bin long, h binary, v binary, leaves binary")
    binned = index.mapInArrow(_binned(bins), "bin long, leaf int, rep long, h binary, v binary")
    return meet(visits, binned, _searched(k + 1), _FOUND, scratch, f"leaves{tag}")


def _binned(bins):
    def run(batches):
        for batch in batches:
            at = bins.value.of_row(batch.column("leaf").to_numpy(), batch.column("u").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at), *(batch.column(c) for c in ("leaf", "rep", "h", "v"))], names=["bin", "leaf", "rep", "h", "v"])

    return run


def _calibrated(asking: DataFrame, n: int, index: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """How many leaves a query visits: widened by one until the visits hold enough of the true neighbours of the calibration queries."""
    some = (asking.where(F.col("u") >= 1 - CALIBRATED / n) if n > CALIBRATED else asking).toArrow()
    if tree.leaves == 1 or not some.num_rows:
        return tree.leaves
    q, digests = matrix(some.column("v")), some.column("h").to_pylist()
    true = index.mapInArrow(_in_full(q, digests, k), "q int, score double, rep long, leaf int")
    true = _largest(true, "q", "rep", k).groupBy("q").agg(F.collect_list("leaf").alias("leaves")).toPandas()
    if true.empty:
        return tree.leaves
    near = tree.near(_asked(q))
    holds = np.zeros(tree.leaves + 1)  # how many neighbours the visit of each place in the order brings
    for i, leaves in zip(true["q"], true["leaves"]):
        place = np.empty(tree.leaves, np.int64)
        place[tree.visit(near[i].tolist(), tree.leaves)] = np.arange(tree.leaves)
        np.add.at(holds, place[leaves] + 1, 1)
    most, total, got = 1, holds.sum(), holds[1]
    while got < recall * total:
        most += 1
        got += holds[most]
    return most
