"""Hard negatives by a pivot table: for an anchor and each of its positives, the best rows of other labels within a band of scores.

Scores are inner products of whole numbers. A vector x gets one more component, sqrt(M^2 - |x|^2), an anchor a zero, so that
score = (|q|^2 + M^2 - distance^2) / 2. Each vector's distances to a few pivots are stored with it; by the triangle inequality they bracket
its distance to an anchor, and so its score. Vectors lie in cells by their nearest pivot and their distance to it; the cells' least and
greatest distances say which cells an anchor must visit, the stored ones which rows of a cell are scored exactly. A first round visits the
anchor's own cell alone; the scores that it finds are floors for the second, which visits all other cells that can hold anything better.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, spread_join
from .vectors import Bins, distinct, matrix, meet, packed

PIVOTS = 16
RINGS = 16  # of a pivot: cells are (nearest pivot, ring)
SAMPLE = 4096  # distinct vectors that pivots and rings are chosen from, about; all rows are in the table
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SCALE = 256.0
LARGEST = 2.0**46  # squared length: below it every score and its hundredfold is exact in a double
SLACK = 1e-5  # of the brackets, relative to the squared lengths: the stored distances are floats
COPIES = 500_000  # further ids of equal vectors are broadcast up to this number; beyond it they are joined


class Pivots:
    """Pivots chosen farthest first from a sample, and the rings' edges."""

    def __init__(self, v: np.ndarray, sq: np.ndarray, largest: float, pivots: int = PIVOTS, rings: int = RINGS):
        self.largest = largest
        x = self._lifted(v, sq)
        at = [int(np.lexsort((*x.T[:2], sq))[-1])]
        far = ((x - x[at[0]]) ** 2).sum(1)
        while len(at) < min(pivots, len(x)) and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
        self.at = x[at]
        d = self._distances(x)
        near = d.argmin(1)
        self.edges = [np.quantile(d[near == p, p], np.arange(1, rings) / rings) if (near == p).any() else np.zeros(rings - 1) for p in range(len(at))]
        self.rings, self.cells = rings, len(at) * rings

    def _lifted(self, v, sq):
        return np.concatenate([v, np.sqrt(np.maximum(self.largest - sq, 0))[:, None]], 1)

    def _distances(self, x):
        sq = (x**2).sum(1)[:, None] + (self.at**2).sum(1) - 2 * x @ self.at.T
        return np.sqrt(np.maximum(sq, 0))

    def of_rows(self, v, sq):
        return self._distances(self._lifted(v, sq))

    def of_anchors(self, v):
        return self._distances(np.concatenate([v, np.zeros((len(v), 1))], 1))

    def cell(self, d: np.ndarray) -> np.ndarray:
        near = d.argmin(1)
        out = np.zeros(len(d), np.int64)
        for p in range(len(self.at)):
            at = np.flatnonzero(near == p)
            out[at] = p * self.rings + np.searchsorted(self.edges[p], d[at, p])
        return out

    def bracket(self, sq: np.ndarray, d: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of anchors (squared lengths and distances) with what lies between least and most of each pivot."""
        low, high = np.zeros((len(d), len(least))), np.full((len(d), len(least)), np.inf)
        for p in range(d.shape[1]):
            mine = d[:, p, None]
            np.maximum(low, np.maximum(least[:, p] - mine, mine - most[:, p]), out=low)
            np.minimum(high, mine + most[:, p], out=high)
        both = sq[:, None] + self.largest
        return (both - high**2) / 2 - SLACK * both, (both - low**2) / 2 + SLACK * both


def _filed(pivots):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            d = pivots.value.of_rows(v, batch.column("sq").to_numpy())
            short = np.abs(v).max() < 2**15  # whole numbers, so nothing is lost
            kept = [r.tobytes() for r in (v.astype(np.int16) if short else v.astype(np.int64))]
            d32 = pa.FixedSizeListArray.from_arrays(pa.array(d.astype(np.float32).ravel()), d.shape[1]).cast(pa.list_(pa.float32()))
            names = ["label", "rep", "h", "u"]
            yield pa.RecordBatch.from_arrays([pa.array(pivots.value.cell(d).astype(np.int32)), *(batch.column(c) for c in names), pa.array(kept, pa.binary()), pa.array([2 if short else 8] * len(v), pa.int32()), d32], names=["cell", *names, "v", "bytes", "d"])

    return run


def _binned(bins):
    def run(batches):
        for batch in batches:
            at = bins.value.of_row(batch.column("cell").to_numpy(), batch.column("u").to_numpy())
            names = ["cell", "label", "rep", "h", "v", "bytes", "d"]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(batch.column(c) for c in names)], names=["bin", *names])

    return run


def _lists(column) -> list[np.ndarray]:
    flat, ends = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, None
    ends = np.cumsum(flat.value_lengths().to_numpy())
    return np.split(flat.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def _visits(pivots, bins, cells, home: bool):
    """The asked bins of each request, with the cells there: its own cell, or all others whose bracket reaches a band above its floor."""

    def run(batches):
        which, least, most = cells.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            d = pivots.value.of_anchors(v)
            own = pivots.value.cell(d)
            s_low, s_high = pivots.value.bracket((v**2).sum(1), d, least, most)
            low, high, floor = (_lists(batch.column(c)) for c in ("low", "high", "floor"))
            who, where, what = [], [], []
            for i in range(len(v)):
                if home:
                    asked = own[i : i + 1][np.isin(own[i], which)]
                else:
                    reach = np.zeros(len(which), bool)
                    for a, b, c in zip(low[i], high[i], floor[i]):
                        reach |= (s_high[i] >= max(a, c)) & (s_low[i] <= b)
                    asked = which[reach & (which != own[i])]
                for b, here in bins.value.of_visits(asked) if len(asked) else ():
                    who.append(i), where.append(b), what.append(here.astype(np.int32).tobytes())
            at = pa.array(who, pa.int64())
            names = [n for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(what, pa.binary()), *(batch.column(c).take(at) for c in names)], names=["bin", "cells", *names])

    return run


_FOUND = "h binary, label long, band int, score double, rep long, oh binary, olabel long"


def _bands(s: np.ndarray, k: int, id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of each row's k largest finite scores, ties to smaller ids."""
    if s.shape[1] > k:
        i, j = np.nonzero((s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]) & (s > -np.inf))
    else:
        i, j = np.nonzero(s > -np.inf)
    order = np.lexsort((id[j], -s[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def _searched(pivots, same: bool, k: int):
    """Of each request, the k best rows of its own label, or of others, in each of its bands: brackets first, then exact scores."""

    def answer(visits: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if visits.num_rows and rows.num_rows:
            width = rows.column("bytes").to_numpy()
            raw, x = rows.column("v").to_pylist(), np.empty((rows.num_rows, len(visits.column("v")[0].as_py()) // 8))
            for w, kind in ((2, np.int16), (8, np.int64)):
                at = np.flatnonzero(width == w)
                x[at] = np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(len(at), x.shape[1])
            d = np.stack(_lists(rows.column("d"))).astype(np.float64)
            cell, label, rep = (rows.column(c).to_numpy() for c in ("cell", "label", "rep"))
            q, asked = matrix(visits.column("v")), visits.column("label").to_numpy()
            seen = [np.frombuffer(b, np.int32) for b in visits.column("cells").to_pylist()]
            low, high, floor = (_lists(visits.column(c)) for c in ("low", "high", "floor"))
            for of in np.unique(asked):
                fits = np.flatnonzero((label == of) == same)
                who = np.flatnonzero(asked == of)
                for lo in range(0, len(who) if len(fits) else 0, 256):
                    out += _pairs(who[lo : lo + 256], fits, q, x, d, cell, rep, seen, low, high, floor)
        i, band, score, j = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 4
        i, j = pa.array(i), pa.array(j)
        left = {c: visits.column(c).take(i) for c in ("h", "label")}
        right = {o: rows.column(c).take(j) for c, o in (("rep", "rep"), ("h", "oh"), ("label", "olabel"))}
        return pa.table({**left, "band": pa.array(band, pa.int32()), "score": pa.array(score, pa.float64()), **right})

    def _pairs(who, fits, q, x, d, cell, rep, seen, low, high, floor):
        some = q[who]
        own = pivots.value.of_anchors(some)
        s_low, s_high = pivots.value.bracket((some**2).sum(1), own, d[fits], d[fits])
        sees = np.stack([np.isin(cell[fits], seen[i]) for i in who])
        bands = max(len(low[i]) for i in who)
        edge = [np.array([side[i][b] if b < len(side[i]) else none for i in who for b in range(bands)]).reshape(len(who), bands) for side, none in ((low, np.inf), (high, -np.inf), (floor, np.inf))]
        reach = [sees & (s_high >= np.maximum(edge[0], edge[2])[:, b, None]) & (s_low <= edge[1][:, b, None]) for b in range(bands)]
        left = np.flatnonzero(np.logical_or.reduce(reach).any(0))  # rows that some bracket leaves
        if not len(left):
            return
        score = some @ x[fits[left]].T
        for b in range(bands):
            exact = reach[b][:, left] & (score >= edge[0][:, b, None]) & (score <= edge[1][:, b, None])
            i, j = _bands(np.where(exact, score, -np.inf), k, rep[fits[left]])
            yield who[i], np.full(len(i), b), score[i, j], fits[left[j]]

    return answer


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("h", "label", "band").orderBy(F.desc("score"), "rep"))
    return found.withColumn("n", nth).where(f"n <= {k}").drop("n")


class _Table:
    """The pivot table of vectors of one length, and its searches."""

    def __init__(self, classes: DataFrame, of, scratch: Scratch, tag: str):
        spark = self.spark = scratch.spark
        self.scratch, self.tag = scratch, tag
        share = SAMPLE / of["n"]
        sample = (classes.where(F.col("u") < share) if share < 1 else classes).select("v", "sq").toArrow()
        if not sample.num_rows:
            sample = classes.select("v", "sq").limit(SAMPLE).toArrow()
        v, sq = matrix(sample.column("v")), sample.column("sq").to_numpy()
        order = np.lexsort((*v.T[:2], sq))  # the same pivots however the sample's rows arrive
        fitted = Pivots(v[order], sq[order], of["largest"])
        self.pivots = spark.sparkContext.broadcast(fitted)
        schema = "cell int, label long, rep long, h binary, u double, v binary, bytes int, d array<float>"
        table = scratch.save(classes.mapInArrow(_filed(self.pivots), schema), f"table{tag}")
        sides = [f(F.get("d", p)).cast("double").alias(f"{name}{p}") for p in range(len(fitted.at)) for f, name in ((F.min, "least"), (F.max, "most"))]
        cells = table.groupBy("cell").agg(F.count("*").alias("n"), *sides).toPandas().sort_values("cell")  # PIVOTS * RINGS rows at most
        bounds = [cells[[f"{name}{p}" for p in range(len(fitted.at))]].to_numpy() for name in ("least", "most")]
        self.cells = spark.sparkContext.broadcast((cells["cell"].to_numpy(np.int64), *bounds))
        self.bins = spark.sparkContext.broadcast(Bins(dict(zip(cells["cell"].tolist(), cells["n"].tolist())), fitted.cells))
        self.index = table.mapInArrow(_binned(self.bins), "bin long, cell int, label long, rep long, h binary, v binary, bytes int, d array<float>")

    def search(self, requests: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The k best rows of each band of each request (h, label, v, low, high), those of one label or those of others."""
        none = F.transform("low", lambda _: F.lit(float("-inf")))
        requests = self.scratch.save(requests.select("h", "label", "v", "low", "high", none.alias("floor")), f"{name}{self.tag}")
        home = self.scratch.save(_best(self._round(requests, same, k, True, name), k), f"{name}{self.tag}-home")
        full = home.groupBy("h", "label", "band").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(f"n = {k}")
        full = full.groupBy("h", "label").agg(F.map_from_entries(F.collect_list(F.struct("band", "floor"))).alias("full"))
        floors = F.transform("floor", lambda f, b: F.coalesce(F.try_element_at("full", b), f))
        raised = requests.join(full, ["h", "label"], "left").select("h", "label", "v", "low", "high", F.when(F.col("full").isNull(), F.col("floor")).otherwise(floors).alias("floor"))
        return _best(home.union(self._round(raised, same, k, False, name)), k)

    def _round(self, requests: DataFrame, same: bool, k: int, home: bool, name: str) -> DataFrame:
        schema = "bin long, cells binary, h binary, label long, v binary, low array<double>, high array<double>, floor array<double>"
        visits = requests.mapInArrow(_visits(self.pivots, self.bins, self.cells, home), schema)
        return meet(visits, self.index, _searched(self.pivots, same, k), _FOUND, self.scratch, f"{name}{self.tag}-{'own' if home else 'far'}")


def _with_copies(found: DataFrame, copies: DataFrame | None, k: int) -> DataFrame:
    """Found classes as rows: their further ids too, the best k of each band."""
    if copies is None:
        return found
    more = found.join(copies, (F.col("oh") == F.col("ch")) & (F.col("olabel") == F.col("clabel"))).select("h", "label", "band", "score", F.col("cid").alias("rep"), "oh", "olabel")
    return _best(found.union(more), k)


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: float = SCALE, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which anchors is true and each of its
    positives, the best rows of other labels whose score is LOW to HIGH per cent of the positive's.

    A score is the inner product of floor(scale * x), a whole number. Positives are the first other rows of the anchor's label; larger scores
    come first everywhere, ties by the smaller vec_id. A positive of a negative score has no negatives.
    Rows of vectors (vec_id, embedding, label) whose id, label or vector is null, and vectors that are empty or hold a null or non-finite
    component, take no part, nor do vectors longer than LARGEST allows (about 32,000 before scaling), whose scores no double holds exactly. Zero vectors take
    part. Vectors of different lengths aren't compared. Rows that repeat an id, a label and a vector are one; rows of one id that differ are
    rows of their own. An empty table gives none; other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    rows = scratch.save(packed(vectors, anchors, F.col("label"), zeros=True, scale=scale).where(F.col("sq") <= LARGEST), "rows")
    classes, copies = distinct(rows, max(positives + 1, negatives))
    classes = scratch.save(classes, "classes")
    copies = scratch.save(copies.select(F.col("label").alias("clabel"), F.col("h").alias("ch"), F.col("vec_id").alias("cid")), "copies")
    copies = None if copies.isEmpty() else small(copies, COPIES)
    lists = None
    for of in classes.groupBy("size").agg(F.max("sq").alias("largest"), F.count("*").alias("n"), F.sum("asking").alias("asking")).toLocalIterator():
        if of["asking"]:
            one = _of_one_length(classes.where(F.col("size") == of["size"]), of, copies, positives, negatives, scratch)
            lists = one if lists is None else lists.union(one)
    if lists is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    lists = scratch.save(lists, "lists")
    asked = scratch.save(rows.where("asks").select(F.col("vec_id").alias("anchor_id"), "label", "h").distinct(), "anchors")
    out = spread_join(asked, lists, ["h", "label"], ["anchor_id"])
    others = F.slice(F.filter("positives", lambda p: (p["vec_id"] != F.col("anchor_id")) | (p["h"] != F.col("h"))), 1, positives)
    out = out.select("anchor_id", F.explode(others).alias("p"), "bands")
    out = out.select("anchor_id", "p", F.posexplode(F.try_element_at("bands", F.col("p.score").cast("long"))).alias("rank", "n"))
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").cast("long").alias("positive_score"), F.col("n.score").cast("long").alias("negative_score"))


def _of_one_length(classes: DataFrame, of, copies: DataFrame | None, positives: int, negatives: int, scratch: Scratch) -> DataFrame:
    """(h, label, positives, bands) of each anchor's label and vector: its best rows of the label, itself among them, and for each of their
    scores the negatives, by score."""
    tag = str(of["size"])
    table = _Table(classes, of, scratch, tag)
    asked = classes.where("asking > 0").select("h", "label", "v")
    anything = (F.array(F.lit(float(f"{s}inf"))) for s in "-+")
    near = table.search(asked.select("*", *(a.alias(n) for a, n in zip(anything, ("low", "high")))), True, positives + 1, "near")
    near = scratch.save(_with_copies(near, copies, positives + 1), f"near{tag}")
    each = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("rep").alias("vec_id"), F.col("oh").alias("h"), "score")))
    near = scratch.save(near.groupBy("h", "label").agg(each.alias("positives")), f"positives{tag}")
    scores = F.array_sort(F.array_distinct(F.filter(F.transform("positives", lambda p: p["score"]), lambda s: s >= 0)))
    bands = near.select("h", "label", scores.alias("scores")).where("size(scores) > 0")
    bands = bands.join(asked, ["h", "label"]).select(
        "h", "label", "v", F.transform("scores", lambda s: F.ceil(s * LOW / 100).cast("double")).alias("low"), F.transform("scores", lambda s: F.floor(s * HIGH / 100).cast("double")).alias("high")
    )
    found = scratch.save(_with_copies(table.search(bands, False, negatives, "bands"), copies, negatives), f"bands{tag}")
    each = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("rep").alias("vec_id"), "score")))
    found = found.groupBy("h", "label", "band").agg(each.alias("found")).groupBy("h", "label").agg(F.collect_list(F.struct("band", "found")).alias("found"))
    keyed = F.map_from_entries(F.transform("found", lambda f: F.struct(F.get("scores", f["band"]).cast("long").alias("score"), f["found"].alias("rows"))))
    return near.withColumn("scores", scores).join(found, ["h", "label"]).select("h", "label", "positives", keyed.alias("bands"))
