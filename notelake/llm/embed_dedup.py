"""Near-duplicate vectors by Euclidean p-stable hashing: in each table a bucket is the quantised projections of the normalised vector
on random directions; vectors that share a bucket are compared exactly.

Equal vectors are one representative with a count. A bucket's vectors are compared in blocks as matrix products; each pair is counted
in the first table where it meets, so links are counted once. A bucket returns counts per vector and a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, local_components

THRESHOLD = 0.93
TABLES = 24
DIRECTIONS = 8  # of one table
WIDTH = 1.2  # of a quantisation step; vectors with cosine 0.93 are 0.374 apart, unrelated ones about 1.41
BLOCK = 1024
SMALL = 64  # vectors in a bucket that is compared along with others


def normalised(vectors: list) -> np.ndarray:
    """Vectors of length 1; the largest component goes first, so that no square over- or underflows."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, tables: int, directions: int, width: float, seed: int = 7) -> np.ndarray:
    """A 64-bit bucket number for each vector and table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * directions))
    b = rng.random(tables * directions) * width
    q = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, directions)
    odd = rng.integers(1, 2**62, directions) | 1
    mixed = (q.view(np.uint64) * odd.astype(np.uint64)).sum(2, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def _coded(tables, directions, width):
    """(label, rep, vid, many, vector, codes): each vector once, with its bucket number in every table."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for at in by_size.values():
                c = codes(normalised([vectors[i] for i in at]), tables, directions, width)
                raw = pa.array([np.asarray(vectors[i], np.float64).tobytes() for i in at], pa.binary())
                label, rep, vid, many = (batch.column(x).take(pa.array(at)) for x in ("label", "rep", "vid", "many"))
                yield pa.RecordBatch.from_arrays([label, rep, vid, many, raw, pa.array([r.tobytes() for r in c], pa.binary())], names=["label", "rep", "vid", "many", "vector", "codes"])

    return run


def _dealt(tables):
    """(label, t, code, rep, vid) of each vector and table: what is dealt out to find shared buckets, without the vectors."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int64)
            each = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            t = pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("label").take(each), t, pa.array(c), batch.column("rep").take(each), batch.column("vid").take(each)], names=["label", "t", "code", "rep", "vid"])

    return run


def _compare(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """Counts of links and a spanning star, of one bucket's block pair."""
    t = rows.column("t")[0].as_py()
    rep, many, side = (rows.column(c).to_numpy() for c in ("rep", "many", "side"))
    raw = rows.column("vector").to_pylist()
    sizes = np.array([len(r) for r in raw])
    code = np.stack([np.frombuffer(c, np.int64) for c in rows.column("codes").to_pylist()])
    links = np.zeros(len(rep), np.int64)
    pairs = [np.empty((0, 2), np.int64)]
    within = not (side == 1).any()
    for size in np.unique(sizes):
        first = np.flatnonzero((side == 0) & (sizes == size))
        second = first if within else np.flatnonzero((side == 1) & (sizes == size))
        if not len(first) or not len(second):
            continue
        x = normalised([np.frombuffer(raw[i]) for i in first])
        y = x if within else normalised([np.frombuffer(raw[i]) for i in second])
        for lo in range(0, len(first), 256):
            i, j = np.nonzero(x[lo : lo + 256] @ y.T >= threshold)
            i, j = first[lo + i], second[j]
            i, j = (i[i < j], j[i < j]) if within else (i, j)
            if t and len(i):
                new = np.ones(len(i), bool)
                for u in range(t):
                    new &= code[i, u] != code[j, u]
                i, j = i[new], j[new]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            pairs.append(np.stack([i, j], 1))
            if sum(map(len, pairs)) > 1 << 18:  # keep a forest of them only
                pairs = [_forest(len(rep), np.concatenate(pairs))]
    forest = _forest(len(rep), np.concatenate(pairs))
    some = np.flatnonzero(links)
    a = np.concatenate([rep[some], rep[forest[:, 0]]])
    b = np.concatenate([np.full(len(some), -1), rep[forest[:, 1]]])
    n = np.concatenate([links[some], np.zeros(len(forest), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(np.arange(len(a)) >= len(some))], names=["a", "b", "n", "edge"])


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    root = local_components(n, pairs[:, 0], pairs[:, 1])
    far = np.flatnonzero(root != np.arange(n))
    return np.stack([far, root[far]], 1)


def _compare_small(rows: pa.Table, group: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Counts of links and a spanning forest of many small buckets at once: rows k places apart in the sorted table, for each k."""
    t, rep, many = (rows.column(c).to_numpy() for c in ("t", "rep", "many"))
    raw = rows.column("vector").to_pylist()
    code = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int64).reshape(len(rep), -1)
    sizes, table = np.array(list(map(len, raw))), np.arange(code.shape[1])
    links, pairs = np.zeros(len(rep), np.int64), [np.empty((0, 2), np.int64)]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x, g = normalised(np.frombuffer(b"".join([raw[i] for i in at])).reshape(len(at), -1)), group[at]
        for k in range(1, len(at)):
            i = np.flatnonzero(g[k:] == g[:-k])
            if not len(i):
                break
            i = i[np.einsum("ij,ij->i", x[i], x[i + k]) >= threshold]
            i, j = at[i], at[i + k]
            new = ~((code[i] == code[j]) & (table < t[i][:, None])).any(1)  # a pair counts in the first table where it meets
            i, j = i[new], j[new]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            pairs.append(np.stack([i, j], 1))
    nodes, at = np.unique(rep, return_inverse=True)
    total = np.bincount(at, links, len(nodes)).astype(np.int64)
    forest = _forest(len(nodes), at[np.concatenate(pairs)])
    some = np.flatnonzero(total)
    a, b = np.concatenate([nodes[some], nodes[forest[:, 0]]]), np.concatenate([np.full(len(some), -1), nodes[forest[:, 1]]])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.concatenate([total[some], np.zeros(len(forest), np.int64)]), pa.int64()), pa.array(np.arange(len(a)) >= len(some))], names=["a", "b", "n", "edge"])


def _compared(threshold):
    """Over rows sorted by bucket: small buckets together, large ones as a matrix product each."""

    def whole(rows: pa.Table, cuts: np.ndarray):
        sizes = np.diff(cuts)
        small = sizes <= SMALL
        if small.any():
            group = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.flatnonzero(small[group])
            yield _compare_small(rows.take(pa.array(keep)), group[keep], threshold)
        for lo, hi in zip(cuts[:-1][~small].tolist(), cuts[1:][~small].tolist()):
            yield _compare(rows.slice(lo, hi - lo), threshold)

    def cuts_of(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        for c in ("label", "t", "code", "s1", "s2"):
            k = rows.column(c).to_numpy()
            change[1:] |= k[1:] != k[:-1]
        return np.array([0, *np.flatnonzero(change), rows.num_rows])

    def run(batches):
        held: list = []  # the last bucket may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            cuts = cuts_of(rows)
            if len(cuts) > 2:
                yield from whole(rows.slice(0, cuts[-2]), cuts[:-1])
            held = rows.slice(cuts[-2]).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from whole(rows, np.array([0, rows.num_rows]))

    return run


def similar_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH, scratch: Scratch | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row, under links of cosine >= threshold between vectors of one label and one length.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with nothing: their own
    component, kept. Equal vectors link with each other. Repeated rows of one vec_id count as vectors of their own in n_links. A null
    vec_id gives null results. An empty table gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embed")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    e = F.col("embedding")
    whole = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(whole & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    # -0.0 and 0.0 are equal here; scaled copies are found as other vectors, through the buckets
    rows = rows.withColumn("same", F.when(F.col("valid"), F.sha2(F.concat_ws(",", "label", F.transform(e, lambda v: (v + 0.0).cast("string"))), 256)))
    rows = scratch.save(rows, "rows")
    groups = rows.where("valid").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    groups = scratch.save(groups, "groups")
    one = rows.where("valid").join(groups, "same").where("vec_id = rep").dropDuplicates(["same"]).select("rep", F.xxhash64("same").alias("vid"), "many", "label", "embedding")
    coded = one.mapInArrow(_coded(tables, directions, width), "label long, rep long, vid long, many long, vector binary, codes binary")
    coded = scratch.save(coded, "coded")
    keys = ["label", "t", "code"]
    dealt = coded.select("label", "rep", "vid", "codes").mapInArrow(_dealt(tables), "label long, t int, code long, rep long, vid long")
    dealt = scratch.save(dealt, "buckets")
    size = dealt.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    # Only vectors that share a bucket are dealt out with it.
    held = dealt.join(size, keys).join(coded.select("rep", "vid", "many", "vector", "codes"), ["rep", "vid"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    held = held.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select(*keys, F.least("own", "other").alias("s1"), F.greatest("own", "other").alias("s2"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "many", "vector", "codes")
    group = [*keys, "s1", "s2"]
    found = held.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compared(threshold), "a long, b long, n long, edge boolean")
    found = scratch.save(found, "found")
    scratch.drop("buckets", "coded")
    counts = found.where("not edge").groupBy("a").agg(F.sum("n").alias("links"))
    near = components(found.where("edge").select("a", "b"), scratch)
    by_class = groups.join(counts, groups.rep == counts.a, "left").join(near, groups.rep == near.node, "left")
    by_class = by_class.select("same", "rep", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "same").join(by_class, "same", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
