"""Exact set-similarity join of word shingles (Jaccard >= 0.75) with signature trees.

Two sets that link share a token among each one's rarest tokens (a quarter of the set and one more), in one order that all
sets use. Documents that share such a token are the members of a signature tree: leaves hold a document's token bitmap and
size, inner nodes the OR of their children's bitmaps and the range of their sizes. A dual traversal drops every pair of
nodes whose largest possible overlap can't reach what the smallest sizes need. What is left is compared exactly.

Components of links are found in two steps, so that a group of near copies costs links in proportion to its size, not to
its square: first the members of a tree are compared with its smallest document; then the trees are traversed for pairs of
documents that are in different components, whose nodes can then be dropped whole if all their documents are in one. Pairs that
a traversal leaves aren't rows of any table: the documents that they reach meet again with their sets, in the same small groups.

Shingles are compared as 64-bit hashes of their words' 64-bit hashes: two texts of n shingles count one too many in common with a
chance of about n * n / 2**64, less than one in 10**10 for texts of 40,000 words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, local_components, shingle_sets, small

SKETCH_BITS = 20  # buckets of the token counts that order tokens; any number gives the same links
SLICES = 16
BLOCK = 512  # members of a tree; larger groups become several trees, traversed in pairs
FANOUT = 8
WANTED = 1_000_000  # documents to compare whose ids are broadcast; beyond it all texts are joined
UNIT_TOKENS = 1 << 23  # of the sets that are compared in one place, 64 MB; more are dealt out in parts
LISTED = 256  # a document in more trees than this may return a pair from several of them


def need(total: np.ndarray) -> np.ndarray:
    """The least overlap of two sets of that total size at a Jaccard similarity of 0.75: overlap >= 3/7 of the total."""
    return -(-3 * total // 7)


# ---------------------------------------------------------------- passes over the texts


def _sets_of(batch, k):
    return shingle_sets(batch.column("text").to_pylist(), k)


def _summaries(k):
    """(doc_id, n, sid) for each document, and at the end of a partition its token counts, compressed, by slice."""

    def run(batches):
        counts, wait, waiting = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        names = ["doc_id", "n", "sid", "slice", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

        def count():
            nonlocal waiting
            if wait:
                counts[:] += np.bincount(np.concatenate(wait), minlength=len(counts))
            wait.clear()
            waiting = 0

        for batch in batches:
            sizes, sids = [], []
            for s in _sets_of(batch, k):
                sizes.append(len(s))
                sids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                wait.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                waiting += len(s)
                if waiting > 1 << 21:
                    count()
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip((sizes, sids, none, none), kinds[1:]))], names=names)
        count()
        if counts.any():
            parts = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(counts, SLICES)]
            none = [None] * SLICES
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, range(SLICES), parts), kinds)], names=names)

    return run


def _add_counts(keys, frames_of):
    import pandas as pd

    total = None
    for blob in frames_of["counts"]:
        x = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
        total = x if total is None else total + x
    out = {"slice": [int(frames_of["slice"].iloc[0])], "salt": [int(frames_of["salt"].iloc[0])]}
    return pd.DataFrame(out | {"counts": [zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)]})


def _levels(made: DataFrame) -> np.ndarray:
    """How frequent each bucket's tokens are, as a byte: 1 MB, whatever the input."""
    rows = made.where("slice is not null").select("slice", F.pmod(F.xxhash64("counts"), F.lit(32)).cast("int").alias("salt"), "counts")
    kind = "slice int, salt int, counts binary"
    rows = rows.groupBy("slice", "salt").applyInPandas(_add_counts, kind).withColumn("salt", F.lit(0))
    rows = rows.groupBy("slice", "salt").applyInPandas(_add_counts, kind).collect()  # SLICES rows
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        x = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
        out[r["slice"] * len(x) : (r["slice"] + 1) * len(x)] = np.minimum(255, 16 * np.log2(1.0 + x))
    return out


def signature(s: np.ndarray) -> bytes:
    """The bitmap of a set; its width, a power of two, is three times the size at least, so that not many tokens share a bit."""
    width = max(64, 1 << int(3 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _prefixes(levels, k):
    """(doc_id, n, sig, prefix): the tokens of which one must be shared by any set that links."""

    def run(batches):
        level = levels.value
        for batch in batches:
            sizes, sigs, prefixes = [], [], []
            for s in _sets_of(batch, k):
                rank = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")  # s is sorted: ties go by the token itself
                sizes.append(len(s))
                sigs.append(signature(s) if len(s) else b"")
                prefixes.append(s[order[: len(s) - int(-(-3 * len(s) // 4)) + 1]].view(np.int64) if len(s) else s.view(np.int64))
            offsets = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *prefixes]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "n", "sig", "prefix"])

    return run


def _shared_only(batches):
    """Of rows sorted by token, those whose token another row has. Carries one row, however large a group is."""
    last, kept = None, False  # the row before, and whether it was returned
    out = lambda t, d: pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(d, pa.int64())], names=["token", "rep"])
    for batch in batches:
        t = batch.column(0).to_numpy(zero_copy_only=False)
        d = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(t):
            continue
        same = t[1:] == t[:-1]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and last[0] == t[0]:
            keep[0] = True
            if not kept:
                yield out([last[0]], [last[1]])
        last, kept = (t[-1], d[-1]), bool(keep[-1])
        if keep.any():
            yield out(t[keep], d[keep])


# ---------------------------------------------------------------- trees


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of half the width and so on, down to that many words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _tree(bits, n, cluster):
    """Levels from the leaves to one root: (bitmaps, least size, most size, most tokens without a bit of their own, cluster or -1)."""
    extra = n - np.bitwise_count(bits).sum(1).astype(np.int64)
    level = (bits, n, n, extra, cluster)
    levels = [level]
    while len(levels[-1][1]) > 1:
        bits, low, high, extra, cluster = levels[-1]
        at = np.arange(0, len(low), FANOUT)
        c1, c2 = np.minimum.reduceat(cluster, at), np.maximum.reduceat(cluster, at)
        levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at), np.where(c1 == c2, c1, -1)))
    return levels


def _possible(x, i, y, j):
    """Whether nodes i of level x and j of level y can hold two documents that link and are in different clusters."""
    bx, lx, hx, ex, cx = x
    by, ly, hy, ey, cy = y
    ok = (4 * hx[i] >= 3 * ly[j]) & (4 * hy[j] >= 3 * lx[i]) & ~((cx[i] == cy[j]) & (cx[i] >= 0))
    i, j = i[ok], j[ok]
    words = min(bx.shape[1], by.shape[1])
    if bx.shape[1] != by.shape[1]:  # folding adds tokens without a bit of their own; the bound by common bits needs them anew
        fx, fy = fold(bx, words), fold(by, words)
        ex = ex + (np.bitwise_count(bx).sum(1).astype(np.int64) - np.bitwise_count(fx).sum(1)) if bx.shape[1] > words else ex
        ey = ey + (np.bitwise_count(by).sum(1).astype(np.int64) - np.bitwise_count(fy).sum(1)) if by.shape[1] > words else ey
        bx, by = fx, fy
    most = np.bitwise_count(bx[i] & by[j]).sum(1).astype(np.int64) + np.minimum(ex[i], ey[j])
    most = np.minimum(most, np.minimum(hx[i], hy[j]))
    good = most >= need(lx[i] + ly[j])
    return i[good], j[good]


def traverse(x, y, limit: int = 1 << 16):
    """Pairs of leaves of two trees that no node ruled out: index arrays, in parts."""
    stack = [(len(x) - 1, len(y) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b, i, j = stack.pop()
        if len(i) > limit:
            half = len(i) // 2
            stack += [(a, b, i[:half], j[:half]), (a, b, i[half:], j[half:])]
            continue
        i, j = _possible(x[a], i, y[b], j)
        if not len(i):
            continue
        if a == b == 0:
            yield i, j
            continue
        if a >= b:  # go down in the taller tree
            child = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            ok = child < len(x[a - 1][1])
            stack.append((a - 1, b, child[ok], np.repeat(j, FANOUT)[ok]))
        else:
            child = (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            ok = child < len(y[b - 1][1])
            stack.append((a, b - 1, np.repeat(i, FANOUT)[ok], child[ok]))


def group_pairs(side, rep, cluster, n, sigs, tree=None, lists=None):
    """Candidate pairs between the members of side 0 and side 1 (or within side 0 if there is no other), by dual traversal.

    lists has the numbers of each member's trees, or None: a pair that meets in several trees is returned by that of the smallest number.
    """
    known: dict[int, frozenset | None] = {}

    def first(i: int, j: int) -> bool:
        for x in (i, j):
            if x not in known:
                known[x] = None if lists[x] is None else frozenset(lists[x])
        p, q = known[i], known[j]
        return p is None or q is None or min(p & q) == tree

    width = np.array([len(s) for s in sigs])
    trees = {}
    for s in (0, 1):
        for w in np.unique(width[side == s]):
            at = np.flatnonzero((side == s) & (width == w))
            at = at[np.lexsort((n[at], cluster[at]))]
            bits = np.frombuffer(b"".join([sigs[i] for i in at]), np.uint64).reshape(len(at), -1)
            trees[s, w] = at, _tree(bits, n[at], cluster[at])
    other = 1 if (side == 1).any() else 0
    found = []
    for (s, w), (at, x) in trees.items():
        for (s2, w2), (at2, y) in trees.items():
            if s != 0 or s2 != other or max(w, w2) > 4 * min(w, w2):
                continue
            for i, j in traverse(x, y):
                if lists is not None:
                    own = np.fromiter(map(first, at[i].tolist(), at2[j].tolist()), bool, len(i))
                    i, j = i[own], j[own]
                a, b = rep[at[i]], rep[at2[j]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b])
    return np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)


def _runs(batches, keys: list[str]):
    """Of batches of rows sorted by some columns, each run of equal ones as one table."""
    rows, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [tuple(r.values()) for r in batch.select(keys).to_pylist()]
        cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            if rows and at[lo] != key:
                yield pa.Table.from_batches(rows)
                rows = []
            key = at[lo]
            rows.append(batch.slice(lo, hi - lo))
    if rows:
        yield pa.Table.from_batches(rows)


def _pairs_of(t: pa.Table, sigs: list[bytes], n: np.ndarray) -> np.ndarray:
    col = lambda c: t.column(c).to_numpy()
    return group_pairs(col("side"), col("rep"), col("cluster"), n, sigs, int(col("tree")[0]), t.column("trees").to_pylist())


def units(pairs: np.ndarray, rep: np.ndarray, side: np.ndarray, n: np.ndarray, most: int = UNIT_TOKENS):
    """(unit, side, row) for the members of a group that candidate pairs reach, which are compared exactly where they meet again.

    A unit is a component of the pairs, so a group's units have no more rows than the group, however many pairs it has. One of more tokens than
    `most` is dealt out to pairs of parts of half as many.
    """
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    root = local_components(len(nodes), at[:, 0], at[:, 1])
    member = np.flatnonzero(np.isin(rep, nodes))
    own = root[np.searchsorted(nodes, rep[member])]
    two = bool((side == 1).any())
    for r in np.unique(own):
        rows = member[own == r]
        if n[rows].sum() <= most:
            yield from ((f"{r}", int(side[i]), int(i)) for i in rows)
            continue
        parts = []  # of each side by itself: (side, rows)
        for s in (0, 1):
            mine = rows[side[rows] == s]
            place = (np.cumsum(n[mine]) - n[mine]) // max(1, most // 2)
            parts += [(s, mine[place == p]) for p in np.unique(place)]
        for x, (s, first) in enumerate(parts):
            for y, (s2, second) in enumerate(parts[x:], x):
                if two and s == s2:
                    continue
                yield from ((f"{r}-{x}-{y}", 0, int(i)) for i in first)
                if x != y:
                    yield from ((f"{r}-{x}-{y}", 1, int(i)) for i in second)


def _met(batches):
    """Over rows sorted by (tree, s1, s2): the units of each group. A group has 2 * BLOCK rows or so."""
    for t in _runs(batches, ["tree", "s1", "s2"]):
        col = lambda c: t.column(c).to_numpy()
        pairs = _pairs_of(t, t.column("sig").to_pylist(), col("n"))
        tree, s1, s2 = (int(col(c)[0]) for c in ("tree", "s1", "s2"))
        found = list(units(pairs, col("rep"), col("side"), col("n"))) if len(pairs) else []
        at = np.array([i for _, _, i in found], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{tree}-{s1}-{s2}-{u}" for u, _, _ in found], pa.string()), pa.array([tree] * len(found), pa.int64()), pa.array([s for _, s, _ in found], pa.int32()), pa.array(col("rep")[at]), pa.array(col("cluster")[at])],
            names=["unit", "tree", "side", "rep", "cluster"],
        )


def _unit_links(k):
    def run(batches):
        for t in _runs(batches, ["unit"]):
            links = _forest_of(t, list(shingle_sets(t.column("text").to_pylist(), k)))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _forest_of(t: pa.Table, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links of a unit, compared by their sets."""
    pairs = _pairs_of(t, [signature(s) for s in sets], np.array([len(s) for s in sets]))
    place = {r: i for i, r in enumerate(t.column("rep").to_pylist())}
    root = dict(zip(place, t.column("cluster").to_pylist()))  # of documents and of their clusters
    root |= {c: c for c in set(root.values())}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x == y:  # another link has joined them
            continue
        r, s = sets[place[a]], sets[place[b]]
        both = len(np.intersect1d(r, s, assume_unique=True))
        if 7 * both >= 3 * (len(r) + len(s)):
            root[max(x, y)] = min(x, y)
            links.append((a, b))
    return links


# ---------------------------------------------------------------- exact comparison


def _bounded(batches):
    """Pairs whose bitmaps allow a link."""
    for batch in batches:
        sig = [batch.column(c).to_pylist() for c in ("sig_a", "sig_b")]
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        keep = np.zeros(batch.num_rows, bool)
        for r, (x, y) in enumerate(zip(*sig)):
            p, q = (np.frombuffer(s, np.uint64)[None, :] for s in (x, y))
            words = min(p.shape[1], q.shape[1])
            p, q = fold(p, words), fold(q, words)
            extra = min(int(na[r]) - int(np.bitwise_count(p).sum()), int(nb[r]) - int(np.bitwise_count(q).sum()))
            keep[r] = int(np.bitwise_count(p & q).sum()) + extra >= -(-3 * int(na[r] + nb[r]) // 7)
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _links(k):
    def run(batches):
        for batch in batches:
            texts = batch.column("text_a")
            coded = pc.dictionary_encode(texts)
            firsts = list(shingle_sets(coded.dictionary.to_pylist(), k))
            keep = []
            for x, s in zip(coded.indices.to_pylist(), shingle_sets(batch.column("text_b").to_pylist(), k)):
                r = firsts[x]
                both = len(r) + len(s) - len(np.union1d(r, s))
                keep.append(7 * both >= 3 * (len(r) + len(s)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, scratch: Scratch, tag: str) -> DataFrame:
    """Of pairs (a, b), those that link: by size, then by bitmap, then exactly. Every b gets its text; the texts of a are dealt
    out to salted groups of a's partners, so that one document with many partners doesn't meet them all in one task."""
    n_of = lambda s: nodes.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"))
    sized = pairs.join(n_of("a"), "a").join(n_of("b"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    sized = scratch.save(sized, f"{tag}_sized")
    ids = scratch.save(sized.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{tag}_met")
    sigs = nodes.select("doc_id", "sig").join(small(ids, WANTED), "doc_id", "left_semi")
    sig_of = lambda s: sigs.select(F.col("doc_id").alias(s), F.col("sig").alias(f"sig_{s}"))
    near = scratch.save(sized.join(sig_of("a"), "a").join(sig_of("b"), "b").mapInArrow(_bounded, "a long, b long"), f"{tag}_bounded")
    salted = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)))
    ids = scratch.save(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{tag}_ids")
    texts = docs.select("doc_id", "text")
    if ids.count() <= WANTED:  # the other documents' texts aren't shuffled
        texts = scratch.save(texts.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]), f"{tag}_texts")
    first = salted.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    second = salted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = scratch.save(second.join(first, ["a", "salt"]).mapInArrow(_links(k), "a long, b long"), f"{tag}_links")
    scratch.drop(f"{tag}_sized", f"{tag}_met", f"{tag}_bounded", f"{tag}_ids", f"{tag}_texts")
    return links


# ---------------------------------------------------------------- the join


def _tree_links(rows: DataFrame, held: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Links between the members of trees, rows (tree, s1, s2, side, rep, cluster, n, sig, trees), enough of them for the components.

    What bitmaps leave possible in a group of near copies grows as its square, so pairs never become rows: the members that such pairs reach do,
    and meet again with their texts, which a shuffle can compress, as it can't their sets.
    """
    keys = ["tree", "s1", "s2"]
    met = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_met, "unit string, tree long, side int, rep long, cluster long")
    met = scratch.save(met, "tree_met")
    ids = scratch.save(met.select(F.col("rep").alias("doc_id")).distinct(), "tree_ids")
    texts = scratch.save(docs.select("doc_id", "text").join(small(ids, WANTED), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "tree_texts")
    whole = met.join(held.select("rep", "trees"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    whole = whole.select("unit", "tree", "side", "rep", "cluster", "trees", "text")
    links = scratch.save(whole.repartition("unit").sortWithinPartitions("unit").mapInArrow(_unit_links(k), "a long, b long"), "tree_links")
    scratch.drop("tree_met", "tree_ids", "tree_texts")
    return links


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def similar_documents(docs: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Per document (doc_id, n_shingles, set_id, component_id) under links of Jaccard >= 0.75 on k-word shingles.

    set_id is the smallest doc_id with the same shingle set (null without words); component_id the smallest doc_id reachable by
    links, itself included. Null, empty and wordless texts have no shingles, link with nothing and are their own component. Texts
    of fewer than k words are one shingle. Repeated rows of one id and text give one row each; rows without an id give a null
    component. Other columns, whatever their names, aren't read. An empty table gives an empty result. Very long texts are taken
    whole. Rows that share an id but not the text are taken as different texts of one document for n_shingles alone.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sigtree")
    docs = _clean(docs)
    made = scratch.save(docs.mapInArrow(_summaries(k), "doc_id long, n long, sid binary, slice int, counts binary"), "sets")
    levels = spark.sparkContext.broadcast(_levels(made))
    rows = made.where("slice is null").select("doc_id", "n", "sid")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("set_id"))
    kept = classes.select(F.col("set_id").alias("doc_id")).distinct()
    nodes = docs.mapInArrow(_prefixes(levels, k), "doc_id long, n long, sig binary, prefix array<bigint>").where("n > 0")
    nodes = scratch.save(nodes.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "nodes")
    tokens = nodes.select(F.explode("prefix").alias("token"), F.col("doc_id").alias("rep"))
    shared = tokens.repartition("token").sortWithinPartitions("token", "rep").mapInArrow(_shared_only, "token long, rep long")
    shared = scratch.save(shared.distinct(), "shared")
    # Tokens with the same members make the same tree; one of them is enough.
    code = F.xxhash64("rep")
    groups = shared.groupBy("token").agg(F.count("*").alias("size"), F.min("rep").alias("pivot"), F.bit_xor(code).alias("h1"), F.sum(F.shiftright(code, 16)).alias("h2")).where("size > 1")
    groups = groups.groupBy("size", "pivot", "h1", "h2").agg(F.min("token").alias("token"))
    members = scratch.save(shared.join(groups.select("token", "size", "pivot"), "token"), "members")
    stars = members.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    links = _verified(stars, nodes, docs, k, scratch, "star")
    near = components(links, scratch, "near")
    placed = members.join(near, members.rep == near.node, "left").select("token", "rep", "size", F.coalesce("component", "rep").alias("cluster"))
    placed = scratch.save(placed, "placed")
    # Trees whose members are in several components get short numbers, as each row carries those of its document's trees.
    mixed = placed.groupBy("token").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x <> y")
    mixed = scratch.save(mixed.select("token", F.monotonically_increasing_id().alias("id")), "mixed")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(2**33 - 1)
    most = mixed.agg(F.coalesce(F.max(part), F.lit(0)).alias("parts"), F.coalesce(F.max(place), F.lit(0)).alias("places")).first()
    stride = most["places"] + 1
    number = part * stride + place
    number = number.cast("int") if (most["parts"] + 1) * stride < 2**31 else number
    placed = placed.join(mixed.select("token", number.alias("tree")), "token").drop("token")
    lists = placed.groupBy("rep").agg(F.count("*").alias("many"), F.collect_list("tree").alias("trees"))  # no longer than a prefix
    lists = lists.select("rep", F.when(F.col("many") <= LISTED, F.col("trees")).alias("trees"))
    held = scratch.save(lists.join(nodes.select(F.col("doc_id").alias("rep"), "n", "sig"), "rep"), "held")
    rest = placed.join(held, "rep")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("own", own)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("tree", F.least("own", "other").alias("s1"), F.greatest("own", "other").alias("s2"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "cluster", "n", "sig", "trees")
    more = _tree_links(rest, held, docs, k, scratch)
    found = components(links.union(more), scratch, "all")
    by_doc = rows.join(classes, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    out = by_doc.join(found, by_doc.set_id == found.node, "left")
    out = out.select("doc_id", "n_shingles", "set_id", F.coalesce("component", "set_id", "doc_id").alias("component_id"))
    scratch.drop("shared", "members", "placed", "nodes", "mixed", "held", "star_links", "tree_links")
    return out

