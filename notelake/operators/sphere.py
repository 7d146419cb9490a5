"""Exact joins of vectors by angle: k nearest neighbours of a whole table in another, and pairs within a threshold.

Vectors of length 1 lie in cells, each with the pivot that is nearest. Of a cell its pivot and its radius are known, so the triangle
inequality on the sphere says how near a vector can be to any of its members; so does the plane midway between two pivots. Cells are dealt
to eight bins, more only where a bin's vectors would take more than WIDE bytes, and so are the queries of a bin: where nothing can be excluded
a vector is shuffled some eight times, whatever the number of rows, until N vectors take more than 8 x WIDE; from there on N / WIDE times. A
query first meets its own cell's rows; the k-th best of them bounds the second round, which goes to the other cells that can hold anything
nearer. The driver sees pivots and a number or two per cell and bin, never a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.sources import shared

BIN = 8192  # rows that are one cell, undivided
QUERIES = 4096  # queries that aren't parted any more
BLOCKS = 8  # bins of a table, and parts of a bin's queries, while they are no larger than WIDE
WIDE = 1 << 25  # bytes of the vectors of a bin, or of a part of its queries, at most
HELD = 1 << 20  # cosines or angles that a task holds at once, at most, and pairs that it gives at once, about
PIVOTS = 1024  # at most; about the square root of the rows
SLACK = 1e-7  # of angles: the rounding of an arc cosine near 1


def id_type(df: DataFrame, c: str) -> tuple[str, pa.DataType]:
    """Whole numbers are long, anything else is a string."""
    whole = df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return ("long", pa.int64()) if whole else ("string", pa.string())


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _matrix(column) -> np.ndarray:
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            at = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(np.float64).reshape(len(c), -1))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros((0, 0))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _units(batches):
    """The last column, an array, as the bytes of a vector of length 1 (a zero vector as it is); rows that aren't whole are left out."""
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1).to_pylist()
        at = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all()]
        raw = [(unit(np.array([vectors[i]], np.float64))[0] + 0.0).tobytes() for i in at]
        rest = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())], names=[*batch.schema.names[:-1], "size", "v"])


def _ready(rows: DataFrame, name: str) -> DataFrame:
    """rows (..., embedding) as (..., u, size, v), written; u is a number in [0, 1) from the row's hash."""
    keep = [c for c in rows.columns if c != "embedding"]
    u = F.shiftrightunsigned(F.xxhash64(*keep), 11) / float(1 << 53)
    rows = rows.select(*keep, u.alias("u"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", size int, v binary"
    return shared.written(rows.mapInArrow(_units, schema), name)


def _blocks(batch: pa.RecordBatch, width: int):
    """A batch by some rows at a time, so that so many numbers for each stay within HELD."""
    step = max(1, HELD // 4 // max(1, width))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


class Cells:
    """Pivots, and of each cell the radius, the number of rows, and the bins that hold them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.apart = np.stack([np.linalg.norm(pivots - p, axis=1) for p in pivots])

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = x @ self.pivots.T
        cell = c.argmax(1)
        return cell, _angles(c[np.arange(len(x)), cell])

    def fill(self, counts: dict[int, int], radii: dict[int, float], most: int) -> None:
        n = len(self.pivots)
        self.first, self.parts, self.rows = np.zeros(n, np.int64), np.ones(n, np.int64), np.array([counts.get(c, 0) for c in range(n)])
        self.radius = np.array([radii.get(c, 0.0) for c in range(n)])
        at = held = 0
        for c in range(n):
            if held and held + self.rows[c] > most:
                at, held = at + 1, 0
            self.first[c] = at
            if self.rows[c] > most:
                self.parts[c] = -(-self.rows[c] // most)
                at += int(self.parts[c])
            else:
                held += int(self.rows[c])
        edges = [*np.flatnonzero(np.diff(self.first, prepend=-1)).tolist(), n]
        self.spans = [(int(self.first[lo]), lo, hi, int(self.parts[lo:hi].max())) for lo, hi in zip(edges, edges[1:])]  # bin, its cells, how many bins they fill

    def bin_of(self, cell: np.ndarray, u: np.ndarray) -> np.ndarray:
        return self.first[cell] + np.minimum((u * self.parts[cell]).astype(np.int64), self.parts[cell] - 1)

    def least_angles(self, x: np.ndarray) -> np.ndarray:
        """How near each row can be to any member of each cell, at least."""
        c = x @ self.pivots.T
        own = c.argmax(1)
        apart = self.apart[own]
        midway = np.arcsin(np.clip((c[np.arange(len(x)), own][:, None] - c) / np.where(apart > 0, apart, np.inf), 0, 1))
        return np.maximum(np.maximum(_angles(c) - self.radius, midway), 0)


def _partition(rows: DataFrame, size: int, n: int, name: str):
    """(cells, table): n vectors of one length dealt to cells; the table has bin and cell. What fits into one bin is one cell."""
    spark = rows.sparkSession
    if n <= BIN:
        cells = Cells(np.eye(1, size))
        cells.fill({0: n}, {0: np.pi}, BIN)
        return spark.sparkContext.broadcast(cells), rows.select(F.lit(0).cast("long").alias("bin"), F.lit(0).alias("cell"), "*")
    wanted = int(min(PIVOTS, max(8, n**0.5)))
    some = rows.where(F.col("u") < 2 * wanted / n).select("v").limit(4 * wanted).toArrow() if n > 4 * wanted else rows.select("v").limit(4 * wanted).toArrow()
    x = _matrix(some.column("v")) if some.num_rows else np.zeros((0, size))
    x = np.unique(x, axis=0)
    cells = Cells(x[:: max(1, len(x) // wanted)][:wanted] if len(x) else np.eye(1, size))
    held = spark.sparkContext.broadcast(cells)

    def deal(batches):
        for whole in batches:
            for batch in _blocks(whole, wanted):
                cell, angle = held.value.of(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle), *batch.columns], names=["cell", "angle", *batch.schema.names])

    schema = "cell int, angle double, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = shared.written(rows.mapInArrow(deal, schema), name)
    known = table.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()  # PIVOTS rows at most
    cells.fill({r["cell"]: r["n"] for r in known}, {r["cell"]: r["r"] for r in known}, max(1, min(-(-n // BLOCKS), WIDE // (8 * size))))
    held = spark.sparkContext.broadcast(cells)

    def bin(batches):
        for batch in batches:
            at = held.value.bin_of(batch.column("cell").to_numpy(), batch.column("u").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["bin", *batch.schema.names])

    return held, table.mapInArrow(bin, f"bin long, {schema}")


def _fitting(cells: Cells, batch: pa.RecordBatch, reach: str) -> tuple[np.ndarray, np.ndarray]:
    """(fits, home): whether each row of a batch goes to each cell, and the cell that it is nearest to, of those that have rows. reach: own, that
    cell; others, all others within the column bound of an angle (null: any); later, those from the row's own column cell on."""
    x = _matrix(batch.column("v"))
    if reach == "later":
        home = batch.column("cell").to_numpy()
    else:
        home = np.where(cells.rows > 0, x @ cells.pivots.T, -2).argmax(1)
    if reach == "own":
        fits = np.zeros((len(x), len(cells.pivots)), bool)
        fits[np.arange(len(x)), home] = True
        return fits, home
    bound = np.nan_to_num(batch.column("bound").to_numpy(zero_copy_only=False), nan=np.inf)
    fits = (cells.least_angles(x) <= bound[:, None] + SLACK) & (cells.rows > 0)
    if reach == "later":
        return fits & (np.arange(len(cells.pivots)) >= home[:, None]), home
    fits[np.arange(len(x)), home] = False
    return fits, home


def _counted(held, reach: str):
    """How many rows go to each bin."""

    def run(batches):
        cells, n = held.value, {}
        for whole in batches:
            for batch in _blocks(whole, len(cells.pivots)):
                fits, _ = _fitting(cells, batch, reach)
                for b, lo, hi, many in cells.spans:
                    some = int(fits[:, lo:hi].any(1).sum())
                    for k in range(many if some else 0):
                        n[b + k] = n.get(b + k, 0) + some
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["bin", "n"])

    return run


def _visits(held, reach: str, parts: dict[int, int]):
    """The rows of a batch once per bin that they go to, with the part of its visits and the cells there, as bits; no bits are all cells."""

    def run(batches):
        cells = held.value
        for whole in batches:
            for batch in _blocks(whole, len(cells.pivots)):
                fits, home = _fitting(cells, batch, reach)
                u, rest = batch.column("u").to_numpy(), [c for c in batch.schema.names if c not in ("cell", "u")]
                for b, lo, hi, many in cells.spans:
                    i = np.flatnonzero(fits[:, lo:hi].any(1))
                    if not len(i):
                        continue
                    some = fits[i, lo:hi]
                    every = (some == (cells.rows[lo:hi] > 0)).all(1)
                    bits = pa.array([b"" if e else p.tobytes() for e, p in zip(every, np.packbits(some, axis=1))], pa.binary())
                    kept = [batch.column(c).take(pa.array(i)) for c in rest]
                    for k in range(many):
                        part = np.minimum((u[i] * parts[b + k]).astype(np.int32), parts[b + k] - 1)
                        made = [pa.array(np.full(len(i), b + k)), pa.array(part, pa.int32()), bits, pa.array(home[i], pa.int32())]
                        yield pa.RecordBatch.from_arrays([*made, *kept], names=["bin", "part", "cells", "cell", *rest])

    return run


def _meet(visitors: DataFrame, held, size: int, reach: str, table: DataFrame, answer, schema: str) -> DataFrame:
    """What answer gives for each bin's rows and each part of the visitors (..., u, v[, cell, bound]) that go there."""
    spark = visitors.sparkSession
    n = visitors.mapInArrow(_counted(held, reach), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # a row a bin
    most = lambda k: max(1, min(max(QUERIES, -(-k // BLOCKS)), WIDE // (8 * size)))
    parts = {r["bin"]: -(-r["n"] // most(r["n"])) for r in n}
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in visitors.schema.fields if f.name not in ("cell", "u"))
    visits = visitors.mapInArrow(_visits(held, reach, parts), f"bin long, part int, cells binary, cell int, {fields}")
    many = spark.createDataFrame(list(parts.items()), "bin long, parts int")
    rows = table.drop("u", "angle").join(F.broadcast(many), "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = visits.withColumn("row", F.lit(False)).unionByName(rows.withColumn("row", F.lit(True)), allowMissingColumns=True)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * sum(parts.values()), 4096))
    return met.repartition(groups, "bin", "part").groupBy("bin", "part").applyInArrow(answer, schema)


def _sides(batches) -> tuple[pa.Table, pa.Table]:
    """The visits and the rows of a group."""
    visits, rows = [], []
    for b in batches:
        visits.append(b.filter(pc.invert(b.column("row"))))
        rows.append(b.filter(b.column("row")))
    return pa.Table.from_batches(visits), pa.Table.from_batches(rows)


def _cosines(visits: pa.Table, rows: pa.Table, x: np.ndarray, y: np.ndarray, span: tuple[int, int]):
    """(visits, cosines with all rows) of some visits at a time; -2 where a visit doesn't go to a row's cell. span: the cells of the bin."""
    cell, bits = rows.column("cell").to_numpy() - span[0], visits.column("cells")
    step = max(1, min(512, HELD // len(y)))
    for lo in range(0, len(x), step):
        c = x[lo : lo + step] @ y.T
        some = bits.slice(lo, step).to_pylist()
        for i in (i for i, b in enumerate(some) if b):
            sees = np.unpackbits(np.frombuffer(some[i], np.uint8), count=span[1] - span[0]).astype(bool)
            c[i, ~sees[cell]] = -2.0
        yield np.arange(lo, lo + len(c)), c


def _span(cells: Cells, b: int) -> tuple[int, int]:
    return next((lo, hi) for first, lo, hi, many in cells.spans if first <= b < first + many)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs, the same for a pair wherever it is computed."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 15):
        s = slice(lo, lo + (1 << 15))
        out[s] = (x[i[s]].astype(np.longdouble) * y[j[s]]).sum(1)
    return out


def _nearest_in(held, k: int, own: bool):
    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits, rows = _sides(batches)
        if not visits.num_rows or not rows.num_rows:
            return
        x, y, ids = _matrix(visits.column("v")), _matrix(rows.column("v")), rows.column("id").to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        if own:  # by cell
            asks, holds = visits.column("cell").to_numpy(), rows.column("cell").to_numpy()
            cases = ((np.flatnonzero(asks == c), np.flatnonzero(holds == c)) for c in np.unique(asks))
            met = ((i[lo : lo + 512], j, x[i[lo : lo + 512]] @ y[j].T) for i, js in cases for j in (js,) for lo in range(0, len(i), 512) if len(j))
            least = np.full(len(x), -2.0)
        else:
            every = np.arange(len(y))
            met = ((i, every, c) for i, c in _cosines(visits, rows, x, y, _span(held.value, key[0].as_py())))
            least = np.nan_to_num(np.cos(visits.column("bound").to_numpy()) - 1e-9, nan=-2.0)
        found, many = [], 0
        for i, j, c in met:
            floor = least[i]
            blind = np.flatnonzero(floor < -1.5)
            if len(blind) and len(j) > k:
                floor[blind] = np.partition(c[blind], len(j) - k, axis=1)[:, -k] - 1e-12
            a, b = np.nonzero((c >= floor[:, None]) & (c > -1.5))
            s = _exact(x, y, i[a], j[b])
            order = np.lexsort((rank[j[b]], -s, a))
            a, b, s = a[order], b[order], s[order]
            first = np.arange(len(a)) - np.searchsorted(a, a) < k
            found.append((i[a[first]], j[b[first]], s[first]))
            many += int(first.sum())
            if many > HELD // 16:
                yield _answered(visits, rows, found)
                found, many = [], 0
        if found:
            yield _answered(visits, rows, found)

    return answer


def _answered(visits: pa.Table, rows: pa.Table, found: list) -> pa.RecordBatch:
    at, to, cosines = (pa.array(np.concatenate(c)) for c in zip(*found))
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.RecordBatch.from_arrays([flat(visits.column("qid").take(at)), flat(rows.column("id").take(to)), flat(rows.column("model").take(to)), cosines], names=["qid", "id", "model", "cosine"])


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, id, model, cosine, rank): the k rows of index (id, model, embedding) of the largest cosine with each query (qid, embedding), ties by id.

    Exact. Vectors that are null, empty or hold a null or non-finite component are left out, zero vectors of the index too; a zero query has
    cosine 0 with all. Vectors of different lengths aren't compared. Queries are shuffled once per bin that they can't exclude, the index
    once in each round for each part of a bin's queries, and k rows a query and bin come back.
    """
    (kind, _), (qkind, _) = id_type(index, "id"), id_type(queries, "qid")
    held = _ready(index.select(F.col("id").cast(kind).alias("id"), "model", "embedding"), "sphere-index").where(F.col("v") != F.expr("cast(repeat('\\0', size * 8) as binary)"))
    asked = _ready(queries.select(F.col("qid").cast(qkind).alias("qid"), "embedding"), "sphere-queries")
    schema = f"qid {qkind}, id {kind}, model string, cosine double"
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    best = lambda found: found.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")
    out = None
    for size, n in held.groupBy("size").count().toLocalIterator():
        some, all_ = asked.where(F.col("size") == size).drop("size"), held.where(F.col("size") == size).drop("size")
        cells, table = _partition(all_, size, n, "sphere-cells")
        near = best(_meet(some, cells, size, "own", table, _nearest_in(cells, k, True), schema))
        if len(cells.value.pivots) == 1:
            out = near.drop("rank") if out is None else out.union(near.drop("rank"))
            continue
        near = shared.written(near, "near")
        bound = near.where(f"rank = {k}").select("qid", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine")))).alias("bound"))
        zero = F.col("v") == F.expr(f"cast(repeat('\\0', {size * 8}) as binary)")
        rest = some.join(bound, "qid", "left").withColumn("bound", F.when(~zero, F.col("bound")))
        found = near.drop("rank").union(_meet(rest, cells, size, "others", table, _nearest_in(cells, k, False), schema))
        out = found if out is None else out.union(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    return best(out)


def _pairs_in(held, threshold: float):
    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits, rows = _sides(batches)
        if not visits.num_rows or not rows.num_rows:
            return
        x, y = _matrix(visits.column("v")), _matrix(rows.column("v"))
        (a, at), (b, to) = ((t.column("id").to_numpy(), t.column("cell").to_numpy()) for t in (visits, rows))
        found, many = [], 0
        for lo, c in _cosines(visits, rows, x, y, _span(held.value, key[0].as_py())):
            i, j = np.nonzero(c >= threshold - 1e-9)
            i = i + lo[0]
            keep = (at[i] != to[j]) | (a[i] < b[j])  # within a cell both meet each other
            i, j = i[keep], j[keep]
            s = _exact(x, y, i, j)
            keep = s >= threshold
            i, j, s = i[keep], j[keep], s[keep]
            found.append((np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), s))
            many += len(s)
            if many > HELD // 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found)], names=["a", "b", "similarity"])
                found, many = [], 0
        if many:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found)], names=["a", "b", "similarity"])

    return answer


def near_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of vectors (id, embedding) with cosine >= threshold, a < b, exact. Of two cells the first one's vectors go to
    the other; a vector is shuffled once per bin that it can't exclude. Vectors that are null, empty, zero or not finite pair with nothing."""
    rows = _ready(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), "sphere-vectors").where(F.col("v") != F.expr("cast(repeat('\\0', size * 8) as binary)"))
    out = None
    for size, n in rows.groupBy("size").count().toLocalIterator():
        some = rows.where(F.col("size") == size).drop("size")
        cells, table = _partition(some, size, n, "sphere-cells")
        bounded = table.select("id", "cell", "u", "v", F.lit(float(np.arccos(max(-1.0, min(1.0, threshold))))).alias("bound"))
        found = _meet(bounded, cells, size, "later", table, _pairs_in(cells, threshold), "a long, b long, similarity double")
        out = found if out is None else out.union(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "a long, b long, similarity double")
