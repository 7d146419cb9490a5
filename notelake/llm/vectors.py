"""What the searches over vectors share: distinct vectors with their copies, bins of an index, and requests meeting bins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small

BIN = 8192  # rows of an index that meet requests at once
REQUESTS = 4096  # requests that meet a bin at once
BINS = 1_000_000  # counts of bins, two numbers each, are broadcast up to this number; beyond it they are joined

_PACKED = "vec_id long, label long, asks boolean, size int, h binary, u double, sq double, v binary"


def _packed(scale: float | None):
    def run(batches):
        for batch in batches:
            e = batch.column("embedding")
            flat, ends = e.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum(e.value_lengths().to_numpy())  # -0.0 becomes 0.0
            vectors = np.split(np.floor(flat * scale) if scale else flat, ends[:-1]) if len(ends) else []
            raw = [v.tobytes() for v in vectors]
            h = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            made = {
                "size": pa.array([len(v) for v in vectors], pa.int32()), "h": pa.array(h, pa.binary()), "u": pa.array([int.from_bytes(x[:8], "big") / 2.0**64 for x in h], pa.float64()),
                "sq": pa.array([float(v @ v) for v in vectors], pa.float64()), "v": pa.array(raw, pa.binary()),
            }
            names = ["vec_id", "label", "asks"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made.values()], names=[*names, *made])

    return run


def packed(vectors: DataFrame, asks: Column, label: Column, zeros: bool, scale: float | None = None) -> DataFrame:
    """(vec_id, label, asks, size, h, u, sq, v) of the rows that can be compared: v the components as doubles, floor(scale * x) if a scale is
    given, h a digest of them, u a number in [0, 1) from it, sq the squared length. Left out are null ids and labels, null and empty
    vectors, those with a null or non-finite component, and zero vectors unless zeros."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding"))
    e = F.col("embedding")
    whole = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zeros:
        whole = whole & F.exists(e, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole).mapInArrow(_packed(scale), _PACKED)


def distinct(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of packed rows: classes (label, size, h, v, u, sq, rep, asking), one per label and vector, rep the smallest vec_id and asking the number
    of asking rows; and copies (label, h, vec_id), the further ids of a class, the smallest up to most ids in all: no search for fewer
    rows needs more of them, however many copies there are."""
    keys = ["label", "size", "h"]
    classes = rows.groupBy(*keys).agg(F.first("v").alias("v"), F.first("u").alias("u"), F.first("sq").alias("sq"), F.min("vec_id").alias("rep"), F.sum(F.col("asks").cast("long")).alias("asking"))
    ids = rows.select("label", "h", "vec_id").distinct()
    nth = ids.withColumn("n", F.row_number().over(Window.partitionBy("label", "h").orderBy("vec_id")))
    return classes, nth.where(f"n <= {most}").where("n > 1").drop("n")


def matrix(column) -> np.ndarray:
    """Rows of doubles of one length from a column of their bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


class Bins:
    """Cells of an index, in order, dealt to bins of at most BIN rows: small cells together, a large one split over bins of its own."""

    def __init__(self, counts: dict[int, int], cells: int, most: int = BIN):
        self.first, self.parts = np.zeros(cells, np.int64), np.ones(cells, np.int64)
        at, held = 0, 0
        for c in range(cells):
            n = counts.get(c, 0)
            if held and held + n > most:
                at, held = at + 1, 0
            self.first[c] = at
            if n > most:
                self.parts[c] = -(-n // most)
                at += int(self.parts[c])
            else:
                held += n

    def of_row(self, cell: np.ndarray, u: np.ndarray) -> np.ndarray:
        return self.first[cell] + np.minimum((u * self.parts[cell]).astype(np.int64), self.parts[cell] - 1)

    def of_visits(self, cells: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
        """(bin, its cells among these) for all bins that hold rows of these cells."""
        first = self.first[cells]
        for b in np.unique(first).tolist():
            here = cells[first == b]
            for k in range(int(self.parts[here].max())):
                yield b + k, here[self.parts[here] > k]


def meet(visits: DataFrame, index: DataFrame, answer: Callable, schema: str, scratch: Scratch, tag: str) -> DataFrame:
    """What answer(visits, rows) gives for each bin's visits, at most about REQUESTS at once, and its rows. Visits have bin and h; rows have bin.

    Both sides are dealt by (bin, part), so no task holds more than a bin's rows and a part of its visits, whatever is hot.
    """
    visits = scratch.save(visits, f"{tag}-visits")
    counts = scratch.save(visits.groupBy("bin").agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("parts")), f"{tag}-counts")
    counts = small(counts, BINS)
    dealt = visits.join(counts, "bin").withColumn("part", F.pmod(F.xxhash64("h", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    rows = index.join(counts, "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, rows = (x.repartition(n, "bin", "part") for x in (dealt, rows))
    return dealt.groupBy("bin", "part").cogroup(rows.groupBy("bin", "part")).applyInArrow(answer, schema)
