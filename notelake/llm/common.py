"""What several operators share: tables in the shared scratch folder, connected components, word and shingle hashes."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints/notelake"  # of local sessions alone, as in tests


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which has one machine, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


BATCH_ROWS = 1_000  # of an Arrow batch, for texts of any kind: a batch of Spark's 10,000 is held several times over by a worker and its executor


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, so that a task's memory doesn't depend on how long a corpus's texts are on average."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run of an operator, as Parquet in the shared folder. They cut lineage and outlive executors.

    An operator drops what its result doesn't read; what it reads stays until clean(), which whoever has written the result calls.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/notelake-{name}-{uuid.uuid4().hex}"
        Scratch.roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))

    @classmethod
    def clean(cls, spark: SparkSession) -> None:
        """Delete all tables of this process's operators; results that aren't written yet can't be read after it."""
        while cls.roots:
            _delete(spark, cls.roots.pop())


def small(df: DataFrame, most: int) -> DataFrame:
    """A narrow table, broadcast if it has at most so many rows, counted; beyond it, left to a shuffle. Give it a written table."""
    return F.broadcast(df) if df.count() <= most else df


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], hot: int = 10_000) -> DataFrame:
    """many joined to one, whose keys are unique and not null. A key of more than hot rows of many is split by those rows' columns `by`,
    and its row of one goes to each part, so that no task gets all rows of a key. Give it written tables."""
    parts = many.groupBy(*keys).agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
    if parts.isEmpty():
        return many.join(one, keys)
    parts = small(parts, 1_000_000)
    split = many.join(parts, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = one.join(parts, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return split.join(copies, [*keys, "part"]).drop("part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- connected components


def _forest(batches):
    """A spanning star of the edges of each batch of edges: (node, smallest node of its local component)."""
    for batch in batches:
        a = batch.column(0).to_numpy(zero_copy_only=False)
        b = batch.column(1).to_numpy(zero_copy_only=False)
        nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_components(len(nodes), inv[: len(a)], inv[len(a) :])
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """Connected components of edges (a, b long): rows (node, component), component being the smallest node reachable.

    Alternating large-star and small-star rounds; each round is a written table. Nodes without edges don't appear.
    """
    cols = ["a", "b"]
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = scratch.save(clean.mapInArrow(_forest, "a long, b long").distinct(), f"{tag}0")
    state, k = None, 0
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))  # every edge already points to the smaller node
        small = (
            large.join(low2, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
            .union(low2.select("a", F.col("m").alias("b"))).distinct()
        )
        k += 1
        now = scratch.save(small.select(*cols), f"{tag}{k}")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}{k - 1}")
        if tuple(found) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(found)


# ---------------------------------------------------------------- words and shingles

_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and the offsets at which they start."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    if not word.any():
        return np.empty(0, _U), np.empty(0, np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(word)
    sizes = np.diff(np.append(np.flatnonzero(first[at]), len(at)))
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    power = np.ones(int(sizes.max()), _U)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    return mix(np.add.reduceat((raw[at].astype(_U) + _U(1)) * power[place], begin) + sizes.astype(_U) * _MULTIPLIER), starts


def shingle_sets(texts: list[str | None], k: int = 5, chunk: int = 1 << 21):
    """For each text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased, words between ASCII white space.

    A text of fewer words, but not none, is one shingle; a text without words, empty or null has none.
    """
    group: list[bytes] = []
    size = 0
    for text in [*texts, None, ...]:
        if text is not ...:
            data = (text or "").encode("utf-8", "surrogatepass").lower()
            if size and size + len(data) > chunk:
                yield from _shingles(group, k)
                group, size = [], 0
            group.append(data)
            size += len(data) + 1
    out = list(_shingles(group, k))
    yield from out[:-1]  # the last is the None that ends the list


def _shingles(group: list[bytes], k: int):
    hashes, starts = word_hashes(b" ".join(group))
    ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in group]))
    whole = _roll(hashes, k) if len(hashes) >= k else np.empty(0, _U)
    begin = 0
    for end in ends.tolist():
        if end - begin >= k:
            yield np.unique(whole[begin : end - k + 1])
        elif end > begin:
            yield _roll(hashes[begin:end], end - begin)
        else:
            yield np.empty(0, _U)
        begin = end


def _roll(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _MULTIPLIER + hashes[j : j + n]
    return mix(out + _U(k))
