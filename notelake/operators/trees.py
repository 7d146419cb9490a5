"""File maps as trees of folders with a hash each, and the difference of two: only folders whose hashes differ are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.sources import shared

BUCKETS = 64  # of a level's folders, so that a level isn't read whole for a few of them
_ENTRY = ["folder", "name", "tree", "hash"]


def folder_of(path: Column) -> Column:
    """What a path stands in; '' is the root."""
    return F.coalesce(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _bucket(folder: Column) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(BUCKETS)).cast("int")


def build(files: DataFrame, location: str) -> DataFrame:
    """The tree of a file map (path, content), written at a location by depth and bucket: (folder, name, tree, hash) of each file and folder.

    A folder's hash is that of its entries' names, kinds and hashes. Levels are made from the deepest up, so as many jobs as folders nest.
    Null paths and contents are no files; of rows that repeat a path the greatest content counts. Names that are empty stand as they are.
    """
    spark = files.sparkSession
    rows = files.where("path is not null and content is not null").groupBy("path").agg(F.max(F.sha2("content", 256)).alias("hash"))
    rows = shared.written(rows.select(folder_of(F.col("path")).alias("folder"), _name(F.col("path")).alias("name"), F.lit(False).alias("tree"), "hash", (F.size(F.split("path", "/")) - 1).alias("depth")), "files")
    deepest = rows.agg(F.max("depth")).first()[0]
    above = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = rows.where(F.col("depth") == depth).select(*_ENTRY)
        level = shared.written(level if above is None else level.union(above), "level")
        level.withColumns({"depth": F.lit(depth), "bucket": _bucket(F.col("folder"))}).repartition("bucket").write.mode("append").partitionBy("depth", "bucket").parquet(location)
        if depth:
            # The entries' own hashes are hashed in order; a folder of very many files costs 65 bytes and its name for each.
            entry = F.struct("name", "tree", "hash")
            folders = level.groupBy("folder").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("hash"))
            above = folders.select(folder_of(F.col("folder")).alias("folder"), _name(F.col("folder")).alias("name"), F.lit(True).alias("tree"), "hash")
    schema = "folder string, name string, tree boolean, hash string, depth int, bucket int"
    return spark.read.schema(schema).parquet(location) if deepest is not None else spark.createDataFrame([], schema)


def _entries(tree: DataFrame, depth: int, frontier: DataFrame, buckets: list[int]) -> DataFrame:
    """What stands in the frontier's folders; other levels and buckets aren't read."""
    rows = tree.where((F.col("depth") == depth) & F.col("bucket").isin(buckets))
    return rows.join(frontier, "folder", "left_semi").select(*_ENTRY)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files added, removed and changed between two trees. It goes down level by level, into folders whose hashes differ alone;
    each step is a written table, and its folders' buckets, BUCKETS at most, all that the driver sees. A file that becomes a folder is removed."""
    spark = before.sparkSession
    frontier, depth, out = spark.createDataFrame([("",)], "folder string"), 0, None
    while True:
        buckets = [r["b"] for r in frontier.select(_bucket(F.col("folder")).alias("b")).distinct().collect()]
        if not buckets:
            break
        a, b = (_entries(t, depth, frontier, buckets).withColumnRenamed("hash", h) for t, h in ((before, "old"), (after, "new")))
        met = a.join(b, ["folder", "name", "tree"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
        path = F.concat_ws("/", "folder", "name") if depth else F.col("name")
        met = shared.written(met.select(path.alias("path"), "tree", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change")), "differs")
        found = met.where("not tree").select("path", "change")
        out = found if out is None else out.union(found)
        frontier, depth = met.where("tree").select(F.col("path").alias("folder")).distinct(), depth + 1
    return out if out is not None else spark.createDataFrame([], "path string, change string")
