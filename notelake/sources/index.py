"""The vector index and the query cache: tables of immutable versions with a manifest of provenance (SRC-14..16, SNK-01..07, IDX)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SCHEMA_VERSION = 2
CACHE_CAPACITY = 1000


def migrate(entries: DataFrame) -> DataFrame:
    """Entries of any older version with all columns of the present one."""
    return entries if "model" in entries.columns else entries.withColumn("model", F.lit(None).cast("string"))


def check_width(entries: DataFrame, width: int | None) -> int | None:
    """The one width of all vectors; another one than the index has is an error."""
    r = entries.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if r["a"] is not None and (r["a"] != r["b"] or (width is not None and r["a"] != width)):
        raise ValueError(f"vectors of {r['a']} to {r['b']} components in an index of {width}")
    return width if width is not None else r["a"]


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index (id, mtime, model, embedding) with new entries in place of those of the same id; the last of repeated ids wins."""
    last = new.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("mtime"), F.desc_nulls_last("model")))).where("n = 1").drop("n")
    return index.join(last, "id", "left_anti").unionByName(last)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def changes(index: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes (id, mtime) to embed because the index hasn't them with that mtime, and ids of the index that no note has."""
    return notes.join(index.select("id", "mtime"), ["id", "mtime"], "left_anti"), index.select("id").join(notes, "id", "left_anti")


def embedding(index: DataFrame, ids: DataFrame, model: str | None = None) -> DataFrame:
    rows = index.join(ids.select("id"), "id", "left_semi")
    return rows.where(F.col("model") == model) if model is not None else rows


def stale_count(index: DataFrame, model: str) -> DataFrame:
    return index.agg(F.count_if(~F.col("model").eqNullSafe(F.lit(model))).alias("stale"))


def cache_open(cache: DataFrame, model: str) -> DataFrame:
    """The cache without other models' rows."""
    return cache.where(F.col("model") == model)


def cache_get(cache: DataFrame, prompts: DataFrame, model: str, now: datetime.datetime | None = None):
    """prompts (qid, prompt) with the cached embedding of the model, null if there is none; with now, also the cache with the rows that were hit touched."""
    keyed = prompts.withColumn("prompt_sha", F.sha2("prompt", 256))
    found = keyed.join(cache.where(F.col("model") == model).select("prompt_sha", "embedding"), "prompt_sha", "left").select("qid", "prompt", "embedding")
    if now is None:
        return found
    hit = keyed.select("prompt_sha", F.lit(True).alias("hit")).distinct()
    touched = cache.join(hit, "prompt_sha", "left").withColumn("accessed_at", F.when(F.col("hit") & (F.col("model") == model), F.lit(now).cast("timestamp")).otherwise(F.col("accessed_at")))
    return found, touched.select(*cache.columns)


def cache_put(cache: DataFrame, new: DataFrame, now: datetime.datetime, model: str, capacity: int = CACHE_CAPACITY) -> DataFrame:
    """The cache with new rows (prompt, embedding), without other models' rows, cut to the most recently used."""
    rows = new.select(F.sha2("prompt", 256).alias("prompt_sha"), F.lit(model).alias("model"), "embedding", F.lit(now).cast("timestamp").alias("accessed_at")).dropDuplicates(["prompt_sha"])
    whole = cache_open(cache, model).join(rows, "prompt_sha", "left_anti").select(*rows.columns).unionByName(rows)
    return whole.orderBy(F.desc("accessed_at"), "prompt_sha").limit(capacity)


def write(index: DataFrame, folder: str, provider: str, model: str, width: int | None) -> None:
    """A new version beside the present one; its manifest, written last, makes it the present one."""
    spark = index.sparkSession
    old = manifest(spark, folder)
    if old and (old["model"], old["width"]) != (model, width):
        raise ValueError(f"the index holds {old['model']} vectors of {old['width']}")
    version = (old["version"] if old else 0) + 1
    index.write.mode("overwrite").parquet(f"{folder}/v{version}")
    rows = [(version, SCHEMA_VERSION, provider, model, width)]
    spark.createDataFrame(rows, "version int, schema_version int, provider string, model string, width int").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str):
    """(version, schema_version, provider, model, width) of the present index, or None."""
    return spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("version")).first() if shared.exists(spark, f"{folder}/manifest") else None


def read(spark: SparkSession, folder: str, provider: str | None = None, model: str | None = None) -> DataFrame:
    """The present index; another provider or model than its manifest names is an error, as their vectors can't be compared."""
    m = manifest(spark, folder)
    if not m:
        raise ValueError(f"no index in {folder}")
    if (provider is not None and m["provider"] != provider) or (model is not None and m["model"] != model):
        raise ValueError(f"the index holds vectors of {m['provider']}, {m['model']}: remove {folder} and build it anew")
    return migrate(spark.read.parquet(f"{folder}/v{m['version']}"))
