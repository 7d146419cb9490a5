"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints/notelake-tables"  # of local sessions alone, as in tests


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, which has one machine, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or LOCAL_FOLDER).rstrip("/")


_PATHS: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what stays until clean()."""
    path = f"{folder(spark)}/notelake-{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from Parquet; the table stays until clean()."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = path_of(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = path_of(spark, path)
    fs.delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete the tables that this process has written so; results that aren't written yet can't be read after it."""
    while _PATHS:
        delete(spark, _PATHS.pop())
