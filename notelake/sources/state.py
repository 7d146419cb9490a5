"""State of a synchronised workspace: what was last agreed, queued snapshots, the last run, and the history of commits (SRC-20..22, SNK-12..16)."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_FILES = "path string, content string"


class Store:
    """One profile's tables in a folder: base (path, content; null is deleted), queue/<id>/{local,base}, manifests, state, commits."""

    def __init__(self, spark: SparkSession, folder: str, profile: str = "default"):
        self.spark, self.folder, self.profile = spark, folder.rstrip("/"), profile

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if shared.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    # ---- the last run

    def load_state(self) -> dict:
        rows = self._table("state", "n long, value string").orderBy(F.desc("n")).limit(1).collect()
        return json.loads(rows[0]["value"]) if rows else {"version": 1, "profile": self.profile, "last_remote_head": None, "last_run_at": None}

    def save_state(self, state: dict) -> None:
        n = self._table("state", "n long, value string").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] + 1
        self.spark.createDataFrame([(n, json.dumps(state, sort_keys=True))], "n long, value string").coalesce(1).write.mode("append").parquet(f"{self.folder}/state")

    # ---- the last agreed files

    def base(self) -> DataFrame:
        rows = self._table("base", _FILES + ", version long")
        now = rows.agg(F.max("version")).first()[0]
        return rows.where(F.col("version") == (now or 0)).where("path is not null").drop("version")

    def replace_base(self, files: DataFrame) -> None:
        """A new version of the whole table; older ones go once it is written, so a reader never sees half a table."""
        now = self._table("base", _FILES + ", version long").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        rows = files.select("path", "content").unionByName(self.spark.createDataFrame([(None, None)], _FILES))  # a version of no files has a row, too
        rows.withColumn("version", F.lit(now)).write.mode("append").partitionBy("version").parquet(f"{self.folder}/base")
        for old in range(max(1, now - 2), now):
            shared.delete(self.spark, f"{self.folder}/base/version={old}")

    # ---- the queue

    def enqueue(self, local: DataFrame, base: DataFrame, now: datetime.datetime, snapshot_id: str | None = None) -> str:
        """The id under which both file maps are kept; its manifest, written last, makes it part of the queue."""
        id_ = snapshot_id or f"{int(now.timestamp() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        for side, files in (("local", local), ("base", base)):
            files.select("path", "content").write.mode("overwrite").parquet(f"{self.folder}/queue/{id_}/{side}")
        self.spark.createDataFrame([(id_, now.isoformat())], "snapshot_id string, created_at string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifests")
        return id_

    def manifests(self) -> DataFrame:
        """(snapshot_id, created_at) of the queue, in the order of the ids."""
        rows = self._table("manifests", "snapshot_id string, created_at string")
        gone = self._table("done", "snapshot_id string")
        return rows.join(gone, "snapshot_id", "left_anti").dropDuplicates(["snapshot_id"]).orderBy("snapshot_id")

    def queue(self) -> list[tuple[str, DataFrame, DataFrame]]:
        read = lambda i, side: self.spark.read.schema(_FILES).parquet(f"{self.folder}/queue/{i}/{side}")
        return [(r["snapshot_id"], read(r["snapshot_id"], "local"), read(r["snapshot_id"], "base")) for r in self.manifests().collect()]

    def dequeue(self, snapshot_id: str) -> None:
        self.spark.createDataFrame([(snapshot_id,)], "snapshot_id string").coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        shared.delete(self.spark, f"{self.folder}/queue/{snapshot_id}")

    # ---- commits: a versioned table instead of a repository

    def commit(self, files: DataFrame, message: str, at: datetime.datetime, expect: str | None = None) -> str:
        """Append a whole file map as a commit. If expect is given and isn't the head any more, it is refused: someone else was first."""
        head = self.head()
        if expect is not None and head != expect:
            raise ValueError(f"rejected: the head is {head}, not {expect}")
        n = self._table("log", "n long, commit_id string, message string, at string").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] + 1
        id_ = f"{n:08d}-{uuid.uuid4().hex[:12]}"
        files.where("content is not null").select(F.lit(id_).alias("commit_id"), "path", "content").write.mode("append").partitionBy("commit_id").parquet(f"{self.folder}/commits")
        self.spark.createDataFrame([(n, id_, message, at.isoformat())], "n long, commit_id string, message string, at string").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return id_

    def head(self) -> str | None:
        rows = self._table("log", "n long, commit_id string, message string, at string").orderBy(F.desc("n")).limit(1).collect()
        return rows[0]["commit_id"] if rows else None

    def log(self) -> DataFrame:
        return self._table("log", "n long, commit_id string, message string, at string")

    def files(self, commit_id: str | None = None) -> DataFrame:
        """(path, content) at a commit, or at the head."""
        at = commit_id or self.head()
        return self._table("commits", _FILES + ", commit_id string").where(F.col("commit_id").eqNullSafe(F.lit(at))).select("path", "content")

    def resolve(self, prefix: str) -> str:
        """The one commit whose id begins so."""
        found = self.log().where(F.col("commit_id").startswith(prefix)).select("commit_id").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{len(found) or 'no'} commits begin with {prefix!r}")
        return found[0]["commit_id"]
