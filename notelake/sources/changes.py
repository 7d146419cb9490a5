"""A stream of what changes in folders: spark.readStream.format("notelake_changes"). Its offsets are listings, so a restart misses nothing."""

from __future__ import annotations

import datetime
import json
import time

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SETTLE = 0.2  # seconds that a file must have been left alone


def listing(paths: list[str], suffix: str, hidden: bool) -> dict[str, list[int]]:
    """path: [time of the last change in microseconds, size] of the files in and below some folders, or of files themselves."""
    out = {}
    for path in paths:
        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            continue
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        for f in found:
            below = f.path[len(root) :]
            if f.type == fs.FileType.File and f.path.endswith(suffix) and (hidden or not any(p.startswith(".") for p in below.split("/"))):
                out[f.path] = [f.mtime_ns // 1000, f.size]
    return out


def settled(before: dict[str, list[int]], now: dict[str, list[int]], at: int, settle_us: int) -> dict[str, list[int]]:
    """The listing as it counts: a file that is still being written is as it was before, or not there yet."""
    out = {}
    for path, seen in now.items():
        if seen == before.get(path) or seen[0] <= at - settle_us:
            out[path] = seen
        elif path in before:
            out[path] = before[path]
    return out


def differences(before: dict[str, list[int]], after: dict[str, list[int]], at: int) -> list[tuple]:
    """(ts, path, kind) in order: add and change at the file's own time, unlink at the time of the listing that misses it."""
    when = lambda us: datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc)
    rows = [(when(seen[0]), p, "change" if p in before else "add") for p, seen in after.items() if before.get(p) != seen]
    return sorted([*rows, *((when(at), p, "unlink") for p in before.keys() - after.keys())])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.suffix, self.hidden = options.get("suffix", ""), options.get("hidden", "false").lower() == "true"
        self.settle, self.existing = int(float(options.get("settle", SETTLE)) * 1e6), options.get("existing", "false").lower() == "true"

    def _list(self) -> dict[str, list[int]]:
        return listing(self.paths, self.suffix, self.hidden)

    def initialOffset(self) -> dict:
        return {"at": 0, "files": {} if self.existing else self._list()}

    def read(self, start: dict):
        at = time.time_ns() // 1000
        files = settled(start["files"], self._list(), at, self.settle)
        end = start if files == start["files"] else {"at": at, "files": files}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(differences(start["files"], end["files"], end["at"]))


class ChangeSource(DataSource):
    """Options: path or paths (JSON), suffix of the files that count, hidden (whether those below a dot count), settle in seconds, existing
    (whether what is there at the start is reported as added). One listing is one offset: a source for workspaces, not for corpora."""

    @classmethod
    def name(cls) -> str:
        return "notelake_changes"

    def schema(self) -> str:
        return "ts timestamp, path string, kind string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeSource)
