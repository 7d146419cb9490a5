"""Three-way merges of file maps, sync plans, queue replay, escalation and restore."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions import text as T

QUEUE_LIMIT_HOURS = 24
NOTE_FACTOR = 30


def has_marker(content: Column) -> Column:
    """Whether any line opens a conflict."""
    return F.coalesce(content.rlike(r"(^|\n)<<<<<<< "), F.lit(False))


#: The strategies, and the marks around two versions that can't be merged.
STRATEGIES = ["inline-markers", "local-wins", "remote-wins"]
OPENER, DIVIDER, CLOSER = "<<<<<<< local", "=======", ">>>>>>> remote"


def merge_text(base: Column, local: Column, remote: Column, strategy: Column | None = None) -> Column:
    """struct(content, status, conflict) of three versions, null being absent. A winner that carries an opener from before is a conflict."""
    strategy = strategy if strategy is not None else F.lit("inline-markers")
    size = F.length(base)
    mine, theirs = F.substring(local, size + 1, F.length(local)), F.substring(remote, size + 1, F.length(remote))
    appended = local.startswith(base) & remote.startswith(base)
    joined = F.when(mine.contains(theirs), local).when(theirs.contains(mine), remote).otherwise(F.concat(base, theirs, mine))
    none = lambda c: F.coalesce(c, F.lit(""))
    block = F.concat_ws("\n", F.lit(OPENER), none(local), F.lit(DIVIDER), none(remote), F.lit(CLOSER))
    out = lambda c, s, x: F.struct(c.alias("content"), F.lit(s).alias("status"), x.alias("conflict"))
    return (
        F.when(local.eqNullSafe(remote), out(local, "unchanged", F.lit(False)))
        .when(local.eqNullSafe(base), out(remote, "remote", has_marker(remote)))
        .when(remote.eqNullSafe(base), out(local, "local", has_marker(local)))
        .when(F.coalesce(appended, F.lit(False)), out(joined, "merged", has_marker(joined)))
        .when(strategy == "local-wins", out(local, "conflict", has_marker(local)))
        .when(strategy == "remote-wins", out(remote, "conflict", has_marker(remote)))
        .otherwise(out(block, "conflict", F.lit(True)))
    )


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select("path", F.col("content").alias(name))


def mapped(path: Column, config: list[dict]) -> Column:
    """Whether a configured destination covers a path: a file itself, a directory everything below it."""
    fits = [(path == c["destination"]) | (F.lit(c["kind"] == "directory") & path.startswith(c["destination"].rstrip("/") + "/")) for c in config]
    return reduce(lambda a, b: a | b, fits, F.lit(False)) & ~path.rlike(r"(^|/)\.\.?(/|$)|^/")


def normal_path(path: Column) -> Column:
    """A path in the remote's form: slashes forward, none at the ends; null if it is empty or leads upwards."""
    out = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    return F.when((out != "") & ~out.startswith(".."), out)


def local_path(path: Column, config: list[dict]) -> Column:
    """Where a remote path is kept: by the first entry that covers it; null if none does."""
    out = F.lit(None).cast("string")
    for c in reversed(config):
        dest, src = c["destination"].rstrip("/"), c["source"].rstrip("/")
        inside = F.lit(c["kind"] == "directory") & path.startswith(dest + "/")
        out = F.when(path == c["destination"], F.lit(src)).when(inside, F.concat(F.lit(src), F.substring(path, F.lit(len(dest) + 1), F.length(path)))).otherwise(out)
    return F.when(mapped(path, config), out)


def foreign(path: Column, config: list[dict], profile: str) -> Column:
    """Whether a path is another owner's file in an owner-scoped directory."""
    scoped = [c["destination"].rstrip("/") for c in config if c.get("ownerScoped")]
    return reduce(lambda a, b: a | b, [path.startswith(d + "/") & (path != f"{d}/{profile}.json") for d in scoped], F.lit(False))


def pull_plan(base: DataFrame, local: DataFrame, remote: DataFrame, config: list[dict] | None = None, strategy: str = "inline-markers") -> DataFrame:
    """(path, content, status, conflict, action) for every path of three file maps (path, content). What the merge leaves as it is here
    is none, whatever the merge was; an unmapped path is skipped before it is classified."""
    rows = _side(local, "l").join(_side(base, "b"), "path", "full").join(_side(remote, "r"), "path", "full")
    rows = rows.withColumn("m", merge_text(F.col("b"), F.col("l"), F.col("r"), F.lit(strategy)))
    unmapped = ~mapped(F.col("path"), config) if config is not None else F.lit(False)
    action = (
        F.when(F.col("m.content").eqNullSafe(F.col("l")), "none").when(unmapped, "skipped").when(F.col("m.conflict"), "conflict")
        .when(F.col("m.content").isNull(), "deleted").when(F.col("m.status") == "merged", "merged").otherwise("applied")
    )
    return rows.select("path", "m.content", "m.status", "m.conflict", action.alias("action"))


def apply_pull(plan: DataFrame, local: DataFrame) -> DataFrame:
    """The local map after a pull."""
    done = plan.where("action not in ('none', 'skipped')")
    return local.join(done, "path", "left_anti").select("path", "content").unionByName(done.where("content is not null").select("path", "content"))


def push_plan(base: DataFrame, local: DataFrame, remote: DataFrame, config: list[dict] | None = None, profile: str | None = None, strategy: str = "inline-markers") -> DataFrame:
    """(path, content, status, conflict, action): only paths that the local map or the base has; unmapped and foreign base paths are left alone."""
    if config is not None:
        base = base.where(mapped(F.col("path"), config) & (~foreign(F.col("path"), config, profile) if profile else F.lit(True)))
    rows = _side(local, "l").join(_side(base, "b"), "path", "full").join(_side(remote, "r"), "path", "left")
    rows = rows.withColumn("m", merge_text(F.col("b"), F.col("l"), F.col("r"), F.lit(strategy)))
    action = F.when(F.col("m.content").eqNullSafe(F.col("r")), "none").when(F.col("m.content").isNull(), "deleted").otherwise("written")
    return rows.select("path", "m.content", "m.status", "m.conflict", action.alias("action"))


def apply_push(plan: DataFrame, remote: DataFrame) -> DataFrame:
    """The remote map after a push."""
    done = plan.where("action <> 'none'")
    return remote.join(done, "path", "left_anti").select("path", "content").unionByName(done.where("content is not null").select("path", "content"))


def replay(queue: list[tuple[str, DataFrame, DataFrame]], remote: DataFrame, config: list[dict] | None = None, strategy: str = "inline-markers") -> DataFrame:
    """Push queued snapshots (id, local, base) in the order of their ids, each onto what the one before has left."""
    entry = lambda id, side, df: df.select(F.lit(id).alias("snapshot_id"), F.lit(side).alias("side"), "path", "content")
    parts = [entry(id, side, df) for id, local, base in queue for side, df in (("local", local), ("base", base))]
    return replay_table(reduce(DataFrame.unionByName, parts), remote, config, strategy) if parts else remote


def replay_table(entries: DataFrame, remote: DataFrame, config: list[dict] | None = None, strategy: str = "inline-markers") -> DataFrame:
    """The remote map after all snapshots of a queue (snapshot_id, side local or base, path, content) are pushed in the order of their ids.

    A push looks at a path alone, so a path's versions are put in order and folded by the merge: the whole queue costs one shuffle, by path,
    and a path holds at most two texts a snapshot. A snapshot that has a path on neither side leaves it as it is, as do unmapped bases.
    """
    if config is not None:
        entries = entries.where((F.col("side") == "local") | mapped(F.col("path"), config))
    rows = entries.select("path", F.col("snapshot_id").cast("string").alias("snapshot_id"), "side", "content").unionByName(remote.select("path", F.lit(None).cast("string").alias("snapshot_id"), F.lit("remote").alias("side"), "content"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("content"))).alias(side)
    # Dealt out by path, rows are grouped by path and snapshot, and then by path, where they stand.
    pairs = rows.where("content is not null").repartition("path").groupBy("path", "snapshot_id").agg(of("base"), of("local"), of("remote"))
    step = F.when(F.col("snapshot_id").isNotNull(), F.struct("snapshot_id", "base", "local"))
    steps = pairs.groupBy("path").agg(F.max("remote").alias("remote"), F.array_sort(F.collect_list(step)).alias("steps"))
    last = F.aggregate("steps", F.col("remote"), lambda r, s: merge_text(s["base"], s["local"], r, F.lit(strategy))["content"])
    return steps.select("path", last.alias("content")).where("content is not null")


def queue_age(manifests: DataFrame, now: datetime.datetime, limit_hours: float | None = QUEUE_LIMIT_HOURS) -> DataFrame:
    """(n, oldest, age_seconds, alert): age of the oldest queued snapshot (snapshot_id, created_at text); unreadable instants are left out."""
    at = F.try_to_timestamp("created_at")
    age = F.greatest(F.lit(0), F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.min(at)))
    rows = manifests.agg(F.count("*").alias("n"), F.min(at).alias("oldest"), age.alias("age_seconds"))
    if limit_hours is None:
        return rows.withColumn("alert", F.lit("off"))
    limit = limit_hours * 3600
    return rows.withColumn("alert", F.when(F.col("age_seconds") > NOTE_FACTOR * limit, "escalate-note").when(F.col("age_seconds") >= limit, "escalate").otherwise("none"))


def restore(snapshots: DataFrame, commit: str, prefix: str | None = None) -> DataFrame:
    """The file map of one commit (commit_id, path, content), or of a path and what is below it."""
    rows = snapshots.where(F.col("commit_id") == commit)
    return (rows.where((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/")) if prefix else rows).select("path", "content")


def commit_message(changed: Column, deleted: Column) -> Column:
    """The message for sets of changed and deleted paths: what is done to one, or how many and a line each."""
    paths = F.array_sort(F.array_union(changed, deleted))
    verb = lambda p: F.when(F.array_contains(deleted, p), "remove ").otherwise("update ")
    lines = F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- "), verb(p), p)), "\n")
    one = F.get(paths, F.lit(0))
    many = F.concat(F.lit("update "), F.size(paths).cast("string"), F.lit(" memories\n\n"), lines)
    return F.when(F.size(paths) == 0, "snapshot: noop").when(F.size(paths) == 1, F.concat(verb(one), one)).otherwise(many)


ACTIONS = ["none", "skipped", "conflict", "deleted", "merged", "applied", "written"]


def summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("total"), *(F.count_if(F.col("action") == n).alias(n) for n in ACTIONS))


def summary_line(counts: DataFrame, kind: str) -> DataFrame:
    """summary() as one line: what was touched always, what was deleted or skipped if anything."""
    touched = F.col("conflict") + F.col("deleted") + F.col("merged") + F.col("applied") + F.col("written")
    some = lambda c, name: F.when(F.col(c) > 0, F.concat(F.lit(f"{name}="), F.col(c).cast("string")))
    line = F.concat_ws(" ", F.lit(f"operation={kind}"), F.concat(F.lit("applied="), touched), F.concat(F.lit("merged="), "merged"), F.concat(F.lit("conflicts="), "conflict"), some("deleted", "deleted"), some("skipped", "skipped"))
    return counts.select(line.alias("line"))


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    s = seconds.cast("double")
    unit = lambda n, u: F.concat(T.fixed(s / n, 1), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s / 60 < 60, unit(60, "m")).otherwise(unit(3600, "h"))


def execute(mode: str, pull, push, unavailable: type[Exception] = ConnectionError) -> dict:
    """Run a mode: pull, push, or sync, which pulls and then pushes; if the remote can't be reached by the pull, the push queues.

    pull() and push() give dicts with status and lists of paths; a sync's lists are the union of both, sorted.
    """
    if mode in ("pull", "push"):
        return pull() if mode == "pull" else push()
    if mode != "sync":
        raise ValueError(f"no such mode: {mode!r}")
    try:
        first = pull()
    except unavailable:
        return push()
    second = push()
    states = {first["status"], second["status"]}
    status = "dry-run" if "dry-run" in states else "queued" if second["status"] == "queued" else "applied"
    lists = {k: sorted({*first.get(k, []), *second.get(k, [])}) for k in ("applied", "merged", "conflicts", "deleted", "skipped")}
    return {"kind": "sync", "status": status, "queued": second.get("queued"), "notes": [*first.get("notes", []), *second.get("notes", [])]} | lists


def remote_kind(url: Column) -> Column:
    """How a remote is reached: over ssh, locally, or not supported."""
    return F.when(url.rlike(r"^ssh://|^[^/@]+@[^/:]+:"), "ssh").when(url.rlike(r"^(/|\./|\.\./|file://)"), "local").otherwise("unsupported")


def streaks(events: DataFrame) -> DataFrame:
    """(key, start, last, failures): unbroken runs of failures of events (key, ts, ok); seq breaks ties."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    rows = events.withColumn("island", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("not ok").groupBy("key", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("failures"))
    return rows.drop("island")


def overdue(events: DataFrame, limit_s: float, now: Column) -> DataFrame:
    """(key, start, ts): unbroken runs of failures of events (key, ts, ok) that had lasted limit_s at ts, by a success or by now; seq breaks
    ties. A stream tells the same by timers: streaming.stateful.overdue."""
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("island", F.sum(F.col("ok").cast("int")).over(w)).withColumn("island", F.col("island") - F.col("ok").cast("int"))
    runs = rows.groupBy("key", "island").agg(F.min(F.when(~F.col("ok"), F.col("ts"))).alias("start"), F.min(F.when(F.col("ok"), F.col("ts"))).alias("end")).where("start is not null")
    lasted = F.unix_micros(F.coalesce("end", now)) - F.unix_micros("start")
    return runs.where(lasted >= int(limit_s * 1e6)).select("key", "start", F.timestamp_micros(F.unix_micros("start") + int(limit_s * 1e6)).alias("ts"))
