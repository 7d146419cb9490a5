"""Sources: note corpora, index documents, vocabularies, golden sets, mappings, daily logs and workspaces (SRC of the survey)."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import frontmatter
from notelake.functions import patterns as P
from notelake.functions import text as T

from . import shared

#: Fixed values.
TYPES = ["user", "feedback", "project", "reference"]
INDEX_FILE = "MEMORY.md"
MAX_REQUEST = 1 << 20
_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
_HEAD = r"(?s)^---\r?\n(.*?)\r?\n---"  # finds the same frontmatter, without reading on

#: The built-in vocabulary, (pattern, whether case is ignored).
VOCABULARY = {
    "deployment": [
        (r"\bdeploy(?:ing|ed|ment)?\b", True), (r"\brelease\b", True), (r"\bpush(?:ing)?\s+to\s+prod\b", True), (r"\bmigrat(?:e|ion|ing)\b", True),
        (r"\brollback\b", True), (r"\bdocker[-\s]?compose\b", True), (r"\bVPS\b", False), (r"\b\.env\b", False),
    ],
    "destructive_ops": [
        (r"\brm\s+-rf\b", True), (r"\bforce[-\s]?push\b", True), (r"\bpush\s+--force\b", True), (r"\bgit\s+reset\s+--hard\b", True),
        (r"\bdrop\s+table\b", True), (r"\btruncate\s+table\b", True),
    ],
    "workflow": [
        (r"\bPRs?\b", True), (r"\bpull\s+request\b", True), (r"\breview(?:er|ing)?\b", True), (r"\bmerg(?:e|ing|ed)\b", True),
        (r"\brebase\b", True), (r"\bbranch\b", True), (r"\btasks?\b", True),
    ],
    "security": [(r"\bsecret\b", True), (r"\btoken\b", True), (r"\bcredential\b", True), (r"\bauth(?:entication|orization)?\b", True), (r"\bCVE\b", False)],
    "testing": [(r"\btests?\b", True), (r"\bvitest\b", True), (r"\bjest\b", True), (r"\bspec\b", True), (r"\bmock\b", True)],
}


def topics_of(text: Column, vocabulary: dict = VOCABULARY) -> Column:
    """The topics of which any pattern is found, in the vocabulary's order."""
    return F.filter(F.array(*(F.when(T.any_match(text, p), F.lit(t)) for t, p in vocabulary.items())), lambda t: t.isNotNull())


def topic_scores(name: Column, description: Column, body: Column, vocabulary: dict = VOCABULARY) -> Column:
    """A map from topic to 3 x hits in the name + 2 x in the description + 1 x in the body."""
    hits = lambda c, ps: sum((T.match_count(c, p, i) for p, i in ps), F.lit(0))
    return F.create_map(*(x for t, ps in vocabulary.items() for x in (F.lit(t), 3 * hits(name, ps) + 2 * hits(description, ps) + hits(body, ps))))


@dataclass
class Vocabulary:
    topics: dict = field(default_factory=lambda: dict(VOCABULARY))
    source: str = "default"
    error: str | None = None


def load_vocabulary(path: str | None, strict: bool = False) -> Vocabulary:
    """A vocabulary file replaces the built-in one; a missing file gives the built-in, an invalid one too, with its error (or raises)."""
    if not path or not Path(path).exists():
        return Vocabulary()
    try:
        rows = yaml.safe_load(Path(path).read_text())
        if not isinstance(rows, list) or not rows:
            raise ValueError("the vocabulary isn't a list of topics")
        out: dict = {}
        for r in rows:
            name = (r.get("name") or "").strip() if isinstance(r, dict) and isinstance(r.get("name"), str) else ""
            patterns = r.get("patterns") or [] if isinstance(r, dict) else []
            if not name or not isinstance(patterns, list) or not all(isinstance(p, str) for p in patterns):
                raise ValueError(f"bad topic: {r!r}")
            if r.get("description") is not None and not isinstance(r["description"], str):
                raise ValueError(f"bad description: {r!r}")
            if name in out:
                raise ValueError(f"duplicate topic: {name}")
            out[name] = [(p if P.may_run(p) else T.keyword_pattern(name), True) for p in patterns] or [(T.keyword_pattern(name), True)]
        return Vocabulary(out, "custom")
    except (ValueError, yaml.YAMLError) as e:
        if strict:
            raise
        return Vocabulary(error=str(e))


def load_golden(path: str) -> list[tuple[int, str, list[str]]]:
    """(qid, prompt, expected ids without repeats)."""
    rows = (yaml.safe_load(Path(path).read_text()) or {}).get("prompts")
    if not isinstance(rows, list) or not rows:
        raise ValueError("prompts must be a list that isn't empty")
    out = []
    for i, r in enumerate(rows):
        expect = r.get("expect") or []
        if not isinstance(r.get("prompt"), str) or not r["prompt"].strip() or not isinstance(expect, list) or not all(isinstance(x, str) for x in expect):
            raise ValueError(f"bad prompt {i}")
        out.append((i, r["prompt"], list(dict.fromkeys(expect))))
    return out


def load_mapping(path: str) -> list[dict]:
    """Ordered rules, each with an id or a prefix, and topics."""
    rows = yaml.safe_load(Path(path).read_text())
    if not isinstance(rows, list):
        raise ValueError("the mapping isn't a list")
    for r in rows:
        if not isinstance(r, dict) or bool(r.get("id")) == bool(r.get("prefix")) or not r.get("topics") or not isinstance(r["topics"], list) or not all(isinstance(t, str) and t.strip() for t in r["topics"]):
            raise ValueError(f"bad rule: {r!r}")
    return [{"ord": i, "id": r.get("id"), "prefix": r.get("prefix"), "topics": [t.strip() for t in r["topics"]]} for i, r in enumerate(rows)]


#: What the parsers say of a bad note, in the order in which it is looked for.
NO_FRONT, NOT_YAML, NOT_OBJECT = "no YAML frontmatter delimiter (`---`) found", "YAML parse error: ", "frontmatter is not a YAML object"
_NOTE = """status string, name string, description string, type string, type_json string, meta_type string, topics array<string>, topics_shape string,
    own_topics array<string>, own_shape string, meta_topics array<string>, severity string, has_topics boolean, has_severity boolean, tools array<string>,
    command_pattern string, verify array<struct<kind:string,value:string,repoRoot:string,whole:boolean>>, created string, updated_at string, strict array<string>"""
_COLUMNS = [c.split()[0] for c in re.split(r",(?![^<]*>)", _NOTE)]


def _kind(v) -> str:
    """The kind of a YAML value, by the names that the reports use."""
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object"


def _shape(v) -> str:
    return "none" if v is None else "list" if isinstance(v, list) else f"<non-list {_kind(v)}: {json.dumps(v, default=str, separators=(',', ':'), ensure_ascii=False)}>"


def strict_faults(fm) -> list[str]:
    """What a strict reader finds: name, description and type must be there at the top level, as strings, the type a known one."""
    if not isinstance(fm, dict):
        return ["frontmatter is not a YAML mapping"]
    fields = {k: fm.get(k) for k in ("name", "description", "type")}
    missing = [k for k, v in fields.items() if v is None or v == ""]
    out = [f"missing required field(s): {', '.join(missing)}"] if missing else []
    out += [f"field '{k}' must be a string (got {_kind(v)})" for k, v in fields.items() if v is not None and v != "" and not isinstance(v, str)]
    if isinstance(fields["type"], str) and fields["type"] not in TYPES and fields["type"] != "":
        out.append(f"unknown type '{fields['type']}' (expected: {', '.join(TYPES)})")
    elif fields["type"] == "":
        out.append(f"unknown type '' (expected: {', '.join(TYPES)})")
    return out


def _front(front: pd.Series) -> pd.DataFrame:
    """YAML has no parser in Spark: Arrow batches of frontmatter become columns."""

    def row(x):
        if x is None:
            return {"strict": ["missing YAML frontmatter block"]}
        try:
            fm = frontmatter.loaded(x)
        except yaml.YAMLError as e:
            detail = str(e).splitlines()[0]
            return {"status": NOT_YAML + detail, "strict": [f"frontmatter YAML parse error: {detail}"]}
        if not isinstance(fm, dict):
            return {"status": "missing required field 'name'" if isinstance(fm, list) else NOT_OBJECT, "strict": strict_faults(fm)}
        s = lambda v: v if isinstance(v, str) else None
        text = lambda v: None if v is None or v is False or v == "" else str(v)
        strings = lambda v: [t if isinstance(t, str) else json.dumps(t, default=str) for t in v] if isinstance(v, list) else None
        meta = fm.get("metadata") if isinstance(fm.get("metadata"), dict) else {}
        found = fm.get("topics") if fm.get("topics") is not None else meta.get("topics")
        trig = fm.get("triggers") if isinstance(fm.get("triggers"), dict) else {}
        entry = lambda v: {"kind": s(v.get("kind")), "value": s(v.get("value")), "repoRoot": s(v.get("repoRoot")), "whole": True} if isinstance(v, dict) else {"kind": None, "value": None, "repoRoot": None, "whole": False}
        hoist = meta.get("topics")
        kind = fm.get("type") or meta.get("type")
        return {
            "status": "ok", "name": text(fm.get("name")), "description": s(fm.get("description")), "type": text(fm.get("type")), "type_json": json.dumps(kind, default=str, ensure_ascii=False),
            "meta_type": text(meta.get("type")), "topics": strings(found) if found is not None else [], "topics_shape": _shape(found), "own_topics": strings(fm.get("topics")), "own_shape": _shape(fm.get("topics")),
            "meta_topics": hoist if isinstance(hoist, list) and hoist and all(isinstance(t, str) for t in hoist) else None, "severity": s(fm.get("severity")),
            "has_topics": "topics" in fm, "has_severity": "severity" in fm, "tools": strings(trig.get("tools")), "command_pattern": s(trig.get("command_pattern")),
            "verify": list(map(entry, fm["verify"])) if isinstance(fm.get("verify"), list) else None, "created": text(fm.get("created")), "updated_at": text(fm.get("updatedAt")),
            "strict": strict_faults(fm),
        }

    rows = [row(x) for x in front]
    return pd.DataFrame([[r.get(c) for c in _COLUMNS] for r in rows], columns=_COLUMNS, dtype=object)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every note of a folder, accepted or not, in load_ord, the order of the file names; a folder that isn't there has none."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    at = shared.exists(spark, folder)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder) if at else spark.createDataFrame([], schema)
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("source"), name.alias("file")).where(name != INDEX_FILE)
    return parse_notes(rows)


def parse_notes(rows: DataFrame) -> DataFrame:
    """rows (path, mtime, source, file) as notes; the first fault is the reason, in the order delimiter, YAML, object, name, type.

    load_ord, the file's name, orders notes as they are loaded. validation_errors are a strict reader's.
    The parser counts as not deterministic: a filter on what it finds stays behind it, instead of parsing, and searching the text, once more for each mention.
    """
    rows = rows.withColumn("front", F.when(F.col("source").rlike(_HEAD), F.regexp_extract("source", _HEAD, 1)))
    rows = rows.withColumn("fm", F.pandas_udf(_front, _NOTE).asNondeterministic()(F.col("front")))
    has = F.col("fm.status").isNotNull()
    kind = F.coalesce("fm.type", "fm.meta_type")
    unknown = F.concat(F.lit("unknown type "), F.col("fm.type_json"), F.lit(f" (expected: {', '.join(TYPES)})"))
    reason = (
        F.when(~has & F.col("source").isNotNull(), NO_FRONT).when(F.col("fm.status") != "ok", F.col("fm.status")).when(F.col("fm.name").isNull(), "missing required field 'name'")
        .when(kind.isNull(), "missing required field 'type'").when(~kind.isin(TYPES), unknown)
    )
    body = F.when(has, F.regexp_extract("source", _FRONT, 2)).otherwise(F.col("source"))
    kept = "name description topics topics_shape own_topics own_shape meta_topics meta_type severity has_topics has_severity verify created updated_at".split()
    return rows.select(
        F.regexp_replace("file", r"\.md$", "").alias("id"), "path", "mtime", "file", F.col("file").alias("load_ord"), kind.alias("type"), F.col("fm.type").alias("own_type"),
        *(F.col(f"fm.{c}").alias(c) for c in kept), F.struct(F.col("fm.tools").alias("tools"), F.col("fm.command_pattern").alias("command_pattern")).alias("triggers"),
        F.col("fm.strict").alias("validation_errors"), T.trim(body).alias("body"), body.alias("raw_body"), "front", "source",
        reason.isNull().alias("ok"), reason.alias("reason"),
    )


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted notes."""
    return scan(spark, folder).where("ok").drop("ok", "reason")


def strict_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every note as a strict reader sees it: validation_errors is empty for good ones. A folder that isn't there is an error."""
    if not shared.exists(spark, folder):
        raise ValueError(f"{folder} is not a directory")
    return scan(spark, folder)


def index_lines(documents: DataFrame) -> DataFrame:
    """(line_no from 1, line, eol) of index documents (content): one end of line belongs to the last line, none to an empty document."""
    eol = F.when(F.col("content").contains("\r\n"), "\r\n").otherwise("\n")
    text = F.regexp_replace("content", r"\n\z", "")
    rows = documents.where("content <> ''").select(eol.alias("eol"), F.posexplode(F.split(text, "\r?\n")).alias("n", "line"))
    return rows.select((F.col("n") + 1).alias("line_no"), "line", "eol")


def index_links(lines: DataFrame) -> DataFrame:
    """(line_no, link_no, title, target, hook) of lines (line_no, line): every [title](file.md), the hook being what follows it on the line."""
    link = rf"\[([^\]]+)\]\(([^){T.WS[1:-1]}]+?\.md)\)"
    found = lambda g: F.regexp_extract_all("line", F.lit(link), F.lit(g))
    after = lambda i: F.array_join(F.zip_with(F.slice(found(0), i + 2, F.size(found(0)) + 1), F.slice(F.split("line", link, -1), i + 3, F.size(found(0)) + 1), lambda a, b: F.concat(a, b)), "")
    hooks = F.transform(found(0), lambda x, i: F.concat(F.get(F.split("line", link, -1), i + 1), after(i)))
    pairs = F.arrays_zip(found(1).alias("title"), found(2).alias("target"), hooks.alias("hook"))
    hook = T.trim(F.regexp_replace("p.hook", rf"^[{T.WS[1:-1]}—–:-]+", ""))
    return lines.select("line_no", F.posexplode(pairs).alias("link_no", "p")).select("line_no", "link_no", "p.title", "p.target", hook.alias("hook"))


_LOG = r"^\d{4}-\d{2}-\d{2}\.md$"


def daily_logs(spark: SparkSession, folder: str, now: datetime.datetime, days_back: int = 7, recursive: bool = False) -> DataFrame:
    """(path, file, date, content, size, in_range, error) of files YYYY-MM-DD.md, newest first; a file with an impossible date has an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    file = F.element_at(F.split("path", "/"), -1)
    rows = raw.select("path", file.alias("file"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size")).where(file.rlike(_LOG))
    rows = rows.withColumn("date", F.try_to_date(F.substring("file", 1, 10), "yyyy-MM-dd"))
    rows = rows.withColumn("in_range", F.coalesce(F.col("date").cast("timestamp") >= F.lit(now - datetime.timedelta(days=days_back)), F.lit(False)))
    return rows.withColumn("error", F.when(F.col("date").isNull(), F.concat(F.lit("no such date: "), "file"))).orderBy(F.desc("date"), "path")


def log_scan(logs: DataFrame) -> dict[str, DataFrame]:
    """daily_logs() as the files in range, the errors, and how many files were named like logs at all."""
    return {"files": logs.where("in_range"), "errors": logs.where("error is not null").select("path", "error"), "total": logs.agg(F.count("*").alias("total_scanned"))}


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below a folder; names that begin with a dot are left out at any depth."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", f"^(?:file:/*(?=/))?{re.escape(root.rstrip('/'))}/", "")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).where(~F.col("path").rlike(r"(^|/)\."))


def workspace(spark: SparkSession, root: str, config: list[dict] | None = None, profile: str | None = None, warnings: list[str] | None = None) -> DataFrame:
    """(path, content) of a workspace's configured files, by their remote paths; without a configuration, of all of them.

    config has source, destination, kind (file or directory), and perhaps required and ownerScoped. A required source that isn't there
    is an error. With a profile, an owner-scoped directory gives <profile>.json alone; if it has others' files only, a warning says so.
    """
    files = tree(spark, root)
    if config is None:
        return files
    out = spark.createDataFrame([], files.schema)
    for c in config:
        source, dest = c["source"].strip("/"), (c.get("destination") or c["source"]).strip("/")
        if not shared.exists(spark, f"{root.rstrip('/')}/{source}"):
            if c.get("required"):
                raise ValueError(f"the required path {c['source']!r} does not exist")
            continue
        if c.get("kind", "directory") == "file":
            out = out.unionByName(files.where(F.col("path") == source).withColumn("path", F.lit(dest)))
            continue
        inside = files.where(F.col("path").startswith(source + "/")).withColumn("path", F.concat(F.lit(dest), F.substring("path", F.lit(len(source) + 1), F.length("path"))))
        if c.get("ownerScoped") and profile:
            own = inside.where(F.col("path") == f"{dest}/{profile}.json")
            if warnings is not None and own.isEmpty() and not inside.isEmpty():
                warnings.append(f"profile {profile!r}: no {profile}.json among the files of {c['source']!r}; nothing of {dest!r} will be published")
            inside = own
        out = out.unionByName(inside)
    return out.orderBy("path")
