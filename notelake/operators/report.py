"""Reports as text and as JSON. A report is for a reader, so its rows are few; they are read from the driver in order."""

from __future__ import annotations

import json

import yaml
from pyspark.sql import DataFrame


def rows_of(df: DataFrame | None) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()] if df is not None else []


def as_json(report: dict) -> str:
    """Tables as lists of objects, anything else as it is."""
    return json.dumps({k: rows_of(v) if isinstance(v, DataFrame) else v for k, v in report.items()}, indent=2, default=str, ensure_ascii=False) + "\n"


def as_yaml(report: dict) -> str:
    return yaml.safe_dump(json.loads(as_json(report)), sort_keys=False, allow_unicode=True)


def write(report: dict, form: str, text) -> str:
    """A report as json, yaml or text; text is a function."""
    return as_json(report) if form == "json" else as_yaml(report) if form == "yaml" else text() + "\n"


def evaluation(result: dict[str, DataFrame]) -> str:
    """An evaluation (retrieval.evaluate): each prompt's figures, the means, and expected ids that aren't there."""
    lines = [f"warning: expected, but in no note: {r['id']}" for r in rows_of(result["unknown"].orderBy("id"))]
    for r in rows_of(result["per_prompt"].orderBy("qid")):
        if r["negative"]:
            lines.append(f"prompt {r['qid']} (negative control): {'pass' if r['precision'] == 1 else 'fail'}")
        else:
            lines.append(f"prompt {r['qid']}: precision={r['precision']:.2f} recall={r['recall']:.2f} rr={r['reciprocal_rank']:.2f}")
    a = rows_of(result["aggregate"])[0]
    rate = "" if a["negative_rate"] is None else f" ({100 * a['negative_rate']:.1f}%)"
    lines.append(f"precision={a['precision']:.3f} recall={a['recall']:.3f} mrr={a['mrr']:.3f} over {a['positives']} prompts")
    lines.append(f"negative controls passed: {a['negatives_passed']} of {a['negatives']}{rate}; prompts with similar notes: {a['semantic_prompts']}")
    return "\n".join(lines)


def findings(rows: DataFrame, key: str, line, title: str) -> str:
    """Findings grouped by a column, a line each, and how many there are."""
    found = sorted(rows_of(rows), key=lambda r: str(r[key]))
    out, last = [], object()
    for r in found:
        if r[key] != last:
            out.append(str(r[key]))
            last = r[key]
        out.append("  " + line(r))
    return "\n".join([*out, f"{title}: {len(found)} found"])


def topics(rows: DataFrame) -> str:
    return findings(rows, "id", lambda r: f"unknown topic {r['topic']!r}" + (f" (did you mean {r['suggestion']!r}?)" if r["suggestion"] else ""), "topics")


def drift(rows: DataFrame) -> str:
    return findings(rows, "kind", lambda r: r["subject"] + (" (fixable)" if r["fixable"] else ""), "drift")


def stale(rows: DataFrame) -> str:
    return findings(rows, "id", lambda r: f"[{r['kind']}/{r['status']}] {r['value']} (from {r['source']})", "stale references")


def conflicts(rows: DataFrame) -> str:
    return findings(rows, "severity", lambda r: f"{r['topic']}: {r['a']} and {r['b']}: {r['reason']}", "conflicts")


def migration(plan: DataFrame, summary: DataFrame) -> str:
    out = []
    for r in sorted(rows_of(plan), key=lambda r: r["id"]):
        sets = [f"{f}: {r[f]['value']} (from {r[f]['source']})" for f in ("type", "topics", "created") if r[f]["action"] == "set"]
        out.append(f"{r['id']}: " + (f"skipped, {r['reason']}" if r["skipped"] else "; ".join(sets) or "no changes"))
    s = rows_of(summary)[0]
    return "\n".join([*out, f"{s['changed']} to change, {s['unchanged']} unchanged, {s['skipped']} skipped, {s['untagged']} untagged, {s['missing_type']} without a type"])


def consolidation(report: dict) -> str:
    """A consolidate() report; it says that nothing was written."""
    near, schema = report["near"], rows_of(report["schema"])[0]
    out = [f"{report['scanned']} notes", "exact duplicates:"] + [f"  {', '.join(map(str, r['ids']))}" for r in rows_of(report["exact"].orderBy("first"))]
    out += ["empty bodies: " + (", ".join(str(r["id"]) for r in rows_of(report["empty"].orderBy("id"))) or "none")]
    if near["status"] == "skipped":
        out.append(f"near duplicates: skipped, {near['reason']}")
    else:
        out += [f"near duplicates (cosine of {near['threshold']} or more; {near['indexed']} of {near['total']} notes have a vector):"]
        out += [f"  {r['similarity']:.4f}  {r['a']} and {r['b']}" for r in rows_of(near["pairs"])]
    out += [stale(report["stale"]), f"untagged: {schema['untagged']} of {schema['accepted']}; legacy: {schema['legacy']} ({100 * schema['legacy_rate']:.1f}%); wrong shape: {schema['bad_shape']}; rejected: {schema['rejected']}"]
    return "\n".join([*out, "report only, nothing was written"])
