"""YAML frontmatter with some keys set, every other byte as it was: comments, quotes, order, anchors and ends of line stay."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F


_FAST = getattr(yaml, "CSafeLoader", None)  # libyaml's, ten times as fast, if PyYAML was built with it
#: Where the two parsers differ: keys and tags that a mark makes, comments glued to a block's head, rare characters. Deep nesting is no matter for libyaml.
_APART = re.compile(r"[^\n\r -~\u00a0-\u2027\u2030-\ud7ff]|[?!]|[|>][^ \n\r]*#|(?:^|[\n\r])[ -]{100}")
_NESTED = 100


def _fast(text: str) -> bool:
    return _FAST is not None and text.count("[") + text.count("{") <= _NESTED and not _APART.search(text)


def loaded(text: str):
    """What yaml.safe_load gives, its errors too: libyaml reads what both parsers read alike, and what it refuses is read anew."""
    if _fast(text):
        try:
            return yaml.load(text, Loader=_FAST)
        except yaml.YAMLError:
            pass
    return yaml.safe_load(text)


def _events(text: str) -> list:
    if _fast(text):
        try:
            return list(yaml.parse(text, Loader=_FAST))
        except yaml.YAMLError:
            pass
    return list(yaml.parse(text, Loader=yaml.SafeLoader))


class _Entries:
    """Where the values of a document's own keys stand, from the parser's events: spans of the source, not nodes, so an alias is itself."""

    def __init__(self, source: str):
        self.at: dict[str, tuple[int, int]] = {}
        self.flow, self.column, self.close, self.any = False, 0, len(source), False
        events = _events(source)
        depth, key, first, last = 0, None, 0, 0
        for e in events:
            if isinstance(e, (yaml.StreamStartEvent, yaml.StreamEndEvent, yaml.DocumentStartEvent, yaml.DocumentEndEvent)):
                continue
            if isinstance(e, yaml.CollectionStartEvent):
                depth += 1
                if depth == 1:
                    if not isinstance(e, yaml.MappingStartEvent):
                        raise ValueError("no mapping")
                    self.flow = bool(e.flow_style)
                    continue
                if depth == 2:
                    first = e.start_mark.index
                last = max(last, e.start_mark.index + (1 if e.flow_style else 0))
                continue
            if isinstance(e, yaml.CollectionEndEvent):
                depth -= 1
                if depth == 0:
                    self.close = e.start_mark.index
                    continue
                last = e.end_mark.index if source[e.start_mark.index : e.end_mark.index] in ("]", "}") else last
            else:  # a scalar or an alias
                if depth == 1:
                    first = e.start_mark.index
                end = e.end_mark.index
                if isinstance(e, yaml.ScalarEvent) and e.style in ("|", ">"):
                    end = e.start_mark.index + len(source[e.start_mark.index : end].rstrip())
                last = end
            if depth == 1:  # a key or a value has ended
                if key is None:
                    key = (e.value if isinstance(e, yaml.ScalarEvent) else None,)
                    if not self.any:
                        self.any, self.column = True, e.start_mark.column
                else:
                    if key[0] is not None and key[0] not in self.at:
                        self.at[key[0]] = (first, last)
                    key = None


def _flow(value) -> str:
    """A value on one line."""
    return _dumped_text(value) if type(value) is str else _dumped(value)


def _dumped(value) -> str:
    text = yaml.safe_dump(value, default_flow_style=True, allow_unicode=True, width=1 << 30)
    return text.removesuffix("\n").removesuffix("\n...")


_dumped_text = functools.lru_cache(10_000)(_dumped)  # keys and topics recur


def _written(value, plain: bool) -> str:
    return value if plain else _flow(value)


def edited(source: str, changes: dict, comments: dict[str, str] | None = None) -> str | None:
    """The frontmatter with keys set to values, texts or lists of texts; a key that isn't there yet comes after the others. None if that
    can't be done without touching more, judged by reading the result. A key of comments gets the comment behind it, if its line is free;
    such a value is written plainly, without quotes."""
    comments = comments or {}
    try:
        found = _Entries(source)
        eol = "\r\n" if "\r\n" in source else "\n"
        out, added = source, []
        spans = sorted(((*found.at[k], k) for k in changes if k in found.at), reverse=True)
        for a, z, k in spans:
            text = _written(changes[k], k in comments)
            line_end = next((i for i in range(z, len(source)) if source[i] in "\r\n"), len(source))
            if k in comments and not source[z:line_end].strip() and not found.flow:
                text, z = f"{text} # {comments[k]}", line_end
            out = out[:a] + ("" if out[:a].endswith((" ", "\n")) else " ") + text + out[z:]
        for k, v in changes.items():
            if k in found.at:
                continue
            if found.flow:
                added.append(f"{_flow(k)}: {_written(v, k in comments)}")
            elif isinstance(v, list):
                added.append(f"{_flow(k)}:" + "".join(f"\n  - {_flow(x)}" for x in v) if v else f"{_flow(k)}: []")
            else:
                added.append(f"{_flow(k)}: {_written(v, k in comments)}" + (f" # {comments[k]}" if k in comments else ""))
        if added and found.flow:
            close = found.close + len(out) - len(source)
            head = out[:close].rstrip()
            out = head + (", " if found.any and not head.endswith(",") else " " if head.endswith(",") else "") + ", ".join(added) + out[len(head) :]
        elif added:
            pad = " " * found.column
            lines = [pad + line for entry in added for line in entry.split("\n")]
            gap = "" if not out or out.endswith("\n") else eol
            out = out + gap + eol.join(lines)
        return out if _same(loaded(out), {**(loaded(source) or {}), **changes}) else None
    except (ValueError, yaml.YAMLError):
        return None


def _same(a, b) -> bool:
    """Whether two documents say the same; a date and its text do."""
    return json.dumps(a, default=str) == json.dumps(b, default=str)


def rendered(source: str, changes: dict, comments: dict[str, str] | None = None) -> str:
    """edited(), or where that can't be done all of the frontmatter anew."""
    out = edited(source, changes, comments)
    if out is None:
        eol = "\r\n" if "\r\n" in source else "\n"
        out = yaml.safe_dump({**(loaded(source) or {}), **changes}, sort_keys=False, allow_unicode=True, width=1 << 30).rstrip("\n").replace("\n", eol)
    return out


def with_keys(source: Column, changes: Column, comments: dict[str, str] | None = None) -> Column:
    """rendered() of frontmatters and JSON objects, whose nulls change nothing."""

    def run(sources: pd.Series, given: pd.Series) -> pd.Series:
        set_ = lambda c: {k: v for k, v in json.loads(c).items() if v is not None}
        return pd.Series([None if s is None or c is None else rendered(s, set_(c), {k: v for k, v in (comments or {}).items() if k in set_(c)}) for s, c in zip(sources, given)], dtype=object)

    return F.pandas_udf(run, "string")(source, changes)
