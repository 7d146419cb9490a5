"""Settings in layers: defaults, then environment, then a file, then what a caller gives; a later layer wins key by key."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

import yaml


def of_environment(environ: Mapping[str, str], prefix: str, keys: list[str]) -> dict[str, str]:
    """The keys that are set as PREFIX_KEY, camel humps as underscores; blank ones aren't set."""
    name = lambda key: prefix + re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).upper()
    return {k: environ[name(k)] for k in keys if environ.get(name(k), "").strip()}


def of_file(path: str | None) -> dict:
    """A YAML or JSON object; none if there is no file. A file that holds anything else is an error."""
    if not path or not Path(path).exists():
        return {}
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def layered(defaults: dict, environ: Mapping[str, str] | None = None, prefix: str = "NOTELAKE_", file: str | None = None, given: dict | None = None) -> dict:
    """defaults < environment < file < given. A null counts in no layer but the defaults; a text from the environment takes its default's
    type, and one that isn't of it is left out."""

    def typed(key: str, text: str):
        of = type(defaults[key]) if defaults[key] is not None else str
        if of is bool:
            return {"true": True, "1": True, "false": False, "0": False}.get(text.strip().lower())
        try:
            return of(text) if of in (int, float) else text
        except ValueError:
            return None

    env = {k: typed(k, v) for k, v in of_environment(environ or {}, prefix, list(defaults)).items()}
    out = dict(defaults)
    for layer in (env, of_file(file), given or {}):
        out |= {k: v for k, v in layer.items() if v is not None}
    return out
