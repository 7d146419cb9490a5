"""String, date and pattern functions on columns (STR, DAT, PRD, JAC, POL, IMP, PRJ of the survey)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the corpus format defines it, and an ASCII word boundary.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_BEGIN, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
MAX_PATTERN = 200


def _boundary(pattern: str, at: int) -> str:
    r"""What \b at a place of a pattern stands for: half of the test is enough where a word's character must stand beside it."""
    before, after = pattern[:at], pattern[at + 2 :]
    if re.match(r"[A-Za-z0-9_]", after):
        return _BEGIN
    if re.search(r"(?<!\\)[A-Za-z0-9_]{2}\??$|^[A-Za-z0-9_]$|(?<!\\)[A-Za-z0-9_]{2}\((?:\?:)?[A-Za-z0-9_|]+\)\??$|[\s+)]\(?[A-Za-z0-9_]{2,}$", before):
        return _END
    return BOUNDARY


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with an ASCII word boundary and Unicode white space, for Spark's engine."""
    out = re.sub(r"(?<!\\)\\b", lambda m: _boundary(pattern, m.start()), pattern)
    out = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{WS[1:-1]}{m[2]}]", out)
    return ("(?i)" if ignore_case else "") + re.sub(r"(?<!\\)\\s", lambda m: WS, out)


def stem(pattern: str) -> str:
    """Letters and digits that any match of a pattern holds, or '': what it begins with, but for the last one if that is optional."""
    found = re.match(r"(?:\\b)?([A-Za-z0-9 ]+)(.?)", pattern)
    if not found or "|" in re.sub(r"\([^)]*\)", "", pattern):
        return ""
    return (found[1][:-1] if found[2] in ("?", "*", "{") else found[1]).lower()


def _candidate(text: Column, pattern: str) -> Column | None:
    """A cheap test that every text with a match passes: a search for the stem, before the pattern is tried."""
    return F.lower(text).contains(stem(pattern)) if stem(pattern) else None


def matches(text: Column, pattern: str, ignore_case: bool) -> Column:
    cheap, test = _candidate(text, pattern), text.rlike(java(pattern, ignore_case))
    return test if cheap is None else cheap & test


def match_count(text: Column, pattern: str, ignore_case: bool) -> Column:
    cheap, count = _candidate(text, pattern), F.regexp_count(text, F.lit(java(pattern, ignore_case)))
    return F.coalesce(count if cheap is None else F.when(cheap, count), F.lit(0))


def any_match(text: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Whether any (pattern, ignore_case) is found in the text; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [matches(text, p, i) for p, i in patterns], F.lit(False)), F.lit(False))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


#: The hash of an empty text.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def body_hash(text: Column) -> Column:
    """sha256 of the text, white space collapsed to blanks, trimmed, in lower case; EMPTY_HASH for an empty one."""
    return F.sha2(F.lower(F.trim(collapse(text))), 256)


def normal_hash(text: Column) -> Column:
    """body_hash, null for an empty text."""
    return F.nullif(body_hash(text), F.lit(EMPTY_HASH))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; only a text with characters of several bytes can have pairs of them."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]")))


def utf16_left(text: Column, units: int) -> Column:
    """The first so many UTF-16 units; a pair that the cut would part is left out."""
    head = F.left(text, F.lit(units))
    size = lambda c: F.when(F.octet_length(c) == 4, 2).otherwise(1)
    step = lambda s, c: F.struct((s["n"] + size(c)).alias("n"), (s["k"] + F.when(s["n"] + size(c) <= units, 1).otherwise(0)).alias("k"))
    kept = F.aggregate(F.split(head, ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), step, lambda s: s["k"])
    return F.when(utf16_length(head) <= units, head).otherwise(F.left(head, kept))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; over 200 characters it is cut and marked."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(text, "\r?\n"), trim), lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when(utf16_length(line) > 200, F.concat(utf16_left(line, 200), F.lit("..."))).otherwise(line)


def embed_input(name: Column, description: Column, body: Column, limit: int = 8000) -> Column:
    """What is embedded of a note: its parts that aren't empty, a line each, cut to a limit."""
    return utf16_left(F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in (name, description, body))), limit)


def keyword_pattern(name: str) -> str:
    return rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"


def clean_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def iso_dates(text: Column) -> Column:
    """The calendar dates YYYY-MM-DD of a text that stand as words; impossible ones are left out."""
    found = F.regexp_extract_all(text, F.lit(f"{_BEGIN}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_END}"), F.lit(0))
    return F.filter(F.transform(found, lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull())


def urls(text: Column) -> Column:
    """The http urls of a text, without repeats and without the punctuation that ends a sentence."""
    found = F.regexp_extract_all(text, F.lit(rf"""{_BEGIN}https?://[^{WS[1:-1]}>"'`)\]]+"""), F.lit(0))
    cut = F.transform(found, lambda u: F.regexp_replace(u, r"[.,!?;:)\]]+$", ""))
    return F.array_distinct(F.filter(cut, lambda u: u != ""))


#: Extensions that make a bare name a path.
PATH_EXTENSIONS = "ts tsx js jsx mjs cjs json yml yaml toml md mdx py rb go rs java kt sh bash zsh sql html css scss lock".split()


def looks_like_path(span: Column) -> Column:
    bad = span.rlike(r"^(?:https?://|file://|mailto:)") | span.contains(" ") | span.rlike(r"[*?<>:@]|\.\.\.")
    ext = F.lower(F.regexp_extract(span, r"^.+\.([^.]+)$", 1))
    return ~bad & (span.contains("/") | ext.isin(PATH_EXTENSIONS))


#: A call in a text, and what may be looked up as a symbol.
SYMBOL_CALL = r"^[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*\(\)$"
SYMBOL_VALUE = r"^[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*(?:\(\))?$"


def symbol_word(value: Column) -> Column:
    """The word to look for: the last part of a dotted name, without call brackets."""
    return F.element_at(F.split(F.regexp_replace(value, r"\(\)$", ""), r"\."), -1)


def references(body: Column) -> Column:
    """Back-ticked spans that are paths or calls, as structs (kind, value), without repeats."""
    spans = F.transform(F.regexp_extract_all(body, F.lit("`([^`\n]+)`"), F.lit(1)), trim)
    kind = lambda s: F.when(looks_like_path(s), "path").when(s.rlike(SYMBOL_CALL), "symbol")
    return F.array_distinct(F.filter(F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s.alias("value"))), lambda r: r["kind"].isNotNull()))


def fixed(number: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", number.cast("double"))


def sanitised(segment: Column) -> Column:
    """A name as one segment of a path."""
    return F.regexp_replace(segment, r"[^a-zA-Z0-9._-]+", "-")


# ---------------------------------------------------------------- ambiguity of a prompt

#: Fixed values of the ambiguity score.
VAGUE = r"\b(check|schau|look|see|mal|irgendwie|kannst\s+du|can\s+you|überprüf)"
IMPERATIVE = r"\b(fix|add|remove|rename|refactor|update|delete|implement|write|create|bump|upgrade|migrate|extract|inline|move)\b"
SPECIFIC = r"\b(function|class|method|file|test|spec|module|config|component|route|endpoint|schema|migration|commit|branch|PR|hook|gate)\b"
PATH = r"(?:[\w.-]+\/[\w./-]+|\b[\w-]+\.[a-z]{1,5}\b)"


def ambiguity(prompt: Column) -> Column:
    """0 for a clear prompt to 1 for a vague or empty one."""
    text = trim(prompt)
    step = lambda cond, by: F.when(cond, by).otherwise(0.0)
    words = F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))
    score = (
        F.lit(0.5) + step(text.rlike(java(PATH)), -0.2) + step(text.rlike(java(SPECIFIC, True)), -0.2) + step(text.rlike(java(IMPERATIVE, True)), -0.1)
        + step(text.rlike(java(VAGUE, True)), 0.3) + step(words < 5, 0.2)
    )
    return F.when(F.coalesce(text, F.lit("")) == "", 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def confidence_threshold(score: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.85 - score * 0.35)


# ---------------------------------------------------------------- polarity of a directive

#: Fixed values: (pattern, whether case is ignored).
ANYWHERE_POSITIVE = [
    (r"\bALWAYS\b", False), (r"\bMUST(?!\s+NOT)\b", False), (r"\bDO\b(?!\s+NOT)", False), (r"\bmandator(?:y|ily)\b", True),
    (r"\bmandate(?:d|s)?\b", True), (r"\bcompulsor(?:y|ily)\b", True),
]
ANYWHERE_NEGATIVE = [
    (r"\bNEVER\b", False), (r"\bMUST\s+NOT\b", False), (r"\bDO\s+NOT\b", False), (r"\bDON'T\b", False), (r"\bprohibit(?:ed|s)?\b", True),
    (r"\bforbid(?:den|s)?\b", True), (r"\bdisallow(?:ed|s)?\b", True), (r"\bcannot\b", True),
]
LEADING_POSITIVE = [(r"\balways\b", True), (r"\bmust(?!\s+not)\b", True), (r"\bprefer\b", True), (r"\brequire(?:d|s)?\b", True)]
LEADING_NEGATIVE = [(r"\bnever\b", True), (r"\bmust\s+not\b", True), (r"\bdo\s+not\b", True), (r"\bdon't\b", True), (r"\bavoid\b", True), (r"\bskip\b", True)]
POLARITY_TOKENS = """always never must avoid skip prefer require required requires don't dont mandatory mandatorily mandate mandates mandated
    compulsory compulsorily prohibit prohibits prohibited forbid forbids forbidden disallow disallows disallowed cannot""".split()


def leading_window(text: Column) -> Column:
    return F.array_join(F.slice(F.split(trim(text), f"{WS}+"), 1, 2), " ")


def polarity(text: Column) -> Column:
    """positive, negative, mixed or null."""
    lead = leading_window(text)
    rest = F.substring(text, F.length(lead) + 1, F.length(text))
    pos, neg = any_match(text, ANYWHERE_POSITIVE), any_match(text, ANYWHERE_NEGATIVE)
    lead_pos, lead_neg = any_match(lead, ANYWHERE_POSITIVE + LEADING_POSITIVE), any_match(lead, ANYWHERE_NEGATIVE + LEADING_NEGATIVE)
    later_pos, later_neg = pos | any_match(rest, LEADING_POSITIVE), neg | any_match(rest, LEADING_NEGATIVE)
    return (
        F.when(lead_pos & lead_neg, "mixed").when(lead_pos, F.when(later_neg, "mixed").otherwise("positive"))
        .when(lead_neg, F.when(later_pos, "mixed").otherwise("negative")).when(pos & neg, "mixed").when(pos, "positive").when(neg, "negative")
    )


def content_tokens(line: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(line), rf"[^a-z0-9'{WS[1:-1]}]", " "), f"{WS}+")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 4), F.array(*map(F.lit, POLARITY_TOKENS)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


# ---------------------------------------------------------------- importance and type of a log line

#: Markers and what each adds; each counts once, by case.
IMPORTANCE = [
    (["✅", "🎉", "🚀", "COMPLETE", "SUCCESS", "BREAKTHROUGH", "CRITICAL"], 0.4),
    (["✓", "🔥", "IMPORTANT", "NOTE", "DECISION", "TODO"], 0.2),
    (["⚠️", "💭", "idea", "consider"], 0.1),
]
LINE_TYPES = {
    "event": ["happened", "completed", "finished", "deployed", "launched", "✅", "🎉"],
    "decision": ["decided", "chose", "will", "going to", "DECISION"],
    "insight": ["learned", "realized", "discovered", "found", "💡", "insight"],
    "action": ["TODO", "need to", "must", "should", "[ ]"],
}


def importance(line: Column) -> Column:
    score = F.lit(0.3)
    for markers, by in IMPORTANCE:
        for m in markers:
            score = score + F.when(line.contains(m), by).otherwise(0.0)
    size = utf16_length(line)
    return F.least(F.lit(1.0), score + F.when(size > 100, 0.1).otherwise(0.0) + F.when(size > 200, 0.1).otherwise(0.0))


def line_type(line: Column) -> Column:
    low, out = F.lower(line), None
    for kind, markers in LINE_TYPES.items():
        cond = reduce(lambda a, b: a | b, [low.contains(m.lower()) for m in markers])
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise("insight")
