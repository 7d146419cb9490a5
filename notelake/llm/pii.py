"""Personal data in texts, in DataFrame operations alone: base patterns, and identifiers that the patterns don't know, found by bootstrapping.

Base matches are the seeds, each whole. The two words before a seed, whatever they are, are a lexical pattern; what else stands after a pattern
and looks like an identifier is an instance: a run of tokens with a digit or an @, blanks between them, that ends at a line's end, after
,;:.!? and at a base match. On the graph of patterns and instances scores are passed to and fro: a pattern's score is its instances' mean
score, an instance's what its patterns together say; seeds keep theirs. No link is left out, so instances found in one round bring in
patterns in the next. Scores only ever rise, so this ends, at a fixed point. Patterns with enough support, a high score, and after which
identifiers stand most of the time, name the kind of their unseen instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 3  # least sum of the scores of a pattern's distinct instances
CONFIDENCE = 0.6  # least score of a pattern, and of a new instance
SPECIFIC = 0.5  # least share of a pattern's occurrences that identifiers follow
CELL = 256  # characters
BROADCAST_ROWS = 100_000

#: Fixed values of the query's contract, written so that no search goes over a run of characters twice: possessive, and begun where a run begins.
_FIND = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
_HINT = {"email": "@", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"


_PIECE = "struct<kind:string,value:string,gap:int,left:string,whole:boolean,blank:boolean>"


def _before(gap: Column) -> tuple[Column, Column, Column]:
    """Of the text before a token: its last two words; whether that is all of it; whether it is nothing but blanks."""
    tail = F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*+(?:\S++(?:\s++\S++)?+)?+\s*+", 0))
    return F.regexp_replace(tail, r"\s+", " "), F.length(tail) == F.length(gap), gap.rlike(r"^[^\S\r\n]++$")


def _pieces(text: Column, kind: str) -> Column:
    """Matches of one kind with the length of the gap before each, and what that gap ends in."""
    gaps = F.split(text, _FIND[kind], -1)
    matches = F.regexp_extract_all(text, F.lit(_FIND[kind]), F.lit(0))

    def piece(m: Column, g: Column) -> Column:
        left, whole, blank = _before(g) if kind == "token" else (F.lit(""), F.lit(False), F.lit(False))
        return F.when(m.isNotNull(), F.struct(F.lit(kind).alias("kind"), m.alias("value"), F.length(g).alias("gap"), left.alias("left"), whole.alias("whole"), blank.alias("blank")))

    rows = F.zip_with(matches, gaps, piece)
    has = text.contains(_HINT[kind]) if kind in _HINT else text.rlike("[0-9@]" if kind == "token" else "[0-9][^@]*[0-9]")
    return F.when(has, F.filter(rows, lambda r: r.isNotNull())).otherwise(F.array().cast(f"array<{_PIECE}>"))


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    number = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when((F.length(digits) - i) % 2 == 1, double(number(i))).otherwise(number(i)))
    return total % 10 == 0


def found(texts: DataFrame) -> DataFrame:
    """(key..., kind, value, start, end, pattern, glue) of the base matches that hold, and of tokens; texts: (doc_id, h, text).

    Tokens have the pattern before them, and glue: whether they go on with the token before.
    """
    hits = texts.select("doc_id", "h", F.concat(*(_pieces(F.col("text"), k) for k in _FIND)).alias("all"))
    hits = hits.where(F.size("all") > 0).dropDuplicates(["doc_id", "h"])  # repeated rows have the same matches
    rows = hits.select("doc_id", "h", F.posexplode("all").alias("n", "r")).select("doc_id", "h", "n", "r.*")
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(w)).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    holds = (
        F.when(F.col("kind") == "ip", F.col("value").rlike(_IP)).when(F.col("kind") == "card", n.between(16, 19) & _luhn(F.when(n.between(16, 19), digits).otherwise("0")))
        .when(F.col("kind") == "phone", n.between(8, 15)).otherwise(F.lit(True))
    )
    o = Window.partitionBy("doc_id", "h", "kind").orderBy("n")
    last = lambda c, by=1: F.lag(c, by).over(o)
    none = lambda c: F.coalesce(c, F.lit(""))
    # The two words may be tokens themselves, if fewer than two words stand since the last ones.
    earlier = F.concat(F.when(last("whole"), none(last("value", 2))).otherwise(F.lit("")), none(last("left")), none(last("value")))
    before = F.concat(F.when(F.col("whole"), earlier).otherwise(F.lit("")), "left")
    glue = F.col("blank") & ~F.coalesce(last("value"), F.lit(",")).rlike("[,;:.!?]$")
    token = F.col("kind") == "token"
    rows = rows.withColumn("before", before).withColumn("glue", glue)
    return rows.where(holds).select("doc_id", "h", "kind", "value", "start", "end", F.when(token, _pattern(F.col("before"))).alias("pattern"), (token & F.col("glue")).alias("glue"))


def _pattern(left: Column) -> Column:
    """The last two words before a place, in lower case, digits as 0; null if there are fewer."""
    words = F.regexp_extract(F.regexp_replace(F.lower(left), "[0-9]", "0"), r"(?:^|\s)(\S+)\s+(\S+)\s*$", 0)
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    return F.when(words != "", words)


def learnt(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, kind, start, end): identifiers that confident patterns name and no base match touches; texts are all of the corpus."""
    token = rows.where("kind = 'token'").select("doc_id", "h", "value", F.col("start").alias("t0"), F.col("end").alias("t1"), "pattern", "glue")
    base = rows.where("kind <> 'token'").select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "kind", F.col("value").alias("match"), "start", "end")
    # Both sides are dealt to the cells of the text that they reach into, so that a text's rows don't all meet.
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor((F.col(hi) - 1) / CELL)))
    token, base = token.withColumn("cell", cells("t0", "t1")), base.withColumn("c", cells("start", "end"))
    meets = (token.doc_id.eqNullSafe(base.d)) & (token.h == base.hh) & (token.cell == base.c) & (token.t0 < base.end) & (base.start < token.t1)
    met = scratch.save(token.join(base, meets, "left").drop("cell", "c", "d", "hh", "end"), "met")
    tokens = met.groupBy("doc_id", "h", "t0", "t1", "value", "pattern", "glue").agg((F.count("start") == 0).alias("free"))
    w = Window.partitionBy("doc_id", "h").orderBy("t0")
    runs = tokens.withColumn("new", ~(F.col("glue") & F.coalesce(F.lag("free").over(w), F.lit(False))))
    runs = runs.withColumn("run", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("free")
    parts = F.array_sort(F.collect_list(F.struct("t0", "value")))
    value = F.array_join(F.transform(parts, lambda x: x["value"]), " ")
    runs = runs.groupBy("doc_id", "h", "run").agg(F.min_by("pattern", "t0").alias("pattern"), value.alias("value"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    named = scratch.save(runs.where("pattern is not null"), "named")
    trimmed = F.regexp_replace(F.lower("value"), r"^[^\w+@]+|[^\w@]+$", "")
    # A seed's pattern stands before the token in which its match begins.
    seen = met.where("pattern is not null and start >= t0").select("pattern", F.regexp_replace("match", r"\s+", " ").alias("value"), "kind")
    edges = seen.unionByName(named.select("pattern", "value", F.lit(None).cast("string").alias("kind")))
    edges = edges.select("pattern", trimmed.alias("instance"), "kind").where("length(instance) >= 5")
    edges = scratch.save(edges.distinct(), "edges")
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    links = scratch.save(edges.select("pattern", "instance").distinct(), "links")
    scores, patterns = scratch.save(seeds, "scores0"), None
    sizes = links.groupBy("pattern").agg(F.count("*").alias("size"))
    state, now, k = None, (), 0
    while state != now:  # until no score changes
        state, k = now, k + 1
        patterns = links.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support")).join(sizes, "pattern")
        patterns = patterns.withColumn("weight", F.col("support") / F.col("size")).where((F.col("support") >= SUPPORT) & (F.col("weight") >= CONFIDENCE))
        patterns = scratch.save(patterns, f"patterns{k}")
        told = links.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("weight")))))).alias("score"))
        new = told.join(seeds.select("instance").distinct(), "instance", "left_anti")
        scores = scratch.save(seeds.unionByName(new), f"scores{k}")
        now = tuple(scores.agg(F.count("*"), F.sum(F.round(F.col("score") * 1_000_000).cast("long"))).first())
        scratch.drop(f"scores{k - 1}", f"patterns{k - 1}")
    n = patterns.count()
    wanted = patterns.select("pattern").distinct()
    wanted = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    if n:  # how often the corpus has these patterns at all
        w = F.split(F.regexp_replace(F.lower("text"), "[0-9]", "0"), r"\s+")
        pairs = texts.select("doc_id", "h", w.alias("w")).where(F.size("w") > 1).select("doc_id", "h", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)))).alias("at", "pattern"))
        total = pairs.join(wanted, "pattern").dropDuplicates(["doc_id", "h", "at"]).groupBy("pattern").agg(F.count("*").alias("total"))  # repeated rows count once, as in followed
        followed = met.select("doc_id", "h", "t0", "pattern").distinct().join(wanted, "pattern").groupBy("pattern").agg(F.count("*").alias("followed"))
        sure = total.join(followed, "pattern").where(F.col("followed") >= SPECIFIC * F.col("total")).select("pattern")
        sure = scratch.save(patterns.join(sure, "pattern").select("pattern", "kind", "weight"), "sure")
    else:
        sure = patterns.select("pattern", "kind", "weight")
    best = F.row_number().over(Window.partitionBy("doc_id", "h", "t0").orderBy(F.desc("weight"), "kind"))
    new = named.where(F.length(trimmed) >= 5).join(sure, "pattern").withColumn("best", best).where("best = 1")
    lead = F.length(F.regexp_extract("value", r"^[^\w+@]+", 0))
    tail = F.length(F.regexp_extract("value", r"[^\w@]+$", 0))
    return new.select("doc_id", "h", "kind", (F.col("t0") + lead).alias("start"), (F.col("t1") - tail).alias("end")).where("end > start")


def spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, kind, start, end, base) of distinct texts, written; and docs with h, the hash of the text."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    texts = docs.select("doc_id", "h", "text").where(F.col("text").rlike("[0-9@]"))
    rows = scratch.save(found(texts).distinct(), "found")
    base = rows.where("kind <> 'token'").select("doc_id", "h", "kind", "start", "end", F.lit(True).alias("base"))
    more = learnt(rows, docs.select("doc_id", "h", "text"), scratch).withColumn("base", F.lit(False))
    return scratch.save(base.unionByName(more.select(*base.columns)), "spans"), docs


def personal_data(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) per row of docs; counts by kind are of the base spans.

    Null is the empty text; texts without spans have counts of 0, the hash of the empty string and an empty list. Repeated rows give a
    row each; a null doc_id is kept. Texts are taken whole. An empty table gives no rows. Other columns aren't read. Spans of
    different kinds may overlap; those of one kind don't.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    marked, docs = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct(order.alias("k"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    counts = [F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS]
    per = marked.groupBy("doc_id", "h").agg(*counts, joined(F.collect_list(F.when(F.col("base"), item))).alias("b"), joined(F.collect_list(item)).alias("all"), F.count("*").alias("n_spans"))
    per = per.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), *(f"n_{k}" for k in KINDS), "b", "all", "n_spans")
    out = docs.select("doc_id", "h").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    whole = [F.coalesce("all", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans")]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), *whole)


def redact(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; spans that overlap become one, named by the first.

    Documents without any stay as they are, null texts included. All columns stay; n_chars, where there is one, is that of the new text.
    """
    scratch = scratch or Scratch(docs.sparkSession, "redact")
    marked, _ = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    w = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("end"), "kind")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    rows = marked.withColumn("new", (F.col("start") >= before).cast("int"))
    rows = rows.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("doc_id", "h", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", F.negate("end"), "kind")).alias("kind"))
    per = rows.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    per = scratch.save(per.select(F.struct("doc_id", "h", "cuts").alias("per")), "cuts")
    scratch.drop("spans")
    n = per.agg(F.coalesce(F.sum(F.size("per.cuts") + 1), F.lit(0))).first()[0]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no other column's name can clash
    of = lambda c: F.col("row").getField(c)
    met = of("doc_id").cast("long").eqNullSafe(F.col("per.doc_id")) & (F.xxhash64(F.coalesce(of("text"), F.lit(""))) == F.col("per.h"))
    if n <= BROADCAST_ROWS:
        joined = row.join(F.broadcast(per), met, "left")
    else:  # texts without a digit or an @ have no spans and stay where they are
        some = F.coalesce(of("text").rlike("[0-9@]"), F.lit(False))
        joined = row.where(some).join(per, met, "left").unionByName(row.where(~some).withColumn("per", F.lit(None).cast(per.schema["per"].dataType)))
    cuts, text = F.col("per.cuts"), of("text")
    at = F.sequence(F.lit(0), F.size(cuts) - 1)
    part = lambda i: F.concat(F.substring(text, _end(cuts, i) + 1, F.get(cuts, i)["start"] - _end(cuts, i)), F.lit("["), F.upper(F.get(cuts, i)["kind"]), F.lit("]"))
    tail = F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text))
    new = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(F.transform(at, lambda i: part(i.cast("int"))), ""), tail))
    kept = {c: of(c) for c in docs.columns} | {"text": new}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(cuts.isNull(), of("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.struct(*(e.alias(c) for c, e in kept.items())).alias("out")).select("out.*")


def _end(cuts: Column, i: Column) -> Column:
    """Where the span before the i-th ends; 0 before the first."""
    return F.when(i > 0, F.get(cuts, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(F.lit(0)).cast("int")
