"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations alone.

Test windows are 13 consecutive words of an item (a shorter item is one window). The index stores postings (term, document, pos) of the
training texts for each window's rarest term, by the corpus's own counts; a posting also carries the words around it. Its list,
adjusted by the term's offset, is intersected with those of the window's other terms, the rarest first, until one fails: whether a
term's list has the adjusted position is read from the words that the posting carries, so no list of a more common term is ever built
or shuffled, and what is left is the phrase, word by word, without hashing. proximity() returns terms near one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small

SPAN = 13
BROADCAST_ROWS = 200_000  # test windows or terms up to this number are broadcast; beyond it Spark chooses
BAD = 1_000_000  # contaminated texts (two numbers each) up to this number are broadcast to drop them; beyond it they are joined

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    parts = F.split(low, _GAP)
    return F.array_remove(parts, "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def test_windows(items: DataFrame, span: int) -> DataFrame:
    """(window, phrase, terms): the distinct windows of the items; phrase is the words joined by a space."""
    w = items.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - span + 1))).alias("i"))
    return w.select("item", F.slice("w", F.col("i"), F.lit(span)).alias("terms")).withColumn("phrase", F.array_join("terms", " ")).distinct()


def phrase_hits(docs: DataFrame, items: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """(doc_id, h, start, n, phrase): exact occurrences of the items' windows in docs (doc_id, h, w), w being the words."""
    phrases = scratch.save(test_windows(items, span).select("phrase", "terms").distinct(), "phrases")
    terms = scratch.save(phrases.select(F.explode("terms").alias("term")).distinct(), "terms")
    n_terms = terms.count()
    # How often the corpus has each test term.
    found = docs.select(F.explode("w").alias("term")).join(_small(terms, n_terms), "term").groupBy("term").count()
    counts = scratch.save(found, "counts")
    # A window's terms with their offsets, the rarest first; a term that occurs nowhere rules its window out.
    spots = phrases.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "term")))
    anchors = spots.groupBy("phrase", "n").agg(order.alias("order")).where(F.get("order", F.lit(0))["count"] > 0)
    first = F.get("order", F.lit(0))
    rest = F.transform(F.slice("order", 2, span), lambda t: F.struct(t["offset"].alias("offset"), t["term"].alias("term")))
    anchors = scratch.save(anchors.select("phrase", "n", first["offset"].alias("offset"), first["term"].alias("term"), rest.alias("rest")), "anchors")
    wanted = anchors.select("term").distinct()
    n_wanted = wanted.count()
    # Postings of the rarest terms, with the words that a window around them can have.
    at = F.greatest(F.lit(0), F.col("pos") - span + 1)
    around = F.slice("w", at + 1, F.lit(2 * span - 1)).alias("around")
    every = docs.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "term"))
    if n_wanted <= BROADCAST_ROWS:
        posted = every.join(F.broadcast(wanted), "term").select("term", "doc_id", "h", "pos", at.alias("at"), around)
    else:  # no text goes into the shuffle, only the words around
        posted = every.select("term", "doc_id", "h", "pos", at.alias("at"), around).join(wanted, "term", "left_semi")
    postings = scratch.save(posted, "postings")
    adjusted = postings.join(_small(anchors, anchors.count()), "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    begin = F.col("start") - F.col("at")
    whole = F.forall("rest", lambda t: F.coalesce(F.get("around", (begin + t["offset"]).cast("int")) == t["term"], F.lit(False)))
    hits = scratch.save(adjusted.where(whole).select("doc_id", "h", "start", "n", "phrase").distinct(), "hits")
    scratch.drop("phrases", "terms", "counts", "anchors", "postings")
    return hits


def judged(docs: DataFrame, items: DataFrame, span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """contamination() with h, the hash of the text that each row was judged by."""
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    hits = phrase_hits(split, items, span, scratch)
    key = ["doc_id", "h"]
    order = Window.partitionBy(*key).orderBy("start", "n")
    end = F.col("start") + F.col("n")
    spans = hits.select(*key, "start", "n").distinct().withColumn("before", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    covered = spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("before", F.lit(0))))).cast("long").alias("n_hit"))
    owners = scratch.save(test_windows(items, span).select("phrase", "item").where("item is not null"), "owners")
    named = hits.select(*key, "phrase").distinct().join(_small(owners, owners.count()), "phrase").select(*key, F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy(*key).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    both = covered.withColumnsRenamed({"doc_id": "d", "h": "g"}).join(named, F.col("d").eqNullSafe(named.doc_id) & (F.col("g") == named.h), "left").drop("doc_id", "h")
    per_doc = scratch.save(both, "per_doc")
    scratch.drop("hits", "owners")
    out = split.select("doc_id", "h", F.size("w").cast("long").alias("n_words")).join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose own text isn't contaminated."""
    scratch = scratch or Scratch(docs.sparkSession, "clean")
    bad = judged(docs, items, span, scratch).where("contaminated").select("doc_id", "h").distinct()
    bad = small(scratch.save(bad, "bad"), BAD)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no other column's name can clash
    return rows.join(bad, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("h")), "left_anti").select("row.*")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs, each judged by its own text.

    Null and empty texts have no words and no hits. Items that are null or without words have no windows. Windows that items share
    count for each item; repeated items count once by item_id. Rows of a null or reused doc_id are told apart by their texts. Empty
    tables give no rows, or no hits. Other columns aren't read.
    """
    return judged(docs, items, span, scratch).drop("h")


def proximity(docs: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """(doc_id, h, pos_first, pos_second): occurrences of two words at most `within` words apart, from their position lists; h is the
    hash of the text. Each list is dealt to cells of the text, so that the lists of a long text don't meet as a whole."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    listed = split.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.posexplode("w").alias("pos", "term")).where(F.col("term").isin(first, second))
    cell = F.floor(F.col("pos") / (within + 1))
    a = listed.where(F.col("term") == first).select("doc_id", "h", F.col("pos").alias("pos_first"), F.explode(F.array(*(cell + d for d in (-1, 0, 1)))).alias("cell"))
    b = listed.where(F.col("term") == second).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("pos_second"), cell.alias("c"))
    near = F.abs(F.col("pos_first") - F.col("pos_second"))
    met = a.join(b, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("cell") == F.col("c")))
    return met.where((near > 0) & (near <= within)).select("doc_id", "h", "pos_first", "pos_second")
