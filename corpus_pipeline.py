"""A corpus pipeline: rejects poor documents, keeps one of near copies, drops contaminated ones, hides personal data, and packs the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import decontam, packing, pii, quality, sigtree
from notelake.llm.common import Scratch, small, table
from notelake.llm.queries import tokenizer

COPIES = 2_000_000  # keys, a number each, up to this number are broadcast to drop copies; beyond it they are joined


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, key) of docs, row holding all their columns, whatever their names, and (key, id, h) of the texts whose id is null or has other
    texts too: those have a key of their own, below all ids; all else has its id. Rows of one id and one text are one document and share a key."""
    scratch = Scratch(docs.sparkSession, "keys")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("id", F.col("row.doc_id").cast("long")).withColumn("h", F.xxhash64("row.text"))
    texts = rows.select("id", "h").distinct()
    odd = texts.join(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("i")), F.col("id").eqNullSafe(F.col("i")), "left_semi")
    odd = scratch.save(odd, "odd")
    if odd.isEmpty():
        return rows.select("row", F.col("id").alias("key")), odd.select(F.lit(0).cast("long").alias("key"), "id", "h")
    least = min(0, rows.agg(F.min("id")).first()[0] or 0)
    odd = scratch.save(odd.select((F.lit(least) - 1 - F.monotonically_increasing_id()).alias("key"), "id", "h"), "keys")
    rows = rows.join(odd.select(F.col("key").alias("own"), F.col("id").alias("i"), F.col("h").alias("g")), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    return rows.select("row", F.coalesce("own", "id").alias("key")), odd


def by_key(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those that have a label, doesn't reject. A label of an id holds for each of its texts.

    Every row is judged by its own text, those of null and reused ids too; a null text has the features of no text.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; one without an id only if none has one.

    Texts that share an id are documents of their own; of rows that repeat an id and a text one stays. Null, empty and wordless texts are
    copies of nothing and stay. An empty table gives none.
    """
    rows, odd = keyed(docs)
    scratch = Scratch(spark, "copies")
    found = sigtree.similar_documents(by_key(rows)).select(F.col("doc_id").alias("key"), "component_id")
    found = scratch.save(found.groupBy("key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("many")).join(odd, "key", "left"), "found")
    id = F.when(F.col("h").isNull(), F.col("key")).otherwise(F.col("id"))
    kept = found.groupBy("component_id").agg(F.min_by("key", F.struct(id.isNull(), id, "h")).alias("key"))
    gone = scratch.save(found.join(kept.select("key"), "key", "left_anti").select("key"), "gone")
    again = scratch.save(found.where("many > 1").join(gone, "key", "left_anti").select("key"), "again")  # rows that repeat an id and a text
    gone, again = small(gone, COPIES), small(again, COPIES)  # so that the texts that stay aren't shuffled
    rows = rows.join(gone, "key", "left_anti")
    once = rows.join(again, "key", "left_anti")
    return once.unionByName(rows.join(again, "key", "left_semi").dropDuplicates(["key"])).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate, each row by its own text; null and empty texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind; rows of null and reused ids by their own texts, null texts as they are."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, in sequences of 2048 tokens; repeated rows are packed each, null and empty texts as one token."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model, a tokenizer and components of links can't be written in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before has written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
