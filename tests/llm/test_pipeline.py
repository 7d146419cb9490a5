"""The pipeline's stages on small tables."""

import corpus_pipeline
import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    from notelake.llm import decontam, pii, quality, sigtree
    from notelake.llm.common import Scratch, table

    scratch, docs = Scratch(spark, "t"), table(spark, DIR, "documents")
    cols, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, DIR), name)
        assert docs.columns == cols
        counts.append(docs.count())
        if name == "quality_classifier":
            good = quality.score_documents(before, table(spark, DIR, "labels")).where("predicted = 1").count()
            assert counts[-1] == good
        if name == "ngram_jaccard_join":
            assert counts[-1] == sigtree.similar_documents(before).select("component_id").distinct().count()
        if name == "decontamination":
            assert decontam.contamination(docs, table(spark, DIR, "benchmark")).where("contaminated").count() == 0
        if name == "personal_data":
            assert pii.personal_data(docs).where("spans <> ''").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_null_and_reused_ids(spark):
    from notelake.llm.common import table

    docs = table(spark, DIR, "documents").select("doc_id", "text")
    good = [r["text"] for r in corpus_pipeline.quality_classifier(spark, docs, DIR).collect()]
    clean = "a clean text of some words that nothing else here resembles in any way at all".split()
    item = next(r["text"] for r in table(spark, DIR, "benchmark").collect() if len(r["text"].split()) > 20)
    text = lambda w: " ".join(f"{w}{x}" for x in clean)
    rows = [(None, good[0]), (None, good[1])] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.quality_classifier(spark, spark.createDataFrame(rows, docs.schema), DIR).collect()
    assert {r["text"] for r in kept if r["doc_id"] is None} == set(good[:2])
    rows = [(None, text("a")), (7, text("b")), (7, text("c")), (3, text("d")), (None, text("d")), (5, text("e")), (5, text("e")), (5, text("a"))]
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, docs.schema), DIR).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(7, text("b")), (7, text("c")), (3, text("d")), (5, text("e")), (5, text("a"))])
    rows = [(None, item), (None, text("a")), (7, item), (7, text("b"))]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, docs.schema), DIR).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(None, text("a")), (7, text("b"))}


def test_odd_tables(spark):
    """Nulls, empty texts, repeats and other columns with names that the stages use; and tables without rows."""
    schema = "doc_id long, text string, row string, key long, h long, id int, component_id int, n_chars int"
    words = "plain clean words that make up one more short text of this little corpus and nothing else".split()
    rows = [(i, " ".join(f"{w}{i}" for w in words), "r", 1, 2, 3, 4, 5) for i in range(6)]
    rows += [(7, None, None, None, None, None, None, None), (8, "", "r", 1, 2, 3, 4, 5), (None, rows[0][1], "x", 1, 2, 3, 4, 5), rows[1], (9, "mail me at a1@b2.org", "r", 1, 2, 3, 4, 5)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, DIR).count() == 0
        got = stage(spark, docs, DIR)
        assert got.columns == docs.columns
        got = sorted(map(tuple, got.collect()), key=str)
        if name == "ngram_jaccard_join":
            assert got == sorted([r for r in rows[:8] + rows[10:]], key=str)
        if name == "decontamination":
            assert got == sorted(rows, key=str)
        if name == "personal_data":
            assert got == sorted([*rows[:10], (9, "mail me at [EMAIL]", "r", 1, 2, 3, 4, 18)], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, none, DIR).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert len(packed) == len(rows) and sum(r["length"] for r in packed if r["doc_id"] in (7, 8)) == 2
