"""Reports with several parts parse their notes once, whatever the number of parts."""

from notelake.operators import hygiene
from notelake.plans import corpora

DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drift_parses_notes_and_links_once(spark):
    plan = plan_of(corpora.drift(spark, DIR))
    assert "EvalPython" not in plan and "arrays_zip" not in plan


def test_exact_members_hash_texts_once(spark):
    rows = [(1, "A  b"), (2, "a b "), (3, ""), (4, None), (5, " "), (6, "c"), (7, None), (8, "\ta\nB")]
    out = hygiene.exact_duplicate_members(spark.createDataFrame(rows, "id long, body string"))
    assert sorted((r["id"], r["n"], r["first"]) for r in out.collect()) == [(1, 3, 1), (2, 3, 1), (8, 3, 1)]
    assert "sha2" not in plan_of(out)
