"""The resolver's gates over topics and tools of many notes."""

import random
from functools import partial

from notelake.operators import retrieval

WORDS = {"a": [(r"\balpha\b", True)], "b": [(r"\bbeta\b", True)], "c": [(r"\bgamma\b", True)]}


def frames(spark, n, turns):
    rng = random.Random(7)
    note = lambda i: (i, rng.sample("abc", rng.randint(0, 3)), (rng.sample(["Bash", "Edit", "Read"], rng.randint(0, 2)), rng.choice([None, "git", r"gi\w", "["])), rng.randint(0, n))
    notes = spark.createDataFrame([note(i) for i in range(n)], "id long, topics array<string>, triggers struct<tools:array<string>,command_pattern:string>, load_ord long")
    notes = notes.withColumn("load_ord", notes["load_ord"] * 1000 + notes["id"])
    asked = [(q, " ".join(rng.sample(["alpha", "beta", "gamma", "no", "word"], 2)), rng.choice([None, "Bash", "Edit"]), rng.choice(["git push", "ls"])) for q in range(turns)]
    return spark.createDataFrame(asked, "qid long, prompt string, tool_name string, tool_command string"), notes


def test_no_more_notes_than_can_be_shown_meet_a_query(spark):
    queries, notes = frames(spark, 300, 40)
    topics = partial(retrieval.topic_gate, vocabulary=WORDS)
    # Gates without a bound, as any other gate is: they give every hit.
    plain = (lambda q, n: topics(q, n), lambda q, n: retrieval.tool_gate(q, n))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for k in (1, 4):
        for some, every in (((topics, retrieval.tool_gate), plain), ((retrieval.tool_gate,), plain[1:]), ((retrieval.tool_gate, topics), plain[::-1])):
            assert rows(retrieval.resolve(queries, notes, k, gates=some)) == rows(retrieval.resolve(queries, notes, k, gates=every))
        assert topics(queries, notes, most=k).count() <= 40 * 3 * 3 * k < topics(queries, notes).count() or k > 1
        assert retrieval.tool_gate(queries, notes, most=k).count() <= 40 * (3 + 3) * k
    assert retrieval.tool_gate(queries, notes).count() > 40 * 6 * 4
