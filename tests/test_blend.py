"""Blending against sorting everything that a query could be shown."""

import random

from pyspark.sql import functions as F

from notelake.operators import retrieval

WORDS = {"a": [(r"\balpha\b", True)], "b": [(r"\bbeta\b", True)], "c": [(r"\bgamma\b", True)]}
TOPIC_OF = {"alpha": "a", "beta": "b", "gamma": "c"}


def by_hand(queries, notes, semantic, tools, floor, max_hits, w):
    out = {}
    for qid, prompt in queries:
        asked = [TOPIC_OF[x] for x in prompt.split() if x in TOPIC_OF]
        sims = {i: s for q, i, s in semantic if q == qid and s >= floor}
        rows = {}
        for id, topics, kind, age, ord_ in notes:
            met = [t for t in dict.fromkeys(topics) if t in asked]
            if sims and (id in sims or met):
                score = sims.get(id, 0.0) + (w.topic_boost if met else 0.0) + w.type_weight * {"feedback": 1.0, "project": 0.5, "reference": 0.25}.get(kind, 0.0) + w.recency * 0.5 ** (max(0.0, age) / w.half_life_days)
                rows.setdefault(id, []).append((score, (0, ord_), "confidence" if id in sims else "topic"))
            elif not sims and met:
                rows.setdefault(id, []).append((1.0, (0, ord_), "topic"))
        for q, id in tools:
            if q == qid:
                ord_ = next(n[4] for n in notes if n[0] == id)
                rows.setdefault(id, []).append((1.0, (1, ord_), "tool"))
        ranked = []
        for id, some in rows.items():
            best = min(some, key=lambda r: (-r[0], r[1]))
            ranked.append((0 if any(g == "tool" for _, _, g in some) else 1, -round(best[0], 9), min(s for _, s, _ in some), id, best[2]))
        out[qid] = [(id, gate) for _, _, _, id, gate in sorted(ranked)[:max_hits]]
    return {q: hits for q, hits in out.items() if hits}


def test_blend_of_large_topics(spark):
    rng = random.Random(9)
    notes = [(i, rng.sample(["a", "b", "c", "d"], rng.randint(0, 3)), rng.choice(["feedback", "project", "reference", "user"]), rng.choice([0.0, 0.0, 5.0, 40.0, -3.0]), (i * 37) % 400) for i in range(400)]
    queries = [(q, " ".join(rng.sample(["alpha", "beta", "gamma", "no", "words"], rng.randint(1, 4)))) for q in range(25)]
    semantic = [(q, i, rng.choice([0.3, 0.6, 0.7, 0.9])) for q in range(0, 25, 2) for i in rng.sample(range(400), 6)]
    tools = [(q, i) for q in range(25) for i in rng.sample(range(400), 2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for max_hits, given in ((3, tools), (7, [])):
        hits = frame([(*t, "tool", 1.0, "tool match: x") for t in given], "qid long, id long, gate string, score double, reason string") if given else None
        got = retrieval.blend(
            frame(queries, "qid long, prompt string"), frame(notes, "id long, topics array<string>, type string, age_days double, load_ord long"), frame(semantic, "qid long, id long, sim01 double"), 0.5, max_hits, tools=hits, vocabulary=WORDS,
        )
        found = {}
        for r in sorted(got.collect(), key=lambda r: (r["qid"], r["rank"])):
            found.setdefault(r["qid"], []).append((r["id"], r["gate"]))
        assert found == by_hand(queries, notes, semantic, given, 0.5, max_hits, retrieval.Weights())
        both = got.where("gate = 'confidence' and reason like '%; topic match: %'")
        assert both.count() and got.where(F.col("gate") == "topic").count()
