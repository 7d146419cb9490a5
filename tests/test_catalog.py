"""Each query of the catalog against its SQL."""

import duckdb
import pytest

from notelake.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings events conversations pages region benchmark labels".split()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    sql = catalog.oracle_sql().get(name)
    assert sql, "each query has its SQL"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    norm = lambda rs: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rs)
    assert norm(rows) == norm(want)


def test_conflicts_read_every_turn(spark):
    turns = spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn").collect()
    want = {(c, t, u) for c, t in turns for d, u in turns if c == d and t < u and (t + u) % 2}
    got = {(r["a"] // 1_000_000, r["a"] % 1_000_000, r["b"] % 1_000_000) for r in catalog.queries()["conflicts_all_turns"](spark, DIR).collect()}
    assert got == want and any(u > 1 for _, _, u in got)
