"""The contract queries that SQL can express, against their SQL in DuckDB (op11 and op12 have theirs beside their tests)."""

import duckdb
import pytest

from arrears.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_topk_search", "op3_embedding_dedup", "op7_jaccard_join"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    order = sorted(rel.columns)
    got = sorted(tuple(r[c] for c in order) for r in df.collect())
    want = sorted(tuple(dict(zip(rel.columns, r))[c] for c in order) for r in rel.fetchall())
    assert sorted(df.columns) == order and len(want) > 100 and got == want
