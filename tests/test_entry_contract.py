"""The driver contract: entry runs, every oracle has a query, and at sf0.001 the value-checked
queries agree with their DuckDB oracles (same comparison as tools/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from arrears.catalog import ORACLES, QUERIES, load_all
from arrears.sources.fixtures import DRIVER_TABLES
from tests.conftest import SF001
from tools.check_oracle import digest
from tools.check_types import norm_spark

load_all()  # the library's own queries; those of arrears.llm have their tests in tests/llm


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "collection_rate_7d" in df.columns


def test_oracles_cover_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 60


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF001)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(entry_mod.oracle_sql()[name])
    o_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    spark_types = {c: norm_spark(t) for c, t in df.dtypes}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert digest(df.columns, s_rows)[0] == digest(rel.columns, o_rows)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert entry_mod.queries()[name](spark, SF001).count() >= 0
