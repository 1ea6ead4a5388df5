"""Compare the column types of each query's Spark result with its DuckDB oracle's result types."""

from __future__ import annotations

import sys

import duckdb

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from arrears.catalog import ORACLES, QUERIES, load_all  # noqa: E402
from arrears.session import local_session  # noqa: E402
from arrears.sources.fixtures import DRIVER_TABLES  # noqa: E402

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT",
}


def norm_spark(t: str) -> str:
    if t.startswith("decimal"):
        return t.upper()
    return SPARK_TO_DUCK.get(t, t)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    spark = local_session(4)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in sorted(ORACLES):
        s = {c: norm_spark(t) for c, t in QUERIES[name](spark, sf_dir).dtypes}
        rel = con.sql(ORACLES[name])
        o = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (s.get(c), o.get(c)) for c in set(s) | set(o) if s.get(c) != o.get(c)}
        if diff:
            bad += 1
            print(f"{name}: {diff}")
    print(f"{bad} queries with type differences")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
