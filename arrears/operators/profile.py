"""Data-quality profiles: shapes, non-null counts, missing tables, distinct counts, value counts,
ranges, duplicates and orphans (S4-S6, A14-A24, J8, P10).

Every profile is one aggregation pass over the table (all columns in the same ``agg``), turned
into rows with ``stack`` on the one-row result. Nothing is collected except schema metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def _stack(one_row: DataFrame, names: Sequence[str], value_cols: Sequence[str], out_cols: Sequence[str]) -> DataFrame:
    """Turn ``one_row`` (columns ``{value}__{name}``) into one row per name."""
    parts = []
    for n in names:
        parts.append(f"'{n}'")
        parts.extend(f"`{v}__{n}`" for v in value_cols)
    expr = f"stack({len(names)}, {', '.join(parts)}) as ({', '.join(out_cols)})"
    return one_row.selectExpr(expr)


def preview_rows(df: DataFrame, order: Sequence[str], n: int = 5, tail: bool = False) -> DataFrame:
    """First (or last) ``n`` rows in an explicit order (``head``/``tail`` made deterministic)."""
    cols = [F.col(c).desc() if tail else F.col(c).asc() for c in order]
    return df.orderBy(*cols).limit(n)


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def profile_columns(df: DataFrame) -> DataFrame:
    """S5 (``info``): per column its position, type and non-NULL count."""
    fields = df.schema.fields
    one = df.agg(*[F.count(F.col(f.name)).alias(f"nn__{i}") for i, f in enumerate(fields)])
    parts = []
    for i, f in enumerate(fields):
        parts += [str(i), f"'{f.name}'", f"'{f.dataType.simpleString()}'", f"`nn__{i}`"]
    return one.selectExpr(
        f"stack({len(fields)}, {', '.join(parts)}) as (position, column_name, data_type, non_null)"
    )


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with NULLs — count and share of rows."""
    cols = df.columns
    one = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"miss__{c}") for c in cols],
        *[F.round(F.count_if(F.col(c).isNull()) / F.count(F.lit(1)), 6).alias(f"share__{c}") for c in cols],
    )
    stacked = _stack(one, cols, ["miss", "share"], ["column_name", "missing", "missing_share"])
    return stacked.where(F.col("missing") > 0).select(
        "column_name", F.col("missing").cast("bigint").alias("missing"), "missing_share"
    )


def nunique_per_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column (``approximate`` uses HyperLogLog++)."""
    cols = df.columns
    agg = F.approx_count_distinct if approximate else F.countDistinct
    one = df.agg(*[agg(F.col(c)).alias(f"nu__{c}") for c in cols])
    return _stack(one, cols, ["nu"], ["column_name", "n_unique"])


def category_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Rows per value with NULL as its own category, most frequent first."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))
    out = out.orderBy(F.col("cnt").desc(), F.col(col).asc_nulls_last())
    return out.limit(top) if top else out


def flag_value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts of several columns side by side (value × column)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.explode(pairs).alias("kv")).select("kv.col", "kv.value")
    return long.groupBy("value").pivot("col", list(cols)).agg(F.count(F.lit(1)))


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min and max of each column, one row per column (values rendered as strings)."""
    one = df.agg(
        *[F.min(c).cast("string").alias(f"lo__{c}") for c in cols], *[F.max(c).cast("string").alias(f"hi__{c}") for c in cols]
    )
    return _stack(one, cols, ["lo", "hi"], ["column_name", "min_value", "max_value"])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys occurring more than once (``HAVING count(*) > 1``)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


def distinct_vs_rows(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys vs rows."""
    return df.agg(F.countDistinct(key).alias("n_unique"), F.count(F.lit(1)).alias("n_rows"))


def orphan_count(child: DataFrame, parent: DataFrame, key: str, child_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose key has no ``parent`` row (anti join), counted.

    Child rows are counted per key before the join, so a hot key is one row there."""
    ck = child_key or key
    per_key = child.groupBy(ck).agg(F.count(F.lit(1)).alias("_n"))
    missing = per_key.join(parent.select(F.col(key).alias(ck)), ck, "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("orphans"))


def split_by_dtype(df: DataFrame) -> tuple[list[str], list[str]]:
    """P10: numeric and string column names, from the schema."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return num, cat
