"""File sources and views.

The reference bulk-loads header CSVs into declared tables and, on the Python side, reads CSVs with
inferred types and re-types the date columns. Both are plain DataFrame readers here; nothing is
collected. Malformed typed input fails fast instead of turning into silent NULLs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType, StringType, StructField, StructType

from arrears import schemas
from arrears.session import ensure_checkpoint_dir

TIMESTAMP_FORMAT = "yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the session's shared checkpoint folder; what is written there goes when the session ends."""
    path = f"{ensure_checkpoint_dir(spark)}/arrears-files/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def _declared(schema: StructType | str) -> StructType:
    return schemas.BY_NAME[schema] if isinstance(schema, str) else schema


def scan_typed_csv(spark: SparkSession, path: str, schema: StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """Header CSV read with a declared schema (a StructType or the name of an input in
    :data:`arrears.schemas.BY_NAME`)."""
    return (
        spark.read.schema(_declared(schema))
        .option("header", True)
        .option("mode", mode)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def scan_csv_with_rejects(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """S1 for dirty files: the rows that fit the declared schema, and the others with what could be read of
    them and the whole line as ``record``.

    A row is rejected for a bad value in any column, whichever columns are read later: Spark converts only the
    columns that a query needs, so both results ask for all of them (by a condition that always holds).
    """
    declared = _declared(schema)
    record = "_record"
    rows = (
        spark.read.schema(StructType([*declared.fields, StructField(record, StringType())]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", record)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
    rows = rows.where(F.xxhash64(*declared.names) >= F.lit(-(1 << 63)))
    rejected = rows.where(F.col(record).isNotNull()).withColumnRenamed(record, "record")
    return rows.where(F.col(record).isNull()).drop(record), rejected


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas' NaN is a missing value; Spark keeps NaN distinct from NULL — map it to NULL."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.when(F.isnan(F.col(f.name)), None).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def scan_inferred_csv(spark: SparkSession, path: str, datetime_cols: Sequence[str] = ()) -> DataFrame:
    """Header CSV with inferred types, then the named columns parsed as TIMESTAMP_NTZ (F6:
    an unparsable value raises under ANSI mode, like ``pd.to_datetime``). Whole numbers are BIGINT and
    others DOUBLE whatever their size, so the types do not depend on the values."""
    df = spark.read.option("header", True).option("inferSchema", True).option("preferDate", False).csv(path)

    def column(f: StructField):
        if f.name in datetime_cols:
            return F.to_timestamp_ntz(F.col(f.name).cast("string")).alias(f.name)
        if isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)

    return nan_to_null(df.select(*[column(f) for f in df.schema.fields]))


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: a parquet table (column pruning and filter pushdown reach the scan)."""
    return spark.read.parquet(path)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Publish a mart as a temporary view for SQL users; returns the frame unchanged."""
    df.createOrReplaceTempView(name)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV in the layout :func:`scan_typed_csv` reads (used for round trips)."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
