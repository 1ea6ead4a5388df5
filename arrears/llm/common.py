"""Shared helpers: tables in the cluster's shared folder, Arrow text views, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.session import ensure_checkpoint_dir

# Text bytes that one vectorised step of a Python task looks at (a longer single text goes alone).
STEP_BYTES = 1 << 19
ARROW_ROWS = 1000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the executors' Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="arrears-package-"), "arrears.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """While a job runs, its Python tasks get at most ``rows`` rows at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stash(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and return the table.

    Cuts the lineage: a lost executor costs only the re-read of its part. The folder is removed
    when the session's JVM ends. While the job runs, Python tasks get at most ``rows`` rows at a
    time, so that long texts do not add up.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{ensure_checkpoint_dir(spark)}/arrears-llm/{uuid.uuid4().hex}"
    with arrow_batches(spark, rows):
        df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory back to the system (a reused Python worker would keep it)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def releasing(function: Callable[..., pa.Table], sides: int = 1) -> Callable[..., pa.Table]:
    """``function`` of one group's rows (or of two sides'), whose memory goes back to the system after each group."""
    def one(rows: pa.Table) -> pa.Table:
        try:
            return function(rows)
        finally:  # what the function held is free by now
            release_memory()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            release_memory()

    return one if sides == 1 else two


def hash_sample(df: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """At most ``n`` rows of each value of ``by``, the first by a hash of ``key``; adds place and total.

    Rows of the commonest values (the 1000 largest counts reach the driver) are first cut by hash at
    twice the wanted share, so no text is shuffled for a value just because it is common.
    """
    common = df.groupBy(by).agg(F.count("*").alias("total")).orderBy(F.desc("total"), by).limit(1000).collect()
    pairs = [F.lit(x) for r in common if r[by] is not None for x in (r[by], r["total"])]
    total = F.create_map(*pairs)[F.col(by)] if pairs else F.lit(None).cast("long")
    hashed = F.xxhash64(key, F.lit(17))
    share = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    cut = df.withColumn("total", total).where(F.coalesce(share < F.lit(2.0 * n + 64) / F.col("total"), F.lit(True)))
    order = Window.partitionBy(by).orderBy(hashed, key)
    return cut.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def text_views(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """UTF-8 bytes of a string column in steps: (first row, bytes, offsets of the step's rows).

    Null texts are empty. ``offsets`` has one entry more than the step has rows.
    """
    for begin in range(0, len(column), 1000):  # converted in slices: no second copy of the whole column
        part = column.slice(begin, 1000)
        part = pa.concat_arrays(part.chunks) if isinstance(part, pa.ChunkedArray) else part
        part = part.cast(pa.large_string()).fill_null("")
        n = len(part)
        _, raw_offsets, raw = part.buffers()
        offsets = np.frombuffer(raw_offsets, np.int64, n + 1, part.offset * 8)
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            last = int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1
            last = min(n, max(last, row + 1))
            yield begin + row, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
            row = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(32))  # a new array; the other steps change it in place
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each of ``n`` nodes' component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while True:
            deeper = new[new]
            if np.array_equal(deeper, new):
                break
            new = deeper
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component) per node of a link.

    ``component`` is the smallest node of the component. Alternating large-star and small-star
    rounds; every round is one job that writes its edges to the shared folder.
    """
    def distinct(df):
        return df.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")

    current = stash(distinct(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))

    def state(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = state(current)
    while before[0]:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = distinct(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stash(distinct(small.unionAll(low.select("u", F.col("m").alias("v")))))
        after = state(current)
        if after == before:
            break
        before = after
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionAll(roots)
