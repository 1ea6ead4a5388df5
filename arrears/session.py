"""Session helpers: a local session for tests/bench and checkpoint-dir handling.

Library functions never create a session themselves; they take the caller's.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package expects. Timestamps are TIMESTAMP_NTZ end to end,
# so the zone only matters for any LTZ value a caller brings in; UTC keeps it neutral.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "arrears") -> SparkSession:
    """A local session for tests and the bench (the UI stays off: no extra port)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. A private
    temporary folder is chosen only when nothing is configured (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            # a machine-local folder is not reachable by other executors: refuse instead of guessing
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="arrears-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume (e.g. 100 TB on 1000 executors).

    * ``spark.sql.shuffle.partitions``: enough that an average shuffle partition stays near
      ``target_partition_bytes`` (AQE then coalesces small ones and splits skewed ones), and at least
      two tasks per core;
    * ``spark.sql.files.maxPartitionBytes``: scan splits of the same size;
    * AQE with skew-join handling and the same advisory size;
    * cleanup of reliable checkpoints that are no longer referenced.

    ``spark.checkpoint.dir`` is not set here: it must name a folder shared by the cluster.
    """
    cores = max(1, executors * cores_per_executor)
    shuffle_parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.session.timeZone": "UTC",
        # the ordered metrics checkpoint their ranked slices; drop the files once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
