"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", app: str = "rewardlake",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench.

    On a cluster the session comes from ``spark-submit`` and this function is
    not used; everything in the library only reads settings from the session
    it is handed.
    """
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there and we use it
    as is.  Only when it is unset on a local master -- tests -- do we create
    one; anywhere else executors would not see it, so that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="rewardlake-ckpt-")
        try:  # core settings cannot always be changed at run time; the context's dir is enough
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (never a machine-local tmp
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cluster_conf(input_bytes: int, executor_cores: int, executors: int,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings to submit a job with at cluster scale (e.g. 100 TB input on
    1000 executors).  The library itself never sets them; it reads the
    session it is given.

    * scan splits of ``target_partition_bytes`` (so a task holds a bounded
      slice of the input, whatever the table size)
    * initial shuffle partitions so that a shuffle of the whole input gives
      partitions of about that size, at least 3 waves of the cluster's cores
      and at most 100,000;
      AQE then coalesces small ones and splits skewed ones (a key holding a
      third of the rows in a join is split into target-size pieces)
    * automatic broadcast capped at 64 MB of estimated size
    """
    cores = max(1, executor_cores * executors)
    # capped: mapper x reducer block counts grow with the product, and AQE
    # splits the few oversized partitions anyway
    parts = min(max(3 * cores, -(-input_bytes // target_partition_bytes)), 100_000)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
