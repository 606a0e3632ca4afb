"""Session helpers for tests, benchmarks and command-line runs.

Library code never creates a session; callers pass one in.  ``get_session``
builds a local one with the settings the analyses are tuned for, and
``ensure_checkpoint_dir`` only fills in ``spark.checkpoint.dir`` when the
cluster has not named one (on a cluster it must be a shared folder).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

ENGINE_CONF = {
    # runtime re-planning: partition coalescing, skew split, and conversion
    # of shuffle joins to broadcast joins once a side's real size is known
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names (``spark.checkpoint.dir``).

    Only a local-mode session without one (tests, benchmarks) gets a fresh
    temporary folder; on a cluster a machine-local folder would be lost with
    its executor, so a missing setting is an error there."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's configuration applies
        if not conf_dir:
            raise RuntimeError("set spark.checkpoint.dir on the server to a shared folder")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(e.g. on HDFS or an object store)")
        conf_dir = tempfile.mkdtemp(prefix="salesdeck-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def get_session(cores: int | str = "*", shuffle_partitions: int = 8,
                app: str = "salesdeck", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SALESDECK_DRIVER_MEM", "16g"))
    )
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Shuffle blocks (map tasks x reducers) of one exchange that the cluster's
#: shuffle service is asked to index at most.
MOST_BLOCKS = 2_000_000_000


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
                 shuffled_share: float = 0.2) -> dict[str, str]:
    """Settings sized to the data, for a cluster run (pass to ``SparkSession.builder``).

    The widest shuffle of every analysis carries at most the projected line
    table (order key, product key, quantity, price: ~32 bytes of a line of
    ~160), ``shuffled_share`` of the input; the number of reducers follows
    from those bytes, not from the input.  Scan splits grow until map tasks
    times reducers stay within ``MOST_BLOCKS``.  AQE coalesces per stage at
    run time, and splits partitions over 4x the median and 1 GB.
    """
    parts = max(2 * total_cores, int(input_bytes * shuffled_share) // target_partition_bytes)
    split = target_partition_bytes
    while split < 4 << 30 and -(-input_bytes // split) * parts > MOST_BLOCKS:
        split *= 2
    t = str(target_partition_bytes)
    return {
        **ENGINE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": t,
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(target_partition_bytes // 4),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    }
