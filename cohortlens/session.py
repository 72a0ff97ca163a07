"""SparkSession settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from measured stage
# sizes (sort-merge -> broadcast when a side turns out small), coalesces
# small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # A CSV row with the wrong number of fields is only detected when the
    # whole row is tokenised; imports must see every malformed row.
    "spark.sql.csv.parser.columnPruning.enabled": "false",
}


def build_session(master: str | None = None, app: str = "cohortlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster leave ``master`` unset so spark-submit decides; size
    ``shuffle_partitions`` to roughly input_bytes / 128 MB there.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(total_cores: int, input_bytes: int, partition_bytes: int | None = None) -> dict[str, str]:
    """Shuffle and scan sizing from the input size and the core count.

    Scan splits: about three tasks per core, between 1 MB and 128 MB per
    split (at terabyte scale the 128 MB cap applies and each task's memory
    stays bounded). Shuffle partitions: one split's worth of data each,
    between three and ten waves of the cores; AQE coalesces small ones at
    run time."""
    if partition_bytes is None:
        partition_bytes = min(128 << 20, max(1 << 20, input_bytes // max(1, 3 * total_cores)))
    by_size = -(-input_bytes // partition_bytes)
    # Map tasks x reduce partitions is the shuffle block count: cap the
    # reduce side at ten waves (shuffled data is smaller than the input
    # after pruning and partial aggregation; AQE coalesces further).
    shuffle = max(3 * total_cores, min(by_size, 10 * total_cores))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.files.openCostInBytes": str(min(4 << 20, partition_bytes)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(max(partition_bytes, 16 << 20)),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(max(4 * partition_bytes, 64 << 20)),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read ``spark.checkpoint.dir`` from the session (a cluster names a
    shared, fault-tolerant folder there). Only where it is unset and the
    master is local -- tests -- make a private folder under the system temp
    dir and record it; on a cluster executors would not see it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(
        spark.sparkContext.applicationId)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        _LOCAL_DIRS[spark.sparkContext.applicationId] = d
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_LOCAL_DIRS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}{name}"
