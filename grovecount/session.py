"""Session helpers.

The library never builds its own session inside an operator; jobs and tests
call :func:`build_session` (or bring their own) and pass the session in.
"""

from __future__ import annotations

import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job wants regardless of data size.  The shuffle partition count is
# left to the caller and the cluster's configuration (AQE coalesces small ones).
BASE_CONF = {
    # Broadcast only what was measured: plan-time size estimates of generated
    # tables (pixel rows exploded from a few rows) and of checkpointed rounds
    # are far too small (a 2.7 M-row pixel table is estimated at 11 KB), so
    # estimate-based broadcast is off; adaptive execution still turns a join
    # into a broadcast when a side's measured shuffle output is under 10 MB.
    # Explicit broadcasts of size-checked tables (Hough offsets) are unaffected.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches into Python (image bytes, candidates) are bounded in bytes
    # as well as rows, so a batch of large images cannot exhaust a worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # checkpoint files of unreachable round tables are removed by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "grovecount",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the rules above.  What is not given here stays as
    spark-submit or spark-defaults set it; without any master it is local."""
    master = master or SparkConf().get("spark.master", None) or "local[*]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if _in_one_process(master):
        # local mode: every task runs in the driver JVM (only applies to a new JVM)
        conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _in_one_process(master: str) -> bool:
    """local, local[4], ...; local-cluster has executors of its own."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS, S3,
    ...); a machine-local temp folder is only acceptable in local mode.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _in_one_process(sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster"
            )
        configured = tempfile.mkdtemp(prefix="grovecount-ckpt-")
    sc.setCheckpointDir(configured)
    return configured
