"""Sinks for per-batch window counts (K-1 text files, K-2 additive totals).

Both are written from ``foreachBatch`` and keyed by the micro-batch id, so a
batch replayed after a failure overwrites its own output instead of adding
to it a second time (effectively once; the original re-adds on replay).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecount.functions.text import render_pair
from grovecount.operators.counts import totals_from_ledger

# Fixed value: name of the rolling text output (the original's part prefix).
TEXT_FOLDER = "monitoring-data"
LEDGER_FOLDER = "ledger"
COMPACT_FOLDER = "ledger-compacted"
LEDGER_SCHEMA = "window_start timestamp, feature string, n bigint, batch_id bigint"


def write_text_rows(counts: DataFrame, output: str, batch_id: int) -> None:
    """K-1: ``(feature,count)`` lines, one folder per micro-batch.

    Written with the counts' own partitioning (AQE has already coalesced
    small shuffle partitions): the number of distinct features in a batch is
    not bounded, so the rows are never funnelled into one task.
    """
    path = os.path.join(output, TEXT_FOLDER, f"batch_id={batch_id}")
    counts.select(render_pair("feature", "n").alias("value")).write.mode("overwrite").text(path)


def write_ledger(counts: DataFrame, output: str, batch_id: int) -> None:
    """K-2 (portable form): append this batch's rows to the ledger.

    ``partitionOverwriteMode=dynamic`` replaces only this batch's partition,
    so a replay rewrites the same rows.
    """
    path = os.path.join(output, LEDGER_FOLDER)
    rows = counts.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), "window_start", "feature", F.col("n").cast("bigint")
    )
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def read_batch(spark: SparkSession, output: str, batch_id: int) -> DataFrame | None:
    """The rows one micro-batch committed, from its own partition only (the
    ledger is not listed); None if it committed none."""
    path = os.path.join(output, LEDGER_FOLDER, f"batch_id={batch_id}")
    if not _exists(spark, path):
        return None
    return spark.read.schema("window_start timestamp, feature string, n bigint").parquet(path)


def _snapshots(spark: SparkSession, output: str) -> list[int]:
    """Batch ids up to which complete compacted ledgers exist."""
    fs, p = _folder(spark, os.path.join(output, COMPACT_FOLDER))
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith("upto=") and _exists(spark, os.path.join(output, COMPACT_FOLDER, n, "_SUCCESS"))]
    return sorted(int(n.removeprefix("upto=")) for n in done)


def read_ledger(spark: SparkSession, output: str) -> DataFrame:
    """Committed ledger rows: those of the latest compacted ledger (one row per
    window and feature) and of the batches after it.  Explicit schema: a ledger
    of empty batches is still readable."""
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(os.path.join(output, LEDGER_FOLDER))
    snapshots = _snapshots(spark, output)
    if not snapshots:
        return rows
    upto = snapshots[-1]
    old = spark.read.schema(LEDGER_SCHEMA).parquet(os.path.join(output, COMPACT_FOLDER, f"upto={upto}"))
    return old.unionByName(rows.where(F.col("batch_id") > upto))


def compact_ledger(spark: SparkSession, output: str, upto: int) -> None:
    """Fold the partitions of batches up to ``upto`` (finished ones, never the
    running batch) into one table, so that a long-lived stream's ledger does not
    grow by a folder per batch.

    The new table counts once its ``_SUCCESS`` file is there; only then are the
    old partitions and older tables deleted.  Readers skip partitions that the
    table covers, so a crash at any point loses and repeats nothing.
    """
    snapshots = _snapshots(spark, output)
    if (snapshots and snapshots[-1] >= upto) or not _exists(spark, os.path.join(output, LEDGER_FOLDER)):
        return
    folded = read_ledger(spark, output).where(F.col("batch_id") <= upto)
    folded = folded.groupBy("window_start", "feature").agg(F.sum("n").cast("bigint").alias("n"))
    path = os.path.join(output, COMPACT_FOLDER, f"upto={upto}")
    folded.withColumn("batch_id", F.lit(upto).cast("bigint")).write.mode("overwrite").parquet(path)
    for old in snapshots:
        fs, p = _folder(spark, os.path.join(output, COMPACT_FOLDER, f"upto={old}"))
        fs.delete(p, True)
    fs, ledger = _folder(spark, os.path.join(output, LEDGER_FOLDER))
    for s in fs.listStatus(ledger):
        name = s.getPath().getName()
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= upto:
            fs.delete(s.getPath(), True)


def drop_text_batches(spark: SparkSession, output: str, upto: int) -> None:
    """Delete the text folders of batches up to ``upto``; the ledger keeps their sums."""
    fs, folder = _folder(spark, os.path.join(output, TEXT_FOLDER))
    if not fs.exists(folder):
        return
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= upto:
            fs.delete(s.getPath(), True)


def read_totals(spark: SparkSession, output: str) -> DataFrame:
    """Running total per feature = sum over all committed ledger rows (O-31)."""
    return totals_from_ledger(read_ledger(spark, output))


def read_window_counts(spark: SparkSession, output: str) -> DataFrame:
    """One row per (window, feature), in either mode and window form, however
    many batches fell into the window."""
    return read_ledger(spark, output).groupBy("window_start", "feature").agg(F.sum("n").cast("bigint").alias("n"))


def read_text_rows(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.text(os.path.join(output, TEXT_FOLDER))


def merge_statements(totals: str, staging: str, batches: str) -> list[str]:
    """Portable statements that add a staged batch to the totals, to run in one
    transaction.  The first fails if the batch was added before (``batch_id`` is
    the key of ``batches``)."""
    return [
        f"INSERT INTO {batches} (batch_id) VALUES (?)",
        f"UPDATE {totals} SET n = n + (SELECT s.n FROM {staging} s WHERE s.feature = {totals}.feature) "
        f"WHERE feature IN (SELECT feature FROM {staging})",
        f"INSERT INTO {totals} (feature, n) SELECT s.feature, s.n FROM {staging} s "
        f"WHERE s.feature NOT IN (SELECT feature FROM {totals})",
    ]


def add_staged_batch(conn, batch_id: int, totals: str, staging: str, batches: str) -> bool:
    """Run the merge on a JDBC connection; False if the batch was there already."""
    conn.setAutoCommit(False)
    first, *rest = merge_statements(totals, staging, batches)
    try:
        known = conn.prepareStatement(f"SELECT batch_id FROM {batches} WHERE batch_id = ?")
        known.setLong(1, batch_id)
        if known.executeQuery().next():
            conn.rollback()
            return False
        mark = conn.prepareStatement(first)
        mark.setLong(1, batch_id)
        mark.executeUpdate()
        for sql in rest:
            conn.prepareStatement(sql).executeUpdate()
        conn.commit()
        return True
    except BaseException:
        conn.rollback()
        raise


def jdbc_totals_sink(
    url: str,
    properties: dict[str, str],
    totals: str = "totals",
    staging: str = "totals_staging",
    batches: str = "totals_batches",
) -> Callable[[DataFrame, int], None]:
    """K-2 relational form, for ``start_job(extra_sinks=(jdbc_totals_sink(...),))``.

    Expects ``totals(feature VARCHAR PRIMARY KEY, n BIGINT NOT NULL)`` and
    ``totals_batches(batch_id BIGINT PRIMARY KEY)``.  A batch's sums (one row per
    feature) are staged over JDBC, then added in one transaction together with
    the batch's id, so a replayed batch changes nothing.  The staging table
    belongs to this sink alone and is replaced by every batch.  Credentials come
    only from ``properties``; errors fail the batch.
    """

    def sink(counts: DataFrame, batch_id: int) -> None:
        delta = counts.groupBy("feature").agg(F.sum("n").cast("bigint").alias("n"))
        delta.write.mode("overwrite").option("truncate", "true").jdbc(url, staging, properties=properties)
        jvm = counts.sparkSession.sparkContext._jvm
        props = jvm.java.util.Properties()
        for k, v in properties.items():
            props.setProperty(k, v)
        conn = jvm.java.sql.DriverManager.getConnection(url, props)
        try:
            add_staged_batch(conn, batch_id, totals, staging, batches)
        finally:
            conn.close()

    return sink
