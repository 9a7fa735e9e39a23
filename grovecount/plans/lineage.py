"""Cutting lineage in iterative operators.

Loops (border graphs, components, acceptance rounds) write each round as
Parquet under the session's checkpoint folder (``spark.checkpoint.dir``, which
must be shared storage on a cluster) and read it again: a round survives lost
executors, and the next round's plan starts from a file scan.  A stored round
also forgets the size estimate of the plan it came from; its estimate is that
of its files.  (A ``checkpoint()`` keeps the old plan's estimate, and a join
multiplies the estimates of its sides, so in a loop of joins the number of
digits doubles every round.)  ``localCheckpoint`` is never used: it keeps the
rows on executors and loses them with the executor.

A long-running job wraps each unit of work (a micro-batch) in
``round_scope``; the rounds written inside it are deleted when it ends, so
the checkpoint folder does not grow with the life of the stream.

File sizes say little about row counts after decoding;
``guard_estimate_broadcast`` keeps sessions that broadcast by estimate from
broadcasting a stored round.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from grovecount.session import ensure_checkpoint_dir

_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("grovecount_rounds", default=None)


@contextlib.contextmanager
def round_scope(spark: SparkSession):
    """Delete the rounds written inside the block when it exits.

    Use it only around work whose results are fully written out inside the
    block (e.g. one micro-batch and its sinks).
    """
    files: list[str] = []
    token = _SCOPE.set(files)
    try:
        yield files
    finally:
        _SCOPE.reset(token)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for f in files:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(conf).delete(p, True)


def guard_estimate_broadcast(df: DataFrame) -> DataFrame:
    """Keep a session that broadcasts by plan-time estimate from broadcasting ``df``.

    Generated tables and checkpointed rounds carry size estimates far below
    their real size.  In a session with estimate-based broadcast on
    (``spark.sql.autoBroadcastJoinThreshold`` > 0) their joins are asked to
    sort-merge; under ``build_session``'s measured-only policy nothing is
    hinted and adaptive execution decides from real sizes.
    """
    # without a default of ours: where nothing is set, Spark's own (10 MB) holds
    threshold = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip()
    estimated = not threshold.startswith("-") and threshold not in ("0", "0b")
    return df.hint("merge") if estimated else df


class RoundTables:
    """Stores loop rounds as Parquet in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.number = 0
        files = _SCOPE.get()
        if files is not None:
            files.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Compute ``df`` once, store it in the checkpoint folder, return the stored rows."""
        path = f"{self.root}/{self.number}-{name}"
        self.number += 1
        df.write.parquet(path)
        return guard_estimate_broadcast(self.spark.read.schema(df.schema).parquet(path))

    def write_counted(self, df: DataFrame, name: str, counted: Column | None = None) -> tuple[DataFrame, int]:
        """``write`` plus the row count (of the rows where ``counted`` holds),
        observed inside the same job (loops use it as their stop test instead of
        running a separate ``isEmpty`` job)."""
        obs = Observation()
        rows = F.count(F.lit(1)) if counted is None else F.count_if(counted)
        stored = self.write(df.observe(obs, rows.alias("rows")), name)
        return stored, int(obs.get["rows"])
