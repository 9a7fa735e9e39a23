"""T-7: throughput and latency of a running query as a DataFrame.

Built from the query's own progress reports (what the engine measured per
micro-batch), not from a metrics server.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS_SCHEMA = (
    "batch_id long, timestamp string, num_input_rows long, input_rows_per_second double, "
    "processed_rows_per_second double, trigger_ms long, batch_ms long, "
    "latency_p50_ms long, latency_p95_ms long, latency_p99_ms long, latency_max_ms long"
)

# Name of the observation that a job's batches carry.
ARRIVAL = "arrival"
# Ranks are right to 1 / RANKS.  Every task sends its sketch to the driver, a few
# kilobytes at this setting, whatever the number of rows.
RANKS = 200


def arrival_metrics(arrived: str) -> list[Column]:
    """Metrics for ``observe``: when a batch's rows had arrived, as a mergeable
    quantile sketch (each task one sketch, no row kept).  Rows commit together,
    so the latest 5 % to arrive are the 5 % with the shortest delay."""
    ms = F.unix_millis(arrived)
    return [
        F.percentile_approx(ms, [0.5, 0.05, 0.01], RANKS).alias("at"),
        F.min(ms).alias("first"),
    ]


def _latencies(d: dict, trigger_ms: int) -> tuple:
    """Milliseconds from a row's arrival to its batch's end: p50, p95, p99, max."""
    seen = (d.get("observedMetrics") or {}).get(ARRIVAL) or {}
    seen = seen if isinstance(seen, dict) else seen.asDict()
    at, first = seen.get("at"), seen.get("first")
    if not at or first is None:
        return (None,) * 4
    start = datetime.fromisoformat(d["timestamp"].replace("Z", "+00:00")).timestamp() * 1000
    end = int(start) + trigger_ms
    return tuple(max(0, end - int(t)) for t in (*at, first))


def _row(p) -> tuple:
    d = p if isinstance(p, dict) else json.loads(p.json)
    dur = d.get("durationMs", {}) or {}
    return (
        int(d.get("batchId", -1)),
        d.get("timestamp"),
        int(d.get("numInputRows", 0) or 0),
        float(d.get("inputRowsPerSecond", 0.0) or 0.0),
        float(d.get("processedRowsPerSecond", 0.0) or 0.0),
        int(dur.get("triggerExecution", 0) or 0),
        int(dur.get("addBatch", 0) or 0),
        *_latencies(d, int(dur.get("triggerExecution", 0) or 0)),
    )


def progress_frame(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The query's recent progress reports (the engine keeps the last 100)."""
    return spark.createDataFrame([_row(p) for p in query.recentProgress], PROGRESS_SCHEMA)


class ProgressRecorder(StreamingQueryListener):
    """Keeps every progress report of the session's queries (one small row per
    micro-batch), for runs longer than the engine's recent window.

    ``spark.streams.addListener(ProgressRecorder(spark, path))``; later
    ``rec.frame(name)``.  With a ``path``, reports are appended to a Parquet table
    there in blocks of ``block`` and leave the driver, so a stream may run for
    ever; without one they stay in memory (short runs, tests).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, block: int = 100):
        self.spark, self.path, self.block = spark, path, block
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((p.name or "", *_row(p)))
        if self.path and len(self.rows) >= self.block:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self) -> None:
        """Append what is held to the table."""
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, "query string, " + PROGRESS_SCHEMA).coalesce(1).write.mode(
                "append").parquet(self.path)

    def frame(self, name: str | None = None) -> DataFrame:
        schema = "query string, " + PROGRESS_SCHEMA
        if self.path:
            self.flush()
            out = self.spark.read.schema(schema).parquet(self.path)
        else:
            out = self.spark.createDataFrame(self.rows, schema)
        return (out if name is None else out.where(out["query"] == name)).drop("query")
