"""Processing-time tumbling windows with exact clock semantics (T-1c, T-1b).

T-1c: per state key, a map state ``window_end -> n`` plus one processing-time
timer per open window.  A window's row is emitted when the clock passes its
end, even if no input arrives afterwards (the native window of T-1b only
closes when later input moves the watermark).

A stateful operator has no map-side combine, so a hot feature keyed alone
would send all its rows to one task.  State is therefore keyed by
``(feature, salt)`` with ``salt`` = input partition mod ``salts``: a hot
feature is spread over up to ``salts`` tasks, and each emits a partial count.
All salts' timers for one window fire in the same micro-batch, so
``merge_partials`` (a per-batch group-by) restores exactly one row per window
and feature; the sinks' sums are additive anyway.

Requires the RocksDB state store provider
(``spark.sql.streaming.stateStore.providerClass``), see ``ROCKSDB_PROVIDER``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# epoch milliseconds: no time zone is involved until Spark makes timestamps of them
OUTPUT_SCHEMA = "start_ms long, end_ms long, feature string, salt int, n long"
DEFAULT_SALTS = 16


class ClockWindowCounter(StatefulProcessor):
    """Sums ``n`` per feature into the processing-time window open on arrival."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open_windows", "window_end long", "n long")

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        end = (now // self.window_ms + 1) * self.window_ms
        added = int(sum(int(pdf["n"].sum()) for pdf in rows))
        if added:
            prev = self.open.getValue((end,)) if self.open.containsKey((end,)) else None
            if prev is None:
                self.handle.registerTimer(end)
                self.open.updateValue((end,), (added,))
            else:
                self.open.updateValue((end,), (prev[0] + added,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs()
        value = self.open.getValue((end,)) if self.open.containsKey((end,)) else None
        if value is None:
            return iter([])
        self.open.removeKey((end,))
        start = end - self.window_ms
        yield pd.DataFrame({
            "start_ms": [int(start)],
            "end_ms": [int(end)],
            "feature": [key[0]],
            "salt": [int(key[1])],
            "n": [int(value[0])],
        })

    def close(self) -> None:
        pass


def clock_window_counts(sightings: DataFrame, window_seconds: int = 10, salts: int = DEFAULT_SALTS) -> DataFrame:
    """Streaming ``window_start, window_end, feature, salt, n`` partial counts,
    emitted when each window's end passes on the processing-time clock
    (Append output mode).  Sum per (window, feature) with ``merge_partials``."""
    salted = sightings.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    partials = salted.groupBy("feature", "salt").transformWithStateInPandas(
        statefulProcessor=ClockWindowCounter(window_seconds * 1000),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    return partials.select(
        F.timestamp_millis("start_ms").alias("window_start"), F.timestamp_millis("end_ms").alias("window_end"),
        "feature", "salt", "n",
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """One row per (window, feature) from the salted partial counts of a batch."""
    return partials.groupBy("window_start", "window_end", "feature").agg(F.sum("n").cast("bigint").alias("n"))


def native_window_counts(sightings: DataFrame, window: str = "10 seconds") -> DataFrame:
    """T-1b: Spark's own window on a processing-time column with a zero watermark.

    Correct, but the last window only closes when later input arrives; use it
    for backfills, not for an idle live stream.
    """
    stamped = sightings.withColumn("pt", F.current_timestamp()).withWatermark("pt", "0 seconds")
    return (
        stamped.groupBy(F.window("pt", window).alias("w"), "feature")
        .agg(F.sum("n").cast("bigint").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "n")
    )
