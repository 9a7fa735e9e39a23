"""The monitoring job as a Structured Streaming query (T-1a/T-1c, T-3..T-6).

watched folder -> (stamp processing time) -> foreachBatch:
    mode pipeline -> sum per (10-second window, feature) -> text rows + ledger

``JobOptions.windows="clock"`` (TEXT mode) uses timer windows instead (see
``streaming/timers.py``): rows are emitted when a window's end has passed.

Windows are processing-time "ticks": each micro-batch is stamped with the
trigger time inside the streaming plan, so the stamp is recorded in the offset
log and a replayed batch keeps its original window.  Two batches that fall in
the same window give two partial rows in the ledger; sums are additive, so
``sinks.read_window_counts`` gives one row per (window, feature) and totals do
not depend on how lines fall into batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovecount.functions.text import ends_with
from grovecount.plans.lineage import round_scope
from grovecount.plans.modes import IMAGE_FILES, JobOptions, pipeline_for
from grovecount.sources.text import stream_lines
from grovecount.streaming.progress import ARRIVAL, arrival_metrics
from grovecount.streaming.sinks import (
    compact_ledger, drop_text_batches, read_batch, write_ledger, write_text_rows,
)
from grovecount.streaming.timers import clock_window_counts, merge_partials


def _seconds(duration: str) -> int:
    n, unit = duration.split()
    scale = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return int(n) * scale


def window_counts(sightings: DataFrame, window: str) -> DataFrame:
    """``window_start, window_end, feature, n`` for sightings of one batch; every
    row carries the batch's stamp ``batch_time``."""
    size = _seconds(window)
    # seconds since the epoch: the stamp never passes through a local date
    start = F.timestamp_seconds(F.floor(F.unix_seconds("at") / size) * size)
    return (
        sightings.groupBy("feature")
        .agg(F.sum("n").cast("bigint").alias("n"), F.max("batch_time").alias("at"))
        .select(start.alias("window_start"), (start + F.expr(f"INTERVAL {size} SECONDS")).alias("window_end"),
                "feature", "n")
    )


def process_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    opts: JobOptions,
    extra_sinks: tuple[Callable[[DataFrame, int], None], ...] = (),
) -> DataFrame | None:
    """One micro-batch: pipeline, window sums, sinks.  Returns the window counts.

    Every row of a batch carries the same stamp (taken from the offset log); the
    text pipeline keeps it on its rows, so the batch is read once.  An empty
    batch writes no counts.
    """
    if opts.mode == "TEXT":
        sightings = pipeline_for(opts.mode)(spark, batch, opts, batch_id)
    else:
        # manifests are small; the stamp comes from one of their lines
        first = batch.select(F.unix_seconds("batch_time").alias("s")).first()
        if first is None:
            return None
        sightings = pipeline_for(opts.mode)(spark, batch.select("value"), opts, batch_id)
        sightings = sightings.withColumn("batch_time", F.timestamp_seconds(F.lit(first.s)))
    # The counts are written twice (text, ledger) and maybe handed to more
    # sinks; write them once as the ledger and read that back for the rest.
    write_ledger(window_counts(sightings, opts.window), opts.output, batch_id)
    committed = read_batch(spark, opts.output, batch_id)
    if committed is None:
        return None
    committed = committed.withColumn("window_end", F.col("window_start") + F.expr(
        f"INTERVAL {_seconds(opts.window)} SECONDS"))
    write_text_rows(committed, opts.output, batch_id)
    for sink in extra_sinks:
        sink(committed, batch_id)
    return committed


def keep_house(spark: SparkSession, opts: JobOptions, batch_id: int) -> None:
    """What keeps a long-lived job's folders bounded, at the end of a batch: every
    ``compact_every`` batches the finished ones are folded into one ledger table
    and text folders beyond ``keep_text_batches`` go.  A batch that fails or is
    replayed repeats this without effect on totals."""
    if not opts.compact_every or not batch_id or batch_id % opts.compact_every:
        return
    compact_ledger(spark, opts.output, batch_id - 1)
    if opts.keep_text_batches is not None:
        drop_text_batches(spark, opts.output, batch_id - opts.keep_text_batches)


def start_job(
    spark: SparkSession,
    opts: JobOptions,
    available_now: bool = False,
    extra_sinks: tuple[Callable[[DataFrame, int], None], ...] = (),
) -> StreamingQuery:
    """Start the job; restart with the same ``opts.checkpoint`` to resume (T-4).

    ``available_now=True`` processes everything present and stops (backfill,
    tests); otherwise a micro-batch runs every ``opts.trigger`` (T-3: the
    checkpoint commit interval is the trigger interval).
    """
    pipeline_for(opts.mode)  # fail fast on an unknown mode
    most = opts.max_files_per_trigger or (IMAGE_FILES if opts.mode == "IMAGES" else None)
    tick = opts.windows == "tick"
    lines = stream_lines(spark, opts.input, opts.glob, most, opts.archive_dir, opts.max_file_age, arrival=tick)
    if opts.windows == "clock":
        return _start_clock_job(spark, lines, opts, extra_sinks)
    if opts.windows != "tick":
        raise ValueError(f"unknown window form {opts.windows!r}")
    # measured inside the batch's own job; the progress report carries it
    stamped = lines.observe(ARRIVAL, *arrival_metrics("arrived")).drop("arrived")
    stamped = stamped.withColumn("batch_time", F.current_timestamp())
    if opts.mode == "TEXT":
        # Stateless filter stays in the streaming plan (runs in the scan stage).
        stamped = stamped.where(ends_with("value", opts.text_suffix))

    def each(batch: DataFrame, batch_id: int) -> None:
        # everything a batch checkpoints is written out by its sinks before the
        # scope ends, so its round tables can go with it
        with round_scope(spark):
            process_batch(spark, batch, batch_id, opts, extra_sinks)
        keep_house(spark, opts, batch_id)

    writer = (
        stamped.writeStream.queryName(f"grovecount-{opts.mode.lower()}")
        .option("checkpointLocation", opts.checkpoint)
        .foreachBatch(each)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=opts.trigger)
    return writer.start()


def _start_clock_job(spark, lines, opts: JobOptions, extra_sinks) -> StreamingQuery:
    """TEXT job with exact processing-time windows (T-1c): a window's rows are
    emitted once its end has passed, also while no input arrives.  Needs the
    RocksDB state store provider on the session."""
    if opts.mode != "TEXT":
        raise ValueError("clock windows need a stateless pipeline before the state (TEXT mode)")
    sightings = pipeline_for(opts.mode)(spark, lines, opts)
    counts = clock_window_counts(sightings, _seconds(opts.window))

    def each(batch: DataFrame, batch_id: int) -> None:
        write_ledger(merge_partials(batch), opts.output, batch_id)
        committed = read_batch(spark, opts.output, batch_id)
        if committed is None:
            return
        write_text_rows(committed, opts.output, batch_id)
        for sink in extra_sinks:
            sink(committed, batch_id)

    return (
        counts.writeStream.queryName("grovecount-text-clock")
        .option("checkpointLocation", opts.checkpoint)
        .outputMode("append")
        .foreachBatch(each)
        .trigger(processingTime=opts.trigger)
        .start()
    )
