"""What a job that never ends needs: bounded folders, measured latency, restarts
within a failure budget, archived input; and loops whose plans stay small."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from grovecount.plans.lineage import RoundTables
from grovecount.streaming.job import start_job
from grovecount.streaming.progress import progress_frame
from grovecount.streaming.sinks import LEDGER_FOLDER, TEXT_FOLDER, read_totals
from grovecount.streaming.supervisor import restart_frame, supervise

from test_streaming import _opts, _put


def test_stream_compacts_its_own_ledger(spark, workdir):
    opts = _opts(workdir, compact_every=4, keep_text_batches=3, max_files_per_trigger=1)
    for i in range(14):
        _put(opts, f"tree_{i:02d}.txt", "ripe orange\n" * (i + 1))
    start_job(spark, opts, available_now=True).awaitTermination()
    folders = os.listdir(os.path.join(opts.output, LEDGER_FOLDER))
    assert sum(f.startswith("batch_id=") for f in folders) <= 4 + 1
    assert len([f for f in os.listdir(os.path.join(opts.output, TEXT_FOLDER)) if "=" in f]) <= 3 + 4
    assert [(r.feature, r.n) for r in read_totals(spark, opts.output).collect()] == [("ripe orange", 105)]


def test_latency_of_every_batch(spark, workdir):
    opts = _opts(workdir, max_files_per_trigger=1)
    for i in range(3):
        _put(opts, f"tree_{i}.txt", "ripe orange\nleaf\n" * 50)
        past = time.time() - 60 * (i + 1)
        os.utime(os.path.join(opts.input, f"tree_{i}.txt"), (past, past))
    q = start_job(spark, opts, available_now=True)
    q.awaitTermination()
    rows = [r for r in progress_frame(spark, q).collect() if r.num_input_rows]
    assert len(rows) == 3
    ages = sorted(r.latency_p50_ms for r in rows)
    for r in rows:
        assert r.latency_p50_ms <= r.latency_p95_ms <= r.latency_p99_ms <= r.latency_max_ms
    assert 60_000 <= ages[0] < 150_000 and ages[-1] >= 180_000


def test_failures_within_the_budget_are_retried(spark, workdir):
    opts = _opts(workdir)
    _put(opts, "tree_0.txt", "ripe orange\nripe orange\n")
    calls = []

    def flaky(counts, batch_id):
        calls.append(batch_id)
        if len(calls) <= 2:
            raise RuntimeError("injected")

    restarts = supervise(lambda: start_job(spark, opts, available_now=True, extra_sinks=(flaky,)), tolerated=2)
    assert len(calls) == 3 and [r.attempt for r in restarts] == [1, 2]
    assert restarts[-1].restart_ms > 0 and restarts[0].error
    assert restart_frame(spark, restarts).count() == 2
    assert [(r.feature, r.n) for r in read_totals(spark, opts.output).collect()] == [("ripe orange", 2)]


def test_one_failure_too_many_ends_the_job(spark, workdir):
    opts = _opts(workdir)
    _put(opts, "tree_0.txt", "ripe orange\n")
    calls = []

    def broken(counts, batch_id):
        calls.append(batch_id)
        raise RuntimeError("always")

    with pytest.raises(StreamingQueryException):
        supervise(lambda: start_job(spark, opts, available_now=True, extra_sinks=(broken,)), tolerated=2)
    assert len(calls) == 3


def test_read_files_are_archived(spark, workdir):
    archive = os.path.join(workdir, "archive")
    opts = _opts(workdir, max_files_per_trigger=1, archive_dir=archive, max_file_age="30d")
    for i in range(4):
        _put(opts, f"tree_{i}.txt", "ripe orange\n")
    start_job(spark, opts, available_now=True).awaitTermination()
    _put(opts, "tree_9.txt", "ripe orange\n")
    start_job(spark, opts, available_now=True).awaitTermination()
    moved = [f for _, _, files in os.walk(archive) for f in files if f.startswith("tree_")]
    deadline = time.time() + 20
    while len(moved) < 3 and time.time() < deadline:
        time.sleep(0.5)
        moved = [f for _, _, files in os.walk(archive) for f in files if f.startswith("tree_")]
    assert len(moved) >= 3 and set(moved).isdisjoint(os.listdir(opts.input))
    assert [r.n for r in read_totals(spark, opts.output).collect()] == [5]


def test_loop_rounds_forget_their_estimates(spark):
    rounds = RoundTables(spark, "t")
    table = spark.range(100).withColumn("v", F.col("id") % 7)
    for _ in range(8):
        table = rounds.write(table.join(table.groupBy("id").agg(F.max("v").alias("w")), "id").select("id", "v"), "r")
        size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert size < 1_000_000
    assert table.count() == 100


def test_dense_scene_settles_in_few_rounds(spark, monkeypatch):
    """300 x 200 full of candidates: rounds follow block borders, not chains."""
    import numpy as np

    from grovecount.operators import overlap

    from test_detect import CANDS, greedy

    rng = np.random.default_rng(2)
    rows = {(int(a), int(b), int(r)): int(v) for a, b, r, v in zip(
        rng.integers(0, 300, 6000), rng.integers(0, 200, 6000), rng.integers(13, 31, 6000), rng.integers(40, 90, 6000))}
    cands = [("i", *k, v) for k, v in rows.items()]
    count = []
    real = RoundTables.write_counted
    monkeypatch.setattr(RoundTables, "write_counted", lambda self, *a: count.append(1) or real(self, *a))
    df = spark.createDataFrame(cands, CANDS)
    assert sorted(map(tuple, overlap.accept_circles(df).collect())) == greedy(cands) and len(count) == 1
    count.clear()
    assert sorted(map(tuple, overlap.accept_circles(df, block=100).collect())) == greedy(cands)
    assert 1 < len(count) <= 8
