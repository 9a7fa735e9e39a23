"""Streaming job (O-01, T-1a, T-3, T-4, K-1, K-2, U-4), timer windows (T-1c)
and progress rows (T-7)."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from grovecount.plans.modes import JobOptions, pipeline_for
from grovecount.plans.text_job import text_sightings
from grovecount.sources.text import stream_lines
from grovecount.streaming import job as job_mod
from grovecount.streaming.job import start_job
from grovecount.streaming.progress import progress_frame
from grovecount.streaming.sinks import read_ledger, read_text_rows, read_totals
from grovecount.streaming.timers import clock_window_counts

from conftest import disc_scene, gray_to_rgb, write_png


def _opts(root, mode="TEXT", **kw):
    inp = os.path.join(root, "data")
    os.makedirs(inp, exist_ok=True)
    return JobOptions(mode=mode, input=inp, output=os.path.join(root, "out"),
                      checkpoint=os.path.join(root, "ck"), **kw)


def _put(opts, name, text):
    with open(os.path.join(opts.input, name), "w") as f:
        f.write(text)


def test_unknown_mode_is_an_error():
    with pytest.raises(ValueError):
        pipeline_for("text")


def test_text_job_resumes_without_double_counting(spark, workdir):
    opts = _opts(workdir)
    _put(opts, "tree_0.txt", "ripe orange\nleaf\nrotten orange\nripe orange\n")
    start_job(spark, opts, available_now=True).awaitTermination()
    _put(opts, "tree_1.txt", "ripe orange\nimmature orange\nbranch\n")
    start_job(spark, opts, available_now=True).awaitTermination()
    totals = {r.feature: r.n for r in read_totals(spark, opts.output).collect()}
    assert totals == {"ripe orange": 3, "rotten orange": 1, "immature orange": 1}
    text = sorted(r.value for r in read_text_rows(spark, opts.output).collect())
    assert "(ripe orange,2)" in text and "(immature orange,1)" in text
    ledger = read_ledger(spark, opts.output)
    assert set(ledger.columns) == {"batch_id", "window_start", "feature", "n"}


def test_replayed_batch_is_not_added_twice(spark, workdir, monkeypatch):
    opts = _opts(workdir)
    _put(opts, "tree_0.txt", "ripe orange\nripe orange\n")
    real = job_mod.write_text_rows
    calls = {"n": 0}

    def failing_once(counts, output, batch_id):
        real(counts, output, batch_id)
        calls["n"] += 1
        if calls["n"] == 1:
            raise RuntimeError("sink crashed after writing")

    monkeypatch.setattr(job_mod, "write_text_rows", failing_once)
    q = start_job(spark, opts, available_now=True)
    with pytest.raises(Exception):
        q.awaitTermination()
    # restart on the same checkpoint: the uncommitted batch replays and overwrites itself
    start_job(spark, opts, available_now=True).awaitTermination()
    assert {r.feature: r.n for r in read_totals(spark, opts.output).collect()} == {"ripe orange": 2}
    assert read_text_rows(spark, opts.output).count() == 1


def test_images_job_streams_manifests(spark, workdir):
    opts = _opts(workdir, mode="IMAGES", image_parallelism=4)
    images = os.path.join(opts.input, "images")
    os.makedirs(images)
    write_png(os.path.join(images, "billiard_0.png"), gray_to_rgb(disc_scene(120, 90, [(60, 45, 9)])))
    write_png(os.path.join(images, "tennis_1.png"),
              gray_to_rgb(disc_scene(120, 90, [(25, 25, 10), (95, 25, 8)])))
    _put(opts, "billiard_0.txt", "billiard_0.png")
    _put(opts, "mixed.txt", "tennis_1.png\nbilliard_0.png\nnotes.doc\nmissing_3.png\n")
    start_job(spark, opts, available_now=True).awaitTermination()
    totals = {r.feature: r.n for r in read_totals(spark, opts.output).collect()}
    assert totals == {"billiard": 2, "tennis": 2, "missing": 0}


def test_clock_windows_fire_while_idle(spark, workdir):
    inp = os.path.join(workdir, "in")
    os.makedirs(inp)
    with open(os.path.join(inp, "t0.txt"), "w") as f:
        f.write("ripe orange\nripe orange\nleaf\nrotten orange\n")
    out = clock_window_counts(text_sightings(stream_lines(spark, inp)), 1, salts=4)
    q = (out.writeStream.format("memory").queryName("clock_test").outputMode("append")
         .option("checkpointLocation", os.path.join(workdir, "ck"))
         .trigger(processingTime="500 milliseconds").start())
    try:
        deadline = time.time() + 60
        rows = []
        while time.time() < deadline:
            rows = spark.sql("select feature, sum(n) as n from clock_test group by feature").collect()
            if sum(r.n for r in rows) >= 3:
                break
            time.sleep(0.5)
        assert sorted((r.feature, r.n) for r in rows) == [("ripe orange", 2), ("rotten orange", 1)]
        prog = progress_frame(spark, q)
        assert prog.agg(F.sum("num_input_rows")).first()[0] == 4
    finally:
        q.stop()


def test_clock_window_job_writes_ledger_while_idle(spark, workdir):
    opts = _opts(workdir, windows="clock", window="1 seconds", trigger="500 milliseconds")
    _put(opts, "tree_0.txt", "ripe orange\nleaf\nripe orange\nimmature orange\n")
    q = start_job(spark, opts)
    try:
        deadline = time.time() + 60
        totals = {}
        while time.time() < deadline:
            time.sleep(1)
            if os.path.exists(os.path.join(opts.output, "ledger")):
                totals = {r.feature: r.n for r in read_totals(spark, opts.output).collect()}
                if totals:
                    break
        assert totals == {"ripe orange": 2, "immature orange": 1}
    finally:
        q.stop()


def test_native_window_closes_on_later_input(spark, workdir):
    from grovecount.streaming.timers import native_window_counts

    inp = os.path.join(workdir, "in")
    os.makedirs(inp)
    with open(os.path.join(inp, "t0.txt"), "w") as f:
        f.write("ripe orange\nripe orange\n")
    out = native_window_counts(text_sightings(stream_lines(spark, inp)), "1 second")
    q = (out.writeStream.format("memory").queryName("native_test").outputMode("append")
         .option("checkpointLocation", os.path.join(workdir, "ck"))
         .trigger(processingTime="500 milliseconds").start())
    try:
        time.sleep(3)
        with open(os.path.join(inp, "t1.txt"), "w") as f:
            f.write("rotten orange\n")
        deadline = time.time() + 60
        rows = []
        while time.time() < deadline:
            rows = spark.sql("select feature, n from native_test").collect()
            if rows:
                break
            time.sleep(0.5)
        assert ("ripe orange", 2) in [(r.feature, r.n) for r in rows]
    finally:
        q.stop()


def test_progress_recorder_keeps_every_batch(spark, workdir):
    from grovecount.streaming.progress import ProgressRecorder

    rec = ProgressRecorder(spark, os.path.join(workdir, "progress"), block=2)
    spark.streams.addListener(rec)
    try:
        opts = _opts(workdir, max_files_per_trigger=1)
        for i in range(3):
            _put(opts, f"tree_{i}.txt", "ripe orange\n" * (i + 1))
        start_job(spark, opts, available_now=True).awaitTermination()
        deadline = time.time() + 30
        frame = rec.frame("grovecount-text")
        while time.time() < deadline and frame.count() < 3:
            time.sleep(0.2)
            frame = rec.frame("grovecount-text")
        assert len(rec.rows) < 2  # blocks leave the driver
        # one file per trigger: three batches, every one recorded
        assert sorted(r.batch_id for r in frame.collect())[:3] == [0, 1, 2]
        assert frame.agg(F.sum("num_input_rows")).first()[0] >= 6
        assert {r.feature: r.n for r in read_totals(spark, opts.output).collect()} == {"ripe orange": 6}
    finally:
        spark.streams.removeListener(rec)


def test_round_scope_removes_batch_checkpoints(spark, workdir):
    from grovecount.plans.lineage import RoundTables, round_scope

    with round_scope(spark) as files:
        RoundTables(spark, "t").write(spark.range(10), "a")
        kept = RoundTables(spark, "t").write(spark.range(5), "b")
        assert kept.count() == 5 and len(files) == 2
        paths = [f.removeprefix("file:") for f in files]
        assert all(os.path.exists(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)


def test_images_job_with_ingested_table_and_crops(spark, workdir):
    from grovecount.plans.image_job import CROPS_FOLDER
    from grovecount.sources.images import stream_ingest_images

    src = os.path.join(workdir, "incoming-images")
    os.makedirs(src)
    write_png(os.path.join(src, "billiard_0.png"), gray_to_rgb(disc_scene(120, 90, [(60, 45, 9)])))
    table = os.path.join(workdir, "image-table")
    stream_ingest_images(spark, src, table, os.path.join(workdir, "ck-ingest"), available_now=True).awaitTermination()

    opts = _opts(workdir, mode="IMAGES", images_table=table)
    _put(opts, "m0.txt", "billiard_0.png\nbilliard_0.png\n")
    start_job(spark, opts, available_now=True).awaitTermination()
    assert {r.feature: r.n for r in read_totals(spark, opts.output).collect()} == {"billiard": 2}
    crops = spark.read.parquet(os.path.join(opts.output, CROPS_FOLDER))
    assert [(r.crop_name, r.a, r.b, r.r) for r in crops.collect()] == [("billiard_billiard_0.png_0.png", 60, 45, 10)]


def test_command_line_entry(workdir):
    import subprocess
    import sys

    inp = os.path.join(workdir, "cli-in")
    os.makedirs(inp)
    with open(os.path.join(inp, "tree_0.txt"), "w") as f:
        f.write("ripe orange\nleaf\nripe orange\n")
    out, ck = os.path.join(workdir, "cli-out"), os.path.join(workdir, "cli-ck")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    proc = subprocess.run(
        [sys.executable, "-m", "grovecount", "--mode", "TEXT", "--input", inp, "--output", out,
         "--checkpoint", ck, "--available-now", "--master", "local[2]"],
        cwd=repo, capture_output=True, text=True, timeout=300,
    )
    assert proc.returncode == 0, proc.stderr[-2000:]
    lines = []
    folder = os.path.join(out, "monitoring-data", "batch_id=0")
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name)) as f:
                lines += f.read().split()
    assert " ".join(lines) == "(ripe orange,2)"


def test_relational_sink_errors_fail_the_batch(spark):
    from grovecount.streaming.sinks import jdbc_totals_sink

    counts = spark.createDataFrame([("ripe orange", 2)], "feature string, n long")
    sink = jdbc_totals_sink("jdbc:grovecount-unknown:totals", {"user": "u"})
    with pytest.raises(Exception):
        sink(counts, 7)  # no driver for the URL: raised, never swallowed


class _Connection:
    """Runs the sink's statements on DuckDB through the few JDBC calls they use."""

    def __init__(self, con):
        self.con = con

    def setAutoCommit(self, on):
        self.con.execute("BEGIN")

    def prepareStatement(self, sql):
        outer, values = self, {}

        class Statement:
            def setLong(self, i, v):
                values[i] = v

            def executeUpdate(self):
                outer.con.execute(sql, [values[i] for i in sorted(values)])

            def executeQuery(self):
                rows = outer.con.execute(sql, [values[i] for i in sorted(values)]).fetchall()
                return type("Rows", (), {"next": lambda _: bool(rows)})()

        return Statement()

    def commit(self):
        self.con.execute("COMMIT")

    def rollback(self):
        self.con.execute("ROLLBACK")


def test_merge_adds_a_batch_once():
    import duckdb

    from grovecount.streaming.sinks import add_staged_batch

    con = duckdb.connect()
    con.execute("CREATE TABLE t (feature VARCHAR PRIMARY KEY, n BIGINT NOT NULL)")
    con.execute("CREATE TABLE b (batch_id BIGINT PRIMARY KEY)")
    con.execute("CREATE TABLE s (feature VARCHAR, n BIGINT)")

    def add(batch_id, rows):
        con.execute("DELETE FROM s")
        for r in rows:
            con.execute("INSERT INTO s VALUES (?, ?)", r)
        return add_staged_batch(_Connection(con), batch_id, "t", "s", "b")

    assert add(0, [("ripe", 2), ("rotten", 1)])
    assert add(1, [("ripe", 3), ("green", 4)])
    assert not add(1, [("ripe", 3), ("green", 4)])  # replayed: nothing changes
    assert con.execute("SELECT * FROM t ORDER BY 1").fetchall() == [("green", 4), ("ripe", 5), ("rotten", 1)]


def test_clock_window_bounds_in_any_zone(spark, workdir):
    old = spark.conf.get("spark.sql.session.timeZone")
    opts = _opts(workdir, windows="clock", window="10 seconds", trigger="500 milliseconds")
    _put(opts, "tree_0.txt", "ripe orange\n")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    before = time.time()
    q = start_job(spark, opts)
    try:
        deadline, rows = time.time() + 60, []
        while time.time() < deadline and not rows:
            time.sleep(1)
            if os.path.exists(os.path.join(opts.output, "ledger")):
                rows = read_ledger(spark, opts.output).select(F.unix_seconds("window_start").alias("s")).collect()
        assert len(rows) == 1 and rows[0].s % 10 == 0
        assert before - 10 <= rows[0].s <= time.time()
    finally:
        q.stop()
        spark.conf.set("spark.sql.session.timeZone", old)


def test_one_row_per_window_and_compaction(spark, workdir):
    from grovecount.streaming.sinks import compact_ledger, read_window_counts, write_ledger

    out = os.path.join(workdir, "out")

    def batch(i, rows):
        df = spark.createDataFrame(rows, "s long, feature string, n long")
        write_ledger(df.select(F.timestamp_seconds("s").alias("window_start"), "feature", "n"), out, i)

    def windows():
        return sorted((r.feature, r.s, r.n) for r in read_window_counts(spark, out).select(
            "feature", F.unix_seconds("window_start").alias("s"), "n").collect())

    batch(0, [(0, "ripe", 2), (0, "rotten", 1)])
    batch(1, [(0, "ripe", 3)])
    batch(2, [(10, "ripe", 4)])
    want = [("ripe", 0, 5), ("ripe", 10, 4), ("rotten", 0, 1)]
    assert windows() == want
    compact_ledger(spark, out, 1)
    assert windows() == want
    assert sorted(os.listdir(os.path.join(out, "ledger")))[-1] == "batch_id=2"
    assert not os.path.exists(os.path.join(out, "ledger", "batch_id=0"))
    batch(3, [(10, "ripe", 1)])
    compact_ledger(spark, out, 2)
    assert windows() == [("ripe", 0, 5), ("ripe", 10, 5), ("rotten", 0, 1)]
    assert os.listdir(os.path.join(out, "ledger-compacted")) == ["upto=2"]
    assert {r.feature: r.n for r in read_totals(spark, out).collect()} == {"ripe": 10, "rotten": 1}


def test_rejects_and_late_images(spark, workdir):
    """Failed lines are written with their reason; an image that ingest has not
    seen yet is read from the folder."""
    from grovecount.sources.images import stream_ingest_images

    opts = _opts(workdir, mode="IMAGES", images_table=os.path.join(workdir, "table"), crop_pixels=True)
    images = opts.images_path()
    os.makedirs(images)
    write_png(os.path.join(images, "billiard_0.png"), gray_to_rgb(disc_scene(120, 90, [(60, 45, 9)])))
    stream_ingest_images(spark, images, opts.images_table, os.path.join(workdir, "ck-i"), available_now=True).awaitTermination()
    write_png(os.path.join(images, "tennis_1.png"), gray_to_rgb(disc_scene(120, 90, [(25, 25, 10), (95, 25, 8)])))
    with open(os.path.join(images, "bad_0.png"), "wb") as f:
        f.write(b"no image")
    _put(opts, "m.txt", "billiard_0.png\ntennis_1.png\nplain.png\nmissing_3.png\nbad_0.png\n")
    start_job(spark, opts, available_now=True).awaitTermination()
    totals = {r.feature: r.n for r in read_totals(spark, opts.output).collect()}
    assert totals == {"billiard": 1, "tennis": 2, "missing": 0, "bad": 0}
    rejects = spark.read.parquet(os.path.join(opts.output, "rejects"))
    assert sorted((r.image_name, r.reason) for r in rejects.collect()) == [
        ("bad_0.png", "unreadable"), ("missing_3.png", "missing"), ("plain.png", "no type separator"),
    ]
    pixels = spark.read.parquet(os.path.join(opts.output, "processed-images-pixels"))
    assert pixels.where("image_name = 'billiard_0.png'").count() == 400
