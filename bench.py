"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the ``noop`` sink (full execution, no
collect).  The streaming TEXT job is timed on workload lines derived from
``lineitem`` (one line per row), written as text files beforehand.
"""

from __future__ import annotations

import contextlib
import json
import os
import signal
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from grovecount.plans.detect import detect_circles_in_images  # noqa: E402
from grovecount.plans.modes import JobOptions  # noqa: E402
from grovecount.plans.registry import QUERIES  # noqa: E402
from grovecount.session import build_session  # noqa: E402
from grovecount.sources.scenes import nation_scenes, scene_images  # noqa: E402
from grovecount.sources.tables import read_table  # noqa: E402
from grovecount.sources.workload import workload_lines  # noqa: E402
from grovecount.streaming.job import start_job  # noqa: E402
from grovecount.streaming.sinks import read_totals  # noqa: E402

HEADLINE = [
    "line_suffix_count",
    "workload_orange_count",
    "tumbling_count",
    "additive_totals",
    "lookup_type_totals",
    "render_rows",
    "scene_type_counts",
    "supplier_type_counts",
    "supplier_type_counts_bands",
    "supplier_crop_pixels",
]


# seconds a single query may take; a query over it is reported as null
LIMIT = int(os.environ.get("BENCH_LIMIT", "240"))


@contextlib.contextmanager
def limited(spark, seconds):
    def stop(signum, frame):
        raise TimeoutError

    old = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    except TimeoutError:
        spark.sparkContext.cancelAllJobs()
        raise
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, old)


def run(spark, name, sf_dir):
    """Seconds of a query, or None beyond the limit; also printed as they come."""
    t0 = time.perf_counter()
    try:
        with limited(spark, LIMIT):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - t0, 3)
    except TimeoutError:
        took = None
    print(f"{name}: {took}", file=sys.stderr, flush=True)
    return took


def rate(n, seconds):
    return round(n / seconds, 2) if seconds else None


def stream_text(spark, sf_dir, scratch):
    inp = os.path.join(scratch, "lines")
    lines = workload_lines(read_table(spark, sf_dir, "lineitem"), "l_orderkey")
    n_lines = lines.count()
    lines.repartition(11).write.mode("overwrite").text(inp)  # 11 files, as in workload L
    opts = JobOptions(mode="TEXT", input=inp, output=os.path.join(scratch, "out"),
                      checkpoint=os.path.join(scratch, "ck"), glob="part-*")
    t0 = time.perf_counter()
    start_job(spark, opts, available_now=True).awaitTermination()
    dt = time.perf_counter() - t0
    total = sum(r.n for r in read_totals(spark, opts.output).collect())
    return dt, n_lines, total


def workload_l(spark, sf_dir, scratch, copies: int = 9, files: int = 55):
    """Opt-in (BENCH_WORKLOAD_L=1): the streaming TEXT job at the scale of the
    reference's workload L: lineitem rows x ``copies`` as lines in ``files`` files,
    read with 11 files per trigger (the batch shape of workload B)."""
    li = read_table(spark, sf_dir, "lineitem")
    rows = li.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("c"), "l_orderkey").select(
        (F.col("l_orderkey") * copies + F.col("c")).alias("rid")
    )
    inp = os.path.join(scratch, "workload-l")
    workload_lines(rows, "rid").repartition(files).write.mode("overwrite").text(inp)
    n_lines = spark.read.text(inp).count()
    opts = JobOptions(mode="TEXT", input=inp, output=os.path.join(scratch, "out-l"),
                      checkpoint=os.path.join(scratch, "ck-l"), glob="part-*", max_files_per_trigger=11)
    t0 = time.perf_counter()
    start_job(spark, opts, available_now=True).awaitTermination()
    return n_lines, time.perf_counter() - t0


def large_images(spark, sf_dir, width: int = 300, height: int = 200):
    """Opt-in (BENCH_LARGE=1): detection on 300x200 scenes (18 radii) at two image
    counts, to tell the fixed cost of a run from the cost per image."""
    rows = nation_scenes(read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation"))
    out = {}
    for part, keep in (("quarter", F.col("s_suppkey") % 4 == 0), ("all", F.lit(True))):
        images = scene_images(rows.where(keep), width, height)
        n = images.count()
        t0 = time.perf_counter()
        detect_circles_in_images(images, "image_id").counts.write.format("noop").mode("overwrite").save()
        out[part] = (n, time.perf_counter() - t0)
    (n0, t0), (n1, t1) = out["quarter"], out["all"]
    return {"images": n1, "seconds": round(t1, 2), "seconds_quarter": round(t0, 2),
            "marginal_images_per_sec": round((n1 - n0) / max(t1 - t0, 1e-6), 1)}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="grovecount-bench-")
    # spark.checkpoint.dir is taken from the environment's configuration;
    # build_session picks a local folder only when none is configured
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.driver.memory": "8g"})
    # warm-up (JVM, codegen, python workers) on the smallest tables; the timed
    # runs below process the whole tables of sf_dir
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("suffix_filter", "line_suffix_count", "scene_type_counts", "supplier_type_counts_bands"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        times[name] = run(spark, name, sf_dir)
    dt, n_lines, kept = stream_text(spark, sf_dir, scratch)
    times["stream_text_job"] = round(dt, 3)
    n_suppliers = read_table(spark, sf_dir, "supplier").count()
    out = {
        "metric": "headline_total",
        "value": round(sum(t for t in times.values() if t is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "rates": {
            "stream_text_lines_per_sec": round(n_lines / dt, 1),
            "stream_text_kept": kept,
            "supplier_images_per_sec": rate(n_suppliers, times["supplier_type_counts"]),
            "supplier_images_per_sec_bands": rate(n_suppliers, times["supplier_type_counts_bands"]),
        },
    }
    if os.environ.get("BENCH_LARGE") == "1":
        out["rates"]["images_300x200"] = large_images(spark, sf_dir)
    if os.environ.get("BENCH_WORKLOAD_L") == "1":
        n_l, dt_l = workload_l(spark, sf_dir, scratch)
        out["queries"]["stream_workload_l"] = round(dt_l, 3)
        out["rates"]["workload_l_lines"] = n_l
        out["rates"]["workload_l_lines_per_sec"] = round(n_l / dt_l, 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
