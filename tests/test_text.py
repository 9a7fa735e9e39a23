"""TEXT-side operators on literal fixtures (O-02, O-05, O-06, O-07, O-10, O-11,
O-21, O-30, T-1 static)."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from grovecount.functions.text import ends_with, ends_with_any, prefix_before, render_pair
from grovecount.operators.counts import keyed_sum, totals_from_ledger, tumbling_sum
from grovecount.plans.text_job import text_counts
from grovecount.sources.text import read_lines, text_column_lines
from grovecount.sources.workload import WORKLOAD_PHRASES, workload_lines


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_line_fixtures_through_text_source(spark, workdir):
    _write(os.path.join(workdir, "tree_0.txt"),
           b"ripe orange\nripe orange\r\nrotten orange \norange\nOrange\noranges\nleaf\n\nimmature orange")
    _write(os.path.join(workdir, "_hidden.txt"), b"ripe orange\n")
    _write(os.path.join(workdir, "notes.csv"), b"ripe orange\n")
    got = {r.feature: r.n for r in text_counts(read_lines(spark, workdir)).collect()}
    assert got == {"ripe orange": 2, "orange": 1, "immature orange": 1}


def test_suffix_filter_is_exact(spark):
    df = spark.createDataFrame([("a orange",), ("a orange ",), ("ORANGE",), ("x",)], "value string")
    assert [r.value for r in df.where(ends_with("value")).collect()] == ["a orange"]


def test_image_suffixes(spark):
    names = ["billiard_0.png", "tennis_1_2.jpg", "tennis_3.jpeg", "tennis_3.PNG", "tennis_3.png ", "plain.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = [r.n for r in df.where(ends_with_any("n")).collect()]
    assert kept == ["billiard_0.png", "tennis_1_2.jpg", "plain.png"]


def test_prefix_before_first_separator(spark):
    df = spark.createDataFrame([("tennis_1_2.jpg",), ("billiard_0.png",), ("plain.png",)], "n string")
    got = [r.t for r in df.select(prefix_before("n").alias("t")).collect()]
    assert got == ["tennis", "billiard", None]


def test_render_pair(spark):
    df = spark.createDataFrame([("ripe orange", 2)], "feature string, n long")
    assert df.select(render_pair("feature", "n").alias("s")).first().s == "(ripe orange,2)"


def test_text_column_lines_all_breaks(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\nd")], "id long, text string")
    assert [r.value for r in text_column_lines(df).collect()] == ["a", "b", "c", "d"]


def test_keyed_sum_hot_key_partial_aggregation(spark):
    # one key holds most rows: the plan must aggregate partially before the shuffle
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("k")).otherwise(F.col("id").cast("string")).alias("feature"),
        F.lit(1).alias("n"),
    )
    out = keyed_sum(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert out.where("feature = 'k'").first().n == 10000


def test_workload_selectivity(spark):
    lines = workload_lines(spark.range(0, 10000), "id")
    counts = {r.value: r.c for r in lines.groupBy("value").agg(F.count("*").alias("c")).collect()}
    assert set(counts) == set(WORKLOAD_PHRASES)
    kept = sum(v for k, v in counts.items() if k.endswith("orange"))
    assert kept == 6000  # 3 of 5 phrases, exactly uniform for consecutive ids


def test_tumbling_sum_and_totals(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(t0 + dt.timedelta(seconds=s), k) for s, k in [(1, "a"), (9, "a"), (10, "a"), (15, "b"), (25, "a")]]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    got = sorted((r.window_start.second, r.feature, r.n) for r in tumbling_sum(df, "ts", "k").collect())
    assert got == [(0, "a", 2), (10, "a", 1), (10, "b", 1), (20, "a", 1)]
    ledger = tumbling_sum(df, "ts", "k").select("feature", "n")
    assert {r.feature: r.n for r in totals_from_ledger(ledger).collect()} == {"a": 4, "b": 1}


def test_text_counts_property(spark):
    from collections import Counter

    from hypothesis import given, settings
    from hypothesis import strategies as st

    words = st.sampled_from(["ripe", "rotten", "immature", "orange", "Orange", "oranges", "leaf", " ", ""])
    lines = st.lists(st.lists(words, max_size=3).map(" ".join), max_size=40)

    @settings(max_examples=15, deadline=None)
    @given(lines)
    def check(sample):
        df = spark.createDataFrame([(v,) for v in sample], "value string")
        got = {r.feature: r.n for r in text_counts(df).collect()}
        assert got == dict(Counter(v for v in sample if v.endswith("orange")))

    check()
