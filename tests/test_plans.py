"""Physical-plan properties the scale design relies on."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

LAZY = ["line_suffix_count", "document_lines", "workload_lines", "suffix_filter", "multi_suffix_filter",
        "prefix_key", "tumbling_count", "additive_totals", "render_rows", "lookup_left", "lookup_type_totals",
        "workload_orange_count", "scene_gray", "scene_blur", "scene_gradient", "scene_thin_snapshot",
        "circle_offsets"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_joins(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_suffix_filter_reaches_the_scan(spark):
    df = entry.queries()["suffix_filter"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringEndsWith(p_name,ring)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


@pytest.mark.parametrize("name", ["line_suffix_count", "tumbling_count", "workload_orange_count"])
def test_partial_aggregate_before_exchange(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "partial_" in plan and "Exchange hashpartitioning" in plan


def test_votes_broadcast_only_the_offsets(spark):
    from grovecount.operators.hough import vote_counts
    from grovecount.sources.scenes import scene_dims
    from grovecount.sources.tables import read_table

    supplier = read_table(spark, SF_SMALL, "supplier")
    edges = spark.createDataFrame([(0, 10, 10), (1, 20, 20)], "image_id long, x int, y int")
    plan = _plan(vote_counts(edges, scene_dims(supplier)))
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert "partial_sum" in plan and "hashpartitioning(image_id" in plan


def test_pixel_table_never_broadcast_by_estimate(spark):
    from grovecount.operators.crops import crop_pixels
    from grovecount.sources.scenes import scene_pixels
    from grovecount.sources.tables import read_table

    supplier = read_table(spark, SF_SMALL, "supplier")
    boxes = spark.createDataFrame([(0, 0, 18, 13, 26, 21)], "image_id long, k int, x0 int, y0 int, x1 int, y1 int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))  # estimate-based session
        df = crop_pixels(boxes, scene_pixels(supplier))
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert df.count() == 64
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pixel_table_never_broadcast_where_no_threshold_is_set(spark):
    """Spark's own threshold holds in a session that sets none."""
    from grovecount.operators.crops import crop_pixels
    from grovecount.sources.scenes import scene_pixels

    supplier = spark.createDataFrame([(i, i % 25) for i in range(10)], "s_suppkey long, s_nationkey int")
    boxes = spark.createDataFrame([(0, 0, 18, 13, 26, 21)], "image_id long, k int, x0 int, y0 int, x1 int, y1 int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        plan = _plan(crop_pixels(boxes, scene_pixels(supplier)))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_drawn_images_are_not_broadcast_to_their_names(spark):
    from grovecount.plans.stream_queries import _named_images

    rows = spark.createDataFrame([(i, i % 25) for i in range(20)], "s_suppkey long, s_nationkey int")
    names = rows.selectExpr("s_suppkey AS image_id", "concat('a_', s_suppkey, '.png') AS image_name")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        images = _named_images(rows, names)
        assert "SortMergeJoin" in _plan(images) and "BroadcastHashJoin" not in _plan(images)
        assert images.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
