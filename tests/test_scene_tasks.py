"""Scenes over many tasks, in bounded frames; the dense part of the
detector from a pixel table in one shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import pixels_frame
from pyspark.sql import functions as F

import grovecount.sources.scenes as scenes
from grovecount.operators.stencil import blur, gradient
from grovecount.operators.stencil_tiles import suppression_inputs_from_pixels
from grovecount.operators.thinning import suppression_inputs, thin_pixels

COLS = ["image_id", "x", "y", "mag2", "q_kills", "p_gt", "px", "py"]


@pytest.fixture()
def suppliers(spark):
    return spark.createDataFrame([(i, i % 25) for i in range(1, 41)], "s_suppkey long, s_nationkey int").coalesce(1)


@pytest.mark.parametrize("shape", [scenes.scene_pixels, scenes.scene_images])
def test_one_input_split_is_drawn_by_many_tasks(suppliers, monkeypatch, shape):
    whole = shape(suppliers)
    want = sorted(tuple(r) for r in whole.collect())
    assert whole.select(F.spark_partition_id()).distinct().count() == 1
    monkeypatch.setattr(scenes, "SCENES_PER_TASK", 5)
    dealt = shape(suppliers)
    assert dealt.select(F.spark_partition_id()).distinct().count() > 4
    assert sorted(tuple(r) for r in dealt.collect()) == want


def test_drawn_frames_are_bounded(spark, suppliers, monkeypatch):
    monkeypatch.setattr(scenes, "RENDER_BYTES", 50_000)
    pdf = scenes._mixed(suppliers).toPandas()
    frames = list(scenes._render_mixed(iter([pdf])))
    assert len(frames) > 4 and sum(map(len, frames)) == 40
    assert all(f["data"].iloc[:-1].map(len).sum() <= 50_000 for f in frames)
    small = pd.DataFrame({"image_id": range(9), "cx": 20, "cy": 20, "radius": 5})
    assert [len(f) for f in scenes._render(iter([small]), 60, 45)] == [6, 3]


@pytest.mark.parametrize("tile", [5, 16, 256])
def test_tiles_give_the_windows_rows(spark, tile):
    rng = np.random.default_rng(tile)
    busy = rng.integers(0, 256, size=(30, 41)).astype(np.int32)
    busy[5:20, 10:25] = 250
    images = {"busy": busy, "flat": np.full((12, 9), 7, np.int32), "thin": rng.integers(0, 256, size=(2, 30)),
              "line": rng.integers(0, 256, size=(25, 1)), "step": np.repeat([[0] * 8 + [255] * 9], 17, axis=0)}
    px = pixels_frame(spark, images)
    want = sorted(tuple(r) for r in suppression_inputs(gradient(blur(px)), 20).select(*COLS).collect())
    got = suppression_inputs_from_pixels(px, 20, tile=tile)
    assert sorted(tuple(r) for r in got.select(*COLS).collect()) == want and {r[0] for r in want} == {"busy", "step"}


def test_repeated_pixels_and_null_ids(spark):
    img = np.random.default_rng(3).integers(0, 256, size=(14, 18)).astype(np.int32)
    once = pixels_frame(spark, {"a": img}).coalesce(1)
    px = once.unionByName(once.withColumn("image_id", F.lit(None).cast("string")))
    px = px.select("*", F.explode(F.when(F.col("image_id").isNull(), F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1))))).drop("col").coalesce(1)
    want = sorted(map(str, suppression_inputs(gradient(blur(px)), 20).select(*COLS).collect()))
    assert sorted(map(str, suppression_inputs_from_pixels(px, 20).select(*COLS).collect())) == want and len(want) > 100


def test_edges_take_one_shuffle_of_the_pixel_table(spark, suppliers):
    df = thin_pixels(scenes.scene_pixels(suppliers), 20, mode="snapshot")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
