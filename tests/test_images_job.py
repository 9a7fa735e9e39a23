"""Image source (O-04), manifest rules (O-07, O-11), lookup (O-22, O-12) and
the IMAGES job on real PNG files (FIXTURES §4)."""

from __future__ import annotations

import os

import numpy as np

from grovecount.plans.image_job import image_counts
from grovecount.sources.images import image_pixels, ingest_images, read_images

from conftest import disc_scene, gray_to_rgb, write_png


def _image_folder(root: str) -> str:
    folder = os.path.join(root, "images")
    os.makedirs(folder)
    write_png(os.path.join(folder, "billiard_0.png"), gray_to_rgb(disc_scene(120, 90, [(60, 45, 9)])))
    write_png(os.path.join(folder, "tennis_1_2.jpg"),  # PNG bytes under a .jpg name decode fine
              gray_to_rgb(disc_scene(120, 90, [(25, 25, 10), (60, 60, 9), (95, 25, 8)])))
    write_png(os.path.join(folder, "plain.png"), gray_to_rgb(disc_scene(120, 90, [])))
    with open(os.path.join(folder, "bad_0.png"), "wb") as f:
        f.write(b"not an image at all")
    return folder


def test_image_source_pixels_are_gray_mean(spark, workdir):
    folder = os.path.join(workdir, "imgs")
    os.makedirs(folder)
    rgb = np.zeros((3, 4, 3), dtype=np.uint8)
    rgb[1, 2] = (30, 60, 91)  # mean 60.33 -> 60
    write_png(os.path.join(folder, "c_0.png"), rgb)
    px = {(r.x, r.y): r.v for r in image_pixels(read_images(spark, folder)).collect()}
    assert len(px) == 12 and px[(2, 1)] == 60 and px[(0, 0)] == 0


def test_unreadable_image_is_kept_with_minus_one(spark, workdir):
    folder = _image_folder(workdir)
    imgs = {r.image_name: r.height for r in read_images(spark, folder).collect()}
    assert imgs["bad_0.png"] == -1 and imgs["billiard_0.png"] == 90


def test_images_job_manifest_rules(spark, workdir):
    folder = _image_folder(workdir)
    lines = ["billiard_0.png", "tennis_1_2.jpg", "tennis_3.jpeg", "tennis_3.PNG", "tennis_3.png ",
             "plain.png", "missing_7.png", "bad_0.png", "billiard_0.png"]
    names = spark.createDataFrame([(n,) for n in lines], "image_name string")
    res = image_counts(names, read_images(spark, folder))
    got = sorted((r.image_name, r.feature, r.n, r.status) for r in res.per_line.collect())
    assert got == sorted([
        ("billiard_0.png", "billiard", 1, "ok"),
        ("billiard_0.png", "billiard", 1, "ok"),
        ("tennis_1_2.jpg", "tennis", 3, "ok"),
        ("missing_7.png", "missing", 0, "missing"),
        ("bad_0.png", "bad", 0, "unreadable"),
    ])
    assert [r.image_name for r in res.rejects.collect()] == ["plain.png"]


def test_ingested_table_gives_same_counts(spark, workdir):
    folder = _image_folder(workdir)
    table = os.path.join(workdir, "images_table")
    ingest_images(spark, folder, table)
    names = spark.createDataFrame([("billiard_0.png",), ("tennis_1_2.jpg",)], "image_name string")
    res = image_counts(names, spark.read.parquet(table))
    assert sorted((r.feature, r.n) for r in res.per_line.collect()) == [("billiard", 1), ("tennis", 3)]


def test_missing_image_folder_counts_zero(spark, workdir):
    names = spark.createDataFrame([("billiard_0.png",)], "image_name string")
    res = image_counts(names, read_images(spark, os.path.join(workdir, "nope")))
    assert [(r.feature, r.n, r.status) for r in res.per_line.collect()] == [("billiard", 0, "missing")]


def test_crop_table_written_per_batch(spark, workdir):
    from grovecount.plans.image_job import CROPS_FOLDER, write_crops

    folder = _image_folder(workdir)
    names = spark.createDataFrame([("tennis_1_2.jpg",), ("billiard_0.png",)], "image_name string")
    images = read_images(spark, folder)
    res = image_counts(names, images)
    path = write_crops(res, os.path.join(workdir, "out"), 3)
    assert path.endswith(os.path.join(CROPS_FOLDER, "batch_id=3"))
    crops = sorted((r.crop_name, r.x0, r.y0, r.x1, r.y1) for r in spark.read.parquet(path).collect())
    assert crops[0] == ("billiard_billiard_0.png_0.png", 50, 35, 70, 55)
    assert len(crops) == 4 and crops[1][0] == "tennis_tennis_1_2.jpg_0.png"


def test_streamed_image_table_serves_the_lookup(spark, workdir):
    from grovecount.sources.images import stream_ingest_images

    folder = _image_folder(workdir)
    table = os.path.join(workdir, "images_stream_table")
    stream_ingest_images(spark, folder, table, os.path.join(workdir, "ck_img"), available_now=True).awaitTermination()
    names = spark.createDataFrame([("billiard_0.png",), ("bad_0.png",)], "image_name string")
    res = image_counts(names, spark.read.parquet(table))
    got = sorted((r.feature, r.n, r.status) for r in res.per_line.collect())
    assert got == [("bad", 0, "unreadable"), ("billiard", 1, "ok")]


def test_pixel_rows_are_chunked_and_complete(monkeypatch):
    import pandas as pd

    import grovecount.sources.images as images_mod

    monkeypatch.setattr(images_mod, "PIXEL_CHUNK", 7)
    rgb = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5 * 4, 3)
    batch = pd.DataFrame({"image_id": ["a", "b"], "width": [4, 2], "n_channels": [3, 1],
                          "data": [rgb.tobytes(), bytes([9, 8, 7, 6])]})
    frames = list(images_mod._pixel_rows(iter([batch])))
    assert all(len(f) <= 7 + 4 for f in frames)
    out = pd.concat(frames, ignore_index=True)
    a = out[out.image_id == "a"].set_index(["x", "y"]).v
    assert len(a) == 20 and a[(3, 4)] == int(rgb[19].astype(int).sum() // 3)
    b = out[out.image_id == "b"]
    assert sorted(zip(b.x, b.y, b.v)) == [(0, 0, 9), (0, 1, 7), (1, 0, 8), (1, 1, 6)]


def test_duplicate_image_rows_count_once(spark, workdir):
    folder = _image_folder(workdir)
    images = read_images(spark, folder)
    doubled = images.unionByName(images)
    names = spark.createDataFrame([("billiard_0.png",), ("billiard_0.png",)], "image_name string")
    res = image_counts(names, doubled)
    assert sorted((r.feature, r.n) for r in res.per_line.collect()) == [("billiard", 1), ("billiard", 1)]


def test_gray_png_levels_follow_java_rgb_conversion(spark, workdir):
    from grovecount.sources.images import java_gray_levels

    folder = os.path.join(workdir, "gray")
    os.makedirs(folder)
    img = np.zeros((4, 5), dtype=np.uint8)
    img[1, 2], img[3, 4] = 128, 255
    write_png(os.path.join(folder, "g_0.png"), img)
    images = read_images(spark, folder)
    assert images.first().n_channels == 1
    px = {(r.x, r.y): r.v for r in image_pixels(images).collect()}
    levels = java_gray_levels(spark)
    assert px[(2, 1)] == levels[128] and px[(4, 3)] == 255 and px[(0, 0)] == 0
    assert levels[128] > 128  # linear gray reads brighter through the sRGB conversion


def test_one_version_of_an_image_is_picked_whole(spark, workdir):
    """Two versions of a name that differ in size: sizes and pixels of one of them."""
    from pyspark.sql import functions as F

    small, large = os.path.join(workdir, "v1"), os.path.join(workdir, "v2")
    for folder, w, h, discs in ((small, 120, 90, [(60, 45, 9)]), (large, 180, 120, [(40, 40, 12), (120, 70, 13)])):
        os.makedirs(folder)
        write_png(os.path.join(folder, "ball_0.png"), gray_to_rgb(disc_scene(w, h, discs)))
    first = read_images(spark, small).withColumn("ingested_at", F.timestamp_seconds(F.lit(100)))
    later = read_images(spark, large).withColumn("ingested_at", F.timestamp_seconds(F.lit(200)))
    names = spark.createDataFrame([("ball_0.png",)], "image_name string")
    alone = {
        "v1": image_counts(names, first).per_line.first().n, "v2": image_counts(names, later).per_line.first().n,
    }
    assert alone == {"v1": 1, "v2": 2}
    both = first.unionByName(later)
    assert image_counts(names, both).per_line.first().n == 2  # the later one
    swapped = later.withColumn("ingested_at", F.timestamp_seconds(F.lit(50))).unionByName(first)
    assert image_counts(names, swapped).per_line.first().n == 1


def test_no_exchange_carries_image_bytes(spark, workdir):
    folder = _image_folder(workdir)
    table = os.path.join(workdir, "plan_table")
    ingest_images(spark, folder, table)
    names = spark.createDataFrame([("billiard_0.png",), ("bad_0.png",)], "image_name string")
    res = image_counts(names, spark.read.parquet(table))
    plan = res.found._jdf.queryExecution().executedPlan().toString()
    assert "data" in plan and "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange Round" not in plan and "SortMergeJoin" not in plan


def test_names_in_several_blocks_find_the_same_images(spark, workdir, monkeypatch):
    import grovecount.plans.image_job as job

    images = read_images(spark, _image_folder(workdir)).select("image_name", "height")
    wanted = spark.createDataFrame([("billiard_0.png",), ("bad_0.png",), ("plain.png",), ("x.png",)], "image_name string")
    whole = sorted(tuple(r) for r in job.rows_named(images, wanted, ["image_name"]).collect())
    monkeypatch.setattr(job, "NAME_BLOCK_BYTES", 40)
    split = sorted(tuple(r) for r in job.rows_named(images, wanted, ["image_name"]).collect())
    assert whole == split and len(whole) == 3


def test_find_images_reads_only_what_is_listed(spark, workdir):
    from grovecount.sources.images import find_images

    folder = _image_folder(workdir)
    names = spark.createDataFrame([("billiard_0.png",), ("nope_1.png",)], "image_name string")
    assert [r.image_name for r in find_images(spark, folder, names).collect()] == ["billiard_0.png"]
    assert find_images(spark, folder, names.where("false")).count() == 0
    assert find_images(spark, os.path.join(workdir, "nowhere"), names).count() == 0


def test_crop_names_keep_the_extension_apart(spark):
    from grovecount.operators.crops import crop_name

    rows = spark.createDataFrame([("orange_1.png", 0), ("orange_1.jpg", 0)], "image_name string, k int")
    names = [r.n for r in rows.select(crop_name().alias("n")).collect()]
    assert sorted(names) == ["orange_orange_1.jpg_0.png", "orange_orange_1.png_0.png"]


def test_crop_pixels_from_bytes_equal_the_pixel_table(spark, workdir):
    from grovecount.operators.crops import crop_pixels
    from grovecount.sources.images import cut_boxes

    folder = _image_folder(workdir)
    images = read_images(spark, folder)
    boxes = spark.createDataFrame(
        [("billiard_0.png", 0, 50, 35, 70, 55), ("tennis_1_2.jpg", 1, 0, 0, 3, 2), ("plain.png", 2, 5, 5, 5, 9)],
        "image_id string, k int, x0 int, y0 int, x1 int, y1 int",
    )
    cut = sorted(tuple(r) for r in cut_boxes(images, boxes).select("image_id", "k", "x", "y", "v").collect())
    assert cut == sorted(tuple(r) for r in crop_pixels(boxes, image_pixels(images)).collect()) and len(cut) == 406


def test_lookup_reads_only_the_folders_of_listed_names(spark, workdir):
    """O-22: the ingested table is pruned by name, and no image byte is hashed."""
    from pyspark.sql import functions as F

    from grovecount.plans.image_job import rows_named
    from grovecount.sources.images import name_part

    folder = _image_folder(workdir)
    table = os.path.join(workdir, "images_parts")
    ingest_images(spark, folder, table)
    images = spark.read.parquet(table)
    listed = spark.createDataFrame([("billiard_0.png",)], "image_name string")
    found = rows_named(images, listed, ["image_name"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    part = listed.select(name_part("image_name")).first()[0]
    assert "PartitionFilters: [isnotnull(name_part" in plan and f"(name_part#" in plan and f"= {part})" in plan
    sizes = found.select("image_name", "version", "height")
    assert "data" not in sizes._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    res = image_counts(listed, images)
    assert [(r.n, r.status) for r in res.per_line.collect()] == [(1, "ok")]
    # a folder read directly has no hash of its own: names are joined first
    res = image_counts(listed, read_images(spark, folder))
    plan = res.found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("xxhash64(data") < plan.index("Join LeftSemi")  # printed from the top down
    assert res.found.select(F.count("*")).first()[0] == 1


def test_crop_values_equal_crop_pixels(spark, workdir):
    from grovecount.plans.image_job import write_crop_pixels, write_crop_values

    folder = _image_folder(workdir)
    names = spark.createDataFrame([("tennis_1_2.jpg",), ("billiard_0.png",)], "image_name string")
    res = image_counts(names, read_images(spark, folder))
    out = os.path.join(workdir, "out")
    pixels = {}
    for r in spark.read.parquet(write_crop_pixels(res, out, 0)).orderBy("y", "x").collect():
        pixels.setdefault((r.image_name, r.k), bytearray()).append(r.v)
    values = spark.read.parquet(write_crop_values(res, out, 0)).collect()
    assert len(values) == len(pixels) == 4
    for r in values:
        assert bytes(r.data) == bytes(pixels[r.image_name, r.k]) and len(r.data) == r.width * r.height
