"""IMAGES mode: manifest lines -> kept names -> type -> image lookup ->
circle detection -> ``(type, count)`` per manifest line (O-07, O-11, O-22, O-12).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecount.functions.text import IMAGE_SUFFIXES, ends_with_any, prefix_before
from grovecount.operators.crops import crop_boxes, crop_name
from grovecount.operators.dealing import deal_by_size
from grovecount.plans.detect import DetectParams, Detection, detect_circles_in_images
from grovecount.plans.lineage import RoundTables
from grovecount.sources.images import cut_boxes, cut_values, image_dims, name_part

# Fixed value: folder of the crop output (the original's processed-images folder).
CROPS_FOLDER = "processed-images"
REJECTS_FOLDER = "rejects"


@dataclass
class ImageJobResult:
    per_line: DataFrame      # image_name, feature (type), n, status
    rejects: DataFrame       # image_name, reason
    detection: Detection | None   # image_id = detector_id of ``images``
    images: DataFrame | None      # analysed images: detector_id, image_name, height, width
    found: DataFrame | None = None  # their rows with the bytes, as read


def split_manifest(names: DataFrame, suffixes=IMAGE_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """Kept names with their type, and the rejects (no ``_`` in the name).

    Names not ending in an image suffix are dropped silently, as in the
    original filter; a kept name without a type separator, which the
    original fails on, goes to rejects.
    """
    kept = names.where(ends_with_any("image_name", suffixes)).withColumn(
        "feature", prefix_before("image_name")
    )
    rejects = kept.where(F.col("feature").isNull()).select(
        "image_name", F.lit("no type separator").alias("reason")
    )
    return kept.where(F.col("feature").isNotNull()), rejects


# Names (or picks) are sent to every task in blocks of this size; the image table
# is read once per block, and its bytes are never shuffled.
NAME_BLOCK_BYTES = 32 * 1024 * 1024


def rows_named(images: DataFrame, wanted: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``images`` that match a stored table of ``wanted`` keys (with
    ``how="inner"`` also its other columns), by a broadcast of measured size: one
    block nearly always, several for a manifest of millions of names.  Of a table
    partitioned by name only the folders that the names fall into are read."""
    parts = F.collect_set(name_part("image_name")).alias("parts")  # at most NAME_PARTS numbers
    size = wanted.agg(F.count(F.lit(1)), F.sum(F.length(keys[0])), parts).first()
    if "name_part" in images.columns:
        images = images.where(F.col("name_part").isin(size["parts"]))
    blocks = -(-((size[0] or 0) * 32 + (size[1] or 0)) // NAME_BLOCK_BYTES)
    if blocks <= 1:
        return images.join(F.broadcast(wanted), keys, how)
    part = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    found = [images.join(F.broadcast(wanted.where(part == i)), keys, how) for i in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def image_counts(
    names: DataFrame,
    images: DataFrame,
    params: DetectParams = DetectParams(),
    parallelism: int | None = None,
) -> ImageJobResult:
    """Circles per manifest line; a missing or unreadable image counts 0.

    ``images`` is the image table (``image_name, height, width, n_channels,
    data``), e.g. ``read_images`` of the folder or an ingested parquet copy.
    Each distinct image is analysed once however often it is listed; every
    listed line still gets its row.

    No exchange carries image bytes: the batch's names go to the images, and
    the stencil runs in the task that reads them.  Only if ``parallelism`` asks
    for it are images moved, dealt to that many tasks by their pixels.  Of several versions of a name
    one is picked, once, by a rule of its own (the latest ``ingested_at`` where
    the table has it, then the largest content hash), so sizes and pixels always
    come from the same version.  An image is keyed by ``xxhash64(image_name)``
    inside the detector; a collision check falls back to names.
    """
    spark = names.sparkSession
    stored = RoundTables(spark, "images")
    kept, rejects = split_manifest(names)
    listed = stored.write(kept.select("image_name").distinct(), "names")
    when = F.col("ingested_at") if "ingested_at" in images.columns else F.lit(None).cast("timestamp")
    # names first: only listed images are hashed, and none where ingest has done it
    versioned = rows_named(images, listed, ["image_name"])
    if "version" not in images.columns:
        versioned = versioned.withColumn("version", F.xxhash64("data"))
    # one row per (name, version), then the pick; sizes only, no bytes
    versions = versioned.groupBy("image_name", "version").agg(
        F.max(when).alias("at"), F.count(F.lit(1)).alias("copies"), F.max("height").alias("height"),
        F.max("width").alias("width"),
    )
    meta = stored.write(
        versions.groupBy("image_name").agg(
            F.max(F.struct("at", "version", "copies", "height", "width")).alias("m"), F.count(F.lit(1)).alias("versions")
        ).select(
            "image_name", F.xxhash64("image_name").alias("image_key"), "m.version", "m.copies", "m.height", "m.width", "versions"
        ),
        "meta",
    )
    checks = meta.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("image_key").alias("keys"), F.max("copies").alias("copies"),
        F.max("versions").alias("versions"),
    ).first()
    key = "image_key" if checks.n == checks["keys"] else "image_name"  # two names share a hash: exact identities
    wanted = versioned
    if parallelism:
        area = F.greatest(F.lit(1), F.col("height").cast("long") * F.col("width")).alias("size")
        parts = deal_by_size(meta.select("image_name", "version", area), ["image_name", "version"], parallelism)
        dealt = rows_named(versioned, stored.write(parts, "parts"), ["image_name", "version"], "inner")
        wanted = dealt.repartitionById(parallelism, F.col("part")).drop("part")
    elif (checks.versions or 0) > 1:
        wanted = rows_named(versioned, meta.select("image_name", "version"), ["image_name", "version"])
    wanted = wanted.withColumn("image_key", F.xxhash64("image_name"))
    status = meta.select(
        "image_name",
        F.col(key).alias("detector_id"),
        F.when(F.col("height") > 0, F.lit("ok")).otherwise(F.lit("unreadable")).alias("status"),
    )
    detection = detect_circles_in_images(
        wanted, key, params, dims=image_dims(meta, key), repeated=(checks.copies or 0) > 1
    )
    counts = detection.counts.withColumnRenamed("image_id", "detector_id")
    per_image = status.join(counts, "detector_id", "left").select("image_name", "status", "n")
    per_line = (
        kept.join(per_image, "image_name", "left")
        .select(
            "image_name",
            "feature",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
            F.coalesce("status", F.lit("missing")).alias("status"),
        )
    )
    return ImageJobResult(per_line, rejects, detection, meta.withColumn("detector_id", F.col(key)), wanted)


def write_rejects(result: ImageJobResult, output: str, batch_id: int | None) -> str:
    """Manifest lines that gave no count and why: ``image_name, reason`` (no type
    separator, missing, unreadable), one folder per micro-batch."""
    failed = result.per_line.where(F.col("status") != "ok").select("image_name", F.col("status").alias("reason"))
    path = os.path.join(output, REJECTS_FOLDER, f"batch_id={batch_id if batch_id is not None else 'batch'}")
    result.rejects.unionByName(failed).write.mode("overwrite").parquet(path)
    return path


def write_crops(result: ImageJobResult, output: str, batch_id: int | None) -> str:
    """K-3: one row per accepted circle with its clamped box and crop name.

    ``crops(image_name, type, k, a, b, r, x0, y0, x1, y1, crop_name)`` as
    parquet, one folder per micro-batch (overwritten on replay).  Empty
    boxes are kept (the circle still counts).  The content of the crops is
    written by ``write_crop_pixels``, as pixel rows instead of encoded files.
    """
    det = result.detection
    names = result.images.select(F.col("detector_id").alias("image_id"), "image_name")
    circles = det.circles.join(names, "image_id")
    boxes = crop_boxes(circles, image_dims(result.images, "detector_id"))
    rows = boxes.join(circles.select("image_id", "image_name", "k", "a", "b", "r"), ["image_id", "k"]).select(
        "image_name",
        F.substring_index("image_name", "_", 1).alias("type"),
        "k", "a", "b", "r", "x0", "y0", "x1", "y1",
        crop_name().alias("crop_name"),
    )
    path = os.path.join(output, CROPS_FOLDER, f"batch_id={batch_id if batch_id is not None else 'batch'}")
    rows.write.mode("overwrite").parquet(path)
    return path


def write_crop_pixels(result: ImageJobResult, output: str, batch_id: int | None) -> str:
    """K-3, content: ``image_name, k, x, y, v`` of every pixel of every crop, cut
    from the image bytes; one folder per micro-batch."""
    dims = image_dims(result.images, "detector_id")
    boxes = crop_boxes(result.detection.circles, dims)
    names = result.images.select(F.col("detector_id").alias("image_id"), "image_name")
    named = boxes.join(names, "image_id").drop("image_id").withColumnRenamed("image_name", "image_id")
    pixels = cut_boxes(result.found, named, "image_name").withColumnRenamed("image_id", "image_name").distinct()
    path = os.path.join(output, CROPS_FOLDER + "-pixels", f"batch_id={batch_id if batch_id is not None else 'batch'}")
    pixels.write.mode("overwrite").parquet(path)
    return path


def write_crop_values(result: ImageJobResult, output: str, batch_id: int | None) -> str:
    """K-3, content as one value per crop: ``image_name, k, width, height, data``
    (gray bytes, row after row); one folder per micro-batch."""
    boxes = crop_boxes(result.detection.circles, image_dims(result.images, "detector_id"))
    names = result.images.select(F.col("detector_id").alias("image_id"), "image_name")
    named = boxes.join(names, "image_id").drop("image_id").withColumnRenamed("image_name", "image_id")
    values = cut_values(result.found, named, "image_name").withColumnRenamed("image_id", "image_name")
    path = os.path.join(output, CROPS_FOLDER + "-values", f"batch_id={batch_id if batch_id is not None else 'batch'}")
    values.dropDuplicates(["image_name", "k"]).write.mode("overwrite").parquet(path)
    return path
