"""Crops of accepted circles: boxes (O-19), names (O-20), pixel content (O-35)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecount.functions.image import clamp
from grovecount.operators.stencil import ID
from grovecount.plans.lineage import guard_estimate_broadcast


def crop_boxes(circles: DataFrame, dims: DataFrame, id_col: str = ID) -> DataFrame:
    """``image_id, k, x0, y0, x1, y1``: ``[a-r, a+r] x [b-r, b+r]`` clamped to
    ``[0, width] x [0, height]`` (end-exclusive when cutting pixels)."""
    j = circles.join(dims, id_col)
    return j.select(
        id_col, "k",
        clamp(F.col("a") - F.col("r"), 0, F.col("width")).alias("x0"),
        clamp(F.col("b") - F.col("r"), 0, F.col("height")).alias("y0"),
        clamp(F.col("a") + F.col("r"), 0, F.col("width")).alias("x1"),
        clamp(F.col("b") + F.col("r"), 0, F.col("height")).alias("y1"),
    )


def crop_name(image_name: str = "image_name", k: str = "k"):
    """O-20: ``<type>_<image name>_<k>.png``.  The image's extension stays in, so
    ``a_1.png`` and ``a_1.jpg`` give different names (the original numbers crops
    with a per-task counter, which collides)."""
    parts = F.concat_ws("_", F.substring_index(image_name, "_", 1), F.col(image_name), F.col(k).cast("string"))
    return F.concat(parts, F.lit(".png"))


def crop_pixels(boxes: DataFrame, pixels: DataFrame, id_col: str = ID) -> DataFrame:
    """O-35: ``image_id, k, x, y, v`` of every pixel inside each box.

    Each box is expanded to its own coordinates and equi-joined on
    ``(image_id, x, y)``: the join emits exactly the output rows, with no
    box x pixel pairs to filter afterwards.  Empty boxes yield nothing.
    """
    cells = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(
        id_col, "k",
        F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y0", "y1",
    ).select(id_col, "k", "x", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    # the pixel table's estimate is tiny (exploded from a few rows): never broadcast it by estimate
    return cells.join(guard_estimate_broadcast(pixels), [id_col, "x", "y"]).select(id_col, "k", "x", "y", "v")
