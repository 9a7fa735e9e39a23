"""Synthetic scenes derived from a table: one small gray image per row.

Each supplier row becomes a 60x45 image with one white disc on black; the
disc's centre and radius follow from the row's keys, so the number of
images (and pixels) grows with the scale factor.  Two geometries:

* ``nation_scenes``: the disc comes from the supplier's nation row
  (k = n_nationkey, g = n_regionkey), 60x45, white on black;
* ``supplier`` rows alone (``mixed_*`` below): sizes from 12x10 to 40x270, three
  discs of which some are faint, ramped or cut by the border, over a noisy
  ground, in three unequal channels.

A bare ``nation`` table (25 rows at every scale) also works, for fixtures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.functions.image import gray_of

# A scene is thousands of pixels while its table row is a few bytes, so a single
# input split can hold every scene: rows are dealt to tasks of this many before
# they are drawn.
SCENES_PER_TASK = 250
# Bytes of drawn images per frame: bounds Python memory whatever the batch.
RENDER_BYTES = 4 << 20

# Fixed scene parameters (shared with the SQL oracle).
SCENE_WIDTH = 60
SCENE_HEIGHT = 45
WHITE = 255


# Mixed scenes: integer expressions over s_suppkey (s) and s_nationkey (n), in the
# SQL that Spark and the oracle share; x, y are pixel coordinates.
MIXED_WIDTH = "CASE WHEN s % 23 = 7 THEN 12 WHEN s % 37 = 11 THEN 40 ELSE 44 + (s * 7) % 23 END"
MIXED_HEIGHT = "CASE WHEN s % 23 = 7 THEN 10 + s % 4 WHEN s % 37 = 11 THEN 270 ELSE 32 + (s * 5) % 19 END"
MIXED_DISCS = 3


def mixed_disc(j: int) -> dict[str, str]:
    """Centre, radius and brightness of disc ``j`` (centres may lie outside)."""
    return {
        "cx": f"(s * 13 + {29 * j} + n * 3) % (width + 6) - 3",
        "cy": f"(s * 7 + {17 * j} + n * 5) % (height + 6) - 3",
        "rad": f"3 + (s + {2 * j} + n) % 5",
        "amp": f"CASE (s + {j}) % 4 WHEN 0 THEN 200 WHEN 1 THEN 90 WHEN 2 THEN 26 ELSE 150 END",
    }


def mixed_level() -> str:
    """Brightness at x, y: ground, noise, and the discs that cover it (the second ramps along x)."""
    level = "20 + (s % 3) * 10 + ((x * 7919 + y * 104729 + s * 1299709) % 1009) % 6"
    for j in range(MIXED_DISCS):
        ramp = f" + 3 * (x - cx{j})" if j == 1 else ""
        level += (
            f" + CASE WHEN (x - cx{j}) * (x - cx{j}) + (y - cy{j}) * (y - cy{j}) <= rad{j} * rad{j}"
            f" THEN amp{j}{ramp} ELSE 0 END"
        )
    return f"greatest(0, least(255, {level}))"


MIXED_GREEN = "least(255, v + (x % 3) * 2)"
MIXED_BLUE = "greatest(0, v - y % 4)"


def _dealt(rows: DataFrame) -> DataFrame:
    """The scene rows in tasks of about ``SCENES_PER_TASK``."""
    tasks = -(-rows.count() // SCENES_PER_TASK)
    return rows.repartition(tasks) if tasks > 1 else rows


def _is_mixed(rows: DataFrame) -> bool:
    return "s_suppkey" in rows.columns and "n_nationkey" not in rows.columns


def _mixed(rows: DataFrame) -> DataFrame:
    """``s, width, height`` and the discs' columns per supplier row."""
    base = rows.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("bigint").alias("n"))
    sized = base.withColumns({"width": F.expr(MIXED_WIDTH).cast("int"), "height": F.expr(MIXED_HEIGHT).cast("int")})
    return sized.withColumns(
        {f"{c}{j}": F.expr(e).cast("int") for j in range(MIXED_DISCS) for c, e in mixed_disc(j).items()}
    )


def mixed_pixels(rows: DataFrame) -> DataFrame:
    """Gray pixel table of the mixed scenes, as column expressions."""
    px = _dealt(_mixed(rows)).select("*", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    px = px.withColumns({"x": F.pmod("i", "width").cast("int"), "y": F.floor(F.col("i") / F.col("width")).cast("int")})
    v = px.select("s", "x", "y", F.expr(mixed_level()).cast("int").alias("v"))
    return v.select(
        F.col("s").alias("image_id"), "x", "y", gray_of("v", F.expr(MIXED_GREEN), F.expr(MIXED_BLUE)).alias("v")
    )


def _framed(batches, size):
    """The batches cut where their images (``size`` bytes each) pass ``RENDER_BYTES``."""
    for pdf in batches:
        frame = (size(pdf).cumsum() // RENDER_BYTES).to_numpy()
        cuts = np.flatnonzero(np.diff(frame, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(pdf))):
            yield pdf.iloc[lo:hi]


def _render_mixed(batches):
    """The same scenes drawn with numpy, as BGR bytes."""
    for pdf in _framed(batches, lambda pdf: 3 * pdf["width"].astype("int64") * pdf["height"]):
        data = []
        for row in pdf.itertuples(index=False):
            ys, xs = np.mgrid[0:row.height, 0:row.width].astype(np.int64)
            v = 20 + (row.s % 3) * 10 + ((xs * 7919 + ys * 104729 + row.s * 1299709) % 1009) % 6
            for j in range(MIXED_DISCS):
                cx, cy, rad, amp = (getattr(row, f"{c}{j}") for c in ("cx", "cy", "rad", "amp"))
                inside = (xs - cx) ** 2 + (ys - cy) ** 2 <= rad * rad
                v += inside * (amp + (3 * (xs - cx) if j == 1 else 0))
            v = np.clip(v, 0, 255)
            bgr = np.stack([np.maximum(0, v - ys % 4), np.minimum(255, v + (xs % 3) * 2), v], axis=2)
            data.append(bgr.astype(np.uint8).tobytes())
        yield pd.DataFrame({
            "image_id": pdf["s"], "height": pdf["height"], "width": pdf["width"], "n_channels": np.int32(3), "data": data,
        })


def _keys(df: DataFrame) -> tuple[str, str, str]:
    """(image id, position key 0..24, size key 0..4) columns of a scene table."""
    cols = set(df.columns)
    if {"s_suppkey", "n_nationkey", "n_regionkey"} <= cols:
        return "s_suppkey", "n_nationkey", "n_regionkey"
    if "n_nationkey" in cols:
        return "n_nationkey", "n_nationkey", "n_regionkey"
    if "s_suppkey" in cols:
        return "s_suppkey", "", ""  # mixed scenes have their own rules
    raise ValueError("scenes are derived from nation or supplier rows")


def nation_scenes(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """One scene per supplier, shaped by its nation row (grows with the data)."""
    return supplier.select("s_suppkey", "s_nationkey").join(
        nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")
    )


def scene_discs(rows: DataFrame) -> DataFrame:
    """``image_id, cx, cy, radius`` for each row shaped by a nation:
    k = n_nationkey, g = n_regionkey; centre (20 + 20k div 25, 15 + 3g), radius
    4 + g % 3.
    """
    ident, k, g = _keys(rows)
    return rows.select(
        F.col(ident).alias("image_id"),
        F.expr(f"20 + (({k}) * 20) div 25").cast("int").alias("cx"),
        F.expr(f"15 + ({g}) * 3").cast("int").alias("cy"),
        F.expr(f"4 + ({g}) % 3").cast("int").alias("radius"),
    )


def scene_dims(rows: DataFrame, width: int = SCENE_WIDTH, height: int = SCENE_HEIGHT) -> DataFrame:
    if _is_mixed(rows):
        return _mixed(rows).select(F.col("s").alias("image_id"), "width", "height")
    return rows.select(
        F.col(_keys(rows)[0]).alias("image_id"),
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
    )


def scene_pixels(rows: DataFrame, width: int = SCENE_WIDTH, height: int = SCENE_HEIGHT) -> DataFrame:
    """Pixel table ``image_id, x, y, v`` with ``v = 255`` inside the disc (or the
    mixed scenes' gray levels)."""
    if _is_mixed(rows):
        return mixed_pixels(rows)
    discs = scene_discs(rows)
    px = _dealt(discs).select("*", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i"))
    x = F.pmod("i", F.lit(width))
    y = F.floor(F.col("i") / F.lit(width))
    dx, dy, r = x - F.col("cx"), y - F.col("cy"), F.col("radius")
    inside = dx * dx + dy * dy <= r * r
    return px.select(
        "image_id",
        x.cast("int").alias("x"),
        y.cast("int").alias("y"),
        F.when(inside, F.lit(WHITE)).otherwise(F.lit(0)).alias("v"),
    )


def scene_names(rows: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Manifest-style names ``<region>_<image id>.png`` (type = region name).

    ``rows`` is the scene table (``nation`` itself or ``supplier``).
    """
    ident = _keys(rows)[0]
    nk = "n_nationkey" if ident == "n_nationkey" else "s_nationkey"
    with_region = rows.select(F.col(ident).alias("image_id"), F.col(nk).alias("nk")).join(
        nation.select(F.col("n_nationkey").alias("nk"), "n_regionkey"), "nk"
    ).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return with_region.select(
        "image_id",
        F.concat(F.lower("r_name"), F.lit("_"), F.col("image_id").cast("string"), F.lit(".png")).alias("image_name"),
    )


def _render(batches, width: int, height: int):
    ys, xs = np.mgrid[0:height, 0:width]
    for pdf in _framed(batches, lambda pdf: pd.Series(3 * width * height, index=pdf.index)):
        data = []
        for cx, cy, r in zip(pdf["cx"], pdf["cy"], pdf["radius"]):
            disc = ((xs - cx) ** 2 + (ys - cy) ** 2 <= r * r).astype(np.uint8) * WHITE
            data.append(np.repeat(disc[:, :, None], 3, axis=2).tobytes())   # 3 equal channels
        yield pd.DataFrame({
            "image_id": pdf["image_id"], "height": height, "width": width, "n_channels": 3, "data": data,
        })


def scene_images(rows: DataFrame, width: int = SCENE_WIDTH, height: int = SCENE_HEIGHT) -> DataFrame:
    """The same scenes as decoded image rows (``image_id, height, width,
    n_channels, data``), the shape the ``image`` source produces, so the
    image-file path of the detector can run on table-derived input."""
    mixed = _is_mixed(rows)
    discs = _dealt(_mixed(rows) if mixed else scene_discs(rows))
    schema = T.StructType([
        T.StructField("image_id", discs.schema["s" if mixed else "image_id"].dataType),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("n_channels", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ])

    def render(batches):
        return _render_mixed(batches) if mixed else _render(batches, width, height)

    return discs.mapInPandas(render, schema)
