"""Edge candidates straight from image bytes, band by band (the dense part of
O-13, O-23, O-14/O-15 and the neighbour comparison of O-24).

The DataFrame operators in ``stencil.py`` hold one row per pixel and shuffle
that table three times.  For image files the same integers are computed here,
inside the task that decodes the image, over horizontal bands with a 4-row
halo (blur 2 + gradient 1 + neighbour 1), so memory is bounded by
``band x width`` whatever the image size.  Only pixels above the weak
threshold leave the task, as ``suppression_inputs`` rows.  Everything that
couples pixels beyond a 3x3 neighbourhood (in-place suppression chains,
hysteresis, voting, acceptance) stays in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grovecount.functions.image import BLUR_DIVISOR, BLUR_WEIGHTS, RADIUS_MAX_DIVISOR, RADIUS_MIN_DIVISOR
from grovecount.sources.images import _gray, java_gray_levels, readable

HALO = 4
DEFAULT_BAND = 256
EMIT_ROWS = 200_000  # candidate rows per emitted frame

# neighbour scanned before (p) and after (q) the pixel, per direction bin 0..4
# (bin 4 is bin 0's axis); see operators/thinning.py
_P_DX, _P_DY = np.array([-1, -1, 0, -1, -1]), np.array([0, -1, -1, 1, 0])
_Q_DX, _Q_DY = np.array([1, 1, 0, 1, 1]), np.array([0, 1, 1, -1, 0])


def _weighted_rows(a: np.ndarray, rows: np.ndarray, first: int, height: int) -> np.ndarray:
    """Binomial 1 4 6 4 1 sum over image rows ``rows +- 2`` (clamped to the
    image); ``a`` holds image rows ``first ..``."""
    half = len(BLUR_WEIGHTS) // 2
    out = np.zeros((len(rows), a.shape[1]), dtype=np.int64)
    for k, wk in enumerate(BLUR_WEIGHTS):
        taps = np.clip(rows + k - half, 0, height - 1) - first
        out += wk * np.take(a, taps, axis=0)
    return out


def _weighted_cols(a: np.ndarray) -> np.ndarray:
    """Binomial 1 4 6 4 1 sum along each row, edge columns repeated."""
    half = len(BLUR_WEIGHTS) // 2
    w = a.shape[1]
    out = np.zeros(a.shape, dtype=np.int64)
    cols = np.arange(w)
    for k, wk in enumerate(BLUR_WEIGHTS):
        out += wk * np.take(a, np.clip(cols + k - half, 0, w - 1), axis=1)
    return out


def band_candidates(
    gray: np.ndarray, low: int, y0: int, y1: int, first: int = 0, height: int | None = None
) -> dict[str, np.ndarray]:
    """Candidate rows for image rows ``y0 .. y1-1``.

    ``gray`` holds image rows ``first ..`` (the whole image by default) of an
    image ``height`` rows tall; only rows ``y0-4 .. y1+3`` are read, and the
    borders repeat the true image edge.
    """
    h = gray.shape[0] + first if height is None else height
    w = gray.shape[1]
    empty = {k: np.zeros(0, dtype=np.int32) for k in ("x", "y", "mag2", "px", "py")}
    empty.update(q_kills=np.zeros(0, dtype=bool), p_gt=np.zeros(0, dtype=bool))
    if h < 3 or w < 3:
        return empty
    g_lo, g_hi = max(0, y0 - HALO), min(h, y1 + HALO)
    horiz = _weighted_cols(gray[g_lo - first:g_hi - first].astype(np.int64))
    b_lo, b_hi = max(0, y0 - 2), min(h, y1 + 2)              # blurred rows needed
    blur = _weighted_rows(horiz, np.arange(b_lo, b_hi), g_lo, h) // BLUR_DIVISOR
    m_lo, m_hi = max(0, y0 - 1), min(h, y1 + 1)              # gradient rows needed
    mag = np.zeros((m_hi - m_lo, w), dtype=np.int64)
    gxs = np.zeros_like(mag)
    gys = np.zeros_like(mag)
    for r in range(max(1, m_lo), min(h - 1, m_hi)):
        row = blur[r - b_lo]
        gx = row[2:] - row[:-2]
        gy = blur[r + 1 - b_lo][1:-1] - blur[r - 1 - b_lo][1:-1]
        gxs[r - m_lo, 1:-1], gys[r - m_lo, 1:-1] = gx, gy
        mag[r - m_lo, 1:-1] = gx * gx + gy * gy

    t = low * low
    rs, xs = np.nonzero(mag > t)
    ys = rs + m_lo
    inside = (ys >= y0) & (ys < y1)
    rs, xs, ys = rs[inside], xs[inside], ys[inside]
    m = mag[rs, xs]
    angle = np.arctan2(gys[rs, xs].astype(np.float64), gxs[rs, xs].astype(np.float64))
    folded = np.where(angle >= 0, angle, angle + math.pi)
    d = np.floor(folded / (math.pi / 4) + 0.5).astype(np.int64)
    p_dx, p_dy = _P_DX[d], _P_DY[d]
    q_dx, q_dy = _Q_DX[d], _Q_DY[d]
    p_mag = mag[rs + p_dy, xs + p_dx]
    q_mag = mag[rs + q_dy, xs + q_dx]
    return {
        "x": xs.astype(np.int32),
        "y": ys.astype(np.int32),
        "mag2": m.astype(np.int32),
        "q_kills": q_mag > m,
        "p_gt": p_mag > m,
        "px": (xs + p_dx).astype(np.int32),
        "py": (ys + p_dy).astype(np.int32),
    }


def _candidate_rows(batches: Iterator[pa.RecordBatch], low: int, band: int, levels: np.ndarray):
    """One batch per ``EMIT_ROWS`` candidates or so: memory follows a band and
    that budget; the image bytes are read where Arrow holds them."""
    for batch in batches:
        height, width, channels = (batch.column(c).to_numpy() for c in ("height", "width", "n_channels"))
        ids, data = batch.column("image_id"), batch.column("data")
        held, size = [], 0
        for at in range(batch.num_rows):
            h, w, c = int(height[at]), int(width[at]), int(channels[at])
            buf = data[at].as_buffer()
            radii = max(1, min(h, w) // RADIUS_MIN_DIVISOR), max(h, w) // RADIUS_MAX_DIVISOR
            for y0 in range(0, h, band):
                y1 = min(h, y0 + band)
                g_lo, g_hi = max(0, y0 - HALO), min(h, y1 + HALO)
                # gray of this band and its halo only, from a view of the decoded bytes
                rows = np.frombuffer(buf, dtype=np.uint8, count=(g_hi - g_lo) * w * c, offset=g_lo * w * c)
                gray = _gray(rows, c, levels).reshape(-1, w)
                cols = band_candidates(gray, low, y0, y1, first=g_lo, height=h)
                if len(cols["x"]):
                    held.append((at, radii, cols))
                    size += len(cols["x"])
                if size >= EMIT_ROWS:
                    yield _emitted(ids, held)
                    held, size = [], 0
        if held:
            yield _emitted(ids, held)


def _emitted(ids: pa.Array, held: list) -> pa.RecordBatch:
    n = [len(cols["x"]) for _, _, cols in held]
    out = {"image_id": ids.take(pa.array(np.repeat([at for at, _, _ in held], n)))}
    out |= {c: pa.array(np.concatenate([cols[c] for _, _, cols in held])) for c in held[0][2]}
    for i, c in enumerate(("r_min", "r_max")):
        out[c] = pa.array(np.repeat([radii[i] for _, radii, _ in held], n).astype(np.int32))
    order = ["image_id", "x", "y", "mag2", "q_kills", "p_gt", "px", "py", "r_min", "r_max"]
    return pa.RecordBatch.from_arrays([out[c] for c in order], order)


def suppression_inputs_from_images(
    images: DataFrame, low: int, id_col: str = "image_name", band: int = DEFAULT_BAND
) -> DataFrame:
    """``suppression_inputs`` rows (``image_id, x, y, mag2, q_kills, p_gt, px, py``)
    computed from image bytes without a dense pixel table, each with its image's
    radius range (``r_min, r_max``; the decoder knows the size, so voting needs
    no join for it)."""
    src = readable(images).select(images[id_col].alias("image_id"), "height", "width", "n_channels", "data")
    schema = T.StructType([
        T.StructField("image_id", src.schema["image_id"].dataType),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("mag2", T.IntegerType()),
        T.StructField("q_kills", T.BooleanType()),
        T.StructField("p_gt", T.BooleanType()),
        T.StructField("px", T.IntegerType()),
        T.StructField("py", T.IntegerType()),
        T.StructField("r_min", T.IntegerType()),
        T.StructField("r_max", T.IntegerType()),
    ])
    levels = java_gray_levels(images.sparkSession)

    def run(batches):
        return _candidate_rows(batches, low, band, levels)

    return src.mapInArrow(run, schema)
