"""Pixel table -> suppression inputs in one shuffle (O-23, O-14, O-15 and the
neighbour comparison of O-24).

``stencil.py`` reads neighbours with windows and sorts the pixel table once per
change of axis.  Here a pixel goes to its tile and, within 4 pixels of a border
(blur 2 + gradient 1 + neighbour 1), to the next one, and the task that holds a
tile computes the same integers in numpy.  Only pixels above the weak threshold
leave it.  Neighbours are neighbours in the order of a row or a column, as
``lag`` and ``lead`` see them, so repeated pixels count as they do there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.functions.image import BLUR_DIVISOR, BLUR_WEIGHTS
from grovecount.operators import tiles
from grovecount.operators.stencil import ID

HALO = 4
STENCIL_TILE = 256
PIXEL_ROWS = 100_000  # pixels of whole tiles handled together


def suppression_inputs_from_pixels(pixels: DataFrame, low: int, id_col: str = ID, tile: int = STENCIL_TILE) -> DataFrame:
    """Rows of ``suppression_inputs(gradient(blur(pixels)), low)``.  ``pixels`` holds
    every pixel of an image, from ``x = y = 0``."""
    def reach(c):
        first = F.greatest(F.lit(0), F.floor((F.col(c) - HALO) / tile).cast("int"))
        return F.explode(F.sequence(first, F.floor((F.col(c) + HALO) / tile).cast("int")))

    placed = pixels.select(id_col, "x", "y", "v", reach("x").alias("tx")).withColumn("ty", reach("y"))
    placed = placed.repartition(id_col, "tx", "ty").sortWithinPartitions(id_col, "tx", "ty", "y", "x")
    schema = T.StructType([
        pixels.schema[id_col],
        *(T.StructField(c, T.IntegerType()) for c in ("x", "y", "mag2")),
        *(T.StructField(c, T.BooleanType()) for c in ("q_kills", "p_gt")),
        *(T.StructField(c, T.IntegerType()) for c in ("px", "py")),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches, [id_col, "tx", "ty"], PIXEL_ROWS):
            yield _candidates(table, low, id_col, tile)

    return placed.mapInArrow(run, schema)


class _Lines:
    """Rows of consecutive groups (image rows or columns) and their neighbours."""

    def __init__(self, *keys: np.ndarray):
        n = len(keys[0])
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        start = np.flatnonzero(new)
        line = np.cumsum(new) - 1
        self.at = np.arange(n)
        self.first = start[line]
        self.last = (np.append(start[1:], n) - 1)[line]

    def clamped(self, k: int) -> np.ndarray:
        return np.clip(self.at + k, self.first, self.last)

    def weighted(self, v: np.ndarray) -> np.ndarray:
        half = len(BLUR_WEIGHTS) // 2
        return sum(wk * v[self.clamped(k - half)] for k, wk in enumerate(BLUR_WEIGHTS))

    def before(self, v: np.ndarray) -> np.ndarray:
        return np.where(self.at > self.first, v[self.clamped(-1)], 0)

    def after(self, v: np.ndarray) -> np.ndarray:
        return np.where(self.at < self.last, v[self.clamped(1)], 0)

    def inner(self) -> np.ndarray:
        return (self.at > self.first) & (self.at < self.last)


class _Cells:
    """The distinct pixels of rows in column order, and those one line up and down."""

    def __init__(self, order: np.ndarray, x: np.ndarray, y: np.ndarray):
        new = np.zeros(len(x), dtype=bool)
        new[:1] = True
        new[1:] = (order[1:] != order[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.start = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        o, cx, cy = order[self.start], x[self.start], y[self.start]
        self.joined = (o[1:] == o[:-1]) & (cx[1:] == cx[:-1]) & (cy[1:] == cy[:-1] + 1)

    def up_down(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of the pixel above and of the one below, 0 where there is none."""
        top = np.maximum.reduceat(v, self.start)
        up, down = np.zeros_like(top), np.zeros_like(top)
        up[1:] = np.where(self.joined, top[:-1], 0)
        down[:-1] = np.where(self.joined, top[1:], 0)
        return up[self.of], down[self.of]


def _candidates(table: pa.Table, low: int, id_col: str, tile: int) -> pa.RecordBatch:
    """Suppression inputs of the whole tiles in ``table``, sorted by tile, y, x."""
    order = np.cumsum(tiles.starts(table, [id_col, "tx", "ty"])) - 1
    x, y, v = (tiles.numbers(table, c) for c in ("x", "y", "v"))
    rows = _Lines(order, y)
    by_col = np.lexsort((y, x, order))  # stable: repeated pixels keep their order
    cols = _Lines(order[by_col], x[by_col])
    back = np.empty_like(by_col)
    back[by_col] = np.arange(len(by_col))

    blurred = cols.weighted(rows.weighted(v)[by_col]) // BLUR_DIVISOR
    gy = (cols.after(blurred) - cols.before(blurred))[back]
    inner = cols.inner()[back] & rows.inner()
    blurred = blurred[back]
    gx = rows.after(blurred) - rows.before(blurred)
    mag = np.where(inner, gx * gx + gy * gy, 0)
    # comparisons are with neighbours above the weak threshold only
    mag[mag <= low * low] = 0
    left, right = rows.before(mag), rows.after(mag)

    cells = _Cells(order[by_col], x[by_col], y[by_col])
    (cu, cd), (lu, ld), (ru, rd) = (
        tuple(side[back] for side in cells.up_down(m[by_col])) for m in (mag, left, right)
    )
    own = (x // tile == tiles.numbers(table, "tx")) & (y // tile == tiles.numbers(table, "ty"))
    at = np.flatnonzero((mag > 0) & own)
    angle = np.arctan2(gy[at].astype(np.float64), gx[at].astype(np.float64))
    folded = np.where(angle >= 0, angle, angle + math.pi)
    bins = np.floor(folded / (math.pi / 4) + 0.5).astype(np.int64) % 4  # bin 4 is bin 0's axis
    m, xs, ys = mag[at], x[at], y[at]
    # p and q per direction bin: see thinning.py
    p = np.choose(bins, [left[at], lu[at], cu[at], ld[at]])
    q = np.choose(bins, [right[at], rd[at], cd[at], ru[at]])
    columns = {
        id_col: table.column(id_col).combine_chunks().take(pa.array(at)),
        "x": pa.array(xs.astype(np.int32)),
        "y": pa.array(ys.astype(np.int32)),
        "mag2": pa.array(m.astype(np.int32)),
        "q_kills": pa.array(q > m),
        "p_gt": pa.array(p > m),
        "px": pa.array((xs + np.array([-1, -1, 0, -1])[bins]).astype(np.int32)),
        "py": pa.array((ys + np.array([0, -1, -1, 1])[bins]).astype(np.int32)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
