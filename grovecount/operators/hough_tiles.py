"""Hough voting in dense accumulators per tile of centres (O-26, O-28, O-08).

An edge pixel goes to the tiles its votes can fall into (at most four while a
tile is wider than the circles), and the task that holds a tile of centres
counts all votes for them in a numpy array, one radius after the other.  No
vote is ever a row: what is shuffled are edge pixels, and a cell's count is
complete inside its task, so cells under the threshold never leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.functions.image import DEFAULT_STEPS, DEFAULT_THRESHOLD
from grovecount.operators.hough import radius_ranges
from grovecount.operators.stencil import ID
from grovecount.operators.tiles import numbers, starts, whole_tiles

CENTRE_TILE = 256
CELLS = 1 << 20  # cells counted at once: several small tiles, or one whole tile
PAIRS = 1 << 19  # edge x offset pairs held at once


def unit_circle(spark: SparkSession, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine of the ``steps`` angles, from Spark's own functions (the
    products with a radius are then the same doubles as in ``circle_offsets``)."""
    angle = F.lit(2.0 * math.pi) * F.col("id") / F.lit(steps)
    rows = spark.range(0, steps, 1, 1).select("id", F.cos(angle), F.sin(angle)).collect()
    table = np.array(sorted(rows), dtype=np.float64).reshape(-1, 3)
    return table[:, 1], table[:, 2]


def offsets_of(r: int, cos: np.ndarray, sin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """O-18 for one radius: distinct ``dx, dy`` and how often each occurs."""
    raw = np.stack([np.trunc(r * cos), np.trunc(r * sin)], axis=1).astype(np.int64)
    each, weight = np.unique(raw, axis=0, return_counts=True)
    return each[:, 0], each[:, 1], weight


def smallest_count(steps: int, threshold: float) -> int:
    """The least number of votes that O-08 keeps."""
    return next((v for v in range(1, steps + 1) if v / float(steps) >= threshold), steps + 1)


def edges_by_tile(edges: DataFrame, tile: int, id_col: str) -> DataFrame:
    """Edge pixels at every tile of centres they may vote for, a tile's rows together."""
    def reach(c):
        return F.explode(F.sequence(*(F.floor((F.col(c) + s * F.col("r_max")) / tile).cast("int") for s in (-1, 1))))

    placed = (
        edges.where(F.col("r_max") >= F.col("r_min"))
        .select(id_col, "x", "y", "r_min", "r_max", reach("x").alias("tx"))
        .withColumn("ty", reach("y"))
    )
    return placed.repartition(id_col, "tx", "ty").sortWithinPartitions(id_col, "tx", "ty")


class _Boxes:
    """The cells of some tiles: per tile the box its votes can fall into, one
    after the other in a flat array."""

    def __init__(self, first: np.ndarray, cols: dict[str, np.ndarray], tile: int):
        def span(c: str, t: str) -> tuple[np.ndarray, np.ndarray]:
            base = cols[t][first] * tile
            lo = np.maximum(base, np.minimum.reduceat(cols[c] - cols["r_max"], first))
            hi = np.minimum(base + tile - 1, np.maximum.reduceat(cols[c] + cols["r_max"], first))
            return lo, hi - lo + 1

        self.x0, self.w = span("x", "tx")
        self.y0, self.h = span("y", "ty")
        self.cells = self.w * self.h


def _groups(cells: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of tiles of about ``limit`` cells (a tile is never split)."""
    total = np.cumsum(cells)
    lo = 0
    while lo < len(cells):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield lo, hi
        lo = hi


def _votes(table: pa.Table, id_col: str, tile: int, cos, sin, least: int, cells: int, pairs: int):
    """Batches ``id, a, b, r, votes`` of the whole tiles in ``table``."""
    cols = {c: numbers(table, c) for c in ("x", "y", "r_min", "r_max", "tx", "ty")}
    new = starts(table, [id_col, "tx", "ty"])
    first = np.flatnonzero(new)
    order = np.cumsum(new) - 1
    boxes = _Boxes(first, cols, tile)
    ids = table.column(id_col).combine_chunks().take(pa.array(first))
    ends = np.append(first[1:], table.num_rows)
    for lo, hi in _groups(boxes.cells, cells):
        rows = slice(first[lo], ends[hi - 1])
        base = np.concatenate([[0], np.cumsum(boxes.cells[lo:hi])])
        r_min, r_max, of = cols["r_min"][rows], cols["r_max"][rows], order[rows] - lo
        x = cols["x"][rows] - boxes.x0[lo:hi][of]
        y = cols["y"][rows] - boxes.y0[lo:hi][of]
        for r in range(int(r_min.min()), int(r_max.max()) + 1):
            use = np.flatnonzero((r_min <= r) & (r <= r_max))
            dx, dy, weight = offsets_of(r, cos, sin)
            counts = np.zeros(base[-1], dtype=np.int64)
            step = max(1, pairs // len(dx))
            for at in range(0, len(use), step):
                part = use[at : at + step]
                t = of[part]
                w, h = boxes.w[lo:hi][t], boxes.h[lo:hi][t]
                a, b = x[part, None] - dx, y[part, None] - dy
                here = (a >= 0) & (a < w[:, None]) & (b >= 0) & (b < h[:, None])
                cell = (base[t][:, None] + b * w[:, None] + a)[here]
                votes = np.broadcast_to(weight, here.shape)[here]
                low = int(cell.min()) if len(cell) else 0
                part_counts = np.bincount(cell - low, weights=votes).astype(np.int64)
                counts[low : low + len(part_counts)] += part_counts
            hit = np.flatnonzero(counts >= least)
            if not len(hit):
                continue
            t = np.searchsorted(base, hit, side="right") - 1
            local = hit - base[t]
            w = boxes.w[lo:hi][t]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(t + lo)),
                pa.array((boxes.x0[lo:hi][t] + local % w).astype(np.int32)),
                pa.array((boxes.y0[lo:hi][t] + local // w).astype(np.int32)),
                pa.array(np.full(len(hit), r, dtype=np.int32)),
                pa.array(counts[hit]),
            ], [id_col, "a", "b", "r", "votes"])


def tile_votes(
    edges: DataFrame,
    dims: DataFrame,
    steps: int = DEFAULT_STEPS,
    id_col: str = ID,
    least: int = 1,
    tile: int = CENTRE_TILE,
    cells: int = CELLS,
    pairs: int = PAIRS,
) -> DataFrame:
    """``image_id, a, b, r, votes`` of every cell with at least ``least`` votes:
    the rows of ``vote_counts``, counted in dense arrays.

    A task holds the edge pixels of some whole tiles (one tile: at most those
    within a circle's reach of it) and ``cells`` counters, whatever the image
    or the table.  Every edge row votes, repeated ones as often as they occur;
    an image without a radius, and an empty table, give no rows.
    """
    if not {"r_min", "r_max"} <= set(edges.columns):
        edges = edges.join(radius_ranges(dims, id_col), id_col)
    cos, sin = unit_circle(edges.sparkSession, steps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches, [id_col, "tx", "ty"]):
            yield from _votes(table, id_col, tile, cos, sin, least, cells, pairs)

    schema = T.StructType([
        T.StructField(id_col, edges.schema[id_col].dataType),
        *(T.StructField(c, T.IntegerType()) for c in ("a", "b", "r")),
        T.StructField("votes", T.LongType()),
    ])
    return edges_by_tile(edges, tile, id_col).mapInArrow(count, schema)


def tile_candidates(
    edges: DataFrame,
    dims: DataFrame,
    steps: int = DEFAULT_STEPS,
    threshold: float = DEFAULT_THRESHOLD,
    id_col: str = ID,
) -> DataFrame:
    """O-08 inside the counting task: only cells that reach the threshold leave it."""
    return tile_votes(edges, dims, steps, id_col, least=smallest_count(steps, threshold))
