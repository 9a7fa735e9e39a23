"""Hough voting: radius ranges (O-17), circle offsets (O-18), edge x offset
pairing (O-26), vote counts (O-28) and the acceptance threshold (O-08)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecount.functions.image import DEFAULT_STEPS, DEFAULT_THRESHOLD, radius_max, radius_min
from grovecount.operators.stencil import ID

# Broadcast the offsets table only up to this many bytes (a row of four fields
# is 40 bytes).  Its size is at most (largest radius) x steps rows: set by image
# dimensions and the step count, never by the number of images or edges.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024
OFFSET_ROW_BYTES = 40
# ``by_tile`` deals edges to tiles of centres this wide, and to tasks of about
# this many votes.
ROW_TILE = 1024
VOTES_PER_TASK = 8_000_000


def radius_ranges(dims: DataFrame, id_col: str = ID) -> DataFrame:
    """``image_id, r_min, r_max`` from ``width, height`` (O-17), for images whose
    range holds at least one radius (an image under 10 px has none; note that
    ``sequence(1, 0)`` would count down, so empty ranges are dropped here)."""
    return dims.select(
        id_col,
        radius_min("height", "width").alias("r_min"),
        radius_max("height", "width").alias("r_max"),
    ).where(F.col("r_max") >= F.col("r_min"))


def _offset_exprs(r, s, steps: int):
    angle = F.lit(2.0 * math.pi) * s / F.lit(steps)
    return (r * F.cos(angle)).cast("int"), (r * F.sin(angle)).cast("int")


def circle_offsets(radii: DataFrame, steps: int = DEFAULT_STEPS) -> DataFrame:
    """O-18: ``r, dx, dy, weight`` for each radius in ``radii`` (column ``r``).

    ``dx = (int)(r cos(2 pi s / steps))``, ``dy`` likewise with sin, truncated
    toward zero, for s in 0..steps-1.  Repeated offsets (small radii) are
    merged into ``weight`` so each still votes as often as it occurs.
    """
    s = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("s")
    raw = radii.select("r", s)
    dx, dy = _offset_exprs(F.col("r"), F.col("s"), steps)
    return raw.select("r", dx.alias("dx"), dy.alias("dy")).groupBy("r", "dx", "dy").agg(
        F.count(F.lit(1)).cast("bigint").alias("weight")
    )


def radii_in_use(ranges: DataFrame) -> DataFrame:
    return ranges.select(F.explode(F.sequence("r_min", "r_max")).alias("r")).distinct()


def vote_counts(
    edges: DataFrame,
    dims: DataFrame,
    steps: int = DEFAULT_STEPS,
    id_col: str = ID,
    by_tile: bool = False,
) -> DataFrame:
    """O-26 + O-28: ``image_id, a, b, r, votes`` with ``a = x - dx``, ``b = y - dy``.

    Each edge pixel is paired with the offsets of every radius of its image;
    edges that carry their image's ``r_min, r_max`` need no join for it.
    The weighted offsets table is broadcast when its proven bound
    (largest radius x steps rows) fits; beyond that the offsets are generated
    inline per edge, which needs no join at all.  Either way the partial hash
    aggregate merges votes inside each task before the shuffle on the full
    cell key, so one large image spreads over all reducers.

    ``by_tile`` is for many images: the edges go to the tiles of centres their
    votes can fall into before they vote, so a cell's votes meet in the task
    that makes them, edges are shuffled and cells are not.
    """
    ranges = radius_ranges(dims, id_col)
    if not {"r_min", "r_max"} <= set(edges.columns):
        edges = edges.join(ranges, id_col)
    edges = edges.where(F.col("r_max") >= F.col("r_min"))
    keys = [id_col]
    if by_tile:
        edges, keys = _dealt_by_tile(edges, steps, id_col), [id_col, "tx", "ty"]
    per_edge = edges.select(*keys, "x", "y", F.explode(F.sequence("r_min", "r_max")).alias("r"))
    top = ranges.agg(F.max("r_max").alias("m")).first()["m"] or 0
    if top * steps * OFFSET_ROW_BYTES <= MAX_BROADCAST_BYTES:
        offsets = circle_offsets(radii_in_use(ranges), steps)
        paired = per_edge.join(F.broadcast(offsets), "r")
        votes = paired.select(
            *keys,
            (F.col("x") - F.col("dx")).alias("a"),
            (F.col("y") - F.col("dy")).alias("b"),
            "r",
            "weight",
        )
    else:
        s = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("s")
        each = per_edge.select("*", s)
        dx, dy = _offset_exprs(F.col("r"), F.col("s"), steps)
        votes = each.select(
            *keys, (F.col("x") - dx).alias("a"), (F.col("y") - dy).alias("b"), "r", F.lit(1).alias("weight")
        )
    if by_tile:
        inside = [F.floor(F.col(c) / ROW_TILE) == F.col(t) for c, t in (("a", "tx"), ("b", "ty"))]
        votes = votes.where(inside[0] & inside[1])
    cells = votes.groupBy(*keys, "a", "b", "r").agg(F.sum("weight").cast("bigint").alias("votes"))
    return cells.select(id_col, "a", "b", "r", "votes")


def _dealt_by_tile(edges: DataFrame, steps: int, id_col: str) -> DataFrame:
    """Edges with ``r_min, r_max`` at every tile ``tx, ty`` of centres they may vote
    for, a tile's edges in one task of about ``VOTES_PER_TASK`` votes."""
    circles = edges.agg(F.sum(F.col("r_max") - F.col("r_min") + 1)).first()[0] or 0

    def reach(c: str):
        ends = [F.floor((F.col(c) + s * F.col("r_max")) / ROW_TILE).cast("int") for s in (-1, 1)]
        return F.explode(F.sequence(*ends))

    placed = edges.select(id_col, "x", "y", "r_min", "r_max", reach("x").alias("tx")).withColumn("ty", reach("y"))
    return placed.repartition(1 + circles * steps // VOTES_PER_TASK, id_col, "tx", "ty")


def candidates(votes: DataFrame, steps: int = DEFAULT_STEPS, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """O-08: vote cells covering at least ``threshold`` of a full circle."""
    return votes.where(F.col("votes") / F.lit(float(steps)) >= F.lit(threshold))
