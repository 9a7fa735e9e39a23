"""Circle detection for any number of images as one Spark program (U-7).

pixels -> blurred -> gradient -> thinned -> edges -> votes -> candidates
-> circles -> counts; every arrow a DataFrame function keyed by image_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from grovecount.functions.image import (
    DEFAULT_HIGH,
    DEFAULT_LOW,
    DEFAULT_STEPS,
    DEFAULT_THRESHOLD,
)
from grovecount.operators.hough_tiles import tile_candidates, tile_votes
from grovecount.operators.hysteresis import grow_edges
from grovecount.operators.overlap import accept_circles, circle_counts
from grovecount.operators.image_bands import suppression_inputs_from_images
from grovecount.operators.thinning import resolve, thin_pixels
from grovecount.plans.lineage import RoundTables
from grovecount.sources.images import image_dims, image_pixels


@dataclass(frozen=True)
class DetectParams:
    steps: int = DEFAULT_STEPS
    threshold: float = DEFAULT_THRESHOLD
    low: int = DEFAULT_LOW
    high: int = DEFAULT_HIGH
    thinning: str = "inplace"
    # image files: "bands" computes blur..neighbour comparison in the decoding
    # task and ships only edge candidates; "dataframe" builds the pixel table
    stencil: str = "bands"


@dataclass
class Detection:
    edges: DataFrame
    votes: DataFrame
    candidates: DataFrame
    circles: DataFrame
    counts: DataFrame


def edge_pixels(pixels: DataFrame, params: DetectParams = DetectParams()) -> DataFrame:
    """Gray pixel table -> distinct edge pixels ``image_id, x, y`` (runs the loops)."""
    thinned = thin_pixels(pixels, params.low, params.thinning)
    return grow_edges(thinned, params.low, params.high)


def detect_circles(pixels: DataFrame, dims: DataFrame, params: DetectParams = DetectParams()) -> Detection:
    """Detection from a gray pixel table (``image_id, x, y, v``)."""
    return _from_edges(edge_pixels(pixels, params), dims, params)


def detect_circles_in_images(
    images: DataFrame,
    id_col: str = "image_name",
    params: DetectParams = DetectParams(),
    dims: DataFrame | None = None,
    repeated: bool = False,
) -> Detection:
    """Detection from decoded image rows (``height, width, n_channels, data``).
    ``repeated`` tells that a row may occur more than once; equal candidate
    pixels are then merged, which costs less than merging image bytes.

    ``dims`` (``image_id, width, height``) may come from a small metadata
    table so the sizes are not read from the image rows again.
    """
    dims = image_dims(images, id_col) if dims is None else dims
    if params.stencil == "dataframe":
        pixels = image_pixels(images, id_col)
        return detect_circles(pixels.distinct() if repeated else pixels, dims, params)
    if params.stencil != "bands":
        raise ValueError(f"unknown stencil {params.stencil!r}")
    radii = ("r_min", "r_max")
    inputs = suppression_inputs_from_images(images, params.low, id_col)
    if repeated:
        inputs = inputs.dropDuplicates(["image_id", "x", "y"])
    thinned = resolve(inputs, params.thinning, carry=radii)
    return _from_edges(grow_edges(thinned, params.low, params.high, carry=radii), dims, params)


def _from_edges(edges: DataFrame, dims: DataFrame, params: DetectParams) -> Detection:
    votes = tile_votes(edges, dims, params.steps)
    # voting runs once: its few survivors are stored for the acceptance rounds
    stored = RoundTables(edges.sparkSession, "circles")
    cands = stored.write(tile_candidates(edges, dims, params.steps, params.threshold), "candidates")
    circles = accept_circles(cands)
    # accepted circles feed counts, crops and sinks: write them once
    circles = stored.write(circles, "circles")
    return Detection(edges, votes, cands, circles, circle_counts(circles, dims))
