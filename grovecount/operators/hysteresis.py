"""O-25 with O-32..O-34: keep strong edges and the weak edges connected to them.

Start from pixels with gradient above ``high``; repeatedly add 8-neighbours
(and the pixel itself) whose gradient is above ``low``; stop when nothing is
added.  The result is exactly the weak pixels whose 8-connected weak component
holds a strong pixel, and that is how it is computed: one shuffle by tile
labels the components inside each tile of an image by union-find.  A component
with a strong pixel is kept, one without that touches no tile border is
dropped, and the rest are joined along tile borders into a graph of components
(not of pixels), whose connected components decide.  The number of exchanges
depends on the number of tiles a contour crosses (its logarithm), not on its
length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.operators import tiles
from grovecount.operators.components import connected_components
from grovecount.operators.stencil import ID
from grovecount.plans.lineage import RoundTables

# one direction of each 8-neighbour pair
_FORWARD = [(1, 0), (-1, 1), (0, 1), (1, 1)]
_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def grow_edges(
    thinned: DataFrame,
    low: int,
    high: int,
    id_col: str = ID,
    tile: int = tiles.DEFAULT_TILE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Edge pixels ``image_id, x, y`` (distinct) after hysteresis.

    ``thinned`` carries ``mag2`` for surviving pixels; values are compared as
    squares (``> low^2`` weak, ``> high^2`` strong).  ``carry`` names columns
    that are constant per image (e.g. its radius range) and stay on the rows.
    """
    rounds = RoundTables(thinned.sparkSession, "edges")
    cols = [id_col, "x", "y", *carry]
    weak = thinned.where(F.col("mag2") > low * low).select(*cols, (F.col("mag2") > high * high).alias("strong"))
    schema = T.StructType([
        *[weak.schema[c] for c in cols],
        T.StructField("rx", T.IntegerType()),
        T.StructField("ry", T.IntegerType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("border", T.BooleanType()),
    ])
    labelled = tiles.by_tile(weak, id_col, tile).mapInArrow(_labeller(id_col, tile, cols), schema)
    labelled, n_open = rounds.write_counted(labelled, "tiles", ~F.col("kept"))
    kept = labelled.where("kept").select(*cols)
    if not n_open:
        return kept
    grown = _grown_over_borders(labelled, rounds, id_col, tile)
    late = labelled.where("NOT kept").join(grown, [id_col, "rx", "ry"], "left_semi").select(*cols)
    return kept.unionByName(late)


def _labeller(id_col: str, tile: int, cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches, [id_col, "tx", "ty"]):
            yield from _label_tiles(table, id_col, tile, cols).to_batches()

    return run


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, for edges ``left - right``: roots
    hook onto the smallest neighbouring root, then paths are compressed."""
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _label_tiles(table: pa.Table, id_col: str, tile: int, cols: list[str]) -> pa.Table:
    """Pixels of whole tiles with the first pixel ``rx, ry`` of their component,
    without the components that no strong pixel and no tile border can save."""
    order, lx, ly = tiles.local_keys(table, id_col, tile)
    key = tiles.pixel_key(order, lx, ly, tile)
    # a repeated row follows its first occurrence and is left out
    first = np.append(True, key[1:] != key[:-1])
    place = np.flatnonzero(first)
    strong = np.logical_or.reduceat(table.column("strong").to_numpy(), place)
    key, order, lx, ly = key[first], order[first], lx[first], ly[first]
    table = table.filter(pa.array(first))
    left, right = [], []
    for dx, dy in _FORWARD:
        nx, ny = lx + dx, ly + dy
        own = np.flatnonzero(tiles.inside(nx, ny, tile))
        at, found = tiles.find(key, tiles.pixel_key(order[own], nx[own], ny[own], tile))
        left.append(own[found])
        right.append(at[found])
    root = _roots(len(key), np.concatenate(left), np.concatenate(right))
    border = (lx == 0) | (ly == 0) | (lx == tile - 1) | (ly == tile - 1)
    kept = np.bincount(root, weights=strong, minlength=len(key))[root] > 0
    open_ = np.bincount(root, weights=border, minlength=len(key))[root] > 0
    x, y = tiles.numbers(table, "x").astype(np.int32), tiles.numbers(table, "y").astype(np.int32)
    out = table.select(cols)
    out = out.append_column("rx", pa.array(x[root]))
    out = out.append_column("ry", pa.array(y[root]))
    out = out.append_column("kept", pa.array(kept))
    out = out.append_column("border", pa.array(border))
    return out.filter(pa.array(kept | open_))


def _grown_over_borders(labelled: DataFrame, rounds: RoundTables, id_col: str, tile: int) -> DataFrame:
    """``id, rx, ry`` of components without a strong pixel of their own that
    reach one with a strong pixel over tile borders."""
    comp = [id_col, "rx", "ry"]
    edge = labelled.where("border")
    nodes = edge.where("NOT kept").select(*comp).distinct()
    nodes = rounds.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _AROUND])
    tx, ty = tiles.tile_of(F.col("x"), F.col("y"), tile)
    nx, ny = F.col("x") + F.col("s.a"), F.col("y") + F.col("s.b")
    ntx, nty = tiles.tile_of(nx, ny, tile)
    across = edge.where("NOT kept").select(*comp, "x", "y", F.explode(steps).alias("s")).where(
        (ntx != tx) | (nty != ty)
    ).select(*comp, nx.alias("x"), ny.alias("y"))
    other = edge.select(
        id_col, "x", "y", F.col("rx").alias("ox"), F.col("ry").alias("oy"), F.col("kept").alias("other_kept")
    )
    met = across.join(other, [id_col, "x", "y"]).select(*comp, "ox", "oy", "other_kept").distinct()
    met = met.join(nodes.withColumnRenamed("node", "src"), comp).join(
        nodes.select(id_col, F.col("rx").alias("ox"), F.col("ry").alias("oy"), F.col("node").alias("dst")),
        [id_col, "ox", "oy"], "left",
    )
    met = rounds.write(met.select("src", "dst", "other_kept"), "met")
    labels = connected_components(met.where("NOT other_kept").select("src", "dst"))
    group = F.coalesce("label", "node").alias("label")
    grouped = nodes.join(labels, "node", "left").select(*comp, "node", group)
    seeded = met.where("other_kept").select(F.col("src").alias("node")).distinct()
    saved = grouped.join(seeded, "node", "left_semi").select("label").distinct()
    return rounds.write(grouped.join(saved, "label", "left_semi").select(*comp), "grown")
