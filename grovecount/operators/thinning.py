"""O-24: non-maximum suppression along the gradient direction.

``mode="inplace"`` reproduces a scan that overwrites as it goes (x outer,
y inner): a neighbour already suppressed earlier in the scan no longer
suppresses.  For direction bin d let ``p`` be the neighbour scanned before the
pixel and ``q`` the one scanned after:

    bin 0, 4 : p = (x-1, y)    q = (x+1, y)
    bin 1    : p = (x-1, y-1)  q = (x+1, y+1)
    bin 2    : p = (x, y-1)    q = (x, y+1)
    bin 3    : p = (x-1, y+1)  q = (x+1, y-1)

    killed(c) = mag(q) > mag(c)  OR  (mag(p) > mag(c) AND NOT killed(p))

Only a pixel whose ``p`` is stronger and whose ``q`` is not depends on another
pixel, and that dependency always points to a strictly stronger pixel, so
chains end.  Chains inside a tile of an image are settled in one task; a chain
that leaves its tile is reduced there to "as / opposite to the pixel it leaves
to", and only those border pixels are resolved against each other by joins.

``mode="snapshot"`` is the textbook one-pass rule (compare with the original
magnitudes only).

Only pixels above the weak threshold can matter downstream, and a chain only
climbs in magnitude, so the whole resolution runs on ``mag2 > low^2`` pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.operators import tiles
from grovecount.operators.stencil import ID, with_neighbour_mags
from grovecount.operators.stencil_tiles import suppression_inputs_from_pixels
from grovecount.plans.lineage import RoundTables

# (bin) -> (p column, p dx, p dy, q column); bin 4 shares bin 0's axis.
_AXES = {
    0: ("m_lc", -1, 0, "m_rc"),
    1: ("m_lu", -1, -1, "m_rd"),
    2: ("m_cu", 0, -1, "m_cd"),
    3: ("m_ld", -1, 1, "m_ru"),
}


def _pick(d, which: int):
    expr = None
    for b, spec in _AXES.items():
        v = F.col(spec[which]) if isinstance(spec[which], str) else F.lit(spec[which])
        cond = (d == b) | (d == 4) if b == 0 else (d == b)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


def suppression_inputs(grad: DataFrame, low: int, id_col: str = ID) -> DataFrame:
    """Interior pixels with ``mag2 > low^2``, each with its p/q comparison."""
    return _compare(with_neighbour_mags(grad, low * low, id_col), low, id_col)


def _compare(nb: DataFrame, low: int, id_col: str) -> DataFrame:
    d = F.col("dir")
    p_mag, q_mag = _pick(d, 0), _pick(d, 3)
    return nb.where(F.col("mag2") > low * low).select(
        id_col, "x", "y", "mag2",
        (q_mag > F.col("mag2")).alias("q_kills"),
        (p_mag > F.col("mag2")).alias("p_gt"),
        (F.col("x") + _pick(d, 1)).cast("int").alias("px"),
        (F.col("y") + _pick(d, 2)).cast("int").alias("py"),
    )


def thin(grad: DataFrame, low: int, mode: str = "inplace", id_col: str = ID) -> DataFrame:
    """Survivors of suppression with ``mag2 > low^2``: ``image_id, x, y, mag2``."""
    return resolve(suppression_inputs(grad, low, id_col), mode, id_col)


def thin_pixels(pixels: DataFrame, low: int, mode: str = "inplace", id_col: str = ID) -> DataFrame:
    """``thin(gradient(blur(pixels)))``: gray pixel table to thinned edges, its
    dense part by tiles in one shuffle."""
    return resolve(suppression_inputs_from_pixels(pixels, low, id_col), mode, id_col)


def resolve(
    cand: DataFrame,
    mode: str = "inplace",
    id_col: str = ID,
    tile: int = tiles.DEFAULT_TILE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Apply the suppression rule to candidate rows from ``suppression_inputs``.

    In-place: one shuffle by tile settles every chain inside a tile.  Where
    chains leave their tiles, the pixels they leave to are settled by pointer
    jumping over the border pixels alone, in O(log tiles crossed) rounds.
    ``carry`` names further columns that stay on the rows.
    """
    cols = [id_col, "x", "y", "mag2", *carry]
    if mode == "snapshot":
        return cand.where(~F.col("q_kills") & ~F.col("p_gt")).select(*cols)
    if mode != "inplace":
        raise ValueError(f"unknown thinning mode {mode!r}")

    rounds = RoundTables(cand.sparkSession, "thin")
    rows = cand.select(*cols, "q_kills", "p_gt", "px", "py")
    fields = [f for f in rows.schema if f.name in cols]
    schema = T.StructType([
        *fields,
        T.StructField("killed", T.BooleanType()),
        T.StructField("flip", T.BooleanType()),
        T.StructField("px", T.IntegerType()),
        T.StructField("py", T.IntegerType()),
    ])
    settled = tiles.by_tile(rows, id_col, tile).mapInArrow(_chain_settler(id_col, tile, cols), schema)
    settled, n_open = rounds.write_counted(settled, "tiles", F.col("killed").isNull())
    alive = settled.where(~F.col("killed")).select(*cols)
    if not n_open:
        return alive
    open_ = settled.where("killed IS NULL")
    exits = rounds.write(open_.select(id_col, "px", "py").distinct(), "exits")
    ports = settled.join(
        exits.select(id_col, F.col("px").alias("x"), F.col("py").alias("y")), [id_col, "x", "y"], "left_semi"
    )
    ports = rounds.write(ports.select(id_col, "x", "y", "killed", "flip", "px", "py"), "ports")
    verdict = _jump(ports, rounds, id_col)
    late = open_.join(verdict, [id_col, "px", "py"]).where(F.col("k") == F.col("flip")).select(*cols)
    return alive.unionByName(late)


def _chain_settler(id_col: str, tile: int, cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches, [id_col, "tx", "ty"]):
            yield from _settle_chains(table, id_col, tile, cols).to_batches()

    return run


def _settle_chains(table: pa.Table, id_col: str, tile: int, cols: list[str]) -> pa.Table:
    """Rows of whole tiles with ``killed``, or with null and the pixel ``px, py``
    of another tile they depend on: killed = that pixel's, or its opposite
    where ``flip``.  Killed pixels are left out unless another tile may ask."""
    order, lx, ly = tiles.local_keys(table, id_col, tile)
    px, py = tiles.numbers(table, "px"), tiles.numbers(table, "py")
    key = tiles.pixel_key(order, lx, ly, tile)
    q_kills = table.column("q_kills").to_numpy()
    waits = ~q_kills & table.column("p_gt").to_numpy()
    plx, ply = px - tiles.numbers(table, "tx") * tile, py - tiles.numbers(table, "ty") * tile
    here = np.flatnonzero(waits & tiles.inside(plx, ply, tile))
    at, found = tiles.find(key, tiles.pixel_key(order[here], plx[here], ply[here], tile))
    end = np.arange(len(key))
    end[here[found]] = at[found]
    flip = end != np.arange(len(key))
    while True:  # pointer jumping: killed(c) = killed(end) XOR flip
        further = end[end]
        if (further == end).all():
            break
        flip = flip ^ flip[end]
        end = further
    known = ~waits[end]
    killed = q_kills[end] ^ flip
    border = (lx == 0) | (ly == 0) | (lx == tile - 1) | (ly == tile - 1)
    keep = ~known | ~killed | border
    out = table.select(cols)
    out = out.append_column("killed", pa.array(killed, mask=~known))
    out = out.append_column("flip", pa.array(~flip))  # the last step, out of the tile, turns once more
    out = out.append_column("px", pa.array(px[end].astype(np.int32)))
    out = out.append_column("py", pa.array(py[end].astype(np.int32)))
    return out.filter(pa.array(keep))


def _jump(ports: DataFrame, rounds: RoundTables, id_col: str) -> DataFrame:
    """``id, px, py, k``: whether the border pixel is killed.  An open one holds
    ``killed = killed(px, py) XOR flip`` and takes over the pointer of the pixel
    it points at until that one is known."""
    found = [ports.where("killed IS NOT NULL").select(id_col, "x", "y", "killed")]
    state = ports.where("killed IS NULL").select(id_col, "x", "y", "flip", "px", "py")
    here = [id_col, "px", "py"]
    while True:
        known = _union(found).select(id_col, F.col("x").alias("px"), F.col("y").alias("py"), F.col("killed").alias("k"))
        onward = state.select(
            id_col, F.col("x").alias("px"), F.col("y").alias("py"),
            F.col("px").alias("nx"), F.col("py").alias("ny"), F.col("flip").alias("nflip"),
        )
        step = state.join(known, here, "left").join(onward, here, "left").where("k IS NOT NULL OR nflip IS NOT NULL")
        step, n_open = rounds.write_counted(step.select(
            id_col, "x", "y",
            (F.col("k") != F.col("flip")).alias("killed"),
            (F.col("flip") != F.col("nflip")).alias("flip"),
            F.col("nx").alias("px"), F.col("ny").alias("py"),
        ), "jump", F.col("killed").isNull())
        found.append(step.where("killed IS NOT NULL").select(id_col, "x", "y", "killed"))
        if not n_open:
            return _union(found).select(
                id_col, F.col("x").alias("px"), F.col("y").alias("py"), F.col("killed").alias("k")
            )
        state = step.where("killed IS NULL").select(id_col, "x", "y", "flip", "px", "py")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
