"""Square tiles of an image: one shuffle brings a tile's rows together, a task
then settles what the tile alone decides, and only tile borders travel again.

A tile holds at most ``tile x tile`` pixels whatever the image or table, so
the rows of one tile fit in a task; a huge image is many tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TILE = 512
TABLE_ROWS = 200_000  # whole tiles are handled together up to this many rows


def tile_of(x, y, tile: int) -> tuple:
    return F.floor(x / tile).cast("int"), F.floor(y / tile).cast("int")


def by_tile(pixels: DataFrame, id_col: str, tile: int) -> DataFrame:
    """Rows plus ``tx, ty``; a tile's rows lie in one partition, tile after tile,
    each by ``y, x``."""
    tx, ty = tile_of(F.col("x"), F.col("y"), tile)
    placed = pixels.withColumns({"tx": tx, "ty": ty})
    return placed.repartition(id_col, "tx", "ty").sortWithinPartitions(id_col, "tx", "ty", "y", "x")


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's ``keys`` differ from those of the row before (nulls are equal)."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        col = table.column(key).combine_chunks()
        here, before = col.slice(1), col.slice(0, max(0, n - 1))
        differ = pc.or_(
            pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(pc.is_null(here), pc.is_null(before))
        )
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return new


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = TABLE_ROWS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never split a run of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(starts(table, keys))[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def local_keys(table: pa.Table, id_col: str, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``number of the tile, x and y inside it`` per row."""
    order = np.cumsum(starts(table, [id_col, "tx", "ty"])) - 1
    return (
        order,
        numbers(table, "x") - numbers(table, "tx") * tile,
        numbers(table, "y") - numbers(table, "ty") * tile,
    )


def pixel_key(order: np.ndarray, lx: np.ndarray, ly: np.ndarray, tile: int) -> np.ndarray:
    """One ascending number per pixel of rows sorted by tile, y, x."""
    return (order * tile + ly) * tile + lx


def inside(lx: np.ndarray, ly: np.ndarray, tile: int) -> np.ndarray:
    return (lx >= 0) & (lx < tile) & (ly >= 0) & (ly < tile)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in ascending ``keys`` and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted
