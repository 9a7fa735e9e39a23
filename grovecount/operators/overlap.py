"""O-27 overlap removal and O-29 circle counts.

Acceptance is greedy and order-dependent inside one image: walk the
candidates in a fixed order (``votes desc, r, a, b``) and accept one unless its
centre lies strictly inside an already accepted circle.

A candidate can only be blocked by a circle that reaches its block of the
image, so every candidate goes to the blocks its disc touches, and one shuffle
by block lets a task walk each block in the fixed order.  A candidate of the
block is accepted when no earlier circle that covers it is accepted or in
doubt, and dropped when an accepted one covers it.  In doubt are the visitors
from other blocks, whose own blockers are not all here, and what they alone
cover.  The next round carries only the candidates still in doubt and the
circles accepted meanwhile.  The earliest candidate in doubt always gets
settled, so rounds end; their number follows the number of block borders a
chain of overlaps crosses, not its length, and an image within one block needs
a single round.

A task keeps the accepted and the doubtful circles of the one block it walks;
dropped candidates, the bulk, are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.operators import tiles
from grovecount.operators.stencil import ID
from grovecount.plans.lineage import RoundTables

DEFAULT_BLOCK = 512
_PAIRS = 2_000_000  # distances held at a time


def accept_circles(cands: DataFrame, id_col: str = ID, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``image_id, k, a, b, r, votes`` of accepted circles; ``k`` numbers them in
    acceptance order within the image."""
    rounds = RoundTables(cands.sparkSession, "accept")
    circle = [id_col, "a", "b", "r", "votes"]
    schema = T.StructType([
        *[cands.schema[c] for c in circle], T.StructField("accepted", T.BooleanType())
    ])
    state = cands.select(*circle, F.lit(False).alias("accepted"))
    accepted = []
    left = 1
    while left:
        settled = _on_blocks(state, id_col, block).mapInArrow(_walker(id_col, circle), schema)
        state, left = rounds.write_counted(settled, "round", ~F.col("accepted"))
        accepted.append(state.where("accepted").select(*circle))
    out = accepted[0]
    for part in accepted[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy(id_col).orderBy(F.desc("votes"), "r", "a", "b")
    return out.select(id_col, (F.row_number().over(order) - 1).cast("int").alias("k"), "a", "b", "r", "votes")


def _on_blocks(circles: DataFrame, id_col: str, block: int) -> DataFrame:
    """A row per block that a circle's inside touches, block after block in a
    partition, in acceptance order; ``own`` in the block of the centre."""
    reach = F.greatest(F.col("r") - 1, F.lit(0))

    def blocks(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / block), F.floor((F.col(c) + reach) / block)))

    spread = circles.select("*", blocks("a").alias("bx")).select("*", blocks("b").alias("by"))
    own = (F.floor(F.col("a") / block) == F.col("bx")) & (F.floor(F.col("b") / block) == F.col("by"))
    # an accepted circle of the block itself has done its work there
    spread = spread.withColumn("own", own).where("NOT (own AND accepted)")
    return spread.repartition(id_col, "bx", "by").sortWithinPartitions(
        id_col, "bx", "by", F.desc("votes"), "r", "a", "b"
    )


class _Block:
    """The circles of one block that still matter, while it is walked."""

    def __init__(self):
        self.sure: list[np.ndarray] = []
        self.doubtful: list[np.ndarray] = []

    def walk(self, a: np.ndarray, b: np.ndarray, r: np.ndarray, own: np.ndarray, known: np.ndarray):
        """``(accepted, doubtful)`` for the next candidates in order."""
        here = np.stack([a, b, r])
        dropped = _covered(self.sure, a, b) & ~known
        doubt = _covered(self.doubtful, a, b)
        sure, unsure = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
        for i in np.flatnonzero(~dropped):
            if dropped[i]:
                continue
            da, db = a[i + 1:] - a[i], b[i + 1:] - b[i]
            hit = da * da + db * db < r[i] * r[i]
            if known[i] or (own[i] and not doubt[i]):
                sure[i] = True
                dropped[i + 1:] |= hit & ~known[i + 1:]
            else:
                unsure[i] = True
                doubt[i + 1:] |= hit
        self.sure.append(here[:, sure])
        self.doubtful.append(here[:, unsure])
        return sure, unsure


def _covered(circles: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), dtype=bool)
    step = max(1, _PAIRS // max(1, len(a)))
    for part in circles:
        for lo in range(0, part.shape[1], step):
            ca, cb, cr = part[:, lo:lo + step, None]
            out |= ((a - ca) ** 2 + (b - cb) ** 2 < cr * cr).any(axis=0)
    return out


def _walker(id_col: str, circle: list[str]):
    keys = [id_col, "bx", "by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = _Block(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            joined = table if last is None else pa.concat_tables([last, table])
            new = tiles.starts(joined, keys)[0 if last is None else 1:]
            last = table.slice(table.num_rows - 1)
            a, b, r = (tiles.numbers(table, c) for c in "abr")
            own, known = (table.column(c).to_numpy() for c in ("own", "accepted"))
            sure, unsure = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(new), [len(a)]]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if new[lo]:
                    block = _Block()
                part = slice(int(lo), int(hi))
                sure[part], unsure[part] = block.walk(a[part], b[part], r[part], own[part], known[part])
            out = table.select(circle).append_column("accepted", pa.array(sure))
            yield from out.filter(pa.array(own & (sure | unsure))).to_batches()

    return run


def circle_counts(circles: DataFrame, dims: DataFrame, id_col: str = ID) -> DataFrame:
    """O-29: circles per image; an image without circles counts 0."""
    per = circles.groupBy(id_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return dims.select(id_col).join(per, id_col, "left").select(
        id_col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )
