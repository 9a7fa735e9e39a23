"""Neighbourhood operators on pixel tables: blur (O-23), gradient (O-14, O-15),
and the neighbour magnitudes edge thinning needs.

Every neighbour is read with ``lag``/``lead`` over one image row
(``partitionBy(image_id, y).orderBy(x)``) or one image column
(``partitionBy(image_id, x).orderBy(y)``).  Window groups are therefore
bounded by an image's width or height, never by an image or a table: a huge
image spreads over all tasks.  Consecutive steps on the same axis share one
exchange and one sort; each change of axis is one shuffle.  Blur -> gradient ->
neighbour magnitudes takes four such passes, the last one over near-edge
pixels only (see ``with_neighbour_mags``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovecount.functions.image import BLUR_DIVISOR, BLUR_WEIGHTS, direction_bin

ID = "image_id"


def row_window(id_col: str = ID):
    return Window.partitionBy(id_col, "y").orderBy("x")


def col_window(id_col: str = ID):
    return Window.partitionBy(id_col, "x").orderBy("y")


def _tag(k: int) -> str:
    return f"m{-k}" if k < 0 else f"p{k}"


def _shifted(c: str, k: int) -> str:
    return f"{c}__{_tag(k)}"


def with_shifts(df: DataFrame, cols: list[str], w, reach: int) -> DataFrame:
    """Add ``<c>__m<k>`` / ``<c>__p<k>`` = value k places before / after along ``w``.

    Each (column, offset) is one window function; everything built from them
    is a plain projection (Spark does not merge repeated window expressions).
    """
    exprs = []
    for c in cols:
        for k in range(-reach, reach + 1):
            if k:
                fn = F.lag if k < 0 else F.lead
                exprs.append(fn(c, abs(k)).over(w).alias(_shifted(c, k)))
    return df.select("*", *exprs)


def clamped(c: str, k: int) -> Column:
    """Value at offset ``k`` with the edge value repeated past either end
    (the farthest existing neighbour in that direction); needs ``with_shifts``."""
    if k == 0:
        return F.col(c)
    step = 1 if k < 0 else -1
    return F.coalesce(*[F.col(_shifted(c, j)) for j in range(k, 0, step)], F.col(c))


def exists_at(c: str, k: int) -> Column:
    """Whether the pixel at offset ``k`` exists (``c`` must be non-null)."""
    return F.lit(True) if k == 0 else F.col(_shifted(c, k)).isNotNull()


def weighted(c: str, centre: int = 0) -> Column:
    """Binomial 1 4 6 4 1 sum of clamped values around offset ``centre``."""
    half = len(BLUR_WEIGHTS) // 2
    terms = [F.lit(wk) * clamped(c, centre + k - half) for k, wk in enumerate(BLUR_WEIGHTS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def blur(pixels: DataFrame, id_col: str = ID) -> DataFrame:
    """O-23: 5x5 binomial blur, edges replicated, truncated once at the end.

    Separable and exact in integers: the 2-D kernel is the outer product of
    1 4 6 4 1 over 256, so one horizontal and one vertical weighted sum give
    256 times the blurred value.
    """
    half = len(BLUR_WEIGHTS) // 2
    horiz = with_shifts(pixels, ["v"], row_window(id_col), half).select(id_col, "x", "y", weighted("v").alias("h"))
    both = with_shifts(horiz, ["h"], col_window(id_col), half)
    return both.select(id_col, "x", "y", F.floor(weighted("h") / F.lit(BLUR_DIVISOR)).cast("int").alias("v"))


def gradient(blurred: DataFrame, id_col: str = ID) -> DataFrame:
    """O-14 / O-15: central differences; squared magnitude and direction bin.

    ``mag2 = gx^2 + gy^2`` is exact; comparing squares orders exactly as
    comparing the square roots.  Border pixels (a missing neighbour) get
    ``mag2 = 0, dir = 0``.
    """
    wc, wr = col_window(id_col), row_window(id_col)
    with_gy = blurred.withColumn("gy", F.lead("v").over(wc) - F.lag("v").over(wc))
    with_g = with_gy.withColumn("gx", F.lead("v").over(wr) - F.lag("v").over(wr))
    inner = F.col("gx").isNotNull() & F.col("gy").isNotNull()
    return with_g.select(
        id_col, "x", "y",
        F.when(inner, F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).otherwise(0).alias("mag2"),
        F.when(inner, direction_bin("gx", "gy")).otherwise(0).alias("dir"),
    )


def with_neighbour_mags(grad: DataFrame, floor2: int = 0, id_col: str = ID) -> DataFrame:
    """Add the eight neighbour magnitudes ``m_<dx><dy>`` (``dx, dy`` in l/c/r, u/c/d)
    for pixels whose own ``mag2`` exceeds ``floor2``; neighbour values at or
    below ``floor2`` read as 0.

    The row neighbours come from the row window (same axis as the incoming
    partitioning, no exchange).  Only rows where one of the three values
    exceeds ``floor2`` then go through the column exchange, and the rows one
    line up and down are read with exact ``RANGE`` frames, so a row left out
    simply reads as 0.  Edge thinning compares against pixels stronger than
    the weak threshold only, so ``floor2 = low^2`` loses nothing while
    shuffling only the pixels near edges.
    """
    wr = row_window(id_col)

    def keep(c: str) -> Column:
        return F.when(F.col(c) > floor2, F.col(c)).otherwise(0)

    rows = grad.select(
        id_col, "x", "y", "mag2", "dir",
        F.coalesce(F.lag("mag2").over(wr), F.lit(0)).alias("m_lc"),
        F.coalesce(F.lead("mag2").over(wr), F.lit(0)).alias("m_rc"),
    ).select(id_col, "x", "y", "dir", keep("mag2").alias("mag2"), keep("m_lc").alias("m_lc"),
             keep("m_rc").alias("m_rc"))
    near = rows.where((F.col("mag2") > 0) | (F.col("m_lc") > 0) | (F.col("m_rc") > 0))
    base = Window.partitionBy(id_col, "x").orderBy("y")
    up, down = base.rangeBetween(-1, -1), base.rangeBetween(1, 1)

    def at(c: str, w) -> Column:
        return F.coalesce(F.max(c).over(w), F.lit(0))

    return near.select(
        "*",
        at("mag2", up).alias("m_cu"),
        at("mag2", down).alias("m_cd"),
        at("m_lc", up).alias("m_lu"),
        at("m_lc", down).alias("m_ld"),
        at("m_rc", up).alias("m_ru"),
        at("m_rc", down).alias("m_rd"),
    ).where(F.col("mag2") > 0)
