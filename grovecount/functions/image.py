"""Column expressions used by the circle pipeline (integer-exact)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the detector (defaults; every one is a parameter downstream):
#   votes per circle (steps) 100, acceptance threshold 0.4,
#   weak edge gradient > 20, strong edge gradient > 25,
#   radius range min(h,w) div 15 .. max(h,w) div 10,
#   blur kernel 1 4 6 4 1 (outer product, divided by 256).
DEFAULT_STEPS = 100
DEFAULT_THRESHOLD = 0.4
DEFAULT_LOW = 20
DEFAULT_HIGH = 25
RADIUS_MIN_DIVISOR = 15
RADIUS_MAX_DIVISOR = 10
BLUR_WEIGHTS = (1, 4, 6, 4, 1)
BLUR_DIVISOR = 256


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, lo: Column | int, hi: Column | int) -> Column:
    """O-16: ``c`` limited to ``[lo, hi]``."""
    return F.greatest(F.lit(lo) if isinstance(lo, int) else lo,
                      F.least(_col(c), F.lit(hi) if isinstance(hi, int) else hi))


def gray_of(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """O-13: integer mean of the three colour channels."""
    return F.floor((_col(r) + _col(g) + _col(b)) / 3).cast("int")


def radius_min(height: Column | str, width: Column | str) -> Column:
    """O-17 lower bound (never below 1: radius 0 would vote for every pixel)."""
    return F.greatest(F.lit(1), F.floor(F.least(_col(height), _col(width)) / RADIUS_MIN_DIVISOR)).cast("int")


def radius_max(height: Column | str, width: Column | str) -> Column:
    """O-17 upper bound, inclusive."""
    return F.floor(F.greatest(_col(height), _col(width)) / RADIUS_MAX_DIVISOR).cast("int")


def direction_bin(gx: Column | str, gy: Column | str) -> Column:
    """O-15: gradient direction folded to [0, pi] and rounded to a 45° bin 0..4.

    Bins 0 and 4 are the same (horizontal) axis.  For integer gx, gy the
    quotient is never exactly k + 0.5, so the rounding mode does not matter.
    """
    angle = F.atan2(_col(gy).cast("double"), _col(gx).cast("double"))
    folded = F.when(angle >= 0, angle).otherwise(angle + F.lit(math.pi))
    return F.floor(folded / F.lit(math.pi / 4) + F.lit(0.5)).cast("int")
