"""Column expressions for line and name handling (all JVM-side, codegen'd)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   kept-line suffix "orange" (case-sensitive, no trimming),
#   kept image suffixes ".png" and ".jpg" (case-sensitive),
#   type separator "_" (text before its first occurrence).
ORANGE_SUFFIX = "orange"
IMAGE_SUFFIXES = (".png", ".jpg")
TYPE_SEPARATOR = "_"

# Line breaks the text source recognises: CRLF, CR, LF.
LINE_BREAK_PATTERN = "\r\n|\r|\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ends_with(c: Column | str, suffix: str = ORANGE_SUFFIX) -> Column:
    """O-06: keep values ending in ``suffix``; exact bytes, no trim."""
    return _col(c).endswith(F.lit(suffix))


def ends_with_any(c: Column | str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> Column:
    """O-07: keep values ending in any of ``suffixes`` (case-sensitive)."""
    col = _col(c)
    cond = None
    for s in suffixes:
        term = col.endswith(F.lit(s))
        cond = term if cond is None else (cond | term)
    return cond if cond is not None else F.lit(False)


def prefix_before(c: Column | str, sep: str = TYPE_SEPARATOR) -> Column:
    """O-11: text before the first ``sep``; null when ``sep`` is absent.

    The original throws on a name without the separator; callers route the
    null keys to a rejects output instead.
    """
    col = _col(c)
    return F.when(F.instr(col, sep) > 0, F.substring_index(col, sep, 1))


def split_lines(c: Column | str) -> Column:
    """Array of the lines of a text value (CRLF, CR and LF all end a line; a line
    break at the very end ends the last line and starts none)."""
    parts = F.split(_col(c), LINE_BREAK_PATTERN, -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def render_pair(feature: Column | str, n: Column | str) -> Column:
    """O-21: ``(feature,count)`` text form of an output row."""
    return F.format_string("(%s,%d)", _col(feature), _col(n))


def file_name(path: Column | str) -> Column:
    """Last path segment of a file URI or path."""
    return F.element_at(F.split(_col(path), "/"), -1)
