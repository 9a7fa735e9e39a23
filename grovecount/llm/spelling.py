"""Spelling variants: words one edit apart, each grouped under a far more
frequent near word.

Two words of lengths a <= b, b - a <= 1, differ by exactly one inserted,
deleted or replaced code point if and only if common prefix + common suffix
reach b - 1.  Candidates come from prefix-suffix tiles: for a pair whose longer
word has b code points, the edit falls into one window of a few code points,
and both words agree on the prefix before and the suffix behind it.  So a word
goes, for b = its length and one more, to the tile of every window, keyed by b,
window, prefix and suffix.  Within a tile words are compared in blocks: rows of
a padded code-point matrix, left-aligned for prefixes and right-aligned for
suffixes, against the same rows shifted, one diagonal of the tile's block
matrix after another.  A pair is reported by the window in which its common
prefix ends, so once.

A tile cannot be hot: up to ``SHORT`` code points a window is two wide, so a
tile holds at most as many words as there are pairs of letters (90 * 90 + 90),
and a longer word has at most ``WINDOWS`` windows a length.  Counting words is
a partial aggregate.  Words follow their forms by pointer doubling; counts grow
tenfold along a chain, so it is short.

Edge cases: null text has no words; a null id counts as an empty one in the
checksum; repeated rows count again; an empty table gives an empty result;
other columns are not read; ties between forms go to the smaller word in
code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecount.llm.common import let
from grovecount.operators.tiles import whole_tiles
from grovecount.plans.lineage import RoundTables

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
SLIP = 31  # one run in this many loses a code point
SHORT = 32
WINDOWS = 16
PAIRS = 200_000  # pairs compared at a time
CELLS = 8_000_000  # code points of a padded matrix


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where the checksum of ``<doc_id>:<run>`` says so."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)

    def slip(h: Column) -> Column:
        at = (h % F.length(run)).cast("int")
        shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        return F.when(h % SLIP == 0, shorter).otherwise(run)

    return let(F.crc32(key.cast("binary")), slip)


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
) -> DataFrame:
    """``word, n`` of words of at least ``min_length`` code points and ``min_count`` occurrences."""
    low = F.translate(docs[text_col].cast("string"), UPPER, LOWER)
    runs = docs.select(docs[id_col].alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), 0)).alias("run"))
    # a slip only shortens
    runs = runs.where(F.length("run") >= min_length)
    words = runs.select(misspelt(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def tiled(words: DataFrame) -> DataFrame:
    """``key, b, start, stop, word, n``: each word in the tiles of all windows
    ``[start, stop)`` of pairs whose longer word has ``b`` code points."""
    size = F.length("word")
    longer = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("b"))
    wide = F.when(F.col("b") <= SHORT, F.lit(2)).otherwise(F.ceil(F.col("b") / WINDOWS).cast("int"))
    windows = longer.withColumn("wide", wide).select(
        "word", "n", "b", "wide", F.explode(F.sequence(F.lit(0), F.ceil(F.col("b") / F.col("wide")).cast("int") - 1)).alias("w")
    )
    placed = windows.select(
        "word", "n", "b", (F.col("w") * F.col("wide")).alias("start"),
        F.least(F.col("b"), (F.col("w") + 1) * F.col("wide")).alias("stop"),
    )
    rest = F.col("b") - F.col("stop")  # code points behind the window
    key = F.xxhash64(
        "b", "start", F.substring("word", F.lit(1), F.col("start")),
        F.substring("word", F.length("word") - rest + 1, rest),
    )
    return placed.select(key.alias("key"), "b", "start", "stop", "word", "n")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and the padded code points, left- and right-aligned (padding 0)."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    width = int(size.max())
    col = np.arange(width)
    left = np.zeros((len(words), width), dtype=np.uint32)
    left[col < size[:, None]] = flat
    right = np.zeros_like(left)
    right[col >= width - size[:, None]] = flat
    return size, left, right


def _same_start(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two matrices."""
    differ = a != b
    first = differ.argmax(axis=1)
    first[~differ.any(axis=1)] = a.shape[1]
    return first


def near_rows(words: list[str], tile: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """``(i, j)``: rows of one tile whose words are one edit apart, where the
    tile's window is the one that reports the pair.  ``tile`` ascends; few rows
    share a hash of their key by chance, hence ``b`` and ``start`` are compared."""
    size, left, right = _matrices(words)
    rows = np.arange(len(words))
    run_end = np.searchsorted(tile, tile, side="right")
    out_i, out_j = [], []
    shift = 1
    rows = rows[rows + shift < run_end[rows]]
    while len(rows):
        for lo in range(0, len(rows), PAIRS):
            i = rows[lo:lo + PAIRS]
            j = i + shift
            longer = np.maximum(size[i], size[j])
            fits = (longer == b[i]) & (b[i] == b[j]) & (start[i] == start[j])
            i, j, longer = i[fits], j[fits], longer[fits]
            shorter = np.minimum(size[i], size[j])
            prefix = np.minimum(_same_start(left[i], left[j]), shorter)
            suffix = np.minimum(_same_start(right[i, ::-1], right[j, ::-1]), shorter)
            # equal words (prefix == longer) are no pair
            hit = (prefix + suffix >= longer - 1) & (prefix < longer) & (start[i] <= prefix) & (prefix < stop[i])
            out_i.append(i[hit])
            out_j.append(j[hit])
        shift += 1
        rows = rows[rows + shift < run_end[rows]]
    if not out_i:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_tiles(batches, ["key"], rows=50_000):
        key = table.column("key").to_numpy()
        # words alone in their tile have no partner there
        run = np.searchsorted(key, key, side="right") - np.searchsorted(key, key, side="left")
        table = table.filter(pa.array(run > 1))
        if not table.num_rows:
            continue
        for part in _even_parts(table):
            b, start, stop = (part.column(c).to_numpy() for c in ("b", "start", "stop"))
            i, j = near_rows(part.column("word").to_pylist(), part.column("key").to_numpy(), b, start, stop)
            a, o = np.concatenate([i, j]), np.concatenate([j, i])
            pairs = pa.table({
                "word": part.column("word").take(pa.array(a)),
                "other": part.column("word").take(pa.array(o)),
                "other_n": part.column("n").take(pa.array(o)),
            })
            yield from pairs.combine_chunks().to_batches()


def _even_parts(table: pa.Table) -> Iterator[pa.Table]:
    """Whole tiles of words of about one length together, so that a matrix is
    as wide as its words and never larger than ``CELLS`` or one tile."""
    b = table.column("b").to_numpy()
    band = np.ceil(np.log2(np.maximum(b, SHORT))).astype(int)
    for v in np.unique(band):
        rows = np.flatnonzero(band == v)
        key = table.column("key").to_numpy()[rows]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        # the part a tile belongs to follows from the rows before it
        part = first // max(1, CELLS >> int(v))
        cuts = np.append(first[np.append(True, part[1:] != part[:-1])], len(rows))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield table.take(pa.array(rows[lo:hi]))


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: every pair of distinct words one edit apart, both ways."""
    dealt = tiled(words).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare, "word string, other string, other_n long")


def roots(forms: DataFrame, rounds: RoundTables) -> DataFrame:
    """``word, root`` for every row of ``word, form``."""
    state = rounds.write(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = state.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = state.join(on, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        state, moved = rounds.write_counted(step, "roots", F.col("moved"))
        state = state.drop("moved")
        if not moved:
            return state


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``word, n`` (distinct words)."""
    rounds = RoundTables(words.sparkSession, "spelling")
    words = rounds.write(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = words.join(near, "word", "left").withColumn("leads", -F.col("best.n") >= ratio * F.col("n"))
    named = rounds.write(near.select(
        "word", F.when(F.col("leads"), F.col("best.w")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("leads"), -F.col("best.n")).alias("form_n"),
    ), "named")
    last = roots(named.where("form is not null"), rounds)
    return named.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    from grovecount.sources.tables import read_table

    return spelling_variants(word_counts(read_table(spark, sf_dir, "documents")))
