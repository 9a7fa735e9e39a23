"""Best-fit packing of tokenised documents by bulk-synchronous sweeps.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces over half
the capacity each open a sequence; the rest are placed band by band, largest
lengths first.  One sweep places many pieces at once:

* the open gaps (a gap that can take several pieces of the band gives several
  slots) and the pieces are range-sorted together by size, descending;
* walking down that order, each piece takes the nearest slot above it that is
  still free, i.e. the smallest gap it fits (best fit).  Every range partition
  is swept on its own; what is left over in it is then matched across
  partitions by rank: the driver sees two counts per partition, never pieces
  or gaps, and the matching itself is a join on the rank;
* gaps are updated, the largest unplaced pieces of the band open as many new
  sequences as the band needs at least, and the sweep repeats until the band
  is placed.

Bands are ``(capacity / (k + 1), capacity / k]`` for ``k = 1..7``, of which
exactly ``k`` pieces fit a new sequence, then halving widths.

Edge cases: a null or empty text is one separator token; equal lengths and
repeated rows are separate pieces ordered by a row number; null identifiers
are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovecount.llm.common import Stored, keyed_text

END_OF_DOCUMENT = 0
LONG_TEXT = 500_000  # characters; such texts take the tokenizer with flat memory
PIECE_SCHEMA = "id long, piece int, start long, length long, crc long"


def encoder(path: str, ranks: str, pattern: str):
    """Function from a text to its ids.  ``ranks`` holds the vocabulary of
    ``path`` for the faster of the two libraries; both give the same ids."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) > LONG_TEXT or any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but maybe the first."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame, capacity: int, path: str, ranks: str, pattern: str,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, piece, start, length, crc`` of every document's token pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array(encode(text) + [END_OF_DOCUMENT], dtype="<u4")
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "piece", "start", "length", "crc"]
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def bands(capacity: int) -> list[tuple[int, int, int]]:
    """(lo, hi, k): lengths in (lo, hi], descending; ``k`` pieces fit a new
    sequence exactly, or 0 for the halving bands."""
    out, hi = [], capacity // 2
    for k in range(2, 8):
        lo = capacity // (k + 1)
        if lo < hi:
            out.append((lo, hi, k))
            hi = lo
    while hi > 0:
        lo = hi // 2 if hi > 16 else 0
        out.append((lo, hi, 0))
        hi = lo
    return out


def _sweep_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep one sorted partition: pieces (kind 1) take the latest free slot
    (kind 0).  Yields matched pieces with their sequence, unmatched pieces with
    their rank in order, unmatched slots with their rank from the latest."""
    free: list[tuple[int, int]] = []
    pid, waiting = 0, 0
    for b in batches:
        out = []
        pid = b.column("pid")[0].as_py() if b.num_rows else pid
        for kind, item, size in zip(*(b.column(c).to_pylist() for c in ("kind", "item", "size"))):
            if kind == 0:
                free.append((item, size))
            elif free:
                out.append((pid, 2, 0, item, size, free.pop()[0]))
            else:
                out.append((pid, 1, waiting, item, size, None))
                waiting += 1
        yield _left(out)
    for lo in range(0, len(free), 50_000):
        top = len(free) - 1
        yield _left([(pid, 0, top - i, *free[i], None) for i in range(lo, min(lo + 50_000, len(free)))])


LEFT_SCHEMA = "pid int, kind int, rank long, item long, size long, seq long"


def _left(rows) -> pa.RecordBatch:
    names = ["pid", "kind", "rank", "item", "size", "seq"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


MATCH_SLOT, MATCH_PIECE, UNPLACED = 0, 1, 2


def _rank_segments(counts) -> tuple[list[tuple], int]:
    """Match what the partitions left over, by rank.

    ``counts``: {pid: (pieces left, slots left)}.  Pieces of a partition take
    the latest free slots of the partitions above it.  Gives rows (role, pid,
    from, to, base): ranks from..to-1 of that role and partition are match
    numbers from base on or, for unplaced pieces, their numbers from base on.
    """
    segments, stack, matches, unplaced = [], [], 0, 0
    for pid in sorted(counts):
        n_pieces, n_slots = counts[pid]
        done = 0
        while done < n_pieces and stack:
            top = stack[-1]
            n = min(n_pieces - done, top[2] - top[1])
            segments.append((MATCH_PIECE, pid, done, done + n, matches))
            segments.append((MATCH_SLOT, top[0], top[1], top[1] + n, matches))
            top[1] += n
            done += n
            matches += n
            if top[1] == top[2]:
                stack.pop()
        if done < n_pieces:
            segments.append((UNPLACED, pid, done, n_pieces, unplaced))
            unplaced += n_pieces - done
        if n_slots:
            stack.append([pid, 0, n_slots])
    return segments, unplaced


def _numbered(left: DataFrame, segments: list[tuple]) -> DataFrame:
    """``role, number, item, size`` of what the sweep left over; ``segments``
    are a few rows per partition."""
    # by (piece or slot, partition, rank): where each segment begins
    table = sorted((int(role != MATCH_SLOT), pid, lo, hi, role, base) for role, pid, lo, hi, base in segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = np.array(table, dtype=np.int64).reshape(-1, 6)
        begin = (cols[:, 0] << 62) + (cols[:, 1] << 40) + cols[:, 2]
        for b in batches:
            kind, pid, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("kind", "pid", "rank"))
            at = np.searchsorted(begin, (kind << 62) + (pid << 40) + rank, side="right") - 1
            if not len(cols):
                continue
            seg = cols[np.maximum(at, 0)]
            hit = (at >= 0) & (seg[:, 0] == kind) & (seg[:, 1] == pid) & (rank < seg[:, 3])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seg[hit, 4].astype(np.int32)), pa.array((seg[:, 5] + rank - seg[:, 2])[hit]),
                    b.column("item").filter(pa.array(hit)), b.column("size").filter(pa.array(hit)),
                ],
                ["role", "number", "item", "size"],
            )

    return left.mapInArrow(run, "role int, number long, item long, size long")


def _sweep(tables: Stored, number: int, rows: int, waiting: DataFrame, bins: DataFrame, lo: int, hi: int) -> tuple[DataFrame, DataFrame, int]:
    """One sweep of the pieces ``waiting`` (item, size) over ``bins`` (seq, gap).

    Returns the placements (item, size, seq), the unplaced pieces (item, size,
    number: 0 for the largest) and their count.
    """
    n_slots = F.greatest(F.lit(1), F.floor(F.col("gap") / hi))
    slots = (
        bins.where(F.col("gap") > lo)
        .select("seq", "gap", n_slots.alias("n"), F.explode(F.sequence(F.lit(1), n_slots.cast("int"))).alias("i"))
        .select(
            F.lit(0).alias("kind"), F.col("seq").alias("item"),
            # all slots of a gap are as wide as the band but the last, which has the rest
            F.when(F.col("i") < F.col("n"), F.lit(hi).cast("long"))
            .otherwise(F.col("gap") - (F.col("n") - 1) * hi).cast("long").alias("size"),
        )
    )
    ordered = [F.desc("size"), F.asc("kind"), F.asc("item")]
    items = slots.unionByName(waiting.select(F.lit(1).alias("kind"), "item", "size"))
    swept = tables.add(
        items.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        .withColumn("pid", F.spark_partition_id())
        .mapInArrow(_sweep_partition, LEFT_SCHEMA),
        f"sweep-{number}", rows,
    )
    counts: dict[int, list[int]] = {}
    for r in swept.where("kind < 2").groupBy("pid", "kind").count().collect():  # two counts a partition
        counts.setdefault(r.pid, [0, 0])[1 - r.kind] = r["count"]
    segments, n = _rank_segments(counts)
    numbered = _numbered(swept.where("kind < 2"), segments)
    pieces_left = numbered.where(F.col("role") == MATCH_PIECE).select("number", "item", "size")
    slots_left = numbered.where(F.col("role") == MATCH_SLOT).select("number", F.col("item").alias("seq"))
    matched = pieces_left.join(slots_left.hint("merge"), "number").select("item", "size", "seq")
    placed = swept.where("kind = 2").select("item", "size", "seq").unionByName(matched)
    return placed, numbered.where(F.col("role") == UNPLACED).select("item", "size", "number"), n


def _room_left(room: DataFrame, placed: DataFrame, capacity: int) -> DataFrame:
    """Gaps (seq, gap) after ``placed``; an opened sequence is named by the piece that opened it."""
    taken = placed.select(
        "seq", (F.when(F.col("item") == F.col("seq"), capacity).otherwise(0) - F.col("size")).alias("gap")
    )
    return room.unionByName(taken).groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0")


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """Place ``item`` (unique long) of ``size`` (1..capacity) tokens: returns
    ``item, size, seq, offset``."""
    band_list = bands(capacity)
    tables, number = Stored(sizes.sparkSession, "packing"), 0
    # what is over half the capacity shares a sequence with smaller pieces only
    alone = sizes.where(F.col("size") * 2 > capacity).select("item", "size", F.col("item").alias("seq"))
    band = F.lit(None).cast("int")
    for i, (lo, hi, _) in enumerate(band_list):
        band = F.when((F.col("size") > lo) & (F.col("size") <= hi), i).otherwise(band)
    present = {
        r.b: (r.n, r.top) for r in sizes.groupBy(band.alias("b"))
        .agg(F.count("*").alias("n"), F.max("size").alias("top")).collect()
    }
    total = sum(n for n, _ in present.values())
    every = tables.add(alone, "placed", present.get(None, (0, 0))[0])
    # what is open at the start of a band; only the band's own placements change it
    room = every.select("seq", (capacity - F.col("size")).alias("gap"))
    for i, (lo, hi, k) in enumerate(band_list):
        n, top = present.get(i, (0, 0))
        if not n:
            continue
        waiting = sizes.where((F.col("size") > lo) & (F.col("size") <= hi)).select("item", "size")
        here = None
        while n:
            gaps = room if here is None else _room_left(room, here, capacity)
            number += 1
            placed, unplaced, left = _sweep(tables, number, 2 * total, waiting, gaps, lo, top)
            found, n, opening = n - left, left, 0
            if n and k:
                # any k of the band fit one sequence: open as many as that takes, the rest follow by rank
                opening = math.ceil(n / k)
                opened = unplaced.where(F.col("number") < opening)
                seqs = opened.select(F.col("number").alias("turn"), F.col("item").alias("seq"))
                turn = unplaced.where(F.col("number") >= opening).withColumn("turn", F.col("number") % opening)
                placed = placed.unionByName(turn.join(seqs.hint("merge"), "turn").select("item", "size", "seq"))
                n = 0
            elif n:
                waiting = unplaced.select("item", "size")
                top, tokens = unplaced.agg(F.max("size"), F.sum("size")).first()
                if found < n:
                    # gaps take little more: the largest pieces open as many sequences as all need at least
                    opening = math.ceil(tokens / capacity)
                    opened = unplaced.where(F.col("number") < opening)
                    waiting = unplaced.where(F.col("number") >= opening).select("item", "size")
                    n -= min(n, opening)
            if opening:
                placed = placed.unionByName(opened.select("item", "size", F.col("item").alias("seq")))
            here = tables.add(placed, f"placed-{i}", found + left)
        every = every.unionByName(here)
        room = tables.add(_room_left(room, here, capacity), f"room-{i}", total)
    # a sequence holds at most `capacity` pieces, so its window is bounded
    before = W.partitionBy("seq").orderBy(F.desc("size"), "item").rowsBetween(W.unboundedPreceding, -1)
    return every.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def pack_documents(
    docs: DataFrame, capacity: int = 2048, path: str | None = None, ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, piece, start, length, crc, seq, offset``: one row per piece."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut_up = pieces(docs, capacity, path, ranks, pattern, id_col, text_col).checkpoint()
    # the checkpoint's files fix the row numbers
    cut_up = cut_up.withColumn("item", F.monotonically_increasing_id())
    full = F.col("length") == capacity
    own = cut_up.where(full).withColumn("seq", F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut_up.where(~full)
    placed = pack(rest.select("item", F.col("length").alias("size")), capacity).drop("size")
    return own.unionByName(rest.join(placed.hint("merge"), "item")).drop("item")


def op7(spark, sf_dir):
    from grovecount.sources.tables import read_table

    out = pack_documents(read_table(spark, sf_dir, "documents"), capacity=2048)
    return out.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("seq").alias("sequence_id"), "offset",
    )
