"""Removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if it is covered by a ``span``-byte string that also starts in a
document with a smaller id.  Documents are cut into batches by ranges of id, so
batch order is document order, and matching runs batch against index:

* Sparse suffix array of a batch.  Only suffixes at anchors enter: positions
  whose 24-byte prefix has the smallest hash in some window of ``span`` bytes
  (minimizers).  A string of ``span`` bytes always contains the same anchor
  wherever it occurs, so no repeat can be missed, at one entry per 14 bytes.
  An entry is (hash of the 24-byte prefix, hash of the whole context that any
  window around the anchor can touch), sorted by the prefix; hashed order
  instead of byte order lets a frequent prefix fall anywhere.
* Logarithmic index family.  Entries are dealt by prefix over all tasks.  In
  each, batches come in order: a run of new batches is sorted, merge-scanned
  against the existing levels, and levels of about equal size merge, so an
  entry is merged O(log n) times.  A scan finds entries whose whole context
  occurs in an earlier batch (they leave the index, which keeps first holders
  only) and prefixes that occur in different contexts.
* The same family over ``span``-byte windows settles the second kind: the
  windows around those anchors (the ends of repeats, and prefixes that are
  common by chance) are looked up exactly.
* A prefix with ``HOT`` contexts or more in one batch is of the second kind
  whatever other batches hold.  Its entries are dealt by prefix and context,
  and one entry tells the task of the prefix; so a batch sends fewer than
  ``HOT`` entries of any prefix to one task, however common the prefix is.

What leaves a batch is deduplicated first, so a passage found in a third of all
documents is one entry per batch.  Entries travel as sorted arrays, not rows.
Texts are shuffled once (to their batch); the three passes over them share
that exchange.

Bytes are compared through 64- to 88-bit hashes; ``batch_bytes`` bounds a
batch's memory (one text larger than that is a batch of its own and is worked
through in blocks).

Edge cases: null text counts as empty; texts shorter than ``span`` keep
everything; rows with a null id keep everything and remove nothing elsewhere;
rows that repeat an id do not remove each other's bytes; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


GRAM = 24  # bytes of an anchor's prefix
BLOCK = 1 << 18  # bytes worked on at once
MARGIN = 256
RUN = 200_000  # entries of a level-0 run at least
HOT = 8  # contexts of a prefix in a batch from which on they are dealt one by one
_M = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
    0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165,
    0x9C6E6877736C46E3, 0x2F9B4D3C7A1E0B57,
)]


def _u(n: int) -> np.uint64:
    return np.uint64(n)


FLAG = _u((1 << 40) - 1)  # in place of a context: the prefix has several


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _u(32))
    x = x * _M[3]
    x ^= x >> _u(29)
    x *= _M[5]
    x ^= x >> _u(32)
    return x


def _grams(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer (a view, unaligned)."""
    return np.ndarray((max(0, len(buf) - 7),), dtype="<u8", buffer=buf, strides=(1,))


def _fold(grams: list[np.ndarray]) -> np.ndarray:
    """Hash of rows given as a list of 8-byte columns."""
    h = np.zeros_like(grams[0])
    for i, g in enumerate(grams):
        h = (h ^ (h >> _u(31))) + (g ^ (g >> _u(29))) * _M[i % len(_M)]
    return _mix(h)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for every i with a whole window."""
    done = 1
    while done * 2 <= width:
        x = pick(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _offsets(start: int, stop: int) -> list[int]:
    """Offsets of 8-byte pieces that cover [start, stop)."""
    return list(range(start, stop - 8, 8)) + [stop - 8]


class Batch:
    """Bytes of a batch's documents in order of id, and its anchors."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, span: int):
        order = np.argsort(ids, kind="stable")
        self.rows = order  # of the table the texts came from
        self.ids = ids[order]
        if (np.diff(order) != 1).any():
            texts = texts.take(pa.array(order))
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        self.buf = raw[ends[0] : ends[-1]]
        self.starts = ends[:-1] - ends[0]
        self.ends = ends[1:] - ends[0]
        # rows with one id are one document as to order
        self.rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int64)
        self.span = span
        self.width = span - GRAM + 1  # positions of an anchor in a window

    def _block_anchors(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors in [lo, hi) and their order values."""
        span, width = self.span, self.width
        base, top = max(0, lo - MARGIN - span), min(len(self.buf), hi + MARGIN + 2 * span)
        g = _grams(self.buf[base:top])
        if top - base < span:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        m = top - base - GRAM + 1
        x = g[:m] * _M[0]
        x ^= x >> _u(31)
        x += g[8 : 8 + m] * _M[1]
        x ^= x >> _u(29)
        x *= _M[2]
        x += g[16 : 16 + m] * _M[4]
        x = _mix(x)
        least = _sliding(x, width, np.minimum)  # of the window from each position
        # windows must end inside their document
        d0 = np.searchsorted(self.ends, base, side="right")
        d1 = np.searchsorted(self.starts, top, side="left")
        s, e = self.starts[d0:d1], self.ends[d0:d1]
        edge = np.zeros(len(least) + 1, dtype=np.int32)
        np.add.at(edge, np.clip(np.maximum(s, e - span + 1) - base, 0, len(least)), 1)
        np.add.at(edge, np.clip(e - base, 0, len(least)), -1)
        least[np.cumsum(edge[:-1]) > 0] = 0
        pad = np.zeros(width - 1, dtype=np.uint64)
        best = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)[:m]
        at = np.flatnonzero(best == x[: len(best)])
        at = at[(at + base >= lo) & (at + base < hi)]
        return at + base, x[at]

    def anchors(self) -> None:
        """Find all anchors: positions ``at``, order values ``x``, documents
        (``rank``), bytes of the document to the left and right, prefix keys and
        context hashes."""
        found = [self._block_anchors(lo, min(len(self.buf), lo + BLOCK)) for lo in range(0, len(self.buf), BLOCK)]
        self.at = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        self.x = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.uint64)
        at, before, after = self.at, self.width - 1, self.span
        doc = np.searchsorted(self.ends, at, side="right")
        self.left = np.minimum(before, at - self.starts[doc]).astype(np.int32)
        self.right = np.minimum(after, self.ends[doc] - at).astype(np.int32)
        self.doc = self.rank[doc]
        g = _grams(self.buf)
        offsets = _offsets(-before, after)
        whole = (self.left == before) & (self.right == after)
        ctx = np.empty(len(at), dtype=np.uint64)
        a = at[whole]
        ctx[whole] = _fold([g[a + o] for o in offsets]) if len(a) else a
        if not whole.all():
            a, l, r = at[~whole], self.left[~whole].astype(np.int64), self.right[~whole].astype(np.int64)
            cols = np.arange(-before, after)
            inside = (cols[None, :] >= -l[:, None]) & (cols[None, :] < r[:, None])
            where = np.clip(a[:, None] + cols[None, :], 0, len(self.buf) - 1)
            rows = np.ascontiguousarray(np.where(inside, self.buf[where], 0).astype(np.uint8))
            pieces = [np.ascontiguousarray(rows[:, o + before : o + before + 8]).view("<u8")[:, 0] for o in offsets]
            pieces.append((l * 4096 + r).astype(np.uint64))
            ctx[~whole] = _fold(pieces)
        self.key = _mix(self.x * _M[6]) >> _u(16)
        self.ctx = np.minimum(ctx >> _u(24), FLAG - _u(1))
        # distinct entries: sorted codes, the anchors of each and its first document
        code = _pair(self.key, self.ctx)
        order = np.argsort(code)
        code = code[order]
        head = np.r_[True, code[1:] != code[:-1]] if len(code) else np.empty(0, bool)
        self.entry = np.empty(len(code), np.int64)  # of each anchor
        self.entry[order] = np.cumsum(head) - 1
        self.code = code[head]
        self.first_doc = np.minimum.reduceat(self.doc[order], np.flatnonzero(head)) if len(code) else self.doc
        self.head = order[head]

    def reach(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows around anchors (by index)."""
        at = self.at[some]
        return at - self.left[some], at + np.minimum(0, self.right[some] - self.span)

    def own_windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index into ``some``) of the windows that have an anchor of
        ``some`` as their smallest."""
        at, x = self.at[some], self.x[some]
        first, last = (np.array(v, dtype=np.int64) for v in self.reach(some))
        for way in (-1, 1):
            todo = np.arange(len(some))
            other = some + way
            while len(todo):
                near = (other >= 0) & (other < len(self.at))
                todo, other = todo[near], other[near]
                near = np.abs(self.at[other] - at[todo]) < self.width
                todo, other = todo[near], other[near]
                less = self.x[other] < x[todo]
                t, o = todo[less], other[less]
                if way < 0:
                    first[t] = np.maximum(first[t], self.at[o] + 1)
                else:
                    last[t] = np.minimum(last[t], self.at[o] - self.width)
                # a smaller neighbour hides what lies behind it
                todo, other = todo[~less], other[~less] + way
        size = np.maximum(0, last - first + 1)
        shift = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(first - shift, size), np.repeat(np.arange(len(some)), size)

    def window_hash(self, p: np.ndarray) -> np.ndarray:
        out = np.empty(len(p), np.uint64)
        g = _grams(self.buf)
        for lo in range(0, len(p), BLOCK):
            q = p[lo : lo + BLOCK]
            out[lo : lo + BLOCK] = _fold([g[q + o] for o in _offsets(0, self.span)])
        return out


def _pair(key: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return _mix(key * _M[7] + ctx * _M[8])


def _first_docs(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (sorted) and the smallest document of each."""
    order = np.argsort(code)
    code, doc = code[order], doc[order]
    head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    return code[head], np.minimum.reduceat(doc, head) if len(head) else doc


def _found(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which codes are in a sorted table."""
    if not len(table):
        return np.zeros(len(code), dtype=bool)
    at = np.minimum(np.searchsorted(table, code), len(table) - 1)
    return table[at] == code


ENTRY_SCHEMA = "part int, batch int, mixed boolean, blob binary"
ANSWER_SCHEMA = "slot int, kind int, blob binary"
CARRIED, MIXED, WINDOW = 1, 2, 3  # kinds of answers


def _pack(key: np.ndarray, ctx: np.ndarray | None) -> bytes:
    """48-bit keys and 40-bit contexts, or 64-bit keys alone, column by column."""
    if ctx is None:
        return key.astype("<u8").tobytes()
    parts = [key >> _u(16), key & _u(0xFFFF), ctx >> _u(8), ctx & _u(0xFF)]
    return b"".join(p.astype(t).tobytes() for p, t in zip(parts, ("<u4", "<u2", "<u4", "<u1")))


def _unpack(blob: bytes, windows: bool) -> tuple[np.ndarray, np.ndarray]:
    if windows:
        key = np.frombuffer(blob, "<u8")
        return key, np.zeros(len(key), np.uint64)
    n = len(blob) // 11
    a = np.frombuffer(blob, "<u4", n).astype(np.uint64)
    b = np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64)
    c = np.frombuffer(blob, "<u4", n, 6 * n).astype(np.uint64)
    d = np.frombuffer(blob, "<u1", n, 10 * n).astype(np.uint64)
    return (a << _u(16)) | b, (c << _u(8)) | d


def _deal(
    batch: int, key: np.ndarray, ctx: np.ndarray | None, parts: int, by: np.ndarray | None = None
) -> pa.Table:
    """One row per target: that target's entries of this batch, sorted.  Targets
    follow from the keys, or from ``by`` for entries of mixed prefixes."""
    part = (_mix(key if by is None else by) % _u(parts)).astype(np.int64)
    order = np.lexsort((key, part))
    part = part[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else [], len(part)].astype(np.int64)
    rows = [
        (int(part[a]), batch, by is not None, _pack(key[order[a:b]], None if ctx is None else ctx[order[a:b]]))
        for a, b in zip(cuts[:-1], cuts[1:])
    ]
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.table({"part": pa.array(cols[0], pa.int32()), "batch": pa.array(cols[1], pa.int32()),
                     "mixed": pa.array(cols[2], pa.bool_()), "blob": pa.array(cols[3], pa.binary())})


def _deal_entries(batch: int, key: np.ndarray, ctx: np.ndarray, parts: int) -> pa.Table:
    """Distinct entries of a batch: by prefix, those of hot prefixes by prefix and
    context, with one flag to the target of each hot prefix."""
    prefixes, which, contexts = np.unique(key, return_inverse=True, return_counts=True)
    hot = contexts[which] >= HOT
    told = prefixes[contexts >= HOT]
    plain = _deal(batch, np.r_[key[~hot], told], np.r_[ctx[~hot], np.full(len(told), FLAG)], parts)
    return pa.concat_tables([plain, _deal(batch, key[hot], ctx[hot], parts, by=_pair(key[hot], ctx[hot]))])


class Family:
    """Levels of sorted runs over one part of the prefixes, batches in order."""

    def __init__(self):
        self.levels: list[tuple] = []  # (key, ctx, batch, mixed), sorted by key, ctx, batch
        self.carried: list[tuple] = []  # (key, ctx, batch) found in an earlier batch

    def scan(self, runs: list[tuple]) -> tuple:
        """Merge sorted runs; entries an earlier batch holds leave."""
        key, ctx, batch, mixed = (np.concatenate(c) for c in zip(*runs))
        order = np.argsort(key)
        k = key[order]
        same = np.r_[False, k[1:] == k[:-1]]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        o = order[tied]
        order[tied] = o[np.lexsort((batch[o], ctx[o], k[tied]))]
        ctx, batch, mixed = ctx[order], batch[order], mixed[order]
        again = same & np.r_[False, ctx[1:] == ctx[:-1]]
        if again.any():
            told = again & (ctx != FLAG)
            self.carried.append((k[told], ctx[told], batch[told]))
            keep = ~again
            k, ctx, batch, mixed = k[keep], ctx[keep], batch[keep], mixed[keep]
            same = np.r_[False, k[1:] == k[:-1]]
        # what is left with an equal prefix has different contexts
        return k, ctx, batch, mixed | same | np.r_[same[1:], False]

    def add(self, runs: list[tuple]) -> None:
        level = self.scan(runs)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = self.scan([self.levels.pop(), level])
        self.levels.append(level)

    def close(self) -> tuple:
        return self.scan(self.levels) if len(self.levels) > 1 else self.levels[0]


def _answers(windows: bool, slots: list[int]):
    """Walk sorted (part, batch, blob) rows; per part one index family."""

    def told(kind, key, ctx, batch):
        code = key if windows else _pair(key, ctx)
        order = np.argsort(batch, kind="stable")
        code, batch = code[order], batch[order]
        which, head = np.unique(batch, return_index=True)
        blobs = [c.astype("<u8").tobytes() for c in np.split(code, head[1:])] if len(head) else []
        return pa.RecordBatch.from_arrays(
            [
                pa.array([slots[b] for b in which.tolist()], pa.int32()), pa.array([kind] * len(which), pa.int32()),
                pa.array(blobs, pa.binary()),
            ],
            ["slot", "kind", "blob"],
        )

    def finish(family, waiting):
        if waiting:
            family.add(waiting)
        if not family.levels:
            return
        key, ctx, batch, mixed = family.close()
        for k, c, b in family.carried:
            yield told(WINDOW if windows else CARRIED, k, c, b)
        mixed &= ctx != FLAG
        if not windows and mixed.any():
            yield told(MIXED, key[mixed], ctx[mixed], batch[mixed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, waiting, size, part = Family(), [], 0, None
        for b in batches:
            for p, batch, mixed, blob in zip(*(b.column(c) for c in ("part", "batch", "mixed", "blob"))):
                if p.as_py() != part:
                    yield from finish(family, waiting)
                    family, waiting, size, part = Family(), [], 0, p.as_py()
                key, ctx = _unpack(blob.as_py(), windows)
                waiting.append((key, ctx, np.full(len(key), batch.as_py(), np.int64), np.full(len(key), mixed.as_py())))
                size += len(key)
                if size >= RUN:
                    family.add(waiting)
                    waiting, size = [], 0
        yield from finish(family, waiting)

    return run


def _codes(answers: pa.Table, kind: int) -> np.ndarray:
    blobs = [b.as_py() for k, b in zip(answers.column("kind").to_pylist(), answers.column("blob")) if k == kind]
    return np.sort(np.frombuffer(b"".join(blobs), "<u8"))


def _batch(table: pa.Table, span: int) -> Batch:
    return Batch(table.column("id").to_numpy(), table.column("text").combine_chunks(), span)


def _index_batch(span: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        batch = _batch(table, span)
        batch.anchors()
        head = batch.head
        return _deal_entries(table.column("batch")[0].as_py(), batch.key[head], batch.ctx[head], parts)

    return run


def _asked(batch: Batch, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which anchors have their context first in this batch in their own
    document; and (start, hash, document) of the windows around those whose
    prefix occurs in different contexts."""
    batch.anchors()
    own = batch.first_doc[batch.entry] == batch.doc
    some = np.flatnonzero(own & _found(batch.code, mixed)[batch.entry])
    p, which = batch.own_windows(some)
    return own, p, batch.window_hash(p), batch.doc[some][which]


def _window_batch(span: int, parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _deal(0, np.empty(0, np.uint64), None, parts)
        _, _, code, _ = _asked(_batch(table, span), _codes(answers, MIXED))
        return _deal(table.column("batch")[0].as_py(), np.unique(code), None, parts)

    return run


def _covered(batch: Batch, answers: pa.Table) -> np.ndarray:
    """Bytes of the batch to remove."""
    own, p, code, doc = _asked(batch, _codes(answers, MIXED))
    cover = np.zeros(len(batch.buf) + 1, dtype=np.int32)
    # contexts held by earlier batches or by smaller documents: all their windows go
    settled = np.flatnonzero(~own | _found(batch.code, _codes(answers, CARRIED))[batch.entry])
    first, last = batch.reach(settled)
    some = last >= first
    np.add.at(cover, first[some], 1)
    np.add.at(cover, last[some] + batch.span, -1)
    if len(p):
        distinct, least = _first_docs(code, doc)
        gone = (least[np.searchsorted(distinct, code)] < doc) | _found(code, _codes(answers, WINDOW))
        np.add.at(cover, p[gone], 1)
        np.add.at(cover, p[gone] + batch.span, -1)
    np.cumsum(cover, out=cover)
    return cover[:-1] > 0


def _finish_batch(span: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(table):
            batch = _batch(table, span)
            cover = _covered(batch, answers)
            for i, (s, e) in enumerate(zip(batch.starts.tolist(), batch.ends.tolist())):
                data, gone = batch.buf[s:e], cover[s:e]
                spans, text = 0, None
                if gone.any():
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = data[~gone].tobytes()
                    text = kept.decode("utf-8", "ignore")
                else:
                    kept = data.tobytes()
                rows.append((int(batch.ids[i]), kept, e - s, e - s - len(kept), spans, text))
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        out = pa.table({
            n: pa.array(c, k) for n, c, k in zip(("id", "kept", "n_bytes", "n_removed", "n_spans", "text"), cols, kinds)
        })
        # the rows' other columns come out as they went in
        rest = table.column("doc").combine_chunks()
        return out.append_column("doc", rest.take(pa.array(batch.rows)) if len(table) else rest)

    return run


def batch_bounds(docs: DataFrame, batch_bytes: int) -> list[int]:
    """Ids at which batches begin after the first: ranges of about ``batch_bytes``
    of text.  The driver gets four rows per batch, of fine ranges that Spark's
    range partitioning makes of the ids; only ids and sizes are shuffled."""
    sized = docs.select("id", F.octet_length("text").cast("long").alias("size"))
    want = (sized.agg(F.sum("size")).first()[0] or 0) // batch_bytes
    if not want:
        return []
    fine = sized.repartitionByRange(4 * (want + 1), "id").groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("id").alias("first"), F.sum("size").alias("size")
    )
    bounds, held = [], 0
    for first, size in sorted((r["first"], r["size"]) for r in fine.collect()):
        if held and held + size > batch_bytes:
            bounds.append(first)
            held = 0
        held += size
    return bounds


def even_keys(spark, parts: int) -> list[int]:
    """One integer per partition that Spark's hash deals there, so that batches
    spread evenly: as many as batches."""
    n = spark.range(parts * (10 + parts.bit_length() * 2)).select(F.col("id").cast("int").alias("k"))
    keys = n.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k")).collect()
    keys = [r.k for r in sorted(keys, key=lambda r: r.p)]
    spare = (k for k in range(10**9, 10**9 + parts))
    return keys + [next(spare) for _ in range(parts - len(keys))]


def remove_repeats(
    docs: DataFrame, span: int = 50, batch_bytes: int = 12 << 20, batches_per_part: int = 2,
    carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, kept, n_bytes, n_removed, n_spans, text, doc`` per row of ``docs``:
    ``kept`` are the remaining bytes concatenated; where something was removed,
    ``text`` is ``kept`` less the halves of characters that were cut through.
    ``doc`` holds the row's columns named in ``carry``, unchanged."""
    if span < GRAM + 8:
        raise ValueError(f"span must be at least {GRAM + 8} bytes")
    every = docs.select(
        docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        F.struct(F.lit(True).alias("__row"), *[docs[c] for c in carry]).alias("doc"),
    )
    named = every.where("id is not null")
    bounds = np.array(batch_bounds(named, batch_bytes), dtype=np.int64)
    n_batches = len(bounds) + 1
    parts = -(-n_batches // batches_per_part)  # of the prefixes, each with an index family
    slots = even_keys(docs.sparkSession, n_batches)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_of = np.array(slots, dtype=np.int32)
        for b in batches:
            at = np.searchsorted(bounds, b.column("id").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot_of[at]), pa.array(at), b.column("id"), b.column("text"), b.column("doc")],
                ["slot", "batch", "id", "text", "doc"],
            )

    doc_type = every.schema["doc"].dataType
    long, string = T.LongType(), T.StringType()
    texts = named.mapInArrow(number, T.StructType([
        T.StructField("slot", T.IntegerType()), T.StructField("batch", T.IntegerType()), T.StructField("id", long),
        T.StructField("text", string), T.StructField("doc", doc_type),
    ])).repartition(n_batches, "slot")
    result = T.StructType([
        T.StructField("id", long), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", long),
        T.StructField("n_removed", long), T.StructField("n_spans", long), T.StructField("text", string),
        T.StructField("doc", doc_type),
    ])
    entries = texts.groupBy("slot").applyInArrow(_index_batch(span, parts), ENTRY_SCHEMA)
    ordered = entries.repartition(parts, "part").sortWithinPartitions("part", "batch")
    settled = ordered.mapInArrow(_answers(False, slots), ANSWER_SCHEMA)
    windows = texts.groupBy("slot").cogroup(settled.where(F.col("kind") == MIXED).groupBy("slot")).applyInArrow(
        _window_batch(span, parts), ENTRY_SCHEMA
    )
    ordered = windows.repartition(parts, "part").sortWithinPartitions("part", "batch")
    answers = settled.unionByName(ordered.mapInArrow(_answers(True, slots), ANSWER_SCHEMA))
    out = texts.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(_finish_batch(span), result)
    loose = every.where("id is null").select(
        "id", F.encode("text", "UTF-8").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.lit(None).cast("string").alias("text"), "doc",
    )
    return out.unionByName(loose)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with its columns, less repeated passages and less the documents
    of which nothing else was left; a null text comes out empty."""
    rest = tuple(c for c in docs.columns if c != text_col)
    out = remove_repeats(docs, carry=rest, id_col=id_col, text_col=text_col, **limits)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.coalesce("text", F.decode("kept", "UTF-8"))
    return out.select(*[text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])


def op3(spark, sf_dir):
    from grovecount.sources.tables import read_table

    out = remove_repeats(read_table(spark, sf_dir, "documents"), span=50)
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
