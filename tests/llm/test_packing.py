"""Packing: whole, gapless, near best-fit decreasing, ids as the library's."""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grovecount.llm import packing

from .conftest import EDGE_ROWS


def best_fit_decreasing(sizes, capacity):
    gaps, n = [], 0
    for x in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            bisect.insort(gaps, gaps.pop(i) - x)
        else:
            n += 1
            bisect.insort(gaps, capacity - x)
    return n


def sized(spark, sizes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item long, size long")


@pytest.mark.parametrize("capacity, sizes", [
    (64, random.Random(1).choices(range(1, 65), k=300)), (64, random.Random(2).choices(range(1, 13), k=300)),
    (64, random.Random(3).choices([1, 2, 3, 40], k=300)), (64, [20] * 100), (64, [1] * 300), (64, [64, 64, 1]), (64, [33] * 9 + [31] * 9), (2048, [300] * 50), (64, []),
])
def test_pack_is_whole_and_close_to_best_fit(spark, capacity, sizes):
    rows = packing.pack(sized(spark, sizes), capacity).collect()
    assert sorted(r.item for r in rows) == list(range(len(sizes)))
    bins = {}
    for r in rows:
        assert r.size == sizes[r.item]
        bins.setdefault(r.seq, []).append((r.offset, r.size))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(bins) <= best_fit_decreasing(sizes, capacity) * 1.03 + 1


def test_rank_segments_match_like_one_stack():
    r = random.Random(4)
    for _ in range(50):
        counts = {p: [r.randint(0, 4), r.randint(0, 4)] for p in range(r.randint(0, 6))}
        segments, unplaced = packing._rank_segments(counts)
        table = {}
        for role, pid, lo, hi, base in segments:
            for k in range(lo, hi):
                assert table.setdefault((role, pid, k), base + k - lo) == base + k - lo
        stack, pairs, free = [], set(), []
        for pid in sorted(counts):
            for k in range(counts[pid][0]):
                if stack:
                    pairs.add(((pid, k), stack.pop()))
                else:
                    free.append((pid, k))
            n = counts[pid][1]
            stack += [(pid, n - 1 - k) for k in range(n)]
        got = {
            ((p, k), (q, j))
            for (a, p, k), m in table.items() if a == packing.MATCH_PIECE
            for (b, q, j), o in table.items() if b == packing.MATCH_SLOT and o == m
        }
        assert got == pairs and unplaced == len(free)
        assert [table[packing.UNPLACED, p, k] for p, k in free] == list(range(len(free)))


def test_documents_keep_the_tokenizers_ids(docs_of):
    rows = EDGE_ROWS + [(20, "ends with <|endoftext|> inside"), (21, "tab\t\ttwo  spaces \n\n new"), (22, "naïve 中文 123's")]
    out = packing.pack_documents(docs_of(rows), capacity=512).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) if len(ids) <= 512 else len(ids) % 512 or 512
        starts = [0, *range(first, len(ids), 512)]
        for n, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((i, n, s, e - s, zlib.crc32(ids[s:e].tobytes())))
    assert sorted(((r.id, r.piece, r.start, r.length, r.crc) for r in out), key=str) == sorted(want, key=str)
    used = {}
    for r in out:
        used.setdefault(r.seq, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512


def test_no_documents(docs_of):
    assert packing.pack_documents(docs_of([])).count() == 0
