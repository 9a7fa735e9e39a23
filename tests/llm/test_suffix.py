"""Removal of repeated passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from grovecount.llm import suffix

from .conftest import EDGE_ROWS


def brute(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - span + 1):
                w = b[p : p + span]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if i is not None and first[b[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, kept, len(b), len(b) - len(kept), spans))
    return sorted(out, key=str)


def passages(seed, n):
    r = random.Random(seed)
    alphabet = r.choice(["ab", "abcé ", "abcdefghij klmnopü", "a"])
    base = "".join(r.choice(alphabet) for _ in range(400))
    rows = []
    for k in range(n):
        t = ""
        for _ in range(r.randint(0, 5)):
            if r.random() < 0.5:
                a = r.randint(0, 350)
                t += base[a : a + r.randint(10, 130)]
            else:
                t += "".join(r.choice(alphabet) for _ in range(r.randint(0, 80)))
        rows.append((r.choice([k, k, max(0, k - 1)]), t))
    return rows


@pytest.mark.parametrize("rows", [EDGE_ROWS, [], *[passages(s, 25) for s in range(4)]])
def test_equals_brute_force(docs_of, rows, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 300)  # passages cross blocks
    monkeypatch.setattr(suffix, "RUN", 40)  # several levels
    out = suffix.remove_repeats(docs_of(rows), span=50, batch_bytes=700).collect()
    got = sorted(((r.id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in out), key=str)
    assert got == brute(rows)


def hot_prefixes(seed, n):
    """One header before ever different texts, in every document, some of which repeat."""
    r = random.Random(seed)
    header = "the same header of forty bytes in all of "
    bodies = ["".join(r.choices("abcdefgh ", k=60)) for _ in range(25)]
    own = lambda: "".join(r.choices("ijklmnop", k=r.randint(5, 60)))
    return [(k, "".join(header + r.choice([own(), r.choice(bodies)]) for _ in range(r.randint(1, 6)))) for k in range(n)]


@pytest.mark.parametrize("hot", [2, 3, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_hot_prefixes_equal_brute_force(docs_of, seed, hot, monkeypatch):
    monkeypatch.setattr(suffix, "RUN", 40)
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = hot_prefixes(seed, 60)
    out = suffix.remove_repeats(docs_of(rows), span=50, batch_bytes=1500).collect()
    got = sorted(((r.id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in out), key=str)
    assert got == brute(rows)
    assert sum(x[3] for x in got) > 0


def test_a_hot_prefix_is_spread_over_tasks():
    n, parts = 40_000, 50
    key = np.r_[np.full(n, 7), np.arange(100, 200)].astype(np.uint64)
    ctx = np.arange(n + 100).astype(np.uint64)
    table = suffix._deal_entries(3, key, ctx, parts)
    held, told = np.zeros(parts, int), 0
    for part, mixed, blob in zip(*(table.column(c).to_pylist() for c in ("part", "mixed", "blob"))):
        k, c = suffix._unpack(blob, False)
        held[part] += np.count_nonzero(k == 7)
        told += np.count_nonzero(c == suffix.FLAG)
        assert not (mixed and (k != 7).any())
    assert held.sum() == n + 1 and told == 1
    assert held.max() < 2 * n / parts


def test_stage_keeps_columns_and_drops_emptied(docs_of):
    text = "a passage that is long enough to count as a repeat of fifty bytes and more"
    rows = [(1, text), (2, text), (3, "other words before " + text + " and after"), (4, "clean"), (4, "")]
    out = suffix.without_repeats(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [
        (1, text), (3, "other words before  and after"), (4, ""), (4, "clean"),
    ]
