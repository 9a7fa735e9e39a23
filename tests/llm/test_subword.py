"""Sampled segmentations: distinct, reversible, distributed as they should be."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from grovecount.llm import subword

from .conftest import EDGE_ROWS

PATH = subword._model_path()


def test_round_trip_and_distinct(docs_of):
    rows = EDGE_ROWS + [(30, " lead"), (31, "two  spaces   three "), (32, "a\x00b"), (33, "the cat sat")]
    out = subword.decode(subword.sample_segmentations(docs_of(rows), k=3, seed=5)).collect()
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    by = defaultdict(list)
    for r in out:
        assert r.text in texts[r.id]
        by[r.id, r.text].append(r)
    assert set(by) == {(i, t) for i, own in texts.items() for t in own}
    for (i, t), rs in by.items():
        copies = sum(1 for j, u in rows if j == i and (u or "") == t)
        assert len({bytes(r.ids) for r in rs}) * copies == len(rs)
        order = [r.perturbed for r in sorted(rs, key=lambda r: r.sample)]
        assert order == sorted(order, reverse=True)
        # fewer than asked for means all there are
        assert len(rs) == copies * 3 or all(r.log_inclusion == 0.0 for r in rs) and len(t) < 5


def test_samples_do_not_depend_on_partitioning(docs_of):
    docs = docs_of([(i, f"some words number {i} in a text") for i in range(40)])
    one, many = (
        sorted((r.id, r.sample, bytes(r.ids)) for r in subword.sample_segmentations(d, k=2, seed=1).collect())
        for d in (docs.coalesce(1), docs.repartition(7))
    )
    assert one == many
    other = subword.sample_segmentations(docs, k=2, seed=2).collect()
    assert sorted((r.id, r.sample, bytes(r.ids)) for r in other) != one


def segmentations(vocabulary, text):
    piece = {s.decode(): i for i, s in enumerate(vocabulary.surface) if s and i >= 259}
    out = []

    def extend(at, logp, ids):
        if at == len(text):
            out.append((tuple(ids), logp))
        for end in range(at + 1, len(text) + 1):
            if (i := piece.get(text[at:end])) is not None:
                extend(end, logp + vocabulary.weight[i], [*ids, i])

    extend(0, 0.0, [])
    z = np.logaddexp.reduce([w for _, w in out])
    return {a: float(np.exp(w - z)) for a, w in out}


def test_sampling_without_replacement_has_the_right_odds():
    vocabulary = subword.Vocabulary(PATH, 0.2)
    p = segmentations(vocabulary, " on a")
    n = 30_000
    drawn = defaultdict(dict)
    for i, j, ids, logp, _, inclusion in subword.sample_block(subword.Lattice(vocabulary), list(range(n)), ["on a"] * n, 3, 7):
        seg = tuple(np.frombuffer(ids, "<u4").tolist())
        assert abs(np.exp(logp) - p[seg]) < 1e-9 and inclusion <= 0.0
        drawn[i][j] = seg
    seen = Counter(tuple(d[j] for j in range(3)) for d in drawn.values())
    for a, b, c in itertools.permutations(p, 3):
        q = p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])
        assert abs(seen[a, b, c] / n - q) < 5 * np.sqrt(q / n) + 1e-4


def test_inclusion_scores_make_sums_unbiased():
    """Sum over the sample of f / inclusion estimates the sum over all."""
    vocabulary = subword.Vocabulary(PATH, 0.2)
    p = segmentations(vocabulary, " the cat")
    n = 20_000
    total = 0.0
    for *_, logp, _, inclusion in subword.sample_block(
        subword.Lattice(vocabulary), list(range(n)), ["the cat"] * n, 4, 3
    ):
        total += np.exp(logp - inclusion)
    assert len(p) > 4 and abs(total / n - 1.0) < 0.02


def test_fewer_segmentations_than_asked_for():
    vocabulary = subword.Vocabulary(PATH, 0.2)
    p = segmentations(vocabulary, " on")
    rows = subword.sample_block(subword.Lattice(vocabulary), [1], ["on"], 50, 1)
    assert {tuple(np.frombuffer(r[2], "<u4").tolist()) for r in rows} == set(p)
    assert all(r[5] == 0.0 for r in rows)


def test_probability_is_the_product_over_words():
    vocabulary = subword.Vocabulary(PATH, 0.2)
    r = random.Random(1)
    words = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(12)]
    odds = [segmentations(vocabulary, " " + w) for w in words]
    for _, _, ids, logp, _, _ in subword.sample_block(subword.Lattice(vocabulary), [1], [" ".join(words)], 3, 1):
        pieces, want = np.frombuffer(ids, "<u4").tolist(), 0.0
        for w, own in zip(words, odds):
            held, size = [], 0
            while size < len((" " + w).encode()):
                held.append(pieces.pop(0))
                size += len(vocabulary.surface[held[-1]])
            want += np.log(own[tuple(held)])
        assert not pieces and abs(want - logp) < 1e-9


def test_encode_is_the_models_own(docs_of):
    rows = [(1, "Hello  world"), (2, ""), (3, None), (4, "é 日本 test")]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = subword.decode(subword.encode(docs_of(rows))).select("id", "ids", "text").collect()
    for r in out:
        text = dict(rows)[r.id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == model.encode(text) and r.text == text


def test_nothing_to_sample(docs_of):
    assert subword.sample_segmentations(docs_of([])).agg(F.count("*")).first()[0] == 0


def test_rows_do_not_depend_on_their_block():
    """Ids and both scores are the same, bit by bit, in one block and row by row."""
    vocabulary = subword.Vocabulary(PATH, 0.2)
    r = random.Random(4)
    texts = [" ".join("".join(r.choices("abcdeé ßth", k=r.randint(1, 9))) for _ in range(r.randint(0, 40))) for _ in range(60)]
    together = subword.sample_block(subword.Lattice(vocabulary), list(range(60)), texts, 3, 1)
    alone = [row for i, t in enumerate(texts) for row in subword.sample_block(subword.Lattice(vocabulary), [i], [t], 3, 1)]
    assert sorted(map(tuple, together), key=str) == sorted(map(tuple, alone), key=str) and len(alone) > 100


def test_lattice_keeps_the_words_of_many_blocks(monkeypatch):
    """300 000 distinct words, about as many as a block-by-block run of the documents
    meets before a smaller lattice would start anew, within 200 MB."""
    from grovecount.llm import subword

    lattice = subword.Lattice(subword.Vocabulary(subword._model_path(), 0.2))
    held = sum(getattr(lattice, name).nbytes for name in (*lattice.EDGE, *lattice.NODE))
    assert held < 200_000_000 and subword.LATTICE_EDGES * 1.5 == len(lattice.first)
    lattice.numbers([f"w{i}" for i in range(300_000)])
    assert 1_500_000 < lattice.n_edges <= subword.LATTICE_EDGES


def test_full_lattice_keeps_the_words_of_two_blocks(monkeypatch):
    """Words that each block has are added once, not after each time the lattice is full;
    samples are those of a lattice that was never full."""
    vocabulary = subword.Vocabulary(PATH, 0.2)
    r = random.Random(8)
    common = ["".join(r.choices("abcdeé ßth", k=7)).replace(" ", "") + "q" for _ in range(200)]
    blocks = [[" ".join([*common, *(f"n{b}x{i}" for i in range(200))])] for b in range(8)]
    added = Counter()
    monkeypatch.setattr(
        subword.Lattice, "add", lambda self, words, add=subword.Lattice.add: (added.update(words), add(self, words))[1]
    )
    whole = [subword.sample_block(subword.Lattice(vocabulary), [b], t, 3, 2) for b, t in enumerate(blocks)]
    added.clear()
    lattice, sizes = subword.Lattice(vocabulary), []
    for b, t in enumerate(blocks):
        if b > 1:
            lattice = lattice.renewed(1_000_000)
            sizes.append(len(lattice.index))
        assert subword.sample_block(lattice, [b], t, 3, 2) == whole[b]
    assert set(sizes) == {len(set(common))} and set(added.values()) == {1}
    assert lattice.n_nodes == len(lattice.first_edge[: lattice.n_nodes]) and lattice.start.max() < lattice.n_nodes
    assert not lattice.renewed(10).index  # too many words were kept: a new one


def test_words_of_texts_with_further_spaces():
    """Words, split in Arrow, are those that a pattern finds text by text."""
    texts = ["", " ", "  ", "a", " a", "a ", "a b a", "two  spaces   three ", "  lead", "a\nb\tc \x00", "é 日本  é", "", "b  a", "end  "]
    words, place, size = subword._words(pa.array(texts))
    found = [words[i] for i in place.tolist()]
    assert len(words) == len(set(words)) and size.tolist() == [len(re.findall(" +[^ ]*", " " + t)) if t else 0 for t in texts]
    assert found == [w[1:] for t in texts if t for w in re.findall(" +[^ ]*", " " + t)]
    words, place, size = subword._words(pa.array(["", ""]))
    assert len(place) == 0 and size.tolist() == [0, 0]


def test_decoding_a_block_is_decoding_its_rows():
    vocabulary = subword.Vocabulary(PATH, 0.2)
    surface = subword.Surface(vocabulary)
    texts = ["", "é 日本", " lead", "two  spaces ", "plain words", ""]
    ids = pa.array([r[2] for r in subword.sample_block(subword.Lattice(vocabulary), list(range(6)), texts, 1, 3)], pa.binary())
    assert surface.texts(ids).to_pylist() == texts and surface.texts(ids[2:4]).to_pylist() == texts[2:4]
    assert surface.texts(ids[:1]).to_pylist() == [""] and surface.texts(ids[:0]).to_pylist() == []


def test_prefixes_of_pieces_are_told_from_no_piece():
    vocabulary = subword.Vocabulary(PATH, 0.2)
    own = {s.decode(): i for i, s in enumerate(vocabulary.surface) if s and i >= 259}

    def key(text):
        h = np.zeros(1, np.uint64)
        for c in text:
            h = vocabulary.step(h, np.array([ord(c)], np.uint32))
        return h

    pieces = random.Random(3).sample(sorted(own), 300)
    prefixes = [t[:n] for t in pieces for n in range(1, len(t))]
    for text in pieces + prefixes:
        assert vocabulary.find(key(text))[0] == own.get(text, vocabulary.PREFIX)
    assert vocabulary.find(key("qqzzxx"))[0] == -1
