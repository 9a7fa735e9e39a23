"""Language identification: exact forward-backward, held-out accuracy, code switching."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovecount.llm import language
from tests.conftest import SF_ORACLE

from .conftest import EDGE_ROWS


def enumerated(scores, trans):
    """Word posteriors by summing over all label sequences."""
    n, k = scores.shape
    out = np.zeros((n, k))
    start = np.exp(trans).mean(axis=0)
    for labels in itertools.product(range(k), repeat=n):
        w = start[labels[0]]
        for t, c in enumerate(labels):
            w *= np.exp(scores[t, c]) * (np.exp(trans[labels[t - 1], c]) if t else 1)
        for t, c in enumerate(labels):
            out[t, c] += w
    return out / out.sum(axis=1, keepdims=True)


def test_posteriors_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 3, 6, 2])
    scores, trans = rng.normal(size=(lengths.sum(), 3)) * 2, rng.normal(size=(3, 3)) * 2
    want = np.concatenate([enumerated(s, trans) for s in np.split(scores, np.cumsum(lengths)[:-1])])
    for piece in (1, 2, 3, 32):
        monkeypatch.setattr(language, "PIECE", piece)
        assert np.allclose(language.word_posteriors(scores, lengths, trans), want)
    node, pair, _ = language._posteriors(np.exp(scores[1:8])[None], np.exp(trans))
    assert np.allclose(node[0], enumerated(scores[1:8], trans)) and np.isclose(pair.sum(), 7)


def test_words_do_not_depend_on_the_batch():
    words = ["a", "über", "x" * 32, "maison", "日本"]
    together = language.Words(words)
    alone = [language.Words([w]) for w in words]
    assert together.hash.tolist() == [int(w.hash[0]) for w in alone]
    assert len(set(together.hash.tolist())) == len(words)
    grouped = {}
    for rows, at in together.features():
        for r, a in zip(rows, at):
            grouped.setdefault(int(r), []).append(int(a))
    for i, w in enumerate(alone):
        assert sorted(grouped[i]) == sorted(int(a) for _, at in w.features() for a in at)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_ORACLE}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, documents):
    teach = documents.where(~language.held_out(F.col("doc_id")))
    return language.learn(teach.select(F.col("doc_id").alias("id"), "text", "lang"))


def test_held_out_accuracy(spark, documents):
    out = language.op12(spark, SF_ORACLE)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert len(test) > 150
    assert sum(r.lang_pred == r.lang for r in test) / len(test) > 0.97


def test_code_switched_words(documents, model):
    """Spliced held-out texts: words get the language of the part they are in."""
    by = {}
    for r in documents.where(language.held_out(F.col("doc_id"))).collect():
        words = language.words_of(r.text or "")
        if r.lang and len(words) > 60:
            by.setdefault(r.lang, []).append(words)
    rng = np.random.default_rng(3)
    langs = sorted(by)
    right = total = 0
    for _ in range(60):
        a, b = rng.choice(len(langs), 2, replace=False)
        parts = [(langs[i], by[langs[i]][rng.integers(len(by[langs[i]]))][20:45]) for i in (a, b, a)]
        got = language.label_words(model, " ".join(w for _, p in parts for w in p))
        want = [lang for lang, p in parts for _ in p]
        assert len(got) == len(want)
        right += sum(g[1] == w for g, w in zip(got, want))
        total += len(want)
    assert right / total > 0.9


def test_edge_rows(spark, docs_of, model):
    docs = docs_of([*EDGE_ROWS, (90, "123 456 !!"), (91, "x " * 120_000)])
    out = language.identify(docs.select("doc_id", "text"), model).collect()
    assert len(out) == docs.count()
    pred = {r.doc_id: r.lang_pred for r in out}
    assert pred[3] == pred[4] == pred[8] == pred[90] == "und" and pred[6] in model.languages
    assert pred[91] in model.languages


def test_nothing_and_one_language_to_learn(spark, docs_of):
    docs = docs_of(EDGE_ROWS).select(F.col("doc_id").alias("id"), "text", "lang")
    none = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert language.predict(none, ["some words"]) == (["und"], [0.0])
    one = language.learn(docs)
    assert language.predict(one, ["some words", None]) == (["en", "und"], [1.0, 0.0])
    empty = language.identify(docs.where("false").select("id", "text"), one)
    assert empty.count() == 0
