"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled with a language; a text may switch between
languages.  A word's score for a language is the sum of learned weights of its
features: prefixes and suffixes, character bigrams and trigrams with word
ends, the word itself, and its standing in the lexicon.  Learned transition
weights tie neighbouring words.  Forward-backward gives each word's
probability of each language; a text's language is the one with the largest
expected number of words, and its score is that share.

* The lexicon counts the words of all training texts per language, in hashed
  buckets: its size is ``BUCKETS`` times the number of languages.
* The weights are fitted, in this order of documents' checksums, on at most
  about ``PER_LANGUAGE`` texts of each language, ``FRAGMENT`` words of each
  from a place given by the text's checksum; fragments of different languages
  are spliced so that switches are seen and transitions learned.
* A model covers the ``MAX_LANGUAGES`` most frequent labels.  It is arrays of
  fixed size and goes to the tasks with the function.
* Prediction reads whole texts.  Words are scored once per batch of texts, and
  forward-backward runs over all texts of a batch at once: products of
  transfer matrices over pieces of ``PIECE`` words, then over pieces.  Texts
  beyond ``LONGEST`` words are labelled in that many words at a time and
  their expected counts added.

Words are runs of letters, lower-cased; runs beyond 32 letters are cut into
words of 32 (scripts without spaces).

Edge cases: null text or text without a letter is ``und`` with score 0, as is
everything when there is nothing to learn from; with one language every text
with letters has it, score 1; null labels teach nothing; equal expected counts
go to the more frequent label; repeated rows count again; extra columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]{1,32}")
BUCKETS = 1 << 16
WEIGHT_BITS = 16
LEVELS = 8  # lexicon levels per language
MAX_LANGUAGES = 64
PER_LANGUAGE = 300
FRAGMENT = 150
SEQUENCES, LENGTH = 1200, 40
STEPS = 100
PIECE = 32
LONGEST = 50_000
BATCH_WORDS = 100_000
SHARES = 1 << 20


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


class Words:
    """Distinct words as a matrix of code points between end marks."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        width = int(self.size.max()) if len(words) else 0
        self.points = np.zeros((len(words), width + 2), dtype=np.uint64)
        col = np.arange(width + 2)
        if len(words):
            flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            self.points[(col >= 1) & (col <= self.size[:, None])] = flat
            self.points[:, 0] = 1
            self.points[np.arange(len(words)), self.size + 1] = 2
        self.hash = np.zeros(len(words), dtype=np.uint64)
        for t in range(width + 2):
            longer = self.hash * np.uint64(1_000_003) + self.points[:, t]
            self.hash = np.where(t <= self.size + 1, longer, self.hash)

    def bucket(self) -> np.ndarray:
        return (_mix(self.hash, 99) >> np.uint64(48)).astype(np.int64)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(rows, weight rows)``, each word at most once in a pair."""
        down = np.uint64(64 - WEIGHT_BITS)
        p, n = self.points, self.size
        for t in range(p.shape[1] - 1):
            rows = np.flatnonzero(n + 1 >= t + 1)
            two = p[rows, t] << np.uint64(21) | p[rows, t + 1]
            yield rows, (_mix(two, 2) >> down).astype(np.int64)
            if t + 2 < p.shape[1]:
                rows = rows[n[rows] + 1 >= t + 2]
                three = (p[rows, t] << np.uint64(42)) | (p[rows, t + 1] << np.uint64(21)) | p[rows, t + 2]
                yield rows, (_mix(three, 3) >> down).astype(np.int64)
        for width in (3, 4):  # shorter affixes are n-grams with an end mark
            rows = np.flatnonzero(n >= width)
            for kind, start in ((10 + width, np.ones(len(rows), dtype=np.int64)), (20 + width, n[rows] - width + 1)):
                h = np.zeros(len(rows), dtype=np.uint64)
                for k in range(width):
                    h = h * np.uint64(1_000_003) + p[rows, start + k]
                yield rows, (_mix(h, kind) >> down).astype(np.int64)
        yield np.arange(len(n)), (_mix(self.hash, 1) >> down).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray      # (2 ** WEIGHT_BITS + languages * LEVELS) x languages
    transitions: np.ndarray  # languages x languages, log
    levels: np.ndarray       # lexicon: BUCKETS, row of ``weights``

    def scores(self, words: Words) -> np.ndarray:
        out = self.weights[self.levels[words.bucket()]].copy()
        for rows, at in words.features():
            out[rows] += self.weights[at]
        return out


def lexicon_levels(counts: np.ndarray) -> np.ndarray:
    """Weight row per bucket from counts (BUCKETS x languages): the language a
    bucket speaks for, and how clearly."""
    total = counts.sum(axis=0)
    share = (counts + 0.5) / (total + 0.5 * BUCKETS)
    best = share.argmax(axis=1)
    rest = (share.sum(axis=1) - share.max(axis=1)) / max(1, counts.shape[1] - 1)
    margin = np.log(share.max(axis=1) / np.maximum(rest, 1e-12)) if counts.shape[1] > 1 else np.ones(len(counts))
    level = np.minimum(LEVELS - 1, (margin * 1.5).astype(np.int64) + 1)
    level[counts.sum(axis=1) == 0] = 0
    return (1 << WEIGHT_BITS) + best * LEVELS + level


def _posteriors(psi: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node and summed pair posteriors of sequences of one length
    (sequences x length x languages), and log likelihood of each."""
    n, length, k = psi.shape
    alpha, scale = np.empty_like(psi), np.empty((n, length))
    a = np.full((n, k), 1 / k)
    for t in range(length):
        a = (a @ trans) * psi[:, t]
        scale[:, t] = a.sum(axis=1)
        a = a / scale[:, t, None]
        alpha[:, t] = a
    beta = np.ones((n, k))
    node = np.empty_like(psi)
    pair = np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        node[:, t] = alpha[:, t] * beta
        after = psi[:, t] * beta / scale[:, t, None]
        before = alpha[:, t - 1] if t else np.full((n, k), 1 / k)
        pair += before.T @ after * trans
        beta = after @ trans.T
    return node / node.sum(axis=2, keepdims=True), pair, np.log(scale).sum(axis=1)


def fit(samples: list[tuple[int, list[str]]], languages: list[str], levels: np.ndarray, seed: int = 7) -> Model:
    """Maximum likelihood with a small penalty, by gradient steps over spliced
    sequences of labelled words."""
    k = len(languages)
    rng = np.random.default_rng(seed)
    by_language = [[w for lang, w in samples if lang == i and w] for i in range(k)]
    present = [i for i in range(k) if by_language[i]]
    rows = (1 << WEIGHT_BITS) + k * LEVELS
    model = Model(languages, np.zeros((rows, k), dtype=np.float32), np.zeros((k, k)), levels)
    if k < 2 or not present:
        return model
    numbers: dict[str, int] = {}
    ids = np.empty((SEQUENCES, LENGTH), dtype=np.int64)
    gold = np.empty((SEQUENCES, LENGTH), dtype=np.int64)
    for s in range(SEQUENCES):
        words, labels = [], []
        pieces = 1 if rng.random() < 0.5 else int(rng.integers(2, 5))
        while len(words) < LENGTH:
            lang = present[rng.integers(len(present))]
            text = by_language[lang][rng.integers(len(by_language[lang]))]
            take = LENGTH if pieces == 1 else int(rng.integers(3, 2 * LENGTH // pieces))
            start = int(rng.integers(max(1, len(text) - take + 1)))
            part = text[start:start + take]
            words += part
            labels += [lang] * len(part)
        ids[s] = [numbers.setdefault(w, len(numbers)) for w in words[:LENGTH]]
        gold[s] = labels[:LENGTH]
    table = Words(list(numbers))
    parts = list(table.features())
    parts.append((np.arange(len(numbers)), levels[table.bucket()]))
    row = np.concatenate([r for r, _ in parts])
    at = np.concatenate([a for _, a in parts])
    # only the rows that the sample touches are fitted
    used, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    back = np.argsort(row, kind="stable")
    row_starts = np.flatnonzero(np.append(True, row[back][1:] != row[back][:-1]))

    theta = [np.zeros((len(used), k)), np.zeros((k, k))]
    first = [np.zeros_like(x) for x in theta]
    second = [np.zeros_like(x) for x in theta]
    hot = np.eye(k)[gold]
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[:, :-1], gold[:, 1:]), 1)
    moves += np.bincount(gold[:, 0], minlength=k) / k
    tokens = ids.size
    for step in range(1, STEPS + 1):
        score = np.add.reduceat(theta[0][at[back]], row_starts, axis=0)
        e = score[ids]
        psi = np.exp(e - e.max(axis=2, keepdims=True))
        node, pair, _ = _posteriors(psi, np.exp(theta[1] - theta[1].max()))
        by_word = np.stack(
            [np.bincount(ids.ravel(), (hot - node)[:, :, c].ravel(), minlength=len(numbers)) for c in range(k)], axis=1
        )
        grads = [
            np.add.reduceat(by_word[row], starts, axis=0) / tokens - 1e-5 * theta[0],
            (moves - pair) / tokens - 1e-4 * theta[1],
        ]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] += 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    model.weights[used] = theta[0]
    model.transitions = theta[1]
    return model


def word_posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over texts laid end to end: ``scores`` of all words (log),
    ``lengths`` of the texts (none 0); words x languages."""
    n, k = scores.shape
    trans = np.exp(transitions - transitions.max())
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    pieces = -(-lengths // PIECE)
    ends = np.cumsum(pieces)
    first = ends - pieces
    text_start = np.cumsum(lengths) - lengths
    count = int(ends[-1])
    owner = np.repeat(np.arange(len(lengths)), pieces)
    start = text_start[owner] + (np.arange(count) - first[owner]) * PIECE
    filled = np.minimum(PIECE, text_start[owner] + lengths[owner] - start)
    spot = start[:, None] + np.arange(PIECE)
    live = np.arange(PIECE) < filled[:, None]
    spot = np.where(live, spot, 0)

    through = np.broadcast_to(np.eye(k), (count, k, k)).copy()
    for t in range(PIECE):
        rows = np.flatnonzero(live[:, t])
        if not len(rows):
            break
        m = (through[rows] @ trans) * psi[spot[rows, t]][:, None, :]
        through[rows] = m / m.max(axis=(1, 2), keepdims=True)
    begin, end = np.empty((count, k)), np.empty((count, k))
    a, b = np.full((len(lengths), k), 1 / k), np.ones((len(lengths), k))
    for j in range(int(pieces.max())):
        own = np.flatnonzero(pieces > j)
        at = first[own] + j
        begin[at] = a[own]
        v = (a[own][:, None, :] @ through[at])[:, 0]
        a[own] = v / v.sum(axis=1, keepdims=True)
        at = ends[own] - 1 - j
        end[at] = b[own]
        v = (through[at] @ b[own][:, :, None])[:, :, 0]
        b[own] = v / v.sum(axis=1, keepdims=True)
    out = np.empty((n, k))
    a = begin
    for t in range(PIECE):
        rows = np.flatnonzero(live[:, t])
        v = (a[rows] @ trans) * psi[spot[rows, t]]
        v /= v.sum(axis=1, keepdims=True)
        a[rows] = v
        out[spot[rows, t]] = v
    b = end
    for t in range(PIECE - 1, -1, -1):
        rows = np.flatnonzero(live[:, t])
        here = spot[rows, t]
        out[here] *= b[rows]
        v = (psi[here] * b[rows]) @ trans.T
        b[rows] = v / v.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Texts' words, some ``BATCH_WORDS`` at a time; a text beyond ``LONGEST``
    words comes in several pieces."""
    places, held, size = [], [], 0
    for i, text in enumerate(texts):
        words = words_of(text) if text else []
        for lo in range(0, len(words), LONGEST):
            part = words[lo:lo + LONGEST]
            places.append(i)
            held.append(part)
            size += len(part)
            if size >= BATCH_WORDS:
                yield places, held
                places, held, size = [], [], 0
    if held:
        yield places, held


def _text_posteriors(model: Model, held: list[list[str]]) -> np.ndarray:
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for part in held for w in part])
    scores = model.scores(Words(list(numbers)))[ids]
    return word_posteriors(scores, np.array([len(p) for p in held]), model.transitions)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    k = len(model.languages)
    expected = np.zeros((len(texts), max(1, k)))
    if k:
        for places, held in _batches(texts):
            sizes = np.array([len(p) for p in held])
            post = _text_posteriors(model, held)
            sums = np.add.reduceat(post, np.cumsum(sizes) - sizes, axis=0)
            np.add.at(expected, np.array(places), sums)
    total = expected.sum(axis=1)
    best = expected.argmax(axis=1)
    score = np.where(total > 0, expected.max(axis=1) / np.maximum(total, 1e-300), 0.0)
    names = [model.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
    return names, np.minimum(score, 1.0).tolist()


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """``(word, language, probability)`` for every word of a text."""
    out = []
    for _, held in _batches([text]):
        post = _text_posteriors(model, held)
        words = [w for part in held for w in part]
        out += [(w, model.languages[p.argmax()], float(p.max())) for w, p in zip(words, post)]
    return out


def held_out(id_col: Column) -> Column:
    """Documents kept from learning: checksum of the id, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            by_language: dict[int, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text and lang in number:
                    by_language.setdefault(number[lang], Counter()).update(words_of(text))
            for lang, counter in by_language.items():
                if counter:
                    bucket = Words(list(counter)).bucket()
                    counts[lang] += np.bincount(bucket, list(counter.values()), minlength=BUCKETS).astype(np.int64)
        lang, bucket = np.nonzero(counts)
        for lo in range(0, len(lang), 50_000):
            part = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[part]), pa.array(bucket[part]), pa.array(counts[lang, bucket][part])],
                ["lang", "bucket", "n"],
            )

    return run


def _cut_fragments(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text) if text else []
                if words:
                    start = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(words) - FRAGMENT + 1)
                    langs.append(number[lang])
                    parts.append(words[start:start + FRAGMENT])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.int64()), pa.array(parts, pa.list_(pa.string()))], ["lang", "words"]
            )

    return run


def learn(labelled: DataFrame) -> Model:
    """Model from ``id, text, lang`` (null labels are left out)."""
    labelled = labelled.where("lang is not null")
    seen = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    seen = seen.collect()
    languages = [r["lang"] for r in seen]
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(BUCKETS, dtype=np.int64))
    counted = labelled.select("lang", "text").mapInArrow(_count_words(languages), "lang long, bucket long, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[counted.column("bucket").to_numpy(), counted.column("lang").to_numpy()] = counted.column("n").to_numpy()
    share = F.lit(0)
    for r in seen:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(SHARES, -(-SHARES * PER_LANGUAGE // r["n"])))).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(SHARES)) < share)
    drawn = drawn.limit(2 * PER_LANGUAGE * len(languages))  # never more, whatever the checksums
    drawn = drawn.select("lang", "text").mapInArrow(_cut_fragments(languages), "lang long, words array<string>")
    samples = sorted((r["lang"], r["words"]) for r in drawn.collect())
    return fit(samples, languages, lexicon_levels(counts))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``id, lang_pred, score`` for every row of ``id, text`` and the columns
    before them."""
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(model, batch.column("text").to_pylist())
            out = batch.select(keep)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op12(spark, sf_dir):
    """Learns from the labelled documents that are not held out and predicts all."""
    from grovecount.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents")
    text = docs["text"].cast("string").alias("text")
    teach = docs.where(~held_out(docs["doc_id"])).select(docs["doc_id"].alias("id"), text, docs["lang"].cast("string").alias("lang"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text)
    return identify(rows, learn(teach))
