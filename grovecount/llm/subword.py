"""SentencePiece encoding and decoding, with sampled segmentations.

``encode`` gives the model's own segmentation, ``decode`` turns ids back into
text, ``sample_segmentations`` draws ``k`` *distinct* segmentations of every
text without replacement (Gumbel top-k) and gives each its inclusion score.

A segmentation is a path through the lattice of vocabulary pieces; its
probability is the product of the path's normalised edge weights (a piece of
rank ``r`` weighs ``(1 + r) ** -alpha``).  Perturbing the log-probability of
every path with Gumbel noise and taking the ``k`` largest is a sample without
replacement; the paths are found by A* search from the top down, without
listing them: the noise of a set of paths that share a prefix is bounded by a
truncated Gumbel variable of the set's total probability, the best set is
split first, and a set is opened only when it is the best one left.  A path
drawn to the end leaves one unopened sibling set per step; the best sibling of
all paths so far holds the next segmentation.

The lattice falls apart at spaces (no piece crosses one), so it is built once
per distinct word; when it is full, it keeps the words that two blocks had.
Steps of all words of a block are taken together as array operations.  Random numbers are a hash of the
seed, the row's key, the word, the step and the draw: a row's samples do not
depend on partitioning, batch or order.

The inclusion score of a sample is the probability that its perturbed value
exceeds the (k+1)-th largest (``log_inclusion``; 0 where all segmentations are
in the sample).

Edge cases: null text counts as empty and has one segmentation, the empty one;
texts with fewer than ``k`` segmentations give all of them; repeated keys give
repeated samples; a null key is a key like any other; characters outside the
vocabulary (and a literal U+2581) become byte pieces, so decoding always
restores the text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.llm.common import keyed_text

SPACE = "▁"
BLOCK_CHARS = 600_000  # text worked on at once
LATTICE_EDGES = 3_000_000  # a larger lattice drops words met in one block only: bounds a worker's memory
ADD_WORDS = 4_000  # words added at once: their arrays stay in a core's cache
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hash(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _C[3]
    x ^= x >> np.uint64(29)
    x *= _C[1]
    return x


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from the upper bits of the hash."""
    out = (_hash(x) >> np.uint64(12)).astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def _salt(draw: int, use: int) -> np.uint64:
    return np.uint64((draw * 4 + use) * int(_C[1]) % 2**64)


class Vocabulary:
    """Pieces of a model and their prefixes, found by a hash of their code points."""

    BITS = 18
    PREFIX = -2  # begins a piece, but is none

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        # a space in the text is the mark; the mark itself is in no piece
        text = {i: model.id_to_piece(i).replace(SPACE, " ") for i in plain}
        self.surface = [b""] * n
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        for i, s in text.items():
            self.surface[i] = s.encode()
        self.longest = max(map(len, text.values()))
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], dtype=np.int64)
        self.weight = np.zeros(n)
        self.weight[plain] = -alpha * np.log1p(np.arange(1, len(plain) + 1))
        self.byte_weight = -alpha * np.log1p(len(plain) + 1)
        ids = np.array(plain, dtype=np.int64)
        size = np.array([len(text[i]) for i in plain])
        points = np.zeros((len(plain), self.longest), np.uint32)
        for row, i in enumerate(plain):
            points[row, : size[row]] = [ord(c) for c in text[i]]
        h, every = np.zeros(len(plain), np.uint64), []
        for n in range(self.longest):  # the n-th character of all pieces at once
            long = size > n
            h[long] = self.step(h[long], points[long, n])
            every.append((h[long], np.where(size[long] == n + 1, ids[long], len(self.surface))))
        keys, ids = (np.concatenate(x) for x in zip(*every))
        order = np.lexsort((ids, keys))  # of a repeated key, a piece comes before prefixes
        order = order[np.r_[True, keys[order[1:]] != keys[order[:-1]]]]
        keys, ids = keys[order], np.where(ids[order] < len(self.surface), ids[order], self.PREFIX)
        left = np.arange(len(keys))
        self.tables = []
        while len(left):  # keys that share a slot move on to the next table
            slot = self.slots(keys[left], len(self.tables))
            own = np.zeros(len(left), dtype=bool)
            own[np.unique(slot, return_index=True)[1]] = True
            key = np.zeros(1 << self.BITS, np.uint64)
            piece = np.zeros(1 << self.BITS, np.int32)
            more = np.zeros(1 << self.BITS, bool)
            key[slot[own]], piece[slot[own]], more[slot[~own]] = keys[left[own]], ids[left[own]], True
            self.tables.append((key, piece, more))
            left = left[~own]

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ (c.astype(np.uint64) + np.uint64(0x1F123BB5))) * _C[0]
        return h ^ (h >> np.uint64(29))

    def slots(self, h: np.ndarray, table: int) -> np.ndarray:
        mixed = (h ^ (h >> np.uint64(31))) * _C[1 + table % 3]
        return (mixed >> np.uint64(64 - self.BITS - table)).astype(np.int64) & ((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, ``PREFIX``, or -1: no piece begins so."""
        out = np.full(len(h), -1, dtype=np.int64)
        todo = None  # all
        for t, (key, piece, more) in enumerate(self.tables):
            own = h if todo is None else h[todo]
            slot = self.slots(own, t)
            hit = np.flatnonzero(key[slot] == own)
            out[hit if todo is None else todo[hit]] = piece[slot[hit]]
            next_table = np.flatnonzero(more[slot] & (key[slot] != own))
            todo = next_table if todo is None else todo[next_table]
            if not len(todo):
                break
        return out


class Lattice:
    """All segmentations of all words seen so far.  A node is a character
    position; the edges of a node are stored together, longest piece first.
    Grows by the new words of each block; ``start`` maps word numbers to nodes."""

    EDGE = {"first": np.int32, "to": np.int32, "piece": np.int32, "logp": np.float64, "cum": np.float64, "rest": np.float64}
    NODE = {"first_edge": np.int32}  # -1 at a word's end, where ``to`` is -1, too

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.index: dict[str, int] = {}  # words in order of first sight
        self.n_edges = self.n_nodes = 0
        self.start = np.empty(0, np.int32)
        self.seen = np.empty(0, np.int32)  # blocks that have the word
        # room for what a lattice usually grows to; untouched pages cost nothing
        for name, kind in self.EDGE.items():
            setattr(self, name, np.empty(LATTICE_EDGES + LATTICE_EDGES // 2, kind))
        for name, kind in self.NODE.items():
            setattr(self, name, np.empty(LATTICE_EDGES, kind))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Number of each of a block's distinct words (given without the space in front)."""
        out = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            out[fresh] = np.arange(len(self.index), len(self.index) + len(fresh))
            added = [words[i] for i in fresh.tolist()]
            self.index.update(zip(added, out[fresh].tolist()))
            for i in range(0, len(added), ADD_WORDS):
                self.add([" " + w for w in added[i : i + ADD_WORDS]])
            self.seen = np.concatenate([self.seen, np.zeros(len(fresh), np.int32)])
        self.seen[out] += 1
        return out

    def renewed(self, limit: int) -> Lattice:
        """This lattice with the words that two blocks have, or, if these have more
        than ``limit`` edges, a new one."""
        kept = np.flatnonzero(self.seen > 1)
        # a word's nodes follow each other, and so do a node's edges
        node = _ranges(self.start[kept], np.diff(np.r_[self.start, self.n_nodes])[kept])
        inner = np.flatnonzero(self.first_edge[node] >= 0)
        end = np.flatnonzero(np.isinf(self.cum[: self.n_edges]))
        begin = self.first_edge[node[inner]].astype(np.int64)
        count = end[np.searchsorted(end, begin)] + 1 - begin
        if count.sum() > limit:
            return Lattice(self.vocabulary)
        edge = _ranges(begin, count)
        place = np.full(self.n_nodes + 1, -1, np.int32)  # the last one for -1
        place[node] = np.arange(len(node))
        self.start = place[self.start[kept]]
        first_edge = np.full(len(node), -1, np.int32)
        first_edge[inner] = np.cumsum(count) - count
        edges = {name: getattr(self, name)[edge] for name in self.EDGE}
        edges |= {name: place[edges[name]] for name in ("first", "to")}
        self._append(0, edges)
        self._append(0, {"first_edge": first_edge})
        self.n_edges, self.n_nodes = len(edge), len(node)
        words = list(self.index)
        self.index = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.seen = np.ones(len(kept), np.int32)
        return self

    def _append(self, size: int, part: dict[str, np.ndarray]) -> None:
        for name, values in part.items():
            held = getattr(self, name)
            if len(held) < size + len(values):
                more = np.empty(max(2 * len(held), size + len(values)), held.dtype)
                more[:size] = held[:size]
                setattr(self, name, more)
                held = more
            held[size : size + len(values)] = values

    def add(self, words: list[str]) -> None:
        v = self.vocabulary
        cp = np.frombuffer(("\0".join([*words, ""])).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        left = np.repeat(start + size, size + 1) - np.arange(len(cp))
        # nodes one, two, ... characters from the end; a word's last position has no edges
        at = np.flatnonzero(left > 0)
        at = at[np.argsort(left[at].astype(np.min_scalar_type(int(size.max(initial=0)))), kind="stable")]
        level, point = left[at], cp[at]
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]) if len(at) else np.zeros(1, np.int64)
        h = v.step(np.zeros(len(at), np.uint64), point)
        piece = v.find(h)
        count = np.ones(len(at), np.int64)  # a character that is no piece: its bytes
        found = [(np.arange(len(at)), np.where(piece >= 0, piece, -1 - point.astype(np.int64)))]
        own = np.arange(len(at))
        for n in range(2, v.longest + 1):
            more = np.flatnonzero((piece != -1) & (level[own] >= n))
            own = own[more]
            if not len(own):
                break
            h = v.step(h[more], cp[at[own] + n - 1])
            piece = v.find(h)
            hit = np.flatnonzero(piece >= 0)
            count[own[hit]] += 1
            found.append((own[hit], piece[hit]))
        bounds = np.r_[0, np.cumsum(count)]
        head, first = bounds[:-1], np.repeat(at, count)
        to, piece = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        place = head.copy()
        for n in range(len(found), 0, -1):
            own, ids = found[n - 1]
            here = place[own]
            to[here], piece[here] = at[own] + n, ids
            place[own] = here + 1
        weight = v.weight[np.maximum(piece, 0)]
        lone = np.flatnonzero(piece < 0)
        point = -1 - piece[lone]
        weight[lone] = v.byte_weight * (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        p = np.empty(len(first))
        total = np.zeros(len(cp) + 1)  # log of the weight of all ways from a node to its word's end
        for a, b in zip(cuts[:-1], cuts[1:]):
            lo, hi = bounds[a], bounds[b]
            val = weight[lo:hi]
            val += total[to[lo:hi]]
            at_head = head[a:b] - lo
            top = np.maximum.reduceat(val, at_head)
            many = count[a:b]
            e = np.exp(val - np.repeat(top, many))
            sums = np.add.reduceat(e, at_head)
            norm = top + np.log(sums)
            total[at[a:b]] = norm
            val -= np.repeat(norm, many)
            p[lo:hi] = e / np.repeat(sums, many)
        logp = np.minimum(weight, 0.0)
        # summed node by node: a running sum over the block would round by what is before
        cum = p.copy()
        later = head
        for j in range(1, int(count.max(initial=0))):
            later = later[count > j] + 1
            count = count[count > j]
            cum[later] += cum[later - 1]
        cum[bounds[1:] - 1] = np.inf
        # log probability of the other edges of an edge's node
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(p, 1.0))
        rest[head[np.diff(bounds) == 1]] = -np.inf
        first_edge = np.full(len(cp), -1, np.int64)
        first_edge[at] = head + self.n_edges
        base = self.n_nodes
        self.start = np.concatenate([self.start, (start + base).astype(np.int32)])
        self._append(self.n_edges, {
            "first": first + base, "to": np.where(left[to] > 0, to + base, -1), "piece": piece, "logp": logp, "cum": cum, "rest": rest,
        })
        self._append(self.n_nodes, {"first_edge": first_edge})
        self.n_edges += len(first)
        self.n_nodes += len(cp)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.first_edge[node]
        todo = np.flatnonzero(u >= self.cum[edge])
        while len(todo):
            edge[todo] += 1
            todo = todo[u[todo] >= self.cum[edge[todo]]]
        return edge

    def options(self, edge: int) -> np.ndarray:
        """All edges of an edge's node."""
        lo = hi = int(self.first_edge[self.first[edge]])
        while self.cum[hi] != np.inf:
            hi += 1
        return np.arange(lo, hi + 1)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + size[i] - 1."""
    total = int(size.sum())
    shift = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - shift, size)


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all texts, the place of each text's words among them, one
    text after the other, and the number of words of each text.  A word goes
    without the space before it; further spaces stay in front."""
    parts = pc.split_pattern(texts, " ")
    size = pc.list_value_length(parts).to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    words, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    if "" not in words:
        return words, place, size
    end = np.cumsum(size)
    blank = place == words.index("")
    void = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    blank[end[~void] - 1] = False  # all other empty parts are spaces in front of the next
    keep = np.flatnonzero(~blank)
    own = blank.copy()
    own[end[void] - 1] = False
    before = np.cumsum(own)[keep]
    spaces = np.diff(before, prepend=0)
    place = place[keep]
    index: dict[str, int] = {}
    for i in np.flatnonzero(spaces).tolist():
        word = " " * int(spaces[i]) + words[place[i]]
        if word not in index:
            index[word] = len(words) + len(index)
        place[i] = index[word]
    text = np.repeat(np.arange(len(size)), size)
    return words + list(index), place, np.bincount(text[keep], minlength=len(size))


class Draws:
    """Paths of all texts of a block, drawn best first."""

    def __init__(self, lattice: Lattice, texts: pa.Array, keys: np.ndarray):
        words, place, self.size = _words(texts)
        self.n = len(texts)
        self.lattice = lattice
        number = lattice.numbers(words)  # extends ``start`` first
        self.node = lattice.start[number][place]
        self.first = np.cumsum(self.size) - self.size  # first word of each text
        doc = np.repeat(np.arange(self.n), self.size)
        self.key = keys
        # of each word: the text's key and the word's place in it
        self.word_key = keys[doc] + (np.arange(len(self.node)) - self.first[doc]).astype(np.uint64) * _C[2]

    def walk(self, starts: list[tuple], draw: int):
        """Draw from a node to the end of each word: (word place, edge), ordered
        by word place, then step.  ``starts`` are (places, nodes, steps taken:
        one number for all or one each)."""
        lat = self.lattice
        words, edges = [], []
        taken = np.zeros(len(self.node), np.int32)
        for word, node, step in starts:
            while len(word):
                salt = (step * _C[0] + _salt(draw, 1)).astype(np.uint64)
                edge = lat.draw(node, _uniform(self.word_key[word] + salt))
                words.append(word)
                edges.append(edge)
                taken[word] += 1
                node = lat.to[edge]
                more = np.flatnonzero(node >= 0)
                word, node = word[more], node[more]
                step = (step[more] if len(step) > 1 else step) + np.uint64(1)
        # a word's steps follow each other: scatter them behind its first
        place = np.cumsum(taken, dtype=np.int32) - taken
        out = np.empty(int(taken.sum()), np.int32)
        for w, e in zip(words, edges):
            to = place[w]
            out[to] = e
            place[w] = to + 1
        return np.repeat(np.arange(len(self.node), dtype=np.int32), taken), out

    def siblings(self, path: dict, fresh: np.ndarray, draw: int) -> np.ndarray:
        """Perturbed value, before it is bounded by the path's own, of the best
        path that leaves ``path`` at each step of ``fresh``."""
        lat = self.lattice
        value = np.full(len(path["edge"]), -np.inf)
        rest = lat.rest[path["edge"][fresh]]
        some = np.flatnonzero(rest > -np.inf)
        at = fresh[some]
        salt = path["step"][at].astype(np.uint64) * _C[0] + _salt(draw, 2)
        noise = _uniform(self.word_key[path["word"][at]] + salt)
        np.log(noise, out=noise)
        np.negative(noise, out=noise)
        np.log(noise, out=noise)
        value[at] = path["before"][at] + rest[some] - noise
        return value

    def path(self, word, edge, size) -> dict:
        head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
        step = np.arange(len(word)) - np.repeat(head, np.diff(np.r_[head, len(word)]))
        start = np.cumsum(size) - size
        logp = self.lattice.logp[edge]
        before, total = np.zeros(len(edge)), np.zeros(len(size))
        # text by text: a running sum over the block would round by what is before
        for d in np.flatnonzero(size).tolist():
            lo, hi = int(start[d]), int(start[d] + size[d])
            run = np.cumsum(logp[lo:hi])
            before[lo + 1 : hi] = run[:-1]
            total[d] = run[-1]
        return {
            "word": word, "edge": edge, "step": step, "size": size, "start": start, "before": before, "logp": total,
        }

    def search(self, k: int):
        """Yields per draw (texts that have one, path arrays, perturbed value);
        afterwards ``self.limit`` is the (k+1)-th largest value per text."""
        lat, n = self.lattice, self.n
        every = np.arange(len(self.node), dtype=np.int32)
        word, edge = self.walk([(every, self.node, np.zeros(1, np.uint64))], 0)
        per_word = np.bincount(word, minlength=len(self.node)) if len(word) else np.zeros(len(self.node), np.int64)
        run = np.r_[0, np.cumsum(per_word)]
        path = self.path(word, edge, run[self.first + self.size] - run[self.first])
        g = -np.log(-np.log(_uniform(self.key + _C[3])))
        path["value"], path["bound"] = self.siblings(path, np.arange(len(edge)), 0), g
        paths, taken = [path], {}
        best, where = self.best(path)
        bests, wheres = [best], [where]
        yield np.arange(n), path, g
        for draw in range(1, k):
            top = np.max(bests, axis=0)
            docs = np.flatnonzero(top > -np.inf)
            source = np.argmax(bests, axis=0)
            chosen = np.zeros(n, np.int64)
            turn = np.zeros(n, np.int64)
            for d in docs.tolist():
                a = int(source[d])
                path, at = paths[a], int(wheres[a][d])
                used = taken.setdefault((a, at), [int(path["edge"][at])])
                options = lat.options(used[0])
                p = np.exp(lat.logp[options])
                p[np.array(used) - options[0]] = 0.0
                salt = np.array([at - path["start"][d]], np.uint64) * _C[0]
                salt = self.key[d : d + 1] + salt + _salt(draw, 3)
                pick = min(int(np.searchsorted(np.cumsum(p), float(_uniform(salt)[0]) * p.sum(), side="right")), len(p) - 1)
                while p[pick] == 0.0:
                    pick -= 1
                chosen[d], turn[d] = options[pick], at
                used.append(int(options[pick]))
                rest = p.sum() - p[pick]
                if len(used) < len(options) and rest > 0.0:
                    mu = path["before"][at] + np.log(rest)
                    noise = np.log(-np.log(float(_uniform(salt + _C[2])[0])))
                    # bounded by the value just taken, which lies below the path's own bound
                    value = np.logaddexp(-top[d], noise - mu)
                    path["value"][at] = -(value + np.log(-np.expm1(-path["bound"][d] - value)))
                else:
                    path["value"][at] = -np.inf
                self.best_of(path, d, bests[a], wheres[a])
            path, fresh = self.branch(paths, source, docs, turn, chosen, draw)
            path["value"], path["bound"] = self.siblings(path, fresh, draw), top
            best, where = self.best(path)
            paths.append(path)
            bests.append(best)
            wheres.append(where)
            yield docs, path, top
        self.limit = np.max(bests, axis=0)

    @staticmethod
    def bounded(value, bound):
        """A Gumbel variable given that it stays below ``bound``; monotone in
        ``value``, so the best of a text's steps can be found before."""
        return -np.logaddexp(-bound, -value)

    def best(self, path: dict) -> tuple[np.ndarray, np.ndarray]:
        best, where = np.full(self.n, -np.inf), np.zeros(self.n, np.int64)
        for d in np.flatnonzero(path["size"] > 0).tolist():
            self.best_of(path, d, best, where)
        return best, where

    def best_of(self, path: dict, d: int, best: np.ndarray, where: np.ndarray) -> None:
        s = int(path["start"][d])
        at = s + int(np.argmax(path["value"][s : s + path["size"][d]]))
        best[d], where[d] = self.bounded(path["value"][at], path["bound"][d]), at

    def branch(self, paths, source, docs, turn, chosen, draw):
        """Paths that follow ``paths[source]`` up to step ``turn``, take the edge
        ``chosen`` there and are drawn anew from there on."""
        lat = self.lattice
        pre = np.zeros(self.n, np.int64)
        prefix = []
        for a, path in enumerate(paths):
            own = docs[source[docs] == a]
            pre[own] = turn[own] - path["start"][own]
            at = _ranges(path["start"][own], pre[own])
            prefix.append((own, path, at))
        here = {c: np.zeros(self.n, np.int64) for c in ("word", "step")}
        for own, path, _ in prefix:
            for c in here:
                here[c][own] = path[c][turn[own]]
        open_word = docs[lat.to[chosen[docs]] >= 0]
        after = here["word"][docs] + 1
        words = _ranges(after, self.first[docs] + self.size[docs] - after)
        part = here["word"][open_word], lat.to[chosen[open_word]], (here["step"][open_word] + 1).astype(np.uint64)
        word, edge = self.walk([part, (words, self.node[words], np.zeros(1, np.uint64))], draw)
        tail = np.zeros(self.n, np.int64)
        cuts = np.searchsorted(word, np.r_[self.first, len(self.node)])
        tail[:] = np.diff(cuts)
        size = np.zeros(self.n, np.int64)
        size[docs] = pre[docs] + 1 + tail[docs]
        start = np.cumsum(size) - size
        out = {c: np.empty(int(size.sum()), np.int32) for c in ("word", "edge")}
        for own, path, at in prefix:
            to = _ranges(start[own], pre[own])
            for c in out:
                out[c][to] = path[c][at]
        mid = start[docs] + pre[docs]
        out["word"][mid], out["edge"][mid] = here["word"][docs], chosen[docs]
        fresh = _ranges(mid + 1, tail[docs])
        out["word"][fresh], out["edge"][fresh] = word, edge
        return self.path(out["word"], out["edge"], size), fresh

    def ids(self, path: dict) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path's texts, and where each text's ids begin."""
        vocabulary = self.lattice.vocabulary
        piece = self.lattice.piece[path["edge"]]
        point = -1 - piece
        lone = (piece < 0) & (point < 0x80)
        piece[lone] = vocabulary.byte_ids[point[lone]]
        wide = np.flatnonzero(piece < 0)
        bounds = np.r_[path["start"], len(piece)]
        if not len(wide):
            return piece, bounds
        pieces = [[int(vocabulary.byte_ids[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in point[wide].tolist()]
        size = np.ones(len(piece), np.int64)
        size[wide] = [len(x) for x in pieces]
        to = np.r_[0, np.cumsum(size)]
        out = np.repeat(piece, size)
        out[_ranges(to[wide], size[wide])] = np.concatenate(pieces)
        return out, to[bounds]


SAMPLE_SCHEMA = "id long, sample int, ids binary, log_prob double, perturbed double, log_inclusion double"
NO_KEY = np.uint64(0x5851F42D4C957F2D)


def _blocks(ids: pa.Array, texts: pa.Array, size: int):
    """Slices of about ``size`` bytes of text."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > size:
            yield ids[at:i], texts[at:i]
            at, held = i, 0
        held += n
    if at < len(texts):
        yield ids[at:], texts[at:]


class Surface:
    """Turns ids back into text."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = np.array([len(x) for x in vocabulary.surface], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(vocabulary.surface), np.uint8)
        self.pieces = pa.array(vocabulary.surface, pa.binary())

    def text(self, ids: bytes) -> str:
        pieces = np.frombuffer(ids, "<u4")
        # the first byte is the space before the first word
        return self.table[_ranges(self.start[pieces], self.size[pieces])].tobytes()[1:].decode("utf-8", "replace")


    def texts(self, ids: pa.BinaryArray) -> pa.Array:
        """``text`` of each row, for ids that make whole characters."""
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        if not len(ids) or bounds[0] == bounds[-1]:
            return pa.array([""] * len(ids), pa.string())
        pieces = np.frombuffer(ids.buffers()[2], "<u4")[bounds[0] // 4 : bounds[-1] // 4]
        joined = self.pieces.take(pa.array(pieces))
        ends = np.frombuffer(joined.buffers()[1], np.int32)[(bounds - bounds[0]) // 4]
        rows = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), joined.buffers()[2]])
        # the first byte is the space before the first word
        return pc.utf8_slice_codeunits(rows.cast(pa.string()), 1)


def sample_block(lattice: Lattice, ids: list | pa.Array, texts: list[str] | pa.Array, k: int, seed: int) -> list[tuple]:
    """(id, sample, ids, log probability, perturbed value, log inclusion) rows."""
    ids = ids.to_pylist() if isinstance(ids, pa.Array) else ids
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    keys = np.array([NO_KEY if i is None else np.uint64(i & (2**64 - 1)) for i in ids], dtype=np.uint64)
    draws = Draws(lattice, texts, _hash(_hash(keys + np.uint64(seed % 2**64)) + _C[0]))
    found = []
    for j, (docs, path, value) in enumerate(draws.search(k)):
        pieces, bounds = draws.ids(path)
        blob = pieces.astype("<u4")
        for d in docs.tolist():
            found.append((d, j, blob[bounds[d] : bounds[d + 1]].tobytes(), float(path["logp"][d]), float(value[d])))
    rows = []
    for d, j, blob, logp, value in found:
        x = logp - float(draws.limit[d])
        # log of 1 - exp(-exp(x))
        inclusion = 0.0 if x > 5 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))
        rows.append((ids[d], j, blob, logp, value, inclusion))
    return rows


def sample_segmentations(
    docs: DataFrame, k: int = 2, seed: int = 0, alpha: float = 0.2, path: str | None = None,
    decoded: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, sample, ids, log_prob, perturbed, log_inclusion``: up to ``k``
    distinct segmentations per row, best perturbed value first; ``ids`` are
    little-endian unsigned 32-bit.  ``decoded`` adds ``text``, decoded from the
    ids in the same pass."""
    path = path or _model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path, alpha)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
        names = ["id", "sample", "ids", "log_prob", "perturbed", "log_inclusion"]
        surface, lattice = Surface(vocabulary), Lattice(vocabulary)
        for b in batches:
            for ids, texts in _blocks(b.column("id"), b.column("text"), BLOCK_CHARS):
                if lattice.n_edges > LATTICE_EDGES:
                    lattice = lattice.renewed(LATTICE_EDGES // 2)
                rows = sample_block(lattice, ids, texts, k, seed)
                cols = list(zip(*rows)) or [()] * 6
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
                if decoded:
                    arrays.append(surface.texts(arrays[2]))
                yield pa.RecordBatch.from_arrays(arrays, names + ["text"] * decoded)

    schema = SAMPLE_SCHEMA + (", text string" if decoded else "")
    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the model's own segmentation."""
    path = path or _model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            ids = [np.array(x, "<u4").tobytes() for x in model.encode(b.column("text").to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "id long, ids binary")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (with a binary column ``ids``) plus ``text``."""
    path = path or _model_path()
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = Surface(Vocabulary(path, 1.0))
        for b in batches:
            texts = [surface.text(x.as_py()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    return rows.mapInArrow(run, schema)


def _model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9(spark, sf_dir):
    from grovecount.sources.tables import read_table

    drawn = sample_segmentations(read_table(spark, sf_dir, "documents"), k=2, seed=42, decoded=True)
    return drawn.select(
        F.col("id").alias("doc_id"), "sample", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"), "log_prob", "log_inclusion", F.sha2("text", 256).alias("decoded_sha256"),
    )
