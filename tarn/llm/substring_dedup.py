"""Substring dedup by seed and extend: winnowed anchors find shared passages, extension finds their extent.

A window is ``threshold`` consecutive words.  Winnowing gives each window the anchor of smallest hash among its
k-grams, so equal windows have equal anchors at equal offsets, and only anchors that several documents share need
extending:

1. Seeds: which anchors occur in more than one document?
2. Extension: an anchor's stretch is all words of the windows that it owns, left and right of it.  If a document with
   a smaller id has the same stretch, all its windows are repeats.
3. Where stretches of an anchor differ (the ends of a passage), the single windows of the first document with each
   stretch are compared.

Repeated windows are then merged into maximal repeats.  Every question is answered for the whole corpus by buckets of
the hash space that see each key once a chunk (see `chunks`).  Anchors that agree by chance in 64 bits only ask more
questions; stretches and windows, which decide, are told apart by 128 bits made of two hashes of every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.chunks import DDL, Docs, Layout, answers, at_chunk, by_bucket, documents, layout, packed, plain, questions, rows
from tarn.llm.common import U, Words, mix

K = 5
LAST = np.iinfo(np.int64).max
#: Multipliers of the two sums over words, with their inverses.
_Q = (U(0xD1342543DE82EF95), U(0x9FB21C651E98DF25))
_QI = tuple(U(pow(int(q), -1, 1 << 64)) for q in _Q)
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
_KEPT_DDL = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept string"
SEED, STRETCH, WINDOW = 1, 2, 3


class Anchors:
    """Anchors of a chunk in order of position: hash, two hashes of the stretch, the windows owned, and the document."""

    def __init__(self, docs: Docs, threshold: int):
        self.words = w = Words(docs.data, docs.offs, wide=True)
        self.threshold = threshold
        self.order = np.where(docs.nulls, LAST, docs.ids)
        spread = threshold - min(K, threshold) + 1
        k = threshold - spread + 1
        n = w.count
        doc = w.doc_of()
        ends = np.repeat(w.first[1:], np.diff(w.first))
        window = np.flatnonzero(np.arange(n) + threshold <= ends)
        if not len(window):
            self.hash = np.zeros(0, U)
            self.stretch = (self.hash, self.hash)
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            return
        gram = w.grams(k)
        # Position of the smallest of the k-grams from each word on, the leftmost of equals.
        best, width = np.arange(n), 1
        while width < spread:
            step = min(width, spread - width)
            other = np.append(best[step:], np.full(step, n - 1))
            best = np.where(gram[best] <= gram[other], best, other)
            width += step
        owner = best[window]
        head = np.concatenate(([True], (owner[1:] != owner[:-1]) | (doc[window[1:]] != doc[window[:-1]]) | (window[1:] != window[:-1] + 1)))
        at = np.flatnonzero(head)
        self.first, self.last = window[at], window[np.append(at[1:], len(window)) - 1]
        place = owner[at]
        self.hash, self.doc = gram[place], doc[self.first]
        upto = self.last + threshold
        shape = (upto - self.first).astype(U) * U(0x9E3779B97F4A7C15) + (place - self.first).astype(U)
        made = []
        for q, qi, hashes in zip(_Q, _QI, (w.hash, w.hash2), strict=True):
            power = np.cumprod(np.concatenate(([U(1)], np.full(n, q, U))), dtype=U)
            undo = np.cumprod(np.concatenate(([U(1)], np.full(n, qi, U))), dtype=U)
            sums = np.concatenate(([U(0)], np.cumsum(hashes * power[:n], dtype=U)))
            made.append(mix(mix((sums[upto] - sums[self.first]) * undo[self.first]) + shape))
        self.stretch = tuple(made)

    def ids(self) -> np.ndarray:
        return self.order[self.doc]

    def pairs(self, chosen: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """Distinct (anchor, stretch) of the chosen anchors, sorted: (anchor, two hashes, smallest id); each one's number."""
        h, s, s2, d = self.hash[chosen], self.stretch[0][chosen], self.stretch[1][chosen], self.ids()[chosen]
        order, head = _heads(h, s, s2, d)
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(head) - 1
        first = order[head]
        return (h[first], s[first], s2[first], d[first]), number

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows owned by the chosen anchors: two hashes, position and id."""
        size = self.last[chosen] - self.first[chosen] + 1
        begin = np.repeat(self.first[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        made = []
        for q, hashes in zip(_Q, (self.words.hash, self.words.hash2), strict=True):
            acc = np.full(len(begin), q, U)
            for j in range(self.threshold):
                acc = mix(acc * q + hashes[begin + j])
            made.append(acc)
        return made[0], made[1], begin, np.repeat(self.ids()[chosen], size)

    def shared_within(self) -> np.ndarray:
        """Anchors that several documents of the chunk have."""
        order = np.lexsort((self.ids(), self.hash))
        h, d = self.hash[order], self.ids()[order]
        heads = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(heads)
        many = d[at] != d[np.append(at[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
        return np.sort(h[at][many])


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _heads(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by all columns, and which rows then begin another value of all columns but the last."""
    order = np.lexsort(columns[::-1])
    head = np.ones(len(order), bool)
    head[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns[:-1]])
    return order, head


def _seeds(lay: Layout, threshold: int):
    def run(batches):
        for docs in documents(batches, lay.chunk_bytes):
            out = questions(SEED, docs.key(), lay, np.unique(Anchors(docs, threshold).hash))
            if out:
                yield from rows(out).to_batches()

    return run


def _answer_seeds(keys: np.ndarray) -> tuple[np.ndarray]:
    """Whether another chunk has the anchor too."""
    every = np.sort(keys)
    return (_among(keys, np.unique(every[1:][every[1:] == every[:-1]])),)


def _shared(a: Anchors, got: dict, lay: Layout) -> np.ndarray:
    """Positions in ``a`` of anchors that more than one document of the corpus has."""
    keys = np.unique(a.hash)
    mask = answers(got, SEED, lay, keys, bool)[0]
    return np.flatnonzero(_among(a.hash, keys[mask]) | _among(a.hash, a.shared_within()))


def _stretches(lay: Layout, threshold: int):
    def step(docs: Docs, got: dict, key: bytes) -> pa.Table:
        a = Anchors(docs, threshold)
        return rows(questions(STRETCH, key, lay, *a.pairs(_shared(a, got, lay))[0]))

    return step


def _answer_stretches(h: np.ndarray, s: np.ndarray, s2: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (anchor, stretch) the smallest id that has it, and whether the anchor has other stretches."""
    order, head = _heads(h, s, s2, d)
    top = np.ones(len(order), bool)
    top[1:] = h[order][1:] != h[order][:-1]
    low, many = np.empty_like(d), np.empty(len(d), bool)
    low[order] = d[order[head]][np.cumsum(head) - 1]
    many[order] = np.add.reduceat(head.astype(np.int64), np.flatnonzero(top))[np.cumsum(top) - 1] > 1
    return low, many


def _resolved(a: Anchors, got: dict, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in ``a`` of shared anchors, those whose whole stretch is a repeat, those to be compared by window)."""
    # The chunk asks again what it asked before, so its answers line up.
    chosen = _shared(a, got, lay)
    (h, *_), number = a.pairs(chosen)
    low, many = answers(got, STRETCH, lay, h, np.int64, bool)
    ids = a.ids()[chosen]
    return chosen, low[number] < ids, (low[number] == ids) & many[number]


def _windows(lay: Layout, threshold: int):
    def step(docs: Docs, got: dict, key: bytes) -> pa.Table:
        a = Anchors(docs, threshold)
        chosen, _, unsure = _resolved(a, got, lay)
        w, w2, _, d = a.windows(chosen[unsure])
        order, head = _heads(w, w2, d)
        first = order[head]
        return rows(questions(WINDOW, key, lay, w[first], w2[first], d[first]))

    return step


def _answer_windows(w: np.ndarray, w2: np.ndarray, d: np.ndarray) -> tuple[np.ndarray]:
    """The smallest id that has each window."""
    order, head = _heads(w, w2, d)
    low = np.empty_like(d)
    low[order] = d[order[head]][np.cumsum(head) - 1]
    return (low,)


def _remove(lay: Layout, threshold: int):
    def step(docs: Docs, got: dict, key: bytes) -> pa.Table:
        a = Anchors(docs, threshold)
        chosen, repeats, unsure = _resolved(a, got, lay)
        w, w2, begin, ids = a.windows(chosen[unsure])
        order, head = _heads(w, w2, ids)
        (low,) = answers(got, WINDOW, lay, w[order[head]], np.int64)
        single = np.empty(len(w), bool)
        single[order] = low[np.cumsum(head) - 1] < ids[order]
        single = begin[single]
        # Words from the first of a repeated window to its last.
        edge = np.zeros(a.words.count + threshold + 1, np.int64)
        np.add.at(edge, a.first[chosen[repeats]], 1)
        np.add.at(edge, a.last[chosen[repeats]] + threshold, -1)
        np.add.at(edge, single, 1)
        np.add.at(edge, single + threshold, -1)
        gone = np.cumsum(edge)[: a.words.count] > 0
        out: list[list] = [[], [], [], [], []]
        first = a.words.first.tolist()
        for d in range(len(docs)):
            words, mask = docs.raw(d).split(), gone[first[d] : first[d + 1]]
            spans = []
            if mask.any():
                at = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                spans = [{"first": x, "end": y} for x, y in zip(at[::2].tolist(), at[1::2].tolist(), strict=True)]
            kept = [x for x, g in zip(words, mask.tolist(), strict=True) if not g] if spans else words
            for col, v in zip(out, (None if docs.nulls[d] else int(docs.ids[d]), len(words), int(mask.sum()), spans, b" ".join(kept).decode("utf-8", "replace")), strict=True):
                col.append(v)
        return pa.table([pa.array(c, t.type) for c, t in zip(out, _KEPT, strict=True)], schema=_KEPT)

    return step


def substring_dedup(docs: DataFrame, *, threshold: int = 13) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, removed (ranges of word numbers), kept (the other words).

    A word, in [^\\x20\\x09-\\x0D]+, is removed when a window of ``threshold`` words covers it whose word sequence also
    starts in a document with a smaller doc_id; ``removed`` are the maximal repeats that result, ``kept`` the other
    words joined by one space.  Windows are judged on the input.  Texts of fewer words lose nothing, nor does a text
    that repeats only itself.

    Null text has no words.  A null doc_id counts as larger than all others; rows with equal ids take nothing from
    each other.  Each row gives one row, repeated rows too.  A text of any length is one chunk at least and is judged
    whole.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    lay = layout(plain(docs))
    chunks = packed(docs, lay)
    seeds = by_bucket(plain(docs).mapInArrow(_seeds(lay, threshold), DDL), lay, _answer_seeds)
    stretches = by_bucket(at_chunk(chunks, seeds, lay, _stretches(lay, threshold)), lay, _answer_stretches)
    known = seeds.unionByName(stretches)
    windows = by_bucket(at_chunk(chunks, known, lay, _windows(lay, threshold)), lay, _answer_windows)
    return at_chunk(chunks, known.unionByName(windows), lay, _remove(lay, threshold), _KEPT_DDL)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
