"""Ranked lexical search: the best documents for each item of a set of queries.

Documents are restricted to the items' vocabulary, so most of what tells texts apart is gone: what is left of one is a
vector of term counts and a length factor.  Documents that agree in both are one class (dealt by a hash, told apart by
all their bytes), a class is scored once, and its members, smallest ids first, take its score.  Scores are integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import FOLD, U, Words, give_back, hash_spans, slices, string_column, written

#: Terms of lowered text (fixed value), and the bytes that separate them.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes of item text that are looked for in one pass.
MAX_BYTES = 1 << 20
#: Scores that a task holds at once.
CELLS = 4 << 20
_VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("vector", pa.binary())])
_FOUND = "item int, score long, members array<struct<none:boolean,doc_id:long>>"


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


class Vocabulary:
    """Terms by number, and a table that finds the number of a term by its hash."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        start = end - np.array([len(w) for w in words], np.int64)
        first, second = hash_spans(data, start, end, (0, 1))
        order = np.argsort(first)
        self.size, self.first, self.second, self.number = len(words), first[order], second[order], order
        self.near = np.zeros(1 << 20, bool)
        self.near[(first >> U(44)).astype(np.int64)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the numbers of these; 128 bits of hash agree."""
        at = np.flatnonzero(self.near[(words.hash >> U(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.first, words.hash[at]), max(self.size - 1, 0))
        same = self.first[place] == words.hash[at]
        at, place = at[same], place[same]
        (again,) = hash_spans(words.folded, words.start[at], words.end[at], (1,))
        same = self.second[place] == again
        return at[same], self.number[place[same]]


class _Terms(Words):
    """Terms of consecutive documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        super().__init__(data, offs, BREAK, fold=True)
        self.folded = FOLD[data]


def _vectors(shared):
    """Rows (doc_id, text) become (doc_id, terms in all, vector): pairs (number, count), numbers ascending."""

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        size = max(vocabulary.size, 1)
        for batch in batches:
            texts, ids = string_column(batch, "text"), batch.column(0)
            for a, b, data, offs in slices(texts):
                words = _Terms(data, offs)
                if vocabulary.size:
                    at, number = vocabulary.find(words)
                    key, count = np.unique(words.doc_of()[at] * size + number, return_counts=True)
                else:
                    key = count = np.zeros(0, np.int64)
                pairs = np.stack([key % size, count], 1).astype("<u4")
                cut = 8 * np.searchsorted(key // size, np.arange(b - a + 1))
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(words.first).astype(np.int64)), blob], schema=_VECTOR)
        give_back()

    return run


def _holders(size: int):
    """How many vectors of a task hold each term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[1], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    return run


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the vectors of a column."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, "<u4", (offs[-1] - offs[0]) // 4, offs[0]) if raw is not None and offs[-1] > offs[0] else np.zeros(0, "<u4")
    pairs = flat.reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(column)), np.diff(offs) // 8), pairs[:, 0], pairs[:, 1]


class Best:
    """The best classes of each item so far: score, whether the first member has no id, its id, all kept members."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), [])] * items

    def add(self, item: int, score: np.ndarray, none: np.ndarray, first: np.ndarray, rows: np.ndarray, members: pa.Array) -> None:
        s0, n0, f0, m0 = self.held[item]
        least = s0[-1] if len(s0) == self.top else 1
        at = np.flatnonzero(score >= max(least, 1))
        if not len(at):
            return
        s, n, f = (np.concatenate(x) for x in ((s0, score[at]), (n0, none[at]), (f0, first[at])))
        order = np.lexsort((f, n, -s))[: self.top]
        kept = [m0[k] if k < len(s0) else members[int(rows[at[k - len(s0)]])].as_py() for k in order.tolist()]
        self.held[item] = (s[order], n[order], f[order], kept)


def _scored(shared, top: int):
    """Classes (m, vector, members) become the best of the task for each item."""

    def run(batches):
        items, posts = shared.value
        best = Best(items, top)
        rows = max(1, CELLS // max(items, 1))
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                m = part.column(0).to_numpy(zero_copy_only=False)
                row, term, tf = _pairs(part.column(1))
                gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                order = np.argsort(term, kind="stable")
                row, term, gain = row[order], term[order], gain[order]
                score = np.zeros((items, part.num_rows), np.int64)
                edge = np.flatnonzero(np.diff(term, prepend=-1))
                for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(term)], strict=True):
                    which, weight = posts[int(term[x])]
                    score[np.ix_(which, row[x:y])] += weight[:, None] * gain[None, x:y]
                members = part.column(2)
                first = pc.list_element(members, 0)
                none, ids = (pc.struct_field(first, k) for k in (0, 1))
                none, ids = none.to_numpy(zero_copy_only=False).astype(bool), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                every = np.arange(part.num_rows)
                for i in range(items):
                    best.add(i, score[i], none, ids, every, members)
        for i, (s, _, _, kept) in enumerate(best.held):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int32()), pa.array(s), pa.array(kept, pa.list_(pa.struct([("none", pa.bool_()), ("doc_id", pa.int64())])))], names=["item", "score", "members"])
        best = None
        give_back()

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lexical_search(docs: DataFrame, items: DataFrame, *, top: int = 20, max_bytes: int = MAX_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item its ``top`` documents of the highest score above 0.

    All documents are ranked for every item; of equal scores the smaller doc_id comes first.  With N documents that have
    a term, L terms in all of them, n in a document, a document's factor m is 75 + 25 n N div L, a term's weight w is
    floor(1000 ln((2 N + 2) / (2 df + 1))), and a score is the sum over the item's terms, repeats included, of
    w (10**9 tf div (1000 tf + 12 m)).

    A class of documents that agree in all counts and in m leaves each task with its ``top`` smallest ids at most: no
    other member can be among an item's ``top``, so nothing is lost, and no class meets whole in one task.  A task gives
    each item's ``top`` classes at most, in blocks of bounded size.

    The items are what every task holds.  Their size is summed first; beyond ``max_bytes`` they are dealt by hash into
    parts, and each part is a pass of its own whose result is written before the next begins, so neither the driver nor
    a task ever holds more than one.

    Null texts and items have no terms.  A document without id comes after all others; repeated ids and rows are
    documents of their own, so an item may have one id twice.  Items that repeat an id and text are one, items of one id
    and different texts share their id and have ranks of their own, items without id are passed over.  A text of any
    length is one row.  Other columns are ignored, whatever their names.  Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    if parts == 1:
        return _searched(rows, asked, top)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = [written(_searched(rows, asked.where(part == p), top), "found") for p in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _searched(rows: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    spark = rows.sparkSession
    queries = [(r.item_id, Counter(terms(r.text))) for r in asked.collect()]  # bounded by max_bytes
    words = sorted({t for _, c in queries for t in c})
    number = {t: k for k, t in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast(words)
    held = written(rows.mapInArrow(_vectors(vocabulary), "doc_id long, n long, vector binary"), "vectors")
    n_docs, n_terms = held.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = held.select("vector").mapInArrow(_holders(max(len(words), 1)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = dict(map(tuple, holding.collect()))  # as many rows as the items have terms
    lists: dict[int, list[tuple[int, int]]] = {number[t]: [] for t in words}
    for i, (_, counts) in enumerate(queries):
        for t, repeats in counts.items():
            if number[t] in df:
                lists[number[t]].append((i, repeats * weight(n_docs, df[number[t]])))
    posts = spark.sparkContext.broadcast((len(queries), {t: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for t, own in lists.items() if own}))
    m = F.expr(f"75L + (25L * n * {n_docs or 0}L) div {n_terms or 1}L").alias("m")
    known = held.where(F.length("vector") > 0).select("doc_id", "vector", m).withColumn("h", F.xxhash64("m", "vector"))
    # Few of a class matter, and they are picked before the shuffle; h deals and sorts, m and the bytes decide.
    first = known.withColumn("place", F.row_number().over(Window.partitionBy("h", "m", "vector").orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("place") <= top)
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    classes = first.groupBy("h", "m", "vector").agg(F.array_sort(F.collect_list(member)).alias("members"))
    best = classes.select("m", "vector", "members").mapInArrow(_scored(posts, top), _FOUND)
    of = Window.partitionBy("item")
    lead = F.element_at("members", 1)
    few = best.withColumn("place", F.row_number().over(of.orderBy(F.col("score").desc(), lead["none"], lead["doc_id"]))).where(F.col("place") <= top)
    every = few.select("item", "score", F.explode("members").alias("d"))
    ranked = every.withColumn("rank", F.row_number().over(of.orderBy(F.col("score").desc(), F.col("d.none"), F.col("d.doc_id")))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(queries)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("d.doc_id").alias("doc_id"), "score")
