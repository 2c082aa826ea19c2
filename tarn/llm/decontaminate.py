"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one pass over each text.

The automaton's alphabet are words, and its patterns are the blocks that an item's text falls into when it is cut every
(window + 1) / 2 words: whatever window of the item occurs in a text, one of these blocks lies inside it.  So there is
one node a word of the benchmark at most, not one a byte of every window.  Where a block is found, the item and the
text are compared word by word in both directions, and what agrees over a whole window or more is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import fresh, slices, string_column, written

#: Bytes of words: 0-9, a-z after folding, and everything beyond ASCII; the rest becomes a space.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of item text that one automaton takes: about 120 MB in each Python worker, see `Items`.
MAX_BYTES = 8 << 20
#: A word before A-Z are lower-cased, as `normalise` finds it (fixed value).
WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_cache: dict = {}


def normalise(text: str | bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_FOLDED).split()


class Items:
    """Items as numbers of their words, an automaton over blocks of them, and the items' ids.

    ``line`` has all items' words one after the other, 0 before and after each; word numbers begin with 1.  Measured on
    invented prose: about 14 bytes a byte of item text, of which the automaton's nodes are most.
    """

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        line, starts = [0], []
        places: dict[tuple[int, ...], list[int]] = {}
        for k, (_, text) in enumerate(items):
            words = [self.number.setdefault(w, len(self.number) + 1) for w in normalise(text)]
            first = len(line)
            starts.append(first)
            line += words
            line.append(0)
            if len(words) < window:
                blocks = [(0, tuple(words))] if words else []
            else:
                blocks = [(at, tuple(words[at : at + self.block])) for at in range(0, len(words) - self.block + 1, self.block)]
            for at, key in blocks:
                # A short item is one pattern, told apart from blocks by its negative number.
                places.setdefault(key, []).append(-1 - k if len(words) < window else first + at)
        self.line, self.starts = np.array(line, np.int32), np.array(starts, np.int64)
        self.auto = None
        if places:
            self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, found in places.items():
                self.auto.add_word(key, (len(key), [-1 - x for x in found if x < 0], np.array([x for x in found if x >= 0], np.int64)))
            self.auto.make_automaton()

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(from, to, number of the item) of the longest stretches of a window or more that a text and an item share."""
        if self.auto is None or not words:
            return []
        number = self.number.get
        text = tuple([number(w, 0) for w in words])
        found, line, padded = [], self.line, None
        done: dict[int, int] = {}
        for at, (size, short, places) in self.auto.iter(text):
            first = at - size + 1
            found += [(first, at + 1, k) for k in short]
            if not len(places):
                continue
            if padded is None:
                padded = np.array((0, *text, -1), np.int32)
            if done:
                # Stretches that an earlier block of theirs has led to already.
                places = np.array([x for x in places.tolist() if done.get(x - first, -1) < first], np.int64)
                if not len(places):
                    continue
            low = np.full(len(places), first)
            high = np.full(len(places), at + 1)
            alive = np.arange(len(places))
            step = 1
            while len(alive):
                alive = alive[(padded[first - step + 1] != 0) & (line[places[alive] - step] == padded[first - step + 1])] if first - step >= 0 else alive[:0]
                low[alive] -= 1
                step += 1
            alive = np.arange(len(places))
            step = size
            while len(alive):
                alive = alive[line[places[alive] + step] == padded[first + step + 1]] if padded[first + step + 1] > 0 else alive[:0]
                high[alive] += 1
                step += 1
            owner = np.searchsorted(self.starts, places, "right") - 1
            for x, a, b, k in zip(places.tolist(), low.tolist(), high.tolist(), owner.tolist(), strict=True):
                done[x - first] = b - 1
                if b - a >= self.window:
                    found.append((a, b, k))
        return sorted(found)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Merged runs [from, to) of hit words, and the ids of the items found."""
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b, k in self.matches(words):
            items.add(k)
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], b))
            else:
                runs.append((a, b))
        return runs, sorted({self.ids[k] for k in items})


def word_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte range in the original text of each word."""
    wordy = np.frombuffer(raw.translate(_FOLDED), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], wordy.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])))])
DDL = "n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long,text:string>>"


def _items(shared, window: int, key: str) -> Items:
    """The automaton, built once in each Python worker."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = Items(shared.value, window)
    return _cache[key]


def _scanner(shared, window: int, key: str):
    """Rows (id, text) become (id, hits)."""

    def run(batches):
        items = _items(shared, window, key)
        for batch in batches:
            texts, ids = string_column(batch, "text"), batch.column(0)
            for a, b, data, offs in slices(texts):
                cols: list[list] = [[], [], [], []]
                for d in range(b - a):
                    raw = data[offs[d] : offs[d + 1]].tobytes()
                    words = normalise(raw)
                    runs, found = items.scan(words)
                    spans = []
                    if runs:
                        at = word_spans(raw)
                        for s, e in runs:
                            lo, hi = at[s][0], at[e - 1][1]
                            chars = len(raw[:lo].decode("utf-8", "replace"))
                            piece = raw[lo:hi].decode("utf-8", "replace")
                            spans.append({"start": chars, "end": chars + len(piece), "text": piece})
                    for col, v in zip(cols, (len(words), sum(e - s for s, e in runs), found, spans), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c, t.type) for c, t in zip(cols, FOUND, strict=True))], names=[batch.schema.names[0], *FOUND.names])

    return run


def _dropper(shared, window: int, key: str, text_col: str, share: tuple[int, int]):
    def run(batches):
        items = _items(shared, window, key)
        for batch in batches:
            texts = string_column(batch, text_col)
            keep = np.ones(len(texts), bool)
            for a, b, data, offs in slices(texts):
                for d in range(b - a):
                    words = normalise(data[offs[d] : offs[d + 1]].tobytes())
                    hit = sum(y - x for x, y in items.scan(words)[0])
                    keep[a + d] = not (hit and hit * share[1] >= len(words) * share[0])
            yield batch.filter(pa.array(keep))

    return run


def _parts(benchmark: DataFrame, max_bytes: int) -> tuple[DataFrame, int]:
    """Distinct items, and into how many parts their size asks to cut them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-total // max_bytes))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: tuple[int, int] = (1, 20), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  A word
    of a document inside any occurrence of a window is hit; ``items`` are the ids whose windows occur (sorted,
    distinct), ``spans`` the merged hit ranges as character offsets in the original text.  A document is contaminated
    when at least ``share`` of its words are hit.

    The items are the only thing that each worker holds.  Their size is summed first: up to ``max_bytes`` of item text
    they make one automaton.  A larger benchmark is cut by id hash into several, each scanned over all texts in its
    own pass whose hits are written before the next begins; they are united by the text's digest, so the result is the
    same and neither the driver nor a worker holds more than one part.

    Null text has no words, an empty one neither; null item text or id is ignored; items that repeat are reported by
    id.  Documents that repeat an id, and repeated rows, are scanned each.  A text of any length is scanned whole, in
    one task.  Columns other than doc_id, text, item_id are ignored, whatever their names.  Empty tables give no rows
    or no hits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, parts = _parts(benchmark, max_bytes)
    if parts == 1:
        out = _hits(rows, "doc_id long", items, parts, window)
    else:
        # Texts of one digest have the same hits, so each is scanned once and all its rows find the hits by it.
        keyed = rows.withColumn("digest", _digest("text"))
        out = keyed.select("doc_id", "digest").join(_hits(keyed.select("digest", "text").dropDuplicates(["digest"]), "digest string", items, parts, window), "digest")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", _contaminated(share).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: tuple[int, int] = (1, 20), max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that ``decontaminate`` does not call contaminated.

    Every row is judged by its own text, so null and repeated ids do not matter, and a benchmark of up to ``max_bytes``
    needs no shuffle.  Other columns pass through whatever their names.
    """
    items, parts = _parts(benchmark, max_bytes)
    if parts == 1:
        return _pass(docs, items, window, lambda shared, w, key: _dropper(shared, w, key, "text", share), docs.schema)
    name = fresh(docs, "digest")
    marked = docs.withColumn(name, _digest("text"))
    texts = marked.select(F.col(name).alias("digest"), F.col("text").cast("string").alias("text")).dropDuplicates(["digest"])
    bad = _hits(texts, "digest string", items, parts, window).where(_contaminated(share)).select(F.col("digest").alias(name))
    return marked.join(bad, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _digest(text: str):
    return F.sha2(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"), 256)


def _contaminated(share: tuple[int, int]):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0])


def _pass(rows: DataFrame, items: DataFrame, window: int, make: Callable, schema) -> DataFrame:
    got = sorted((r.item_id, r.text) for r in items.collect())
    key = hashlib.sha256(repr((window, got)).encode("utf-8", "surrogatepass")).hexdigest()
    return rows.mapInArrow(make(rows.sparkSession.sparkContext.broadcast(got), window, key), schema)


def _hits(rows: DataFrame, id_ddl: str, items: DataFrame, parts: int, window: int) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for ``rows`` (id, text); with more than one part, ids are distinct."""
    ddl = f"{id_ddl}, {DDL}"
    if parts == 1:
        return _pass(rows, items, window, _scanner, ddl)
    found, rows = [], written(rows, "texts")
    for p in range(parts):
        # A part's hits are written before the next part is fetched, so the driver and the workers hold one at a time.
        own = _pass(rows, items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p), window, _scanner, ddl)
        found.append(written(own.where("n_hit > 0"), "hits"))
    # Texts that no part hits are not in them.
    count = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 1)).cast("long")
    key = rows.columns[0]
    united = _united(reduce(DataFrame.unionByName, found), key)
    none = rows.join(united.select(key), key, "left_anti").select(key, count.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<long>").alias("items"), F.array().cast(united.schema["spans"].dataType).alias("spans"))
    return united.unionByName(none)


def _united(found: DataFrame, key: str) -> DataFrame:
    """The hits of all parts, one row for each id."""
    merged = found.groupBy(key, "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Overlapping spans of different parts become one; its words are counted again from its text.
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:long,end:long,text:string>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(_glued(F.element_at(acc, -1), x)))).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.withColumn("spans", joined)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + F.size(F.regexp_extract_all(x["text"], F.lit(WORD), 1)))
    return merged.select(key, "n_words", words.alias("n_hit"), "items", "spans")


def _glued(a, b):
    return F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"), F.when(b["end"] > a["end"], F.concat(a["text"], F.substring(b["text"], a["end"] - b["start"] + 1, b["end"] - a["end"]))).otherwise(a["text"]).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract: item ids as a SHA-256 of their sorted, comma-joined strings."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), "contaminated")
