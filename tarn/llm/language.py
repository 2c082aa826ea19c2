"""Language identification of mixed-language text.

Script ranges of code points narrow the candidate languages, features of each word (the word itself, its first and its last bytes)
score it in each candidate, and a Viterbi pass with a switching penalty labels spans.  The tables of the features have
a fixed size and are learned from documents whose language is known.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.chunks import compress, documents, expand, plain
from tarn.llm.common import U, Words, mix
from tarn.llm.toxicity import held_out

SAMPLE_ROWS = 50_000
#: Entries of the tables of whole words, first bytes and last bytes.
SIZES = (1 << 15, 1 << 13, 1 << 13)
WIDTH = sum(SIZES)
PENALTY = 12.0
MAX_LANGUAGES = 256
#: Words are ASCII letters and everything beyond ASCII.
SEPARATORS = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b > 127) for b in range(256)])
#: First code points of ranges and their script (fixed values, from the blocks of Unicode); 0 is no script of its own.
SCRIPT_STARTS = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 1), (0x00B6, 0),
    (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x02B0, 0),
    (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7), (0x0750, 6), (0x0780, 8), (0x07C0, 9),
    (0x0800, 10), (0x0860, 7), (0x0870, 6), (0x0900, 11), (0x0980, 12), (0x0A00, 13), (0x0A80, 14), (0x0B00, 15),
    (0x0B80, 16), (0x0C00, 17), (0x0C80, 18), (0x0D00, 19), (0x0D80, 20), (0x0E00, 21), (0x0E80, 22), (0x0F00, 23),
    (0x1000, 24), (0x10A0, 25), (0x1100, 26), (0x1200, 27), (0x13A0, 28), (0x1400, 29), (0x1680, 30), (0x16A0, 31),
    (0x1700, 32), (0x1780, 33), (0x1800, 34), (0x18B0, 29), (0x1900, 35), (0x1C80, 3), (0x1C90, 25), (0x1CC0, 35),
    (0x1D00, 1), (0x1DC0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C00, 36), (0x2C60, 1), (0x2C80, 2), (0x2D00, 25),
    (0x2D30, 37), (0x2D80, 27), (0x2DE0, 3), (0x2E00, 0), (0x2E80, 38), (0x3000, 0), (0x3005, 38), (0x3008, 0),
    (0x3040, 39), (0x3100, 40), (0x3130, 26), (0x3190, 38), (0x31A0, 40), (0x31C0, 38), (0x31F0, 39), (0x3200, 0),
    (0x3400, 38), (0x4DC0, 0), (0x4E00, 38), (0xA000, 41), (0xA4D0, 35), (0xA640, 3), (0xA6A0, 35), (0xA720, 1),
    (0xA800, 35), (0xA8E0, 11), (0xA900, 35), (0xA960, 26), (0xA980, 35), (0xAB00, 27), (0xAB30, 1), (0xAB70, 28),
    (0xABC0, 35), (0xAC00, 26), (0xD800, 0), (0xF900, 38), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
    (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 39), (0xFFA0, 26), (0xFFE0, 0),
    (0x10000, 42), (0x20000, 38), (0x40000, 0),
)
SCRIPTS = 43
_STARTS, _SCRIPT_OF = (np.array(x) for x in zip(*SCRIPT_STARTS, strict=True))
_NARROW = _SCRIPT_OF[np.searchsorted(_STARTS, np.arange(128), "right") - 1].astype(np.uint8)
ASCII_LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters: those of category L."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def has_letter(text: bytes) -> bool:
    code = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return bool(letters()[code].any())


def scripts(data: np.ndarray) -> np.ndarray:
    """The script of the code point that begins at each byte of UTF-8, 0 within code points."""
    out = np.where(data < 128, _NARROW[np.minimum(data, 127)], 0).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        code = first & (0x7F >> size)
        tail = np.append(data, np.zeros(3, np.uint8)).astype(np.int64) & 63
        for k in range(1, 4):
            code = np.where(size > k, (code << 6) | tail[lead + k], code)
        out[lead] = _SCRIPT_OF[np.searchsorted(_STARTS, code, "right") - 1]
    return out


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(three table positions, script) of each word."""
    if not words.count:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.uint8)
    size = words.end - words.start
    data = words.data
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(U)
    head, tail = np.zeros(words.count, U), np.zeros(words.count, U)
    for k in range(3):
        has = size > k
        head[has] = head[has] * U(256) + low[words.start[has] + k]
        tail[has] = tail[has] * U(256) + low[words.end[has] - 1 - k]
    at = np.empty((words.count, 3), np.int64)
    at[:, 0] = words.hash % U(SIZES[0])
    at[:, 1] = SIZES[0] + (mix(head + U(1)) % U(SIZES[1])).astype(np.int64)
    at[:, 2] = SIZES[0] + SIZES[1] + (mix(tail + U(3)) % U(SIZES[2])).astype(np.int64)
    bounds = np.empty(2 * words.count, np.int64)
    bounds[::2], bounds[1::2] = words.start, words.end
    pad = np.append(scripts(data), np.uint8(0))
    return at, np.maximum.reduceat(pad, bounds)[::2]


@dataclass
class Model:
    """Log-probabilities by language of each table entry, and which scripts each language uses."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    def words(self, words: Words) -> np.ndarray:
        at, script = word_features(words)
        s = self.scores[at].sum(axis=1)
        allowed = self.scripts[:, script].T
        # Where no language uses a script, all stay candidates.
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, s, s.min(axis=1, keepdims=True, initial=0.0) - 10.0)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: the sum of scores less ``penalty`` for each switch; ties stay with the earlier language."""
    n, k = scores.shape
    total = np.cumsum(scores, axis=0)
    best = int(total[-1].argmax())
    gain = total - total[:, best : best + 1]
    low = np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty:  # no stretch in any other language pays for a switch
        return np.full(n, best)
    now, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(range(k), key=now.__getitem__)
        other = now[top] - penalty
        back.append([j if now[j] >= other else top for j in range(k)])
        now = [max(now[j], other) + row[j] for j in range(k)]
    at = max(range(k), key=now.__getitem__)
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    return np.array(path[::-1])


def _counted(languages):
    """Counts of the table entries and scripts by language, one dense row of each language a task."""

    def run(batches):
        index = {x: i for i, x in enumerate(languages.value)}
        counts = np.zeros((len(index), WIDTH + SCRIPTS), np.int64)
        for batch in batches:
            lang = np.array([index.get(x, -1) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()])
            at = 0
            for d in documents([batch]):
                words = Words(d.data, d.offs, SEPARATORS, fold=True)
                place, script = word_features(words)
                own = lang[at : at + len(d)][words.doc_of()]
                at += len(d)
                for k in np.unique(own[own >= 0]).tolist():
                    mine = own == k
                    counts[k, :WIDTH] += np.bincount(place[mine].ravel(), minlength=WIDTH)
                    counts[k, WIDTH:] += np.bincount(script[mine], minlength=SCRIPTS)
        rows = [(k, compress(counts[k].tobytes())) for k in range(len(index)) if counts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["lang", "counts"])

    return run


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(expand(x), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([compress(x.tobytes()) for x in total.values()], pa.binary())], names=["lang", "counts"])


def learn(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> Model:
    """From at most about ``sample_rows`` rows that are not held out and whose lang is known, chosen by a hash of their id.

    Every language has an equal share of the sample, all its rows if they are fewer, so rare ones are learned too.  The
    tables have a fixed size, so what reaches the driver is one table for each language, whatever the input; more than
    ``max_languages`` languages are an error.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros((0, SCRIPTS), bool))
    languages = sorted(r.lang for r in sizes)
    counts = np.zeros((len(languages), WIDTH + SCRIPTS), np.int64)
    share = max(1, sample_rows // len(languages))
    if any(r.n > share for r in sizes):
        limits = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, (1 << 20) if r.n <= share else int((1 << 20) * share / r.n))))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limits[F.col("lang")])
    parts = known.mapInArrow(_counted(spark.sparkContext.broadcast(languages)), "lang int, counts binary")
    for r in parts.repartition("lang").mapInArrow(_summed, "lang int, counts binary").collect():
        counts[r.lang] = np.frombuffer(expand(bytes(r.counts)), np.int64)
    tables = counts[:, :WIDTH].astype(np.float64)
    scores = np.empty((WIDTH, len(languages)), np.float32)
    at = 0
    for size in SIZES:
        own = tables[:, at : at + size]
        own = own + 0.5
        p = np.log(own / own.sum(axis=1, keepdims=True))
        # Seen as often everywhere, an entry says nothing.
        scores[at : at + size] = (p - p.mean(axis=0)).T / len(SIZES) * 1.5
        at += size
    used = counts[:, WIDTH:] / np.maximum(counts[:, WIDTH:].sum(axis=1, keepdims=True), 1)
    return Model(languages, scores, used >= 0.001)


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])


def _labelled(model, penalty: float):
    def run(batches):
        m = model.value
        for d in documents(batches, 1 << 20):
            words = Words(d.data, d.offs, SEPARATORS, fold=True)
            scores = m.words(words) if m.languages else np.zeros((words.count, 0))
            first = words.first.tolist()
            weight = (words.end - words.start).astype(np.float64)
            ascii_letters = np.add.reduceat(np.append(ASCII_LETTERS[d.data], False).astype(np.int64), np.minimum(d.offs[:-1], len(d.data)))
            out: list[list] = [[], [], [], []]
            for i in range(len(d)):
                a, b = first[i], first[i + 1]
                base = int(d.offs[i])
                lettered = b > a and ((d.offs[i + 1] > d.offs[i] and ascii_letters[i] > 0) or has_letter(d.raw(i)))
                lang, score, spans = "und", 0.0, []
                if lettered and m.languages:
                    path = viterbi(scores[a:b], penalty)
                    mass = np.bincount(path, weights=weight[a:b], minlength=len(m.languages))
                    best = int(mass.argmax())
                    lang, score = m.languages[best], float(mass[best] / mass.sum())
                    edge = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [b - a]))
                    spans = [{"start": int(words.start[a + x]) - base, "end": int(words.end[a + y - 1]) - base, "lang": m.languages[path[x]]} for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                for col, v in zip(out, (None if d.nulls[i] else int(d.ids[i]), lang, score, spans), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _OUT, strict=True)], schema=_OUT)

    return run


def language_id(docs: DataFrame, *, model: Model | None = None, sample_rows: int = SAMPLE_ROWS, penalty: float = PENALTY, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, spans (UTF-8 byte ranges and their languages).

    lang_pred is the language with most bytes in words of its spans (of equals the first by name), score its share of
    them.  ``und`` with score 0 if text is null, empty or has no letter (Unicode category L), or if no language could
    be learned.  The model is learned from text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not
    0; only text enters a prediction.  More than ``max_languages`` different values of lang are an error.

    A null doc_id is held out or not as the empty string is.  Repeated ids and repeated rows are predicted each.  A
    text of any length is labelled whole, in one task.  Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    model = model or learn(docs, sample_rows=sample_rows, max_languages=max_languages)
    out = plain(docs).mapInArrow(_labelled(docs.sparkSession.sparkContext.broadcast(model), penalty), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
