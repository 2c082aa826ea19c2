"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their words.

An untrained pre-tokeniser (a regex split of the tokenizers library) over ASCII-lowered text gives words with offsets.
Windows of consecutive offset pairs are the features; their CRC-32 says which bucket of a histogram they count in.  The
words are found once: a document goes on as its own small histogram, of which the corpus's is the sum, and on which the
gains are summed.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.chunks import pack, unpack
from tarn.llm.common import FOLD, give_back, slices, string_column, written

#: Words of lowered text (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words whose bucket a task remembers; then it begins anew.
REMEMBERED = 1 << 19
_BAG = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("bag", pa.binary())])
BAG = "doc_id long, n_words long, n_features long, bag binary"


def splitter():
    """text -> [(word, (from, to))], characters of the text."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str


class Features:
    """Buckets of the features of a text."""

    def __init__(self, max_n: int, buckets: int):
        self.split, self.max_n, self.buckets = splitter(), max_n, buckets
        self.known: dict[str, int] = {}

    def windows(self, pairs: list[tuple[str, tuple[int, int]]]) -> list[int]:
        """The bucket of every run of 1 to ``max_n`` consecutive offset pairs, its words joined by one space."""
        known, size = self.known, self.buckets
        out = []
        for word, _ in pairs:
            b = known.get(word)
            if b is None:
                if len(known) > REMEMBERED:
                    known.clear()
                b = known[word] = zlib.crc32(word.encode()) % size
            out.append(b)
        if self.max_n > 1:
            words = [w.encode() for w, _ in pairs]
            for first in range(len(words)):
                crc = zlib.crc32(words[first])
                for w in words[first + 1 : first + self.max_n]:
                    crc = zlib.crc32(w, zlib.crc32(b" ", crc))
                    out.append(crc % size)
        return out

    def bag(self, text: str) -> tuple[int, int, bytes]:
        """Words, features, and the packed histogram (buckets ascending, counts)."""
        pairs = self.split(text)
        found = self.windows(pairs)
        return len(pairs), len(found), pack(*(x.astype("<u4") for x in np.unique(np.array(found, np.int64), return_counts=True)))


def _bags(max_n: int, buckets: int):
    def run(batches):
        features = Features(max_n, buckets)
        for batch in batches:
            texts, ids = string_column(batch, "text"), batch.column(0)
            for a, b, data, offs in slices(texts):
                low = FOLD[data].tobytes()
                made = [features.bag(low[x:y].decode("utf-8", "replace")) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                cols = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c, t.type) for c, t in zip(cols, list(_BAG)[1:], strict=True))], schema=_BAG)
        features = None
        give_back()

    return run


def bags(docs: DataFrame, *, max_n: int, buckets: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, bag (its histogram, packed)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_bags(max_n, buckets), BAG)


def _summed(buckets: int):
    """Bags of a task become one histogram."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                b, n = unpack(blob)
                total[b] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def histogram(of: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket; ``buckets`` numbers are all that comes to the driver, whatever the input is."""
    sums = of.select("bag").mapInArrow(_summed(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for b, n in sums.collect():
        out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """For each bucket floor(1000 ln of target's share over source's), one feature more in each bucket of both."""
    k, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source, target, strict=True)]


def _weigher(shared):
    def run(batches):
        gain = np.array(shared.value, np.int64)
        for batch in batches:
            made = []
            for blob, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b, c = unpack(blob)
                made.append(int((gain[b] * c.astype(np.int64)).sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g), where g is Gumbel noise made of the id's digest; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, max_n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank.

    Features are all runs of 1 to ``max_n`` words, repeats counted.  ``weight`` is the floored mean of their gains (0
    without any), ``score`` adds noise that the id and ``seed`` decide.  Of the documents of at least ``min_words``
    words, ``percent`` in a hundred are drawn, the highest scores first, of equal ones the smaller id; ``rank`` is their
    place from 1 and null for all others.

    Every document is weighed.  Ranks are given without one task that sees all: how many documents have each score says
    where its ranks begin, and documents are numbered within their score.  Scores are integers between about -95,000 and
    115,000 (a gain is at most 1000 ln 2**63 either way, noise is between -3,200 and 22,900), so these counts are bounded
    whatever the input is; the noise spreads documents of one weight over thousands of scores.

    Null text has no words: weight 0, never drawn unless ``min_words`` is 0.  A null id comes after all others and has
    the noise of an empty one.  Repeated rows are documents of their own; of rows equal in score and id the one with more
    features comes first.  A text of any length is split whole in one task.  Other columns are ignored, whatever their
    names.  An empty table gives no rows; an empty target counts nothing in any bucket.
    """
    spark = docs.sparkSession
    held = written(bags(docs, max_n=max_n, buckets=buckets), "bags")
    goal = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = spark.sparkContext.broadcast(gains(histogram(held, buckets), histogram(bags(goal, max_n=max_n, buckets=buckets), buckets)))
    weighed = held.mapInArrow(_weigher(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    fit = scored.where(F.col("n_words") >= min_words)
    # One row a score, see above.
    each = sorted(((r.score, r.n) for r in fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in each) // 100
    begins, before = [], 0
    for score, n in each:
        if before >= drawn:
            break
        begins.append((score, before))
        before += n
    least = begins[-1][0] if begins else None
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    chance = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("weight").desc())
    placed = scored.where(chance).join(F.broadcast(spark.createDataFrame(begins, "score long, before long")), "score").withColumn("rank", F.col("before") + F.row_number().over(order))
    return placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.where(~chance).select(*columns, F.lit(None).cast("long").alias("rank")))
