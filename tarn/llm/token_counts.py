"""Token counts through a digest cache.

A count is stored under two digests: of the normalised content, and of the tokenizer's version (library, its release
and all bytes of the vocabulary file).  Documents are joined to what is stored by content digest; of the contents that
the cache lacks each distinct one is encoded once, and its count is appended.  A corpus that was counted before costs a
scan, a narrow distinct and a narrow join, and no text is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from importlib.metadata import version as release

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, give_back, slices, string_column

#: Missing contents up to so many are sent to every task as digests of 32 bytes (2 MiB); more are joined by a shuffle.
SENT = 1 << 16
#: Segments of up to so many characters are remembered by a task, so many at most; then it begins anew.
SEGMENT, REMEMBERED = 48, 1 << 19
STORED = "digest binary, n_bytes long, n_tokens long"
_OUT = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
#: White space of pieces; a space in a text becomes it.
_MARK = "▁"
_SEGMENTS = re.compile(f"[ {_MARK}]+[^ {_MARK}]*")
_loaded: dict = {}


def content(text: Column) -> Column:
    """What is counted and digested: null as empty, bytes that are no UTF-8 replaced.

    Nothing else is changed, since tokenizers tell apart whatever else differs.
    """
    return F.make_valid_utf8(F.coalesce(text.cast("string"), F.lit("")))


def tokenizer_version(path: str) -> str:
    """Digest of the library, its release and the whole vocabulary file: 64 hexadecimal digits."""
    library = _library(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {release(library)}\n".encode() + f.read()).hexdigest()


def _library(path: str) -> str:
    for ending, library in ((".model", "sentencepiece"), (".json", "tokenizers")):
        if path.endswith(ending):
            return library
    raise ValueError("the vocabulary is a .model or .json file")


class Pieces:
    """Counts of a sentencepiece model.

    Where no piece has white space inside (the mark stands only at its front), nothing is merged across the front of a
    run of white space, so a text is the sum of its segments: a run and what follows it.  The library encodes each
    distinct segment once a task.  A model of any other kind, or one that normalises, encodes whole texts.
    """

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "  aÄ①  　b \t"
        kept = self.model.decode(self.model.encode(probe)) == probe
        falls_back = any(self.model.is_byte(i) for i in range(len(pieces)))
        prefixed = "".join(self.model.encode("a", out_type=str)) == f"{_MARK}a"
        self.segmented = kept and falls_back and prefixed and not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.segmented:
            return self._whole(texts)
        found = [Counter(_SEGMENTS.findall(" " + t)) if t else {} for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({s for c in found for s in c if s not in known})
        # A segment begins with one mark that the library puts before whatever it encodes.
        fresh = dict(zip(new, (self.lone if len(s) == 1 else n for s, n in zip(new, self._whole([s[1:] for s in new]), strict=True)), strict=True))
        known |= {s: n for s, n in fresh.items() if len(s) <= SEGMENT}
        return [sum(n * (known[s] if s in known else fresh[s]) for s, n in c.items()) for c in found]


class Tokens:
    """Counts of a tokenizers file, whole texts, without truncation and padding."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(raw.decode("utf-8"))
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def _counter(kind: str, key: str, raw: bytes):
    """The tokenizer, loaded once in each Python worker."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = (Pieces if kind == "sentencepiece" else Tokens)(raw)
    return _loaded[key]


def _encoder(kind: str, key: str, shared):
    """Rows (digest, text) become (digest, n_bytes, n_tokens)."""

    def run(batches):
        counter = _counter(kind, key, shared.value)
        for batch in batches:
            digests, texts = batch.column(0), string_column(batch, "text")
            for a, b, _, offs in slices(texts):
                n = counter.counts(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([digests.slice(a, b - a).cast(pa.binary()), pa.array(offs[1:] - offs[:-1], pa.int64()), pa.array(n, pa.int64())], schema=_OUT)
        give_back()

    return run


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(digest, n_bytes, n_tokens), a row a content, of what is stored for a version; None if nothing was ever."""
    try:
        found = spark.read.schema(STORED).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # Two jobs that ran at once may both have appended a content; their counts are the same.
    return found.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, *, cache: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is a vocabulary file, .model or .json; texts are encoded whole, without begin, end or added special
    tokens, without truncation or padding.  ``cache`` is a folder that all executors share; it may hold counts of
    several versions and is made if it is not there.  Calling this appends what is missing, before the result is read.

    Contents are told apart by SHA-256.  Texts of one content, a third of all rows or more, leave each task as one row
    when they are gathered, and their rows find the count in a join whose large side Spark may split.

    Null text counts as empty: no bytes, no tokens.  Null and repeated doc_ids, and repeated rows, pass through, one row
    each.  A text of any length is encoded whole in one task.  Other columns are ignored, whatever their names.  An empty
    table gives no rows.  The order of rows means nothing, so there are no ties.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content(F.col("text")).alias("text"))
    keyed = text.select("doc_id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    missing = _missing(keyed, stored(spark, cache, version))
    if missing is not None:
        with open(tokenizer, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
        missing.mapInArrow(_encoder(_library(tokenizer), version, shared), STORED).write.mode("append").parquet(f"{cache}/version={version}")
    counts = stored(spark, cache, version)
    return keyed.select("doc_id", "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _missing(keyed: DataFrame, known: DataFrame | None) -> DataFrame | None:
    """(digest, text) of each distinct content that is not stored; None if all are."""

    def each(rows: DataFrame) -> DataFrame:
        # By digest and not by text: what follows is joined by digest without another shuffle.
        return rows.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text"))

    if known is None:
        return each(keyed)
    digests = checkpointed(keyed.select("digest").distinct().join(known, "digest", "left_anti"))
    n = digests.count()
    if not n:
        return None
    return each(keyed.join(F.broadcast(digests), "digest", "left_semi")) if n <= SENT else each(keyed).join(digests, "digest", "left_semi")
