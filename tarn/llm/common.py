"""Pieces shared by the text operators: table access, checkpoints, and vectorised word hashing over Arrow batches.

Texts reach Python as Arrow string arrays.  Their UTF-8 buffers are handled as numpy byte arrays, so words are found
and hashed without one Python object per word.  Work is cut into slices of about ``SLICE_BYTES`` of text, which bounds
memory whatever the Arrow batch holds; a single document is never cut.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 20
#: Bytes that separate words of the kind [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
U = np.uint64
_STEP, _LINK = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; no other character changes."""
    return F.translate(c, UPPER, LOWER)


def shared_base(spark: SparkSession) -> str:
    """The folder for what outlives executors: the cluster's checkpoint folder, as spark.checkpoint.dir names it.

    Only a session on one machine that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder, read again: made once, whatever executors are lost."""
    path = f"{shared_base(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers are kept for the next, and there are several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as strings, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def long_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and a mask of nulls."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about SLICE_BYTES; a longer row stands alone."""
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


#: Words of up to so many bytes are hashed by blocks of eight, all at once; longer ones each by BLAKE2.
BLOCKED = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """A 64-bit hash of the bytes of each span for each seed.

    Every block of eight bytes goes through `mix`, so spans that differ agree no more often than by chance: no choice
    of letters makes them cancel out, as they do in sums of powers.
    """
    size = (end - start).astype(np.int64)
    out = [mix(size.astype(U) * _LINK + U((s * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for s in seeds]
    if not len(size):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    now = np.flatnonzero((size > 0) & (size <= BLOCKED))
    for k in range(0, BLOCKED, 8):
        now = now[size[now] > k]
        if not len(now):
            break
        block = eights[start[now] + k] & _KEEP[np.minimum(size[now] - k, 8)]
        for h in out:
            h[now] = mix((h[now] ^ block) * _STEP)
    for i in np.flatnonzero(size > BLOCKED).tolist():
        raw = data[start[i] : end[i]].tobytes()
        for h, s in zip(out, seeds, strict=True):
            h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=s.to_bytes(8, "little")).digest(), "little")
    return out


class Words:
    """Words of consecutive documents: hash, byte start and end of each, and where each document's words begin.

    ``first`` has one entry more than there are documents; document d has words first[d]..first[d+1].  With ``wide``
    there is a second hash, so that both tell words apart by 128 bits.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, fold: bool = False, wide: bool = False):
        n = len(data)
        inside = ~sep[data]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        starts_at = offs[:-1][(offs[:-1] < n) & (np.diff(offs) > 0)]
        head[starts_at] = inside[starts_at]
        self.start = np.flatnonzero(head)
        tail = inside.copy()
        tail[:-1] &= ~inside[1:]
        before = starts_at[starts_at > 0] - 1
        tail[before] |= inside[before]
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = len(self.start)
        self.data = data
        self.hash, *more = hash_spans(FOLD[data] if fold else data, self.start, self.end, (0, 1) if wide else (0,))
        self.hash2 = more[0] if more else None

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; entries whose k words would leave the document mean nothing."""
        n = self.count
        out = np.zeros(n, U)
        if n < k:
            return out
        acc = np.full(n - k + 1, U(0x243F6A8885A308D3 + seed), U)
        for j in range(k):
            acc *= _LINK
            acc += self.hash[j : n - k + 1 + j]
            acc ^= acc >> U(29)
        out[: n - k + 1] = mix(acc)
        return out

    def doc_of(self) -> np.ndarray:
        """For each word the number of its document."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
