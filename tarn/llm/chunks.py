"""Documents in packed chunks, and packed exchanges between chunks and buckets of a hash space.

A chunk is a run of documents under a 128-bit digest of all that it holds (ids, which of them are null, sizes, bytes),
so chunks of one name are the same documents and get the same answers.  What chunks ask of the whole corpus travels as
one binary row for each chunk and bucket: sorted unique 64-bit keys with what belongs to them.  A key that a third of
all documents have is thus one entry a chunk, whatever the size of the corpus, and no task holds more than its chunk or
its bucket.

Sizes follow the input (`layout`): there are as many buckets as keep each at a bounded share of the text, whatever the
session's shuffle partitions are, and chunks grow with the input, so that a row between a chunk and a bucket stays
worth its overhead.  A bucket is answered in ranges of its keys, a bounded number of entries at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import U, give_back, long_column, string_column

#: Bytes of text: least and most of a chunk, least of a bucket, chunks of a bucket at least, chunks that the input is cut into before they grow.
CHUNK_BYTES, MAX_CHUNK_BYTES, BUCKET_BYTES, BUCKET_CHUNKS, CHUNKS = 1 << 20, 32 << 20, 16 << 20, 8, 1 << 14
#: Entries of a bucket that are answered at a time.
RANGE_ENTRIES = 4 << 20
DDL = "bucket int, chunk binary, kind int, blob binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.binary()), ("kind", pa.int32()), ("blob", pa.binary())])


class Layout(NamedTuple):
    """Bytes of text of a chunk, and the number of buckets."""

    chunk_bytes: int
    buckets: int


def layout(docs: DataFrame) -> Layout:
    """For ``docs`` (text string): sums the sizes of all texts once."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = min(max(total // CHUNKS, CHUNK_BYTES), MAX_CHUNK_BYTES)
    return Layout(chunk, max(1, -(-total // max(BUCKET_BYTES, BUCKET_CHUNKS * chunk))))


def compress(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, each as planes of its bytes, compressed together."""
    head = [len(arrays).to_bytes(1, "little")]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little"))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = expand(blob)
    at, out = 1 + 12 * raw[0], []
    for k in range(raw[0]):
        head = raw[1 + 12 * k : 13 + 12 * k]
        kind, n = np.dtype(head[:4].decode().strip()), int.from_bytes(head[4:], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def rows(found: list[tuple[int, bytes, int, bytes]]) -> pa.Table:
    cols = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, t.type) for c, t in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)


class Docs:
    """Ids, which of them are null, and texts (bytes and offsets) of some documents."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, data: np.ndarray, offs: np.ndarray):
        self.ids, self.nulls, self.data, self.offs = ids, nulls, data, offs

    def __len__(self) -> int:
        return len(self.ids)

    def raw(self, d: int) -> bytes:
        return self.data[self.offs[d] : self.offs[d + 1]].tobytes()

    def _parts(self) -> tuple[bytes, ...]:
        return (len(self).to_bytes(8, "little"), self.ids.astype("<i8").tobytes(), self.offs.astype("<i8").tobytes(), self.nulls.astype(np.uint8).tobytes(), self.data.tobytes())

    def key(self) -> bytes:
        """A digest of all that the chunk holds."""
        state = hashlib.blake2b(digest_size=16)
        for part in self._parts():
            state.update(part)
        return state.digest()

    def pack(self) -> bytes:
        return compress(b"".join(self._parts()))

    @staticmethod
    def unpack(blob: bytes) -> Docs:
        raw = expand(blob)
        n = int.from_bytes(raw[:8], "little")
        at = 8 + 8 * n
        offs = np.frombuffer(raw, "<i8", n + 1, at)
        at += 8 * (n + 1)
        return Docs(np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, np.uint8, n, at).astype(bool), np.frombuffer(raw, np.uint8, offset=at + n), offs)


def documents(batches, size: int = CHUNK_BYTES) -> Iterator[Docs]:
    """Chunks of the rows (doc_id, text) of Arrow batches; a longer text stands alone."""
    for batch in batches:
        texts = string_column(batch, "text")
        ids, nulls = long_column(batch, "doc_id")
        n = len(texts)
        if not n:
            continue
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1))
            yield Docs(ids[at:end], nulls[at:end], data[offs[at] : offs[end]], offs[at : end + 1] - offs[at])
            at = end
    give_back()


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def packed(docs: DataFrame, lay: Layout) -> DataFrame:
    """One row a chunk: (bucket -1, chunk, kind 0, the documents)."""

    def run(batches):
        for d in documents(batches, lay.chunk_bytes):
            yield from rows([(-1, d.key(), 0, d.pack())]).to_batches()

    return plain(docs).mapInArrow(run, DDL)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys; buckets are equal ranges of the hash space."""
    return np.searchsorted(((keys >> U(32)) * U(buckets)) >> U(32), np.arange(buckets + 1, dtype=U))


def questions(kind: int, chunk: bytes, lay: Layout, keys: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes, int, bytes]]:
    """A row for each bucket that has some of the sorted ``keys``, with what belongs to them."""
    cut = bucket_cuts(keys, lay.buckets).tolist()
    out = []
    for b in range(lay.buckets):
        lo, hi = cut[b], cut[b + 1]
        if lo < hi:
            out.append((b, chunk, kind, pack(np.diff(keys[lo:hi], prepend=U(0)), *(c[lo:hi] for c in columns))))
    return out


def asked(blob: bytes) -> list[np.ndarray]:
    """Keys and columns of a question."""
    steps, *columns = unpack(blob)
    return [np.cumsum(steps, dtype=U), *columns]


def answers(got: dict, kind: int, lay: Layout, keys: np.ndarray, *dtypes) -> list[np.ndarray]:
    """What the buckets answered about the sorted ``keys`` that the chunk asked about before; zeros where they were silent."""
    cut = bucket_cuts(keys, lay.buckets).tolist()
    out = [np.zeros(len(keys), t) for t in dtypes]
    for b in range(lay.buckets):
        if cut[b] < cut[b + 1] and (blob := got.get((kind, b))) is not None:
            for whole, part in zip(out, unpack(blob), strict=True):
                whole[cut[b] : cut[b + 1]] = part
    return out


def _answered(held: list[tuple[bytes, bytes]], answer: Callable[..., tuple[np.ndarray, ...]]) -> Iterator[tuple[bytes, bytes]]:
    """Answers a bucket's questions in ranges of their keys and gives each chunk its part, unless all of it is zero."""
    parts = [asked(blob) for _, blob in held]
    total = sum(len(p[0]) for p in parts)
    low = min(int(p[0][0]) for p in parts)
    high = max(int(p[0][-1]) for p in parts) + 1
    ranges = -(-total // RANGE_ENTRIES)
    made: list[list[tuple[np.ndarray, ...]]] = [[] for _ in held]
    at = [0] * len(parts)
    for r in range(1, ranges + 1):
        end = low + (high - low) * r // ranges
        upto = [len(p[0]) if r == ranges else int(np.searchsorted(p[0], U(end))) for p in parts]
        slices = [[c[a:b] for c in p] for p, a, b in zip(parts, at, upto, strict=True)]
        found = answer(*(np.concatenate(c) for c in zip(*slices, strict=True)))
        cuts = np.cumsum([0, *(b - a for a, b in zip(at, upto, strict=True))]).tolist()
        for k, own in enumerate(made):
            own.append(tuple(c[cuts[k] : cuts[k + 1]] for c in found))
        at = upto
    for (chunk, _), own in zip(held, made, strict=True):
        columns = [np.concatenate(c) for c in zip(*own, strict=True)]
        if any(c.any() for c in columns):
            yield chunk, pack(*columns)


def by_bucket(df: DataFrame, lay: Layout, answer: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """``answer(keys, columns...)`` for the questions in each bucket; gives rows of the same kind back to the chunks.

    ``answer`` gets each key once for each chunk that asks about it, in any order, and gives arrays of the same length.
    """

    def run(batches):
        at, kind, held = None, 0, []
        for batch in batches:
            for b, chunk, k, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != at:
                    if held:
                        yield from rows([(at, c, kind, x) for c, x in _answered(held, answer)]).to_batches()
                    at, kind, held = b, k, []
                held.append((chunk, blob))
        if held:
            yield from rows([(at, c, kind, x) for c, x in _answered(held, answer)]).to_batches()
        held = None
        give_back()

    return df.repartitionById(lay.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, DDL)


def at_chunk(chunks: DataFrame, replies: DataFrame, lay: Layout, step, ddl: str = DDL) -> DataFrame:
    """``step(documents, {(kind, bucket): blob}, chunk)`` for each packed chunk, with what the buckets answered it.

    Both sides are dealt to as many parts as there are buckets, so a part grows no more than a bucket does.
    """

    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        got = {(k, b): x for b, k, x in zip(right.column("bucket").to_pylist(), right.column("kind").to_pylist(), right.column("blob").to_pylist(), strict=True)}
        # Chunks of one name hold the same documents, so one answer to each question serves them all.
        made = [step(Docs.unpack(blob), got, key) for key, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist(), strict=True)]
        return pa.concat_tables(made) if made else step(Docs(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(1, np.int64)), got, b"")

    left, right = (x.repartition(lay.buckets, "chunk").groupBy("chunk") for x in (chunks, replies))
    return left.cogroup(right).applyInArrow(run, ddl)
