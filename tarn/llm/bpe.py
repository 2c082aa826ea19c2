"""Byte-level BPE over a global table of distinct words, and its inverse.

Two passes over the texts split them into pre-tokens, chunk by chunk.  The first sends the distinct words of each
chunk, packed and dealt by word hash, to the tasks that hold the global word table: there each distinct word is
encoded once and every chunk gets the ids of its words back.  The second sends each chunk's sequence of word numbers
(the positions) to where those ids arrive, and the tokens are put together by position.  A word that fills a third of
all texts still is one entry a chunk.  Words are equal when their bytes are; chunks are named by a digest of all that
they hold (see `chunks`).  Decoding looks ids up in the token-byte table.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.chunks import DDL, Docs, Layout, documents, layout, plain, rows
from tarn.llm.common import hash_spans

#: The pre-token pattern that `token_heads` implements (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of the lowest rank, leftmost first, until none merges."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 200:
        return _encode_long(word, ranks)
    rank, never = ranks.get, 1 << 30
    cut = list(range(len(word) + 1))
    pair = [rank(word[i : i + 2], never) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == never:
            break
        i = pair.index(low)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = rank(word[cut[i] : cut[i + 2]], never)
        if i:
            pair[i - 1] = rank(word[cut[i - 1] : cut[i + 1]], never)
    return [ranks[word[x:y]] for x, y in zip(cut, cut[1:], strict=False)]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges from a heap, for words whose pairs are too many to look through each time."""
    n = len(word)
    parts: list[bytes] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) != a or len(parts[j]) != b:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, len(parts[x]), len(parts[y])))
    return [ranks[p] for p in parts if p]


def char_classes() -> np.ndarray:
    """Class of each code point, asked of the library whose results count; regex engines differ in Unicode version."""
    import tiktoken  # for the driver alone, workers get the classes

    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, codes))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        one = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(one.encode_ordinary(every)).decode("utf-8").encode("utf-32-le"), np.uint32)] = kind
    return out


def token_heads(code: np.ndarray, kind: np.ndarray, doc_head: np.ndarray) -> np.ndarray:
    """Whether a pre-token of PATTERN begins at each character; ``doc_head`` marks first characters of documents."""
    n = len(code)
    head = doc_head.copy()
    head[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(head)
    ends = np.append(runs[1:], n)
    follows = np.append(~doc_head[runs[1:]], False) if len(runs) else np.zeros(0, bool)  # a run of the same document
    blank = kind[runs] == BLANK
    # The last of the blanks before something else stands alone, or leads what follows if it is a space.
    last = ends[blank & follows] - 1
    head[last] = True
    led = last[code[last] == 32] + 1
    head[led] = False
    # An apostrophe that begins a token may be a contraction; what is left of the letters begins another token.
    single = runs[(ends - runs == 1) & (code[runs] == 39) & follows]
    single = single[head[single]]
    if len(single):
        pad = np.append(code, [0, 0])
        inner = np.append(doc_head, [True, True])
        a, b = pad[single + 1], np.where(inner[single + 2], 0, pad[single + 2])
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for where, size in ((single[one], 2), (single[two], 3)):
            head[where + 1] = False
            rest = where + size
            head[rest[rest < n]] = True
    return head


def split(text: str, kinds: np.ndarray) -> list[str]:
    """Pre-tokens of one text."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(code):
        return []
    first = np.zeros(len(code), bool)
    first[0] = True
    at = np.flatnonzero(token_heads(code, kinds[code], first)).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


#: Bytes of text that are split at a time (a longer text is split alone), and words that are compared at a time.
SPLIT_BYTES, COMPARED = 1 << 18, 1 << 16


def _heads_of(data: np.ndarray, docs_at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where in the UTF-8 bytes ``data`` pre-tokens begin; documents begin at ``docs_at``."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero(data & 0xC0 != 0x80)
    first = np.zeros(len(code) + 1, bool)
    first[np.searchsorted(lead, docs_at)] = True
    return lead[token_heads(code, kinds[code], first[:-1])]


def _valid(docs: Docs) -> Docs:
    """The documents, with bytes that are no UTF-8 replaced."""
    try:
        docs.data.tobytes().decode("utf-8")
        return docs
    except UnicodeDecodeError:
        raw = [docs.raw(k).decode("utf-8", "replace").encode("utf-8") for k in range(len(docs))]
        return Docs(docs.ids, docs.nulls, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))


class Chunk:
    """Distinct words of some documents, the sequence of their numbers, and how many tokens each document has.

    Documents are split some at a time, so that what is held for every character is held for SPLIT_BYTES of them.
    """

    def __init__(self, docs: Docs, kinds: np.ndarray):
        docs = _valid(docs)
        data, offs = docs.data, docs.offs
        parts, at = [np.zeros(0, np.int64)], 0
        while at < len(docs):
            end = min(len(docs), max(at + 1, int(np.searchsorted(offs, offs[at] + SPLIT_BYTES, "right")) - 1))
            lo, hi = int(offs[at]), int(offs[end])
            if lo < hi:
                parts.append(_heads_of(data[lo:hi], offs[at:end] - lo, kinds) + lo)
            at = end
        begin = np.concatenate(parts)
        end = np.append(begin[1:], len(data))[: len(begin)]
        self.counts = np.diff(np.searchsorted(begin, offs))
        found = pa.array(hash_spans(data, begin, end)[0]).dictionary_encode()
        seq = found.indices.to_numpy()
        where = np.empty(len(found.dictionary), np.int64)
        where[seq[::-1]] = np.arange(len(seq) - 1, -1, -1)
        raw = data.tobytes()
        if not _same(data, begin, end, where[seq]):
            _, where, seq = np.unique(np.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], object), return_index=True, return_inverse=True)
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(seq, minlength=len(where)), kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        self.sequence = number[seq]
        self.words: list[bytes] = [raw[a:b] for a, b in zip(begin[where[order]].tolist(), end[where[order]].tolist(), strict=True)]


def _same(data: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether every word has the bytes of the word whose number ``other`` gives for it."""
    size = end - begin
    if (size[other] != size).any():
        return False
    for a in range(0, len(begin), COMPARED):
        n = size[a : a + COMPARED]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(begin[other[a : a + COMPARED]], n) + steps] != data[np.repeat(begin[a : a + COMPARED], n) + steps]).any():
            return False
    return True


def _pack(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed."""
    v = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    planes = 4 if len(v) and v[:, 3].any() else 3 if len(v) and v[:, 2].any() else 2
    return bytes([planes]) + zlib.compress(np.ascontiguousarray(v[:, :planes].T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = blob[0]
    raw = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 4), np.uint8)
    out[:, :planes] = raw.T
    return out.reshape(-1).view("<u4").astype(np.int64)


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], "<u4").tobytes()
    return len(words).to_bytes(4, "little") + zlib.compress(sizes + b"".join(words), 1)


def _unpack_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    raw = zlib.decompress(blob[4:])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64) + 4 * n
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _chunks(batches, size: int, kinds) -> Iterator[tuple[bytes, Docs, Chunk]]:
    """(name, documents, chunk) for runs of rows of about ``size`` bytes."""
    for d in documents(batches, size):
        yield d.key(), d, Chunk(d, kinds)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], np.int64)


def _words_out(kinds, lay: Layout):
    """A chunk's distinct words by bucket, in the order of their numbers."""

    def run(batches):
        for key, _, chunk in _chunks(batches, lay.chunk_bytes, kinds.value):
            by = _hashes(chunk.words) % lay.buckets
            order = np.argsort(by, kind="stable")
            cut = np.searchsorted(by[order], np.arange(lay.buckets + 1))
            out = [(b, key, 0, _pack_words([chunk.words[i] for i in order[cut[b] : cut[b + 1]].tolist()])) for b in np.flatnonzero(np.diff(cut)).tolist()]
            if out:
                yield from rows(out).to_batches()

    return run


def _positions_out(kinds, lay: Layout):
    """A chunk's sequence of word numbers and its documents."""

    def run(batches):
        for key, d, chunk in _chunks(batches, lay.chunk_bytes, kinds.value):
            head = zlib.compress(d.ids.astype("<i8").tobytes() + d.nulls.astype(np.uint8).tobytes() + chunk.counts.astype("<i8").tobytes(), 1)
            words = _pack(_hashes(chunk.words) % lay.buckets)
            body = len(d).to_bytes(4, "little") + len(head).to_bytes(4, "little") + len(words).to_bytes(4, "little") + head + words + _pack(chunk.sequence)
            yield from rows([(-1, key, 1, body)]).to_batches()

    return run


def _encode_words(ranks):
    """Each distinct word that this task holds is encoded once; every chunk gets the ids of its words."""

    def run(batches):
        known: dict[bytes, list[int]] = {}
        table = ranks.value
        for batch in batches:
            out = []
            for b, key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                flat: list[int] = []
                counts = []
                for w in _unpack_words(blob):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode_word(w, table)
                    flat += got
                    counts.append(len(got))
                packed = _pack(np.array(counts))
                out.append((b, key, 0, len(packed).to_bytes(4, "little") + packed + _pack(np.array(flat))))
            yield from rows(out).to_batches()

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _assemble(blob: bytes, parts: dict[int, bytes]) -> pa.Table:
    """Tokens of a chunk's documents: its positions filled with the ids of its words, which came by bucket."""
    n, head, size = (int.from_bytes(blob[i : i + 4], "little") for i in (0, 4, 8))
    raw = zlib.decompress(blob[12 : 12 + head])
    ids, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
    counts = np.frombuffer(raw, "<i8", n, 9 * n)
    by, seq = _unpack(blob[12 + head : 12 + head + size]), _unpack(blob[12 + head + size :])
    words = len(by)
    each_word, begin = np.zeros(words, np.int64), np.zeros(words, np.int64)
    flat, total = [], 0
    for bucket in np.unique(by).tolist():
        if bucket not in parts:
            raise RuntimeError("the documents changed between the two passes; write them to a table first")
        got = parts[bucket]
        m = int.from_bytes(got[:4], "little")
        each, mine = _unpack(got[4 : 4 + m]), np.flatnonzero(by == bucket)
        each_word[mine] = each
        begin[mine] = total + np.cumsum(each) - each
        flat.append(_unpack(got[4 + m :]))
        total += len(flat[-1])
    table = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    each = each_word[seq]
    upto = np.concatenate(([0], np.cumsum(each)))
    tokens = table[np.repeat(begin[seq] - upto[:-1], each) + np.arange(upto[-1])].astype(np.int32)
    ends = upto[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
    return pa.table([pa.array(ids, mask=nulls), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))], schema=_OUT)


def _together(_key, table):
    """All rows of a chunk: the ids of its words by bucket, and its positions (more than once if it comes more than once)."""
    found = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True))
    parts = {b: blob for b, kind, blob in found if kind == 0}
    return pa.concat_tables([_assemble(blob, parts) for _, kind, blob in found if kind == 1])


def bpe_encode(docs: DataFrame, ranks_path: str, *, pattern: str = PATTERN, buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, ids (array of int), as the vocabulary at ``ranks_path`` encodes its whole text.

    Every match of the pattern is encoded separately; there are no special tokens.  ``buckets`` is the number of parts
    of the global word table (as the size of all texts asks for unless given): each holds its distinct words and their
    ids, and nothing that grows with how often words occur.

    Null and empty texts give an empty array.  Null and repeated doc_ids pass through, one row each, and so do repeated
    rows.  A text of any length is one row and one chunk at least.  Other columns are ignored, whatever their names; an
    empty table gives no rows.  The input is read twice and must give the same rows in the same order, as files do; if
    it does not, the query fails rather than mix them up.
    """
    if pattern != PATTERN:
        raise ValueError("only the fixed pre-token pattern is supported")
    spark = docs.sparkSession
    texts = plain(docs)
    lay = layout(texts)
    lay = Layout(2 * lay.chunk_bytes, buckets or lay.buckets)
    kinds = spark.sparkContext.broadcast(char_classes())
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    words = texts.mapInArrow(_words_out(kinds, lay), DDL).repartitionById(lay.buckets, "bucket")
    ids = words.mapInArrow(_encode_words(ranks), DDL)
    both = ids.unionByName(texts.mapInArrow(_positions_out(kinds, lay), DDL))
    return both.repartition(lay.buckets, "chunk").groupBy("chunk").applyInArrow(_together, "doc_id long, ids array<int>")


def _decoder(table):
    def run(batches):
        words = table.value
        size = np.zeros(max(words, default=-1) + 1, np.int64)
        for i, w in words.items():
            size[i] = len(w)
        begin = np.cumsum(size) - size
        every = np.frombuffer(b"".join(words.get(i, b"") for i in range(len(size))), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(part.schema.get_field_index("ids"))
                ids = col.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and not (0 <= ids.min() and ids.max() < len(size) and size[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                each = size[ids]
                upto = np.concatenate(([0], np.cumsum(each)))
                raw = every[np.repeat(begin[ids] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
                ends = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
                cut = upto[np.concatenate(([0], ends))].tolist()
                made = [raw[a:b] if ok else None for a, b, ok in zip(cut, cut[1:], col.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "decoded"])

    return run


def bpe_decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the column decoded: the bytes of the ids, from the token-byte table.

    The table is as large as the vocabulary file, so each worker holds it whole.  An id outside of it is an error.
    Null ids give null, no ids no bytes.
    """
    table = {i: b for b, i in load_ranks(ranks_path).items()}
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(tokens.sparkSession.sparkContext.broadcast(table)), "doc_id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The columns of the contract."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
