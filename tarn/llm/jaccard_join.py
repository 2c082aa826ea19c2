"""N-gram Jaccard join: shingles hashed into groups, group counts in an R-tree, surviving pairs verified.

Which pairs could link at all is settled first, exactly: with shingles in one order for all documents, the rarest
first, two sets of similarity s share one of the first (1 - s) n + 1 shingles of each.  Shingles that only one set has
are no use there, so most documents send nothing.  Sets that share such a shingle, directly or through others, form
candidate groups; inside each, points of group counts stand in an R-tree, whose nodes bound the overlap by summed
coordinate minima (`CountTree`), and pairs that survive are verified on the shingles.

Candidate groups of more than `block` shingles are cut: first into bands of set size, so narrow that only sets of one
band or of neighbouring bands can link, then each band into blocks; every pair of blocks that can link is a task of its
own, and every pair of sets is judged exactly once.

The order comes from counts over the whole corpus, by buckets of the hash space that see each shingle once a chunk (see
`chunks`).  They are counts of 40-bit hashes: a collision moves a shingle in the order, for all documents alike, and
changes no result.  Sets of equal content are one node from the start, whatever number of documents has them, and send
their text once.  Sets are told apart by 128 bits, the shingles of a pair by 64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.chunks import DDL, Docs, Layout, answers, asked, at_chunk, by_bucket, documents, layout, pack, packed, plain, questions, rows, unpack
from tarn.llm.common import U, Words, checkpointed, mix
from tarn.llm.components import components

DIMS = 64
#: Shingles of a block; a group of fewer than FEW blocks of that size is cut into smaller ones, down to 1 / SMALLER.
BLOCK, FEW, SMALLER = 1 << 20, 8, 32
#: Kinds of packed rows.
COUNTS, SETS, KEYS, TEXTS = 1, 2, 3, 4


class Sets:
    """Distinct shingles of each of some documents, sorted: ``flat`` with bounds ``at``; sizes and set ids of two halves."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, shingle: int):
        words = Words(data, offs, fold=True)
        grams, first = words.grams(shingle), words.first.tolist()
        found = []
        for d in range(len(offs) - 1):
            n = first[d + 1] - first[d]
            if n >= shingle:
                found.append(np.unique(grams[first[d] : first[d + 1] - shingle + 1]))
            elif n:
                acc = U(n)
                for h in words.hash[first[d] : first[d + 1]]:
                    acc = mix(np.array([acc], U) * U(0x9E3779B97F4A7C15) + h)[0]
                found.append(np.array([acc], U))
            else:
                found.append(np.zeros(0, U))
        self.flat = np.concatenate(found) if found else np.zeros(0, U)
        self.size = np.array([len(x) for x in found], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        halves = []
        for salt in (U(1), U(0x6A09E667F3BCC909)):
            sums = np.concatenate(([U(0)], np.cumsum(mix(self.flat ^ mix(np.array([salt]))), dtype=U)))
            halves.append(mix(sums[self.at[1:]] - sums[self.at[:-1]] + self.size.astype(U)))
        self.high, self.low = halves

    def names(self, chosen: np.ndarray) -> list[bytes]:
        """Set ids as they go between tasks."""
        raw = np.stack((self.high[chosen], self.low[chosen]), axis=1).astype(">u8").tobytes()
        return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def _order_keys(shingles: np.ndarray) -> np.ndarray:
    """What shingles are counted by: 40 bits of a hash, at the upper end of the word."""
    return mix(shingles + U(0x51ED270B)) & ~U(0xFFFFFF)


def _distinct(s: Sets) -> np.ndarray:
    """One document of each set that is not empty."""
    order = np.lexsort((s.low, s.high))
    order = order[s.size[order] > 0]
    head = np.ones(len(order), bool)
    head[1:] = (s.high[order][1:] != s.high[order][:-1]) | (s.low[order][1:] != s.low[order][:-1])
    return order[head]


def _members(s: Sets, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of the chosen sets, number of the set among them)."""
    size = s.size[chosen]
    pick = np.repeat(s.at[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return s.flat[pick], np.repeat(np.arange(len(chosen)), size)


def _count_out(shingle: int, lay: Layout):
    """A chunk's distinct shingle keys, with how many of its sets have each (255: or more)."""

    def run(batches):
        for d in documents(batches, lay.chunk_bytes):
            s = Sets(d.data, d.offs, shingle)
            keys, counts = np.unique(_order_keys(_members(s, _distinct(s))[0]), return_counts=True)
            out = questions(COUNTS, d.key(), lay, keys, np.minimum(counts, 255).astype(np.uint8))
            if out:
                yield from rows(out).to_batches()

    return run


def _answer_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray]:
    """The magnitude of each key's count: 0 for one set, then the binary logarithm rounded up."""
    order = np.argsort(keys, kind="stable")
    head = np.ones(len(keys), bool)
    head[1:] = keys[order][1:] != keys[order][:-1]
    total = np.add.reduceat(counts.astype(np.int64)[order], np.flatnonzero(head)) if len(keys) else np.zeros(0)
    size = np.empty(len(keys), np.uint8)
    size[order] = np.ceil(np.log2(total)).astype(np.uint8)[np.cumsum(head) - 1]
    return (size,)


def routes(s: Sets, chosen: np.ndarray, magnitude, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number among the chosen sets): the shingles by which the chosen sets meet those that they can link with.

    ``magnitude`` gives, for shingles, 0 where only one set has them and more for more common ones.
    """
    flat, owner = _members(s, chosen)
    size = s.size[chosen]
    level = magnitude(flat)
    order = np.lexsort((flat, level, owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    first = size - -(-size * num // den) + 1
    take = order[(place < first[owner]) & (level[order] > 0)]
    return flat[take], owner[take]


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First id of each key, and the distinct links (first, other) with a key of each."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    first = ids[head][np.cumsum(head) - 1]
    other = ~head & (first != ids)
    k, a, b = keys[other], first[other], ids[other]
    order = np.lexsort((b, a))
    k, a, b = k[order], a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return keys[head], ids[head], k[new], a[new], b[new]


def _prepare(shingle: int, num: int, den: int, lay: Layout):
    """For each chunk: its documents' sets, keys by bucket (each once a chunk, and more ids only for links that it has not
    shown yet), and the texts of sets that have keys."""

    def step(d: Docs, got: dict, key: bytes) -> pa.Table:
        s = Sets(d.data, d.offs, shingle)
        chosen = _distinct(s)

        def magnitude(flat: np.ndarray) -> np.ndarray:
            own = _order_keys(flat)
            keys = np.unique(own)
            return answers(got, COUNTS, lay, keys, np.uint8)[0][np.searchsorted(keys, own)]

        keys, owner = routes(s, chosen, magnitude, num, den)
        k, i, k2, _, other = _stars(keys, owner)
        k, i = np.concatenate((k, k2)), chosen[np.concatenate((i, other))]
        order = np.argsort(k, kind="stable")
        k, i = k[order], i[order]
        out = [(-1, key, SETS, pack(d.ids.astype("<i8"), d.nulls.astype(np.uint8), s.size, s.high, s.low))]
        out += questions(KEYS, key, lay, k, s.high[i], s.low[i])
        sent = chosen[np.unique(owner)]
        if len(sent):
            raw = [d.raw(x) for x in sent.tolist()]
            offs = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
            texts = Docs(np.zeros(len(sent), np.int64), np.zeros(len(sent), bool), np.frombuffer(b"".join(raw), np.uint8), offs)
            out.append((-1, key, TEXTS, b"".join((len(sent).to_bytes(8, "little"), *s.names(sent), texts.pack()))))
        return rows(out)

    return step


def _described(batches):
    """Each document's id, size and set, and the chunk that it is in."""
    for batch in batches:
        for chunk, blob in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            ids, nulls, size, high, low = unpack(blob)
            raw = np.stack((high, low), axis=1).astype(">u8").tobytes()
            sid = [raw[16 * k : 16 * k + 16] if n else None for k, n in enumerate(size.tolist())]
            home = int.from_bytes(chunk[:8], "little", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls.astype(bool)), pa.array(size), pa.array(sid, pa.binary()), pa.array(np.full(len(ids), home))], names=["doc_id", "n", "sid", "home"])


def _texts(batches):
    for batch in batches:
        for chunk, blob in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n = int.from_bytes(blob[:8], "little")
            d = Docs.unpack(blob[8 + 16 * n :])
            home = int.from_bytes(chunk[:8], "little", signed=True)
            for a in range(0, n, 1000):
                part = range(a, min(n, a + 1000))
                yield pa.RecordBatch.from_arrays([pa.array([blob[8 + 16 * k : 24 + 16 * k] for k in part], pa.binary()), pa.array([home] * len(part), pa.int64()), pa.array([d.raw(k).decode("utf-8", "replace") for k in part], pa.string())], names=["sid", "home", "text"])


def _meet(batches):
    """Links between the sets that share a key of the bucket."""

    def links(held):
        keys, high, low = (np.concatenate(c) for c in zip(*map(asked, held), strict=True))
        # The bucket's own numbers for sets, in the order of their ids.
        order = np.lexsort((low, high))
        head = np.ones(len(order), bool)
        head[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(head) - 1
        raw = np.stack((high[order[head]], low[order[head]]), axis=1).astype(">u8").tobytes()
        _, _, _, a, b = _stars(keys, number)
        return pa.RecordBatch.from_arrays([pa.array([raw[16 * k : 16 * k + 16] for k in x.tolist()], pa.binary()) for x in (a, b)], names=["a", "b"])

    at, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if b != at:
                if held:
                    yield links(held)
                at, held = b, []
            held.append(blob)
    if held:
        yield links(held)


class CountTree:
    """R-tree over points of group counts; a query gives the points whose overlap bound reaches what a link needs."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Leaves hold neighbours: sorted by size, then by the groups that vary most.
        vary = np.argsort(-points.var(axis=0))[:4] if len(points) else []
        bins = np.minimum(np.log(np.maximum(sizes, 1)) * 8, 1000).astype(np.int64)
        self.order = np.lexsort((*(points[:, v] for v in vary), bins))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.nodes = []  # from the leaves up: (upper corners, smallest sizes, bounds of children)
        upper, low = self.points, self.sizes
        while len(upper) > self.FAN:
            at = np.arange(0, len(upper), self.FAN)
            upper, low = np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at)
            self.nodes.append((upper, low))

    def near(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Numbers of points whose sum of coordinate minima is at least what a set of their size needs."""

        def reach(upper: np.ndarray, low: np.ndarray) -> np.ndarray:
            fits = (low * num <= size * den) & (np.minimum(upper, point).sum(axis=1) * (num + den) >= num * (low + size))
            return np.flatnonzero(fits)

        alive = np.arange(len(self.nodes[-1][0]) if self.nodes else len(self.points))
        below = [len(self.points), *(len(u) for u, _ in self.nodes)]
        for k in range(len(self.nodes) - 1, -1, -1):
            upper, low = self.nodes[k]
            alive = alive[reach(upper[alive], low[alive])]
            alive = (alive[:, None] * self.FAN + np.arange(self.FAN)).ravel()
            alive = alive[alive < below[k]]
        alive = alive[reach(self.points[alive], self.sizes[alive])]
        alive = alive[self.sizes[alive] * den >= size * num]
        return self.order[alive]


def overlaps(flat: np.ndarray, at: np.ndarray, mark: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many marked members each of the chosen sets has; no set is empty."""
    size = at[which + 1] - at[which]
    begin = np.cumsum(size) - size
    pick = np.repeat(at[which] - begin, size) + np.arange(size.sum())
    return np.add.reduceat(mark[flat[pick]].astype(np.int64), begin) if len(which) else np.zeros(0, np.int64)


def join_block(texts: list[str], ids: list[int], copies: list[int], sides: list[int], across: bool, shingle: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(id, smallest id that it is linked with through this block, documents linked with it directly) for linked sets.

    Of a pair of different blocks (``across``) only pairs of different sides are judged.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    s = Sets(np.frombuffer(b"".join(raw), np.uint8), offs, shingle)
    side = np.array(sides, np.int64)
    weight = np.array(copies, np.int64)
    n = len(ids)
    if n < 2:
        return []
    group = (mix(s.flat + U(7)) >> U(58)).astype(np.int64)
    points = np.bincount(np.repeat(np.arange(n), s.size) * DIMS + group, minlength=n * DIMS).reshape(n, DIMS)
    tree = CountTree(points, s.size)
    _, local = np.unique(s.flat, return_inverse=True)
    mark = np.zeros(int(local.max()) + 1, bool)
    root, links = list(range(n)), np.zeros(n, np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        near = tree.near(points[i], int(s.size[i]), num, den)
        near = near[near > i]
        if across:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        own = local[s.at[i] : s.at[i + 1]]
        mark[own] = True
        common = overlaps(local, s.at, mark, near)
        mark[own] = False
        hit = near[common * den >= num * (s.size[near] + s.size[i] - common)]
        if len(hit):
            links[i] += weight[hit].sum()
            links[hit] += weight[i]
            for j in hit.tolist():
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
    low: dict[int, int] = {}
    linked = np.flatnonzero(links).tolist()
    for i in linked:
        r = find(i)
        low[r] = min(low.get(r, ids[i]), ids[i])
    return [(ids[i], low[find(i)], int(links[i])) for i in linked]


def _verify(shingle: int, num: int, den: int):
    """Rows come by candidate group and pair of blocks; each pair is judged when its last row is there."""

    def run(batches):
        at, held = None, {}
        out: list = []

        def done():
            if at is not None and len(held) > 1:
                own = list(held.values())
                out.extend(join_block([x[2] for x in own], list(held), [x[1] for x in own], [x[0] for x in own], at[1:3] != at[3:5], shingle, num, den))

        def made():
            cols = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

        for batch in batches:
            for key in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if key[:5] != at:
                    done()
                    at, held = key[:5], {}
                held[key[5]] = key[6:]
            if out:
                yield made()
        done()
        if out:
            yield made()

    return run


def _blocks(total: Column, block: int) -> Column:
    """Into how many blocks a band of so many shingles is cut: FEW more than its size asks for, while blocks stay worth it."""
    whole = F.ceil(total / F.lit(float(block)))
    return F.greatest(whole, F.least(F.lit(FEW), F.ceil(total / F.lit(float(max(1, block // SMALLER)))))).cast("long")


def dealt(members: DataFrame, similarity: tuple[int, int], block: int) -> DataFrame:
    """``members`` (root, node, n, ...) once for each pair of blocks (x, i), (y, j) that they are judged in, and their side.

    A group of at most ``block`` / SMALLER shingles is one block.  Larger ones are cut into bands of size: sets that
    link differ in size by 1 / similarity at most, which is less than a band is wide, so their bands are the same or
    neighbours.
    """
    width = math.log(similarity[1] / similarity[0]) + 1e-3
    groups = members.groupBy("root").agg(F.sum("n").alias("total"))
    small = F.col("total") <= max(1, block // SMALLER)
    banded = members.join(groups, "root").withColumn("band", F.when(small, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / F.lit(width))).cast("long"))
    bands = banded.groupBy("root", "band").agg(_blocks(F.sum("n"), block).alias("blocks"), F.max(F.when(small, 1).otherwise(0)).alias("small"))
    bands = bands.withColumn("blocks", F.when(F.col("small") == 1, F.lit(1).cast("long")).otherwise(F.col("blocks"))).drop("small")
    # Each band with the number of blocks of those below and above it, worked out by sums, not by a window over a group.
    near = bands.select("root", F.explode(F.array(*(F.struct((F.col("band") + k).alias("band"), F.lit(k).alias("place"), "blocks") for k in (-1, 0, 1)))).alias("x")).select("root", "x.*")
    near = near.groupBy("root", "band").agg(*(F.coalesce(F.max(F.when(F.col("place") == k, F.col("blocks"))), F.lit(0)).alias(name) for k, name in ((1, "under"), (0, "here"), (-1, "over")))).where("here > 0")
    placed = banded.join(near, ["root", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("here")))

    def pairs(count: str, make) -> Column:
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).otherwise(F.array().cast("array<long>")), make)

    def task(x, i, y, j, side):
        return F.struct(x.alias("x"), i.alias("i"), y.alias("y"), j.alias("j"), side.cast("long").alias("side"))

    band, own = F.col("band"), F.col("own")
    same = pairs("here", lambda k: task(band, F.least(own, k), band, F.greatest(own, k), own))
    below = pairs("under", lambda k: task(band - 1, k, band, own, F.lit(1)))
    above = pairs("over", lambda k: task(band, own, band + 1, k, F.lit(0)))
    return placed.withColumn("task", F.explode(F.concat(same, below, above))).select(*members.columns, "task.*")


def jaccard_join(docs: DataFrame, *, shingle: int = 5, similarity: tuple[int, int] = (4, 5), block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Words are [^\x20\x09-\x0D]+ with A-Z lower-cased.  A document's set is its distinct shingles of ``shingle`` words;
    of fewer words, the whole sequence is the one member; without words it is empty and linked with nothing.  Two
    documents link when den * |both| >= num * |either|, for ``similarity`` = (num, den).  component_id is the smallest
    doc_id reachable by links, the document's own included; n_links counts the other documents linked directly.

    ``block`` is the number of shingles that one task holds at most of a side, but for a single document.

    Null text has no words.  A null doc_id never is a component_id unless no id of the component is known.  Repeated
    doc_ids are documents of their own, which share the id.  A text of any length is one set in one task; equal texts
    are one set, however many.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    num, den = similarity
    rows_ = plain(docs)
    lay = layout(rows_)
    counts = by_bucket(rows_.mapInArrow(_count_out(shingle, lay), DDL), lay, _answer_counts)
    prepared = checkpointed(at_chunk(packed(docs, lay), counts, lay, _prepare(shingle, num, den, lay)))
    each = prepared.where(F.col("kind") == SETS).mapInArrow(_described, "doc_id long, n long, sid binary, home long")
    sets = each.where("sid is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.max("n").alias("n"), F.min("home").alias("home"))
    keys = prepared.where(F.col("kind") == KEYS)
    met = checkpointed(keys.repartitionById(lay.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a binary, b binary"))
    # Sets that share a key get numbers, which are written so that a lost executor does not change them.
    ends = met.select(F.col("a").alias("sid")).unionByName(met.select(F.col("b").alias("sid"))).distinct()
    nodes = checkpointed(ends.withColumn("node", F.monotonically_increasing_id()))
    edges = met.join(nodes.select(F.col("sid").alias("a"), F.col("node").alias("x")), "a").join(nodes.select(F.col("sid").alias("b"), F.col("node").alias("y")), "b")
    near = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    members = checkpointed(nodes.join(near, "node").join(sets, "sid").select("sid", "home", "node", "root", "copies", "n"))
    # A set's text comes from one of the chunks that have it.
    texts = prepared.where(F.col("kind") == TEXTS).mapInArrow(_texts, "sid binary, home long, text string")
    full = dealt(members, similarity, block).join(texts, ["sid", "home"]).select("root", "x", "i", "y", "j", "node", "side", "copies", "text")
    tasks = full.repartition("root", "x", "i", "y", "j").sortWithinPartitions("root", "x", "i", "y", "j", "node")
    judged = checkpointed(tasks.mapInArrow(_verify(shingle, num, den), "a long, b long, links long"))
    roots = components(judged.select("a", "b"))
    links = judged.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = nodes.join(roots, "node").join(links, "node").select("sid", F.col("root").alias("root"), "links")
    known = sets.join(linked, "sid", "left")
    lows = known.where("root is not null").groupBy("root").agg(F.min("low").alias("lowest"))
    known = known.join(lows, "root", "left").select("sid", F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return each.join(known, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
