"""The text operators against brute force, on small tables with nulls, ties, repeated rows, long texts and odd columns."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import public_tokenizers
import tiktoken
from tarn.llm import bpe, chunks, components, decontaminate, exact_dedup, jaccard_join, language, licenses, line_dedup, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, norm string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows, lang="en", source="s"):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, "y") for i, t in rows], DOCS)


def corpus(seed: int, n: int = 120, vocabulary: int = 40):
    """Texts from few words, with copies, near copies, shared passages, empty and null ones."""
    rng = random.Random(seed)
    words = [f"w{k}" if k % 5 else f"É{k}" for k in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(20)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.05:
            text = rng.choice(["", None, "   \n\t", "one", "Two words", "a b c"])
        elif kind < 0.3 and rows:
            text = rng.choice(rows)[1]
            if text and rng.random() < 0.7:
                w = text.split(" ")
                w[rng.randrange(len(w))] = rng.choice(words)
                text = " ".join(w)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([3, 8, 14, 30, 60]))]
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage[rng.randrange(5) :]
            text = rng.choice([" ", "\n", "  "]).join(w)
        rows.append((i * 3 % 251, text))
    rows.append((7001, " ".join(rng.choice(words) for _ in range(6000))))
    return rows


@pytest.fixture
def small_chunks(monkeypatch):
    """Tiny chunks and buckets, so that small tables are cut into many of both."""
    for name, value in (("CHUNK_BYTES", 600), ("BUCKET_BYTES", 900), ("BUCKET_CHUNKS", 1)):
        monkeypatch.setattr(chunks, name, value)


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# Exact dedup


def brute_exact(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = []
    for i, t in rows:
        key = (t or "").translate(FOLD)
        ids = [x for x in groups[key] if x is not None]
        best = keep(ids) if ids else None
        out.append((i, best, len(groups[key]), i == best, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = [*corpus(1), (900, "Same Text"), (901, "sAME tEXT"), (902, "ÀB"), (903, "àb"), (None, "same text"), (None, None), (905, "dup"), (905, "dup")]
    got = exact_dedup.exact_dedup(table(spark, rows), keep=keep)
    assert sorted(rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256"), key=repr) == brute_exact(rows, min if keep == "smallest" else max)


def test_exact_dedup_is_native_and_empty(spark):
    df = exact_dedup.exact_dedup(table(spark, []))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert exact_dedup.drop_copies(table(spark, [(1, "a"), (2, "A"), (3, "b")])).select("doc_id").orderBy("doc_id").collect() == [(1,), (3,)]


# Decontamination


def brute_hits(docs, items, window=13):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = split.findall((t or "").translate(FOLD))
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = split.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEMS = [(1, " ".join(f"q{k}" for k in range(20))), (2, "short Item"), (10, " ".join(f"q{k}" for k in range(5, 30))), (3, ""), (4, None), (5, "été über 1/2"), (2, "short Item")]
HITTING = [
    (1, "before " + " ".join(f"Q{k}," for k in range(20)) + " after"),
    (2, "a SHORT\titem, and short-item."),
    (3, None),
    (4, ""),
    (5, "x été — ÜBER 1 2 été über 1 2"),
    (None, "short item"),
    (7, " ".join(f"q{k}" for k in range(12))),
    (7, "short item " + "pad " * 200),
    (8, "shortitem short  item"),
]


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_decontaminate(spark, max_bytes):
    docs, bench = table(spark, HITTING), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.decontaminate(docs, bench, max_bytes=max_bytes)
    got = rows_of(decontaminate.digest(found), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    # Ü folds in neither: only A-Z do.
    assert sorted(got, key=repr) == brute_hits(HITTING, ITEMS)
    kept = decontaminate.without_contaminated(docs, bench, max_bytes=max_bytes)
    assert kept.columns == docs.columns
    dirty = [bool(brute_hits([r], ITEMS)[0][5]) for r in HITTING]
    assert sorted(rows_of(kept, "doc_id", "text"), key=repr) == sorted((r for r, bad in zip(HITTING, dirty, strict=True) if not bad), key=repr)
    for r in found.collect():
        text = next(t for i, t in HITTING if i == r.doc_id and len(decontaminate.normalise(t)) == r.n_words)
        assert [text[s.start : s.end] for s in r.spans] == [s.text for s in r.spans]


def test_decontaminate_windows_at_random(spark):
    rng = random.Random(21)
    for window in (1, 2, 5, 13):
        for vocabulary in (2, 4, 30):
            items = [(k, " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 40)))) for k in range(8)]
            items.append((99, items[0][1]))
            own = decontaminate.Items(items, window)
            for _ in range(60):
                text = " ".join(f"v{rng.randrange(vocabulary + 1)}" for _ in range(rng.randrange(30)))
                if rng.random() < 0.8:
                    w = rng.choice(items)[1].split()
                    a = rng.randrange(len(w) + 1)
                    text += " " + " ".join(w[a : a + rng.randrange(25)]) + rng.choice(["", " v0 v1"])
                runs, found = own.scan(decontaminate.normalise(text))
                ((_, _, n_hit, n_items, digest, _),) = brute_hits([(1, text)], items, window)
                assert (sum(b - a for a, b in runs), len(found)) == (n_hit, n_items)
                assert hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest() == digest


def test_decontaminate_holds_little():
    """A benchmark of several MB, in a process of its own: what an automaton of MAX_BYTES may need at most."""
    import subprocess
    import sys

    code = """
import random, resource
from tarn.llm.decontaminate import Items
rng = random.Random(1)
words = ["w%x" % rng.randrange(1 << 40) for _ in range(60000)]
items = [(k, " ".join(rng.choices(words, k=200))) for k in range(1600)]
size = sum(len(t) for _, t in items)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
own = Items(items, 13)
print(size, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""
    size, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert size > 3_000_000 and grown < 40 * size


def test_decontaminate_very_long_text(spark):
    """A text of a million words, with passages at both ends and far inside, beside columns of clashing names."""
    passage = " ".join(f"P{k}" for k in range(20))
    text = passage + " \u00e9" + " filler" * 500_000 + " " + passage.lower() + "!" + " filler" * 500_000 + " " + passage
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (2, "filler " * 30, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_hit string")
    bench = spark.createDataFrame([(7, passage, 0), (8, None, 0), (9, "other words", 0)], "item_id long, text string, doc_id long")
    got = decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got] == [(1, 1_000_061, 60, [7], False)] * 2 + [(2, 30, 0, [], False)]
    for r in got[:2]:
        assert [s.text.lower() for s in r.spans] == [passage.lower()] * 3 and [text[s.start : s.end] for s in r.spans] == [s.text for s in r.spans]


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(table(spark, [(1, "a b")]), none).collect()] == [0]
    assert decontaminate.decontaminate(table(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# N-gram Jaccard join


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_join(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return sorted(((i, len(sets[a]), low.get(find(a)), links[a]) for a, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("seed", "k", "num", "den", "block"), [(1, 4, 85, 100, 1 << 20), (2, 5, 4, 5, 1 << 10), (3, 2, 3, 5, 100), (4, 1, 1, 2, 50)])
def test_jaccard_join(spark, small_chunks, seed, k, num, den, block):
    rows = [*corpus(seed), (None, "w1 w2 w3 w4 w6 w7 w8"), (None, "only null ids share this one text"), (None, "only null ids share this one text"), (3, "w1 w2 w3 w4 w6 w7 w8")]
    got = jaccard_join.jaccard_join(table(spark, rows), shingle=k, similarity=(num, den), block=block)
    assert sorted(rows_of(got, "doc_id", "n_shingles", "component_id", "n_links"), key=repr) == brute_join(rows, k, num, den)


def test_jaccard_join_empty(spark):
    assert jaccard_join.jaccard_join(table(spark, [])).count() == 0
    assert rows_of(jaccard_join.jaccard_join(table(spark, [(5, None), (6, "")])).orderBy("doc_id"), "doc_id", "n_shingles", "component_id", "n_links") == [(5, 0, 5, 0), (6, 0, 6, 0)]


def test_count_tree_gives_all_that_can_link():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.poisson(3, (400, jaccard_join.DIMS))
    points[200:] = np.maximum(points[:200] + rng.integers(-1, 2, (200, jaccard_join.DIMS)) * (rng.random((200, jaccard_join.DIMS)) < 0.1), 0)
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(points, sizes)
    for i in range(0, 400, 7):
        low = np.minimum(points, points[i]).sum(axis=1)
        fits = (low * 180 >= 80 * (sizes + sizes[i])) & (sizes * 100 >= sizes[i] * 80) & (sizes * 80 <= sizes[i] * 100)
        assert set(np.flatnonzero(fits)) == set(tree.near(points[i], int(sizes[i]), 80, 100).tolist())


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000), (None, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(rows_of(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substring dedup


def brute_substring(rows, n=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for at in range(len(w) - n + 1):
            key, rank = tuple(w[at : at + n]), float("inf") if i is None else i
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, w in split:
        gone = set()
        for at in range(len(w) - n + 1):
            if first[tuple(w[at : at + n])] < (float("inf") if i is None else i):
                gone |= set(range(at, at + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "threshold"), [(1, 13), (2, 13), (3, 5), (4, 3)])
def test_substring_dedup(spark, small_chunks, seed, threshold):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [*corpus(seed, vocabulary=6 if threshold == 13 else 30), (None, passage), (None, passage), (400, "A " + passage + " z"), (401, passage + " q " + passage), (401, passage), (399, passage[:50])]
    rows += [(500 + k, " ".join([f"x{rng.randrange(9)}"] * rng.randrange(1, 40))) for k in range(20)]
    got = substring_dedup.digest(substring_dedup.substring_dedup(table(spark, rows), threshold=threshold))
    assert sorted(rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256"), key=repr) == brute_substring(rows, threshold)


def test_substring_dedup_spans(spark):
    w = [f"a{k}" for k in range(40)]
    rows = [(1, " ".join(w[5:25])), (2, " ".join(w))]
    found = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert [(s.first, s.end) for s in found[2].removed] == [(5, 25)] and found[2].kept == " ".join(w[:5] + w[25:])
    assert found[1].removed == []
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_chunks_round_trip(spark):
    rows = corpus(9)
    packed = chunks.packed(table(spark, rows), chunks.Layout(5000, 3)).collect()
    found = [(None if d.nulls[k] else int(d.ids[k]), d.raw(k).decode()) for r in packed for d in [chunks.Docs.unpack(bytes(r.blob))] for k in range(len(d))]
    assert sorted(found) == sorted((i, t or "") for i, t in rows)


def test_answers_come_in_ranges(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    held = [(bytes([k]), np.unique(rng.integers(0, 1 << 64, 50, np.uint64) >> np.uint64(k))) for k in range(5)]
    blobs = [(c, chunks.pack(np.diff(x, prepend=np.uint64(0)), x % np.uint64(7))) for c, x in held]
    whole = {c: chunks.unpack(b) for c, b in chunks._answered(blobs, lambda keys, other: (keys ^ other, keys > 5))}
    monkeypatch.setattr(chunks, "RANGE_ENTRIES", 11)
    parts = {c: chunks.unpack(b) for c, b in chunks._answered(blobs, lambda keys, other: (keys ^ other, keys > 5))}
    for c, x in held:
        assert (whole[c][0] == (x ^ (x % np.uint64(7)))).all() and (parts[c][0] == whole[c][0]).all() and (parts[c][1] == whole[c][1]).all()


# Chunks and words that are easily taken for others


def test_word_hashes_tell_words_apart():
    import numpy as np

    from tarn.llm.common import Words

    made = {thue_morse(n, *p) for n in (8, 64, 65, 1024, 2048, 4096) for p in ("ab", "ba", "xy", "yx")} | {"\0", "\0\0", "a\0", "a", "aa", "é", "ab" * 40, "ba" * 40}
    for text in (" ".join(sorted(made)), "pad " * 3 + "\n".join(sorted(made))):
        data = np.frombuffer(text.encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]), wide=True)
        raw = [data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
        for hashes in (words.hash, words.hash2):
            found = dict(zip(hashes.tolist(), raw, strict=True))
            assert len(found) == len(set(raw)) and all(found[h] == w for h, w in zip(hashes.tolist(), raw, strict=True))
        assert (words.hash != words.hash2).all()


def look_alikes():
    """Revisions of equal size under the same ids, null ids, exchanged texts, and words that cancel out in sums of powers."""
    rows = [(i, f"{'one red fox ran off over the low hill to the old inn by ' * 3}{x}") for x in "ab" for i in range(10)]
    rows += [(1, "one red fox"), (2, "two old men"), (1, "one fat cat"), (2, "two bad men"), (None, "nul one"), (None, "nul two")]
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    lead = " ".join(f"k{k}" for k in range(12))
    return [*rows, (50, x), (51, y), (60, f"{lead} {x}"), (61, f"{lead} {y}"), (70, f"x {x} y z"), (71, f"x {y} y z")]


def two_files(spark, rows, tmp_path):
    """The rows in several files, so that equal ids come from different tasks."""
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:], rows[:10], rows[10:20])):
        table(spark, part).coalesce(1).write.parquet(f"{tmp_path}/t{k}")
    return spark.read.parquet(*(f"{tmp_path}/t{k}" for k in range(4))), [*rows, *rows[:20]]


def test_look_alikes_substring(spark, small_chunks, tmp_path):
    df, rows = two_files(spark, look_alikes(), tmp_path)
    got = rows_of(substring_dedup.digest(substring_dedup.substring_dedup(df)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got, key=repr) == brute_substring(rows)


def test_look_alikes_jaccard(spark, small_chunks, tmp_path):
    df, rows = two_files(spark, look_alikes(), tmp_path)
    got = rows_of(jaccard_join.jaccard_join(df, shingle=4, similarity=(85, 100)), "doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(got, key=repr) == brute_join(rows, 4, 85, 100)


@pytest.mark.parametrize("buckets", [1, None])
def test_look_alikes_bpe(spark, small_chunks, tmp_path, buckets):
    df, rows = two_files(spark, look_alikes(), tmp_path)
    enc = encoding()
    got = rows_of(bpe.bpe_decode(bpe.bpe_encode(df, vocabulary(), buckets=buckets), vocabulary()), "doc_id", "ids", "decoded")
    assert sorted(((i, ids, bytes(b).decode()) for i, ids, b in got), key=repr) == sorted(((i, enc.encode_ordinary(t or ""), t or "") for i, t in rows), key=repr)


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    rows = [(1, long), (2, long + " more"), (3, long[:1_500_000]), (4, "short"), (5, None)]
    assert len(long) > 2 * chunks.CHUNK_BYTES
    got = substring_dedup.digest(substring_dedup.substring_dedup(table(spark, rows)))
    assert sorted(rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256")) == brute_substring(rows)
    got = jaccard_join.jaccard_join(table(spark, rows))
    assert sorted(rows_of(got, "doc_id", "n_shingles", "component_id", "n_links")) == brute_join(rows, 5, 4, 5)
    decoded = rows_of(bpe.bpe_decode(bpe.bpe_encode(table(spark, rows), vocabulary()), vocabulary()), "doc_id", "decoded")
    assert sorted((i, bytes(b).decode()) for i, b in decoded) == sorted((i, t or "") for i, t in rows)


# Byte-level BPE


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary()), special_tokens={})


def vocabulary():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_pre_tokens_and_merges():
    assert bpe.PATTERN == public_tokenizers.PATTERN
    kinds, ranks, enc = bpe.char_classes(), bpe.load_ranks(vocabulary()), encoding()
    rng = random.Random(2)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "É", "ß", "1", "٣", "!", "-", " ", "　", "漢", "😀", "\x1c", "՘", "\r\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [i for w in bpe.split(text, kinds) for i in bpe.encode_word(w.encode(), ranks)] == enc.encode_ordinary(text)
    for n in (199, 200, 201, 5000):
        word = bytes(rng.randrange(97, 123) for _ in range(n))
        assert bpe.encode_word(word, ranks) == bpe._encode_long(word, ranks) == enc.encode_ordinary(word.decode())


@pytest.mark.parametrize("buckets", [1, None])
def test_bpe_round_trip(spark, small_chunks, buckets):
    enc = encoding()
    rows = [*corpus(11), (1, "it's <|endoftext|> ok  \n\n x"), (None, "null id"), (2, None), (3, ""), (3, "again 😀 " * 3000), (4, "x" * 30000)]
    tokens = bpe.bpe_encode(table(spark, rows), vocabulary(), buckets=buckets)
    got = rows_of(bpe.bpe_decode(tokens, vocabulary()), "doc_id", "ids", "decoded")
    assert sorted((i, ids, bytes(b).decode()) for i, ids, b in got if i is not None) == sorted((i, enc.encode_ordinary(t or ""), t or "") for i, t in rows if i is not None)
    assert [ids for i, ids, _ in got if i is None] == [enc.encode_ordinary("null id")]
    digest = {(r.doc_id, r.n_tokens): r for r in bpe.digest(bpe.bpe_decode(tokens, vocabulary())).collect()}
    ids = enc.encode_ordinary(rows[-1][1])
    assert digest[4, len(ids)].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_bpe_edges(spark):
    assert bpe.bpe_encode(table(spark, []), vocabulary()).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert rows_of(bpe.bpe_decode(ids, vocabulary()).orderBy("doc_id"), "decoded") == [(None,), (b"",)]
    with pytest.raises(Exception, match="vocabulary"):
        bpe.bpe_decode(spark.createDataFrame([(1, [999999])], "doc_id long, ids array<int>"), vocabulary()).collect()


# Toxicity


def toxic_corpus():
    rng = random.Random(3)
    plain, insults = [f"word{k}" for k in range(60)], ["blorg", "snarf", "grumlet", "grumlix"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = [rng.choice(plain) for _ in range(rng.choice([5, 40]))]
        for _ in range(1 + len(w) // 20 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus()
    got = toxicity.toxicity(table(spark, [*docs, (5000, None), (5001, ""), (None, "word1")]), spark.createDataFrame([*labels, (None, 1), (5, None), (7, 9)], "doc_id long, toxic int"))
    rows = got.collect()
    assert len(rows) == len(docs) + 3
    truth = dict(labels)
    out = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 100 and sum(a == b for a, b in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    empty = {r.doc_id: r for r in rows if r.doc_id in (5000, 5001)}
    assert empty[5000].score == empty[5001].score < 0.5 and empty[5000].clauses == []


def test_toxicity_ignores_other_columns(spark):
    docs, labels = toxic_corpus()
    shown = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(table(spark, docs), shown)
    a = rows_of(toxicity.toxicity(table(spark, docs, "de", "t"), shown, model=model), "doc_id", "score")
    assert sorted(a) == sorted(rows_of(toxicity.toxicity(table(spark, docs), shown, model=model), "doc_id", "score"))
    assert toxicity.without_toxic(table(spark, docs), shown).count() == sum(1 for i, t in docs if not toxicity.Matcher(model.terms).features(t)[0])


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(table(spark, [(1, "a"), (2, None)]), none).collect()} == {0}
    assert toxicity.toxicity(table(spark, []), none).count() == 0


def test_grammar():
    terms = {"oaf": 2.0, "grum*": 3.0}

    def read(clause):
        f = toxicity.read_clause(clause, terms)
        return f.weight, f.marked["targeted"], f.marked["negated"], f.marked["reported"], f.threats

    assert read("such an oaf") == (2.0, 0, 0, 0, 0) and read("grumlet") == (3.0, 0, 0, 0, 0)
    assert read("you oaf and grumlet") == (5.0, 5.0, 0, 0, 0)
    assert read("not an oaf") == (2.0, 0, 2.0, 0, 0)
    assert read("he said oaf") == (2.0, 2.0, 0, 2.0, 0)
    assert read("we will kill you") == read("ich werde dich töten") == read("they want to burn all of them") == (0, 0, 0, 0, 1)
    for none in ("the fire will burn wood and beat the cold", "to beat the eggs, hurt nobody", "we will not kill you", "you kill time", "skills for you", "kill a b c d you", "dich a b c töten"):
        assert read(none) == (0, 0, 0, 0, 0), none
    assert read("killing you, beating him") == (0, 0, 0, 0, 2)
    assert toxicity.Matcher(terms).clauses("First. The oaf here! Boaf oafs.\nGrumbling on") == [" the oaf here", "grumbling on"]


def test_threats_need_targets(spark):
    import math

    m = toxicity.Matcher({})
    assert [c for c, _ in m.found("Skills here. We will kill you! Killjoys\nIch will dich töten")] == [" we will kill you", "ich will dich töten"]
    assert m.features("Fine. We will kill you.") == (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, math.log1p(1))
    docs, labels = toxic_corpus()
    shown = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = table(spark, [*docs, (5001, ""), (5002, "word1. We will kill you."), (5003, "word2, word3."), (5004, "The fire will burn wood and beat the cold."), (5005, "to beat the eggs, hurt nobody"), (5006, "we will kill you")])
    model = toxicity.learn(rows, shown)
    assert not any(t.rstrip("*").startswith("kil") for t in model.terms)
    got = {r.doc_id: r for r in toxicity.toxicity(rows, shown, model=model).collect()}
    assert [c.text for c in got[5002].clauses] == [" we will kill you"] and got[5002].clauses[0].score > 0.5
    # A threat is above what only uses such words, which is as any other text.
    assert got[5006].score == got[5002].score > got[5001].score == got[5003].score == got[5004].score == got[5005].score
    # Without learned terms, threats are found all the same.
    none = toxicity.toxicity(rows.where("doc_id >= 5001"), shown.where("false")).collect()
    assert {r.doc_id: len(r.clauses) for r in none} == {5001: 0, 5002: 1, 5003: 0, 5004: 0, 5005: 0, 5006: 1}


def test_worth_of_marks_is_learned(spark):
    """Insults are toxic where they have a target, and are not where they are denied."""
    rng = random.Random(3)
    plain = [f"word{k}" for k in range(40)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(plain, k=12)
        kind = i % 3
        if kind == 1:
            w[4:4] = ["you", "oaf", "grumlet"]
        elif kind == 2 and i % 4:
            w[4:4] = ["never", "oaf", "grumlet"]
        rows.append((i, " ".join([*w, "you", "never"])))
        labels.append((i, int(kind == 1)))
    model = toxicity.learn(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), least_weight=0.3)
    assert {"oaf", "grumle*"} & set(model.terms)
    worth = dict(zip(toxicity.FEATURES, model.weights, strict=True))
    assert worth["targeted"] > 0.25 and worth["negated"] < -0.5 and worth["threats"] == pytest.approx(1.5)
    m = toxicity.Matcher(model.terms)
    assert model.score(m.features("you oaf grumlet")) > 0.5 > model.score(m.features("never oaf grumlet"))


def brute_toxicity(text, model):
    """The score of one text, clause by clause, from word positions in place of the composed transducer."""
    import math

    found = []
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        w = re.findall(r"[^\W\d_]+", clause)
        kinds, weights = [], []
        for x in w:
            own = [v for t, v in model.terms.items() if (t[:-1] if t.endswith("*") else t) == (x[: len(t) - 1] if t.endswith("*") else x)]
            weights.append(max(own, default=0.0))
            kinds.append("insult" if own else "threat" if x.startswith(toxicity.THREATS) else "object" if x in toxicity.OBJECTS else "target" if x in toxicity.TARGETS else "negation" if x in toxicity.NEGATIONS else "report" if x in toxicity.REPORTS else "other")
        sums = {"targeted": 0.0, "negated": 0.0, "reported": 0.0}
        for k, kind in enumerate(kinds):
            if kind == "insult":
                sums["targeted"] += weights[k] * any(kinds[j] in ("target", "object") for j in range(max(0, k - 6), k))
                sums["negated"] += weights[k] * ("negation" in kinds[max(0, k - 3) : k])
                sums["reported"] += weights[k] * ("report" in kinds[:k])
        threats = 0
        waiting = seen = denied = 0
        for kind in kinds:
            was = waiting, seen, denied
            waiting, seen, denied = max(0, waiting - 1), max(0, seen - 1), max(0, denied - 1)
            if kind == "negation":
                waiting, seen, denied = 0, 0, 3
            elif kind == "threat":
                threats += bool(was[1])
                waiting, seen, denied = (0 if was[1] or was[2] else 4), 0, 0
            elif kind in ("target", "object") and was[0]:
                threats += 1
                waiting = seen = denied = 0
            elif kind == "object" and not was[2]:
                waiting, seen, denied = 0, 3, 0
        if sum(weights) or threats:
            found.append((sum(weights), sums, threats))
    values = [max((f[0] for f in found), default=0.0), math.log1p(sum(f[0] for f in found)), len(found), *(math.log1p(sum(f[1][m] for f in found)) for m in ("targeted", "negated", "reported")), math.log1p(sum(f[2] for f in found))]
    z = model.bias + sum(a * b for a, b in zip(model.weights, values, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_against_brute_force(spark):
    rng = random.Random(14)
    parts = ["you", "not", "said", "oaf", "oafs", "grumlet", "kill", "kills", "töten", "dich", "te", "beats", "word", "they", "never", "never said", ".", "!", "?", ";", "\n", ",", "OAF", "Kill", "x1oaf", "oaf_", "il"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(300)] + ["", None, "you " * 200_000 + "oaf", "kill"]
    model = toxicity.Model({"oaf": 2.0, "grum*": 3.0, "beat*": 2.6}, -4.0, (1.0, 0.7, 0.2, 0.4, -0.6, -0.3, 1.1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [*enumerate(texts), (None, "oaf"), (3, "oaf"), (3, "oaf")]
    got = toxicity.toxicity(table(spark, rows), none, model=model).collect()
    want = sorted(((i, round(brute_toxicity(t, model), 9)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, round(r.score, 9)) for r in got), key=repr) == want
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_lexicon_limits_are_parameters(spark):
    docs, labels = toxic_corpus()
    shown = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = table(spark, docs)
    every = toxicity.learn(df, shown)
    assert set(toxicity.learn(df, shown, terms=2).terms) < set(every.terms)
    assert toxicity.learn(df, shown, least_docs=10_000).terms == toxicity.learn(df, shown, least_weight=99.0).terms == {}


def test_stems_win_over_equal_words():
    text = "Losers lost. A loser. Such grumlets"
    for lexicon in ("loser*", "loser", "grumle"), ("loser", "loser*", "grumle*"):
        terms = dict.fromkeys(lexicon, 2.0)
        assert toxicity.Matcher(terms).clauses(text)[:2] == ["losers lost", " a loser"]
        assert toxicity.Matcher(terms).features("losers")[0] == 2.0
    assert toxicity.Matcher({"loser": 2.0}).clauses(text) == [" a loser"]
    # A threat that is also a learned stem is found with endings.
    assert toxicity.Matcher({"kill*": 3.0}).clauses("Killers.") == ["killers"]


# WARC


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 600 + "</p>\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/1", big), (5, "http://a/5", big), (9, None, big), (2, "http://b\r\nx", "small"), (3, "u", "small"), (4, "n", None), (6, "v", "y" * 999), (7, "v", "y" * 999), (8, "v", "z" * 1000), (10, "v", "z" * 1000), (10, "v", "z" * 1000), (None, "w", "z" * 1000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, n long").repartition(3)
    manifest, records = warc.archive(df, folder=f"file://{tmp_path}/w")
    got = sorted(rows_of(records, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), key=repr)
    expect, seen = [], set()
    for i, url, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == raw and p is not None]
        # Of rows that repeat the largest page, one is the response.
        revisit = len(raw) >= 1000 and (i != max(same) or (i, url) in seen)
        seen.add((i, url))
        expect.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(expect, key=repr)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    payloads = {r.page_id: bytes(r.payload).decode() for r in records.collect() if r.payload is not None}
    assert payloads[9] == big and payloads[4] == ""


def test_warc_shuffles_no_body_of_a_revisit(spark, tmp_path):
    """A page that most rows have leaves each task once; small pages are not shuffled at all."""
    rows = [(k, f"u{k % 3}", "hot " * 500 if k % 4 else f"own {k} " * 300, k) for k in range(400)] + [(1000, None, "tiny", 0), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int").repartition(4)
    resolved = warc.resolve(df)
    assert resolved.where("record_type = 'revisit' and html is not null").count() == 0
    got = rows_of(resolved.groupBy("record_type").count(), "record_type", "count")
    assert dict(got) == {"revisit": 299, "response": 103}
    _, records = warc.archive(df, folder=f"file://{tmp_path}/w")
    assert {r.refers_to for r in records.where("record_type = 'revisit'").collect()} == {399}
    assert records.where("record_type = 'revisit'").agg(F.min("payload_bytes"), F.max("payload_bytes")).first() == (2000, 2000)


def test_warc_long_page(spark, tmp_path):
    page = "<p>long é</p>" * 400_000
    _, records = warc.archive(spark.createDataFrame([(1, "u", page), (2, "u", page)], "page_id long, url string, html string"), folder=f"file://{tmp_path}/w")
    got = {r.page_id: r for r in records.collect()}
    assert bytes(got[2].payload).decode() == page and got[1].payload is None and got[1].payload_bytes == len(page.encode())


def test_warc_empty(spark, tmp_path):
    manifest, records = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), folder=f"file://{tmp_path}/w")
    assert manifest.count() == 0 and records.count() == 0


# Language


def test_language(spark):
    import zlib

    rng = random.Random(4)
    parts = {"aa": ["tha", "ner", "ing", "wor"], "bb": ["ço", "léa", "qui", "ment"], "cc": ["при", "вет", "дом", "ая"]}
    rows = []
    for i in range(600):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang, "s"))
    mixed = " ".join(r[1] for r in rows[:2])
    extra = [(1000, None, None, "s"), (1001, "12 34 !! —", "aa", "s"), (1002, "", "bb", "s"), (1003, mixed, None, "s"), (None, rows[2][1], "cc", "s"), (1004, "漢字", None, "s")]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.language_id(df).collect()}
    truth = {i: lang for i, _, lang, _ in rows}
    out = [got[i].lang_pred == truth[i] for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 80 and all(out) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1000].score == 0
    assert [s.lang for s in got[1003].spans] == ["aa", "bb"] and got[1003].spans[0].start == 0 and 0.3 < got[1003].score < 0.7
    assert got[1004].lang_pred in ("aa", "bb", "cc")
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_id(none).collect()} == {"und"}
    assert language.language_id(df.where("false")).count() == 0


ASKED = ["12 £", "25 °", "20 °C", "£5", "© 2024", "§ 5", "«1»", "2×3", "1\u00a02", "\u00a0", "½", "²", "x²", "٣", "①", "Ⅷ", "\u0301", "e\u0301", "ª", "ˣ", "漢", "〇", "々", "かな", "한국", "😀", "\U00020000", "5 ñ", "дом", "é", "", "\ufffd", "ก", "हि", "abc дом ½ xyz", "Ĳ ß"]


def test_language_of_repeated_rows_and_clashing_columns(spark):
    import zlib

    texts = {"en": "the river runs through the valley and the hills", "de": "der Fluss flie\u00dft durch das Tal und die H\u00fcgel"}
    rows = [(k, texts[lang], lang, "s", "p") for k in range(40) for lang in [("en", "de")[k % 2]]]
    odd = [(3, texts["de"], "de", "s", "p"), (3, texts["de"], "de", "s", "p"), (3, texts["en"], "en", "s", "p"), (None, texts["en"], None, None, None), (None, texts["en"], None, None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string, lang_pred string")
    got = sorted((str(r.doc_id), r.lang_pred, r.held_out) for r in language.language_id(df).collect())
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 0 for k in [None, *range(40)]}
    assert got == sorted((str(k), "de" if "Fluss" in t else "en", held[k]) for k, t, *_ in rows + odd)


def brute_language(model, text, penalty):
    """lang_pred and score of one text: words one by one, all features and the Viterbi table spelled out."""
    import bisect
    import unicodedata

    import numpy as np

    from tarn.llm.common import Words

    if not model.languages or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    words = re.findall(rb"(?:[A-Za-z]|[^\x00-\x7f])+", text.encode())
    starts = [s for s, _ in language.SCRIPT_STARTS]
    rows = []
    for w in words:
        raw = np.frombuffer(w, np.uint8)
        at, _ = language.word_features(Words(raw, np.array([0, len(w)]), language.SEPARATORS, fold=True))
        script = max(language.SCRIPT_STARTS[bisect.bisect_right(starts, ord(c)) - 1][1] for c in w.decode())
        each = model.scores[at[0]].sum(axis=0).astype(float)
        allowed = model.scripts[:, script]
        low = min(each.min(), 0.0) - 10.0
        rows.append([x if ok or not allowed.any() else low for x, ok in zip(each, allowed, strict=True)])
    k = len(model.languages)
    best, back = list(rows[0]), []
    for row in rows[1:]:
        top = max(range(k), key=best.__getitem__)
        froms = [j if best[j] >= best[top] - penalty else top for j in range(k)]
        best = [max(best[j], best[top] - penalty) + row[j] for j in range(k)]
        back.append(froms)
    at = max(range(k), key=best.__getitem__)
    path = [at]
    for froms in reversed(back):
        at = froms[at]
        path.append(at)
    mass = [0.0] * k
    for w, j in zip(words, path[::-1], strict=True):
        mass[j] += len(w)
    return model.languages[max(range(k), key=mass.__getitem__)], max(mass) / sum(mass)


def test_language_against_brute_force(spark):
    known = [(i, "the cat sat on the mat and the dog", "en") for i in range(20)] + [(40 + i, "кот сидел на ковре и пёс", "ru") for i in range(20)] + [(80 + i, "el gato se sentó en la alfombra", "es") for i in range(20)]
    mixed = [" ".join(k[1] for k in random.Random(s).choices(known, k=5)) for s in range(20)]
    asked = [*ASKED, *mixed, None, " ".join(["the cat sat"] * 20_000)]
    df = spark.createDataFrame([*known, *((1000 + k, t, None) for k, t in enumerate(asked))], "doc_id long, text string, lang string").coalesce(1)
    model = language.learn(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(df, model=model).collect()}
    for k, text in enumerate(asked):
        lang, score = brute_language(model, text, language.PENALTY)
        assert got[1000 + k][0] == lang and got[1000 + k][1] == pytest.approx(score), text
    und = {t for k, t in enumerate(asked) if got[1000 + k][0] == "und"}
    assert und >= {"25 °", "£5", "© 2024", "½", "²", "\u00a0", "٣", "①", "\u0301", "😀", "", None} and not und & {"漢", "ª", "ˣ", "x²", "e\u0301", "ก"}


def test_language_learns_rare_ones(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(3000)] + [(5000 + i, "кот сидел на ковре", "ru") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df, sample_rows=100)
    assert model.languages == ["en", "ru"] and (model.scripts.sum(axis=1) > 0).all()
    with pytest.raises(ValueError, match="languages"):
        language.learn(df, max_languages=1)


def test_scripts_are_told_apart():
    assert len(language.SCRIPT_STARTS) < 200 and sorted(language.SCRIPT_STARTS) == list(language.SCRIPT_STARTS)
    import numpy as np

    def script(text):
        return int(language.scripts(np.frombuffer(text.encode(), np.uint8)).max())

    each = ["a", "α", "ж", "ա", "א", "ب", "ह", "ক", "த", "ก", "ລ", "က", "ა", "한", "ሀ", "ខ", "漢", "か"]
    assert len({script(x) for x in each}) == len(each) and script("é") == script("a") == script("ẽ") and script("½") == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(60):
        s = rng.normal(0, 2, (6, 3))
        path = language.viterbi(s, 1.5)

        def value(p, s=s):
            return sum(s[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))

        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))))


# Licences


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", mit), ("a/b/c/x.txt", "code code"), ("a/b/y.txt", "text\n" + apache + "\nmore text here and there, quite a lot of it"), ("a/b/c/NOTICE", apache), ("z/q.txt", "plain"), ("top.txt", "plain"), (None, mit), ("a/b/n.txt", None), ("a/b/c/d/e.txt", ""), ("a/b/c/x.txt", "code code")]
    got = licenses.license_scan(spark.createDataFrame([(*f, "u", "v") for f in files], "path string, text string, license string, dir string"), file_share=0.5)
    rows = sorted(rows_of(got, "path", "license", "basis", "license_from"), key=repr)
    assert rows == sorted(
        [
            ("a/LICENSE", "MIT", "file", None),
            ("a/b/c/x.txt", "Apache-2.0", "inherited", "a/b/c/NOTICE"),
            ("a/b/c/x.txt", "Apache-2.0", "inherited", "a/b/c/NOTICE"),
            ("a/b/y.txt", "Apache-2.0", "header", None),
            ("a/b/c/NOTICE", "Apache-2.0", "file", None),
            ("z/q.txt", None, None, None),
            ("top.txt", None, None, None),
            (None, "MIT", "file", None),
            ("a/b/n.txt", "MIT", "inherited", "a/LICENSE"),
            ("a/b/c/d/e.txt", "Apache-2.0", "inherited", "a/b/c/NOTICE"),
        ],
        key=repr,
    )
    assert licenses.license_scan(spark.createDataFrame([], "path string, text string")).count() == 0
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        assert index.best(licenses.tokens(text)) == (name, pytest.approx(1.0))
        assert index.scan(text, 0.6)[:2] == (name, pytest.approx(1.0))


GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users.
"""


def cosines(text, threshold):
    """All runs of lines of all lengths against all templates, word by word: what the scan may give at best."""
    import math
    from collections import Counter

    lines = [x for x in (licenses.tokens(t) for t in text.split("\n")) if x]
    df = Counter(w for _, t in licenses.TEMPLATES for w in set(licenses.tokens(t)))
    n = len(licenses.TEMPLATES)

    def vector(words):
        return {w: c * math.log(1 + n / df.get(w, 1)) for w, c in Counter(words).items()}

    best = (0.0, 0, None)
    for at in range(len(lines)):
        for end in range(at + 1, len(lines) + 1):
            words = [w for x in lines[at:end] for w in x]
            if end - at > licenses.TITLE_LINES and (at, end) != (0, len(lines)):
                continue
            v = vector(words)
            for name, t in licenses.TEMPLATES:
                u = vector(licenses.tokens(t))
                dot = sum(x * u.get(w, 0.0) for w, x in v.items())
                score = dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()))
                if (round(score, 9), len(words)) > best[:2]:
                    best = (round(score, 9), len(words), name)
    return (best[2], best[0]) if best[0] >= threshold else (None, 0.0)


def test_licenses_against_brute_force():
    import textwrap

    rng = random.Random(8)
    index = licenses.Index(licenses.TEMPLATES)
    texts = [GPL_FILE, "CC BY-NC 4.0", "CC0 1.0", "nothing here", "", "\n\n", "SPDX-License-Identifier: ISC", "the the the software software", "See LICENSE"]
    for name, t in rng.sample(licenses.TEMPLATES, 12):
        texts.append("\n".join(textwrap.wrap(t, 300)))
        texts.append("word one two\n" + t.replace("\n", " ") + "\nplain words after " * 3)
        texts.append(" ".join(w if rng.random() < 0.9 else "changed" for w in t.split()))
    for text in texts:
        name, score, _ = index.scan(text, 0.6)
        if text.count("\n") < 15:
            want = cosines(text, 0.6)
            assert score == pytest.approx(want[1], abs=1e-6) and (name == want[0] or score == 0), text
    assert index.scan(GPL_FILE, 0.6)[0] == "GPL-2.0"
    assert index.scan("CC BY-NC 4.0", 0.6)[0] == "CC-BY-NC-4.0" and index.scan("CC0 1.0", 0.6)[0] == "CC0-1.0"
    # Wrapped as in files, with a copyright line of its own before it.
    for name, t in licenses.TEMPLATES:
        if len(t) > 400 and not name.startswith("GPL"):
            found = index.scan("Copyright 2020 Some One\n\n" + "\n".join(textwrap.wrap(t, 72)), 0.6)
            assert found[0] == name and found[2] > 0.9


def test_license_query_with_odd_ids(spark, tmp_path):
    from tarn.llm.queries import QUERIES

    mit = "Released under the MIT License."
    rows = [(1, mit, "en", "a", 1), (2, "text", "en", "a", 1), (None, "other", "en", "a", 1), (2, "again", "en", "a", 1), (3, None, "en", "b", 1), (4, "", None, None, 1), (4, "x " * 900_000 + "\n" + mit, None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(QUERIES["op9_license_scan"](spark, str(tmp_path)), "doc_id", "license", "basis", "from_doc_id")
    assert sorted(got, key=repr) == sorted([(1, "MIT", "header", None), (2, None, None, None), (None, None, None, None), (2, None, None, None), (3, None, None, None), (4, None, None, None), (4, "MIT", "header", None)], key=repr)


def test_own_texts_of_licences():
    import textwrap

    licences = licenses.LicenceTexts()
    own = {t for _, t in licenses.TITLES} | {t for _, t in licenses.TEMPLATES if any(x.startswith(t) for _, x in licenses.TERMS)}
    assert len(licenses.TITLES) == 10 and len(licenses.TERMS) == 6 and len(own) == 16
    for name, t in licenses.TITLES:
        assert licences.own(t, name) and licences.own(t + "\n\n" + "words of the licence\n" * 300, name) and licences.own("A Legal Code\n" + t, name)
        assert not licences.own("word one\nword two\nword three\n" + t, name) and not licences.own(t, "other")
    for name, t in licenses.TERMS:
        file = f"The {name} Licence\n\nCopyright (c) 2020 Some One\n\n" + "\n".join(textwrap.wrap(t, 72))
        assert licences.own(t, name) and licences.own(file, name)
        assert not licences.own(file + "\n" + "".join(f"def function{i}(value{i}): pass\n" for i in range(60)), name)
    for name, t in licenses.TEMPLATES:
        assert t in own or not licences.own(t, name)
    assert licences.own(GPL_FILE, "GPL-2.0") and not licences.own("", "MIT") and not licences.own("\n \n", "MIT")


def test_license_query_inherits_from_own_texts(spark, tmp_path):
    from tarn.llm.queries import QUERIES

    terms = next(t for n, t in licenses.TERMS if n == "MIT")
    mit, notice = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + terms, "Released under the MIT License."
    code = terms + "\n" + "".join(f"def function{i}(value{i}): pass\n" for i in range(60))
    rows = [
        (1, GPL_FILE, "a"), (2, mit, "a/b"), (3, "plain", "a/b/c/d"), (3, "plain", "a/b/c/d"), (4, "plain", "a"), (5, None, "a/b/"), (6, "x\nLicensed under the Apache License, Version 2.0.", "a/b"), (7, "plain", "ab"),
        (8, mit, None), (9, "plain", None), (10, mit, ""), (11, "", "//"), (12, notice, "n"), (13, "plain", "n"), (14, code, "m"), (15, "plain", "m"), (None, "plain", "a/x"), (16, mit, "a/b"),
    ]
    spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(QUERIES["op9_license_scan"](spark, str(tmp_path)), "doc_id", "license", "basis", "from_doc_id")
    # Of the two in a/b the smallest path gives the licence: 16.txt is before 2.txt.
    want = [
        (1, "GPL-2.0", "file", None), (2, "MIT", "file", None), (3, "MIT", "inherited", 16), (3, "MIT", "inherited", 16), (4, "GPL-2.0", "inherited", 1), (5, "MIT", "inherited", 16), (6, "Apache-2.0", "header", None), (7, None, None, None),
        (8, "MIT", "file", None), (9, None, None, None), (10, "MIT", "file", None), (11, None, None, None), (12, "MIT", "header", None), (13, None, None, None), (14, "MIT", "header", None), (15, None, None, None), (None, "GPL-2.0", "inherited", 1), (16, "MIT", "file", None),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_license_query_on_the_table_with_a_licence_text(spark, tmp_path):
    from tarn.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    terms = next(t for n, t in licenses.TERMS if n == "ISC")
    docs.unionByName(spark.createDataFrame([(-1, "Copyright Some One\n" + terms, "en", "src3", 1)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    after = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    assert (after[-1].license, after[-1].basis) == ("ISC", "file") and after.keys() == before.keys() | {-1}
    src3 = {r.doc_id for r in docs.where("source = 'src3'").collect()}
    inherits = {k for k, r in before.items() if k in src3 and r.license is None}
    assert len(inherits) > 10 and all((after[k].license, after[k].basis, after[k].from_doc_id) == ("ISC", "inherited", -1) for k in inherits)
    assert all(after[k] == r for k, r in before.items() if k not in inherits)


def test_license_of_pages_by_their_addresses(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    files = licenses.page_files(pages)
    rows = files.select("page_id", "path").collect()
    host, lang = next(r.path for r in rows if r.path.count("/") == 2).split("/")[:2]
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    planted = [(-1, f"{host}/LICENSE", mit), (-2, f"{host}/{lang}/deep/COPYING", apache), (-3, f"{host}/{lang}/deep/er/a.html", "plain words"), (-4, f"{host}/{lang}/b.html", "plain words"), (-5, f"{host}x/{lang}/c.html", "plain words"), (-6, f"{host}/{lang}/NOTICE", "no notice at all")]
    every = files.unionByName(spark.createDataFrame(planted, "page_id long, path string, text string"))
    found = licenses.license_scan(every, id_col="page_id").collect()
    got = {r.page_id: (r.license, r.basis, r.license_from) for r in found}
    assert len(found) == len(rows) + len(planted)
    assert [got[k] for k in (-1, -2, -3, -4, -5, -6)] == [("MIT", "file", None), ("Apache-2.0", "file", None), ("Apache-2.0", "inherited", f"{host}/{lang}/deep/COPYING"), ("MIT", "inherited", f"{host}/LICENSE"), (None, None, None), ("MIT", "inherited", f"{host}/LICENSE")]
    for r in rows:
        basis, source = got[r.page_id][1:]
        assert basis == "header" or (basis, source) == (("inherited", f"{host}/LICENSE") if r.path.startswith(host + "/") else (None, None))
    odd = spark.createDataFrame([(1, None, None), (2, "http://h.example", "<p>" + mit + "</p>"), (3, "http://h.example/a/", ""), (4, "https://h.example/a/b?x=/LICENSE#y", None)], "page_id long, url string, html string")
    assert sorted(rows_of(licenses.page_files(odd), "page_id", "path", "text")) == [(1, None, None), (2, "h.example/index.html", "\n" + mit + "\n"), (3, "h.example/a/index.html", ""), (4, "h.example/a/b", None)]


# Line dedup


def brute_lines(rows, ratio, least):
    total, pages = {}, {}
    for _, host, text in rows:
        total[host] = total.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host, line] = pages.get((host, line), 0) + 1
    out = []
    for i, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not (pages[host, x.strip(" ")] >= least and pages[host, x.strip(" ")] > ratio * total[host])]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_line_dedup(spark, broadcast_bytes):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        host = rng.choice(["big", "big", "big", "small", None])
        lines = [rng.choice([f"own {i} {k}", " menu ", "menu", "", "footer", f"rare {rng.randrange(90)}"]) for k in range(rng.randrange(6))]
        rows.append((i, host, rng.choice(["\n".join(lines), "\n".join(lines), None])))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, host string, line long")
    got = line_dedup.line_counts(df, ratio=0.1, broadcast_bytes=broadcast_bytes)
    assert sorted(rows_of(got, "doc_id", "text", "n_lines", "n_dropped"), key=repr) == brute_lines(rows, 0.1, 2)
    kept = line_dedup.line_dedup(df, ratio=0.1, broadcast_bytes=broadcast_bytes)
    assert kept.columns == df.columns
    assert sorted(rows_of(kept, "doc_id", "text"), key=repr) == sorted(((i, t) for i, t, _, _ in brute_lines(rows, 0.1, 2)), key=repr)
    assert line_dedup.line_dedup(df.where("false")).count() == 0


def test_line_dedup_odd_tables(spark):
    """Names that the operator could use itself, null and repeated ids, a host of two pages, a very long text."""
    long = "\n".join(f"line {k}" for k in range(60_000)) + "\nmenu"
    rows = [(None, "h", "menu\na", 1), (1, "h", "b\n menu", 2), (1, "h", long, 3), (2, "two", "same\nx", 4), (3, "two", "same\ny", 5), (3, "two", None, 6), (4, "one", "alone\nalone", 7), (4, "one", "", 8), (5, None, "n\nn", 9), (5, None, "n", 9)]
    names = ["doc_id", "source", "text", "__bad"]
    for extra in ("host_", "bad_", "HOST_", "all_", "kept_", "__host", "__all", "__lines", "__dropped", "n_lines", "line", "total", "a.b"):
        df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"doc_id long, source string, text string, __bad int, `{extra}` int")
        got = line_dedup.line_dedup(df)
        assert got.columns == [*names, extra]
        if extra in ("bad_", "a.b"):
            expect = brute_lines([r[:3] for r in rows], 0.02, 2)
            assert sorted(rows_of(got, "doc_id", "text"), key=repr) == sorted(((i, t) for i, t, _, _ in expect), key=repr)
            assert sorted(rows_of(line_dedup.line_counts(df), "doc_id", "text", "n_lines", "n_dropped"), key=repr) == expect
            assert [r.text for r in got.where("source = 'two'").orderBy("__bad").collect()] == ["x", "y", None]


def test_exact_dedup_odd_names(spark):
    for extra in ("kept_id", "__kept_id", "h", "x", "n", "s", "keep_id", "group_size"):
        df = spark.createDataFrame([(1, "a", 1), (2, "A", 2), (None, "b", 3), (None, "b", 4), (5, "c" * 3_000_000, 5), (6, "C" * 3_000_000, 6)], f"doc_id long, text string, `{extra}` int")
        got = exact_dedup.drop_copies(df)
        assert got.columns == df.columns and sorted(rows_of(got, "doc_id"), key=repr) == [(1,), (5,), (None,), (None,)]
        assert exact_dedup.exact_dedup(df).count() == 6
