"""Token counts, resampling and lexical search against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tarn.llm import lexical_search, resampling, token_counts

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, digest int, n long, bag string, m int, vector string, score string, rank string, members int"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "b", 3, "v", "s", "r", 4) for i, t in rows], DOCS).repartition(3)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "item_id long, text string, doc_id int, part int")


def sentences():
    words = "the old mill by Über river grinds corn while Thé miller's cat sleeps 7 hours a day and dreams of MICE 日本 naïve".split(" ")
    out = []
    for k in range(90):
        n = (k * 7) % 43
        out.append((k * 3 % 97, " ".join(words[(k * k + j * (k % 5 + 1)) % len(words)] for j in range(n)) + (".\n" if k % 4 else "")))
    return out


ODD = [(None, "the cat sleeps by the old mill " * 5), (None, None), (200, ""), (200, "The  cat"), (201, None), (202, " \t\n"), (203, "mill corn cat " * 20_000), (204, "a" * 60_000), (205, "the cat sleeps by the old mill " * 5), (205, "the cat sleeps by the old mill " * 5), (206, "THE CAT sleeps by the old mill " * 5)]
ROWS = sentences() + ODD
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def same(df, want):
    return sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


# Token counts


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts(spark, tmp_path, model):
    got = token_counts.count_tokens(table(spark, ROWS), PIECES, cache=f"file://{tmp_path}/c", limit=30)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 30) for i, t in ROWS]
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and same(got, want)
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == len({t or "" for _, t in ROWS})


@pytest.mark.parametrize("text", ["", " ", "  ", "a", "a ", " a", "a  b", "a   b ", "▁", "▁▁a", "a▁b", " ▁ a", "\n", "a\n b", "\ta \t b", "x" * 400, " " * 300, "<s> a</s><unk>", "<0x41> b", "é́ 日本語 テスト", "a b", "　a", "🙂🙂 🙂", "①ﬁ ½", "\u0000a", "a﻿b ​"])
def test_segments_are_as_the_library_counts(text, model):
    with open(PIECES, "rb") as f:
        pieces = token_counts.Pieces(f.read())
    assert pieces.segmented
    for t in (text, f"{text}{text}", f"b{text} c", f" {text} "):
        assert pieces.counts([t, t]) == [len(model.encode(t))] * 2


def test_memory_of_segments_is_bounded(monkeypatch, model):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    with open(PIECES, "rb") as f:
        pieces = token_counts.Pieces(f.read())
    for _, t in ROWS:
        assert pieces.counts([t or ""]) == [len(model.encode(t or ""))]
        assert len(pieces.known) < 100


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/c"
    rows = sentences()
    first = token_counts.count_tokens(table(spark, rows[:40]), PIECES, cache=cache)
    before = spark.read.parquet(cache)
    assert before.count() == len({t for _, t in rows[:40]})
    known = sorted(map(repr, first.collect()))
    # Whatever is stored is believed: a stored count that is wrong on purpose shows that nothing was counted again.
    version = token_counts.tokenizer_version(PIECES)
    other = f"file://{tmp_path}/d"
    before.select("digest", "n_bytes", F.lit(-5).cast("long").alias("n_tokens")).write.parquet(f"{other}/version={version}")
    for sent in (1 << 16, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(token_counts, "SENT", sent)
        place = f"{other}-{sent}"
        spark.read.parquet(f"{other}/version={version}").write.parquet(f"{place}/version={version}")
        got = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(table(spark, rows), PIECES, cache=place).collect()}
        texts = {t for _, t in rows[:40]}
        right = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(table(spark, rows), PIECES, cache=cache).collect()}
        assert got == {(i, -5 if t in texts else n) for i, t in rows for j, n in right if j == i}
        assert spark.read.parquet(place).count() == len({t for _, t in rows})
    # All is stored: nothing is appended.
    files = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    again = token_counts.count_tokens(table(spark, rows[:40]), PIECES, cache=cache)
    assert sorted(map(repr, again.collect())) == known and sorted(p.name for p in tmp_path.rglob("*.parquet")) == files


def test_a_count_stored_twice_is_one(spark, tmp_path):
    cache, rows = f"file://{tmp_path}/c", sentences()
    want = sorted(map(repr, token_counts.count_tokens(table(spark, rows), PIECES, cache=cache).collect()))
    spark.read.parquet(cache).drop("version").write.mode("append").parquet(f"{cache}/version={token_counts.tokenizer_version(PIECES)}")
    assert sorted(map(repr, token_counts.count_tokens(table(spark, rows), PIECES, cache=cache).collect())) == want


def test_counts_of_a_tokenizers_file(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ROWS, (300, "an <|endoftext|> b"), (301, "<|startoftext|>")]
    one = Tokenizer.from_file(path)
    got = token_counts.count_tokens(table(spark, rows), path, cache=f"file://{tmp_path}/c")
    want = [(i, len((t or "").encode()), n := len(one.encode(t or "", add_special_tokens=False).ids), n > 4096) for i, t in rows]
    assert same(got, want)
    assert token_counts.tokenizer_version(path) != token_counts.tokenizer_version(PIECES)
    with pytest.raises(ValueError, match="model"):
        token_counts.tokenizer_version("ranks.tiktoken")


def test_counts_of_nothing(spark, tmp_path):
    assert token_counts.count_tokens(table(spark, []), PIECES, cache=f"file://{tmp_path}/c").collect() == []


# Resampling


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_resample(rows, goal, max_n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for _, x in goal for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        f = features(x)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in f)
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    fit = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    ranks = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return [(*r[:4], ranks[r].pop() if ranks.get(r) else None) for r in out]


GOAL = [(1, "the miller sleeps by the mill"), (1, "corn and MICE, corn and mice"), (None, "日本 cat's dream"), (3, None), (4, "")]


@pytest.mark.parametrize("options", [{}, {"max_n": 3}, {"percent": 50, "min_words": 5}, {"buckets": 7, "percent": 100, "min_words": 0}, {"percent": 0}, {"max_n": 2, "seed": 5, "percent": 30}])
def test_resample(spark, options):
    got = resampling.resample(table(spark, ROWS), items(spark, GOAL), **options)
    want = brute_resample(ROWS, GOAL, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and same(got, want)
    assert {t for _, t in got.dtypes} == {"bigint"}


def test_equal_scores_go_by_id(spark):
    """Rows of one id have the same noise: equal texts, equal scores."""
    rows = [(i % 3, "corn and mice and the mill by the river " * 4) for i in range(40)]
    got = resampling.resample(table(spark, rows), items(spark, GOAL), percent=60)
    assert same(got, brute_resample(rows, GOAL, percent=60))


def test_resample_of_nothing(spark):
    assert resampling.resample(table(spark, []), items(spark, GOAL)).collect() == []
    assert same(resampling.resample(table(spark, ROWS), items(spark, [])), brute_resample(ROWS, []))


def test_words_have_offsets():
    text = "héllo, wörld 日本_x9"
    assert resampling.splitter()(text) == [(w.group(), w.span()) for w in WORD.finditer(text)]


def test_words_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(resampling, "REMEMBERED", 3)
    f = resampling.Features(2, 100)
    assert f.bag("a b c d e f g a b") == resampling.Features(2, 100).bag("a b c d e f g a b") and len(f.known) < 6


# Lexical search


def brute_search(rows, asked, top=20):
    docs = [(i, Counter(words(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs]
    n_docs, total = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in asked if i is not None and t is not None):
        found = []
        for i, c, n in docs:
            m = 75 + 25 * n * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return out


ASKED = [(1, "The miller's cat sleeps"), (2, "corn corn mill"), (3, "nothing here"), (3, "the the old mill!"), (4, None), (None, "cat"), (5, ""), (2, "corn corn mill"), (6, "日本 Über naïve MICE a")]


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"top": 200}, {"max_bytes": 20}])
def test_search(spark, options):
    got = lexical_search.lexical_search(table(spark, ROWS), items(spark, ASKED), **options)
    want = brute_search(ROWS, ASKED, options.get("top", 20))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and same(got, want)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 12)
    assert same(lexical_search.lexical_search(table(spark, ROWS), items(spark, ASKED)), brute_search(ROWS, ASKED))


def test_classes_and_their_members(spark):
    """A class of two thousand copies, other texts that agree in all that counts, ties among classes."""
    rows = [((k * 37) % 5003, "the cat sleeps in a box") for k in range(2000)] + [(6000 + k, f"the cat sleeps in a w{k}") for k in range(50)] + [(9000 - k, "mill the cat") for k in range(30)] + [(9500, "x y z")]
    asked = [(1, "cat box"), (2, "cat"), (3, "mill"), (4, "sleeps cat mill box")]
    assert same(lexical_search.lexical_search(table(spark, rows), items(spark, asked), top=25), brute_search(rows, asked, 25))


def test_search_of_nothing(spark):
    for rows, asked in (([], ASKED), (ROWS, []), ([], []), ([(1, None), (2, " ,")], ASKED)):
        assert lexical_search.lexical_search(table(spark, rows), items(spark, asked)).collect() == []
