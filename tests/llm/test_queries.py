"""Every query of the text operators on the smallest data: against its SQL where it has one, else for shape and sense."""

from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def connection():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_warc", "op5_substring_dedup", "op6_exact_dedup", "op10_line_dedup", "op13_lexical_search"])
def test_oracle(spark, name):
    from tarn.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    expect = connection().sql(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, expect))


def test_all_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline_step(spark, stage, docs, k)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= seen and len(ids) == len(set(ids)) and len(ids) > 100
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        seen = set(ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == seen


def corpus_pipeline_step(spark, stage, docs, k):
    import tempfile

    path = tempfile.mkdtemp() + f"/{k}"
    stage(spark, docs, DATA).write.parquet(path)
    return spark.read.parquet(path)


def odd_rows():
    """Odd rows: null and repeated ids, repeated rows, null, empty, blank and long texts, null columns."""
    base = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark forest near the old mill"
    other = "a completely different text about numbers and letters which nobody else has written in this small table so far"
    return [
        (1, f"{base} one", "en", "s", 10),
        (2, f"{base} two", "en", "s", 10),
        (2, f"{other} x", None, None, None),
        (2, f"{other} x", None, None, None),
        (None, f"{other} y", "de", "t", 3),
        (None, f"{other} y", "de", "t", 3),
        (None, "words that only rows without any id have in this table and that are not few", None, "t", None),
        (None, "words that only rows without any id have in this table and that are not few", None, "t", None),
        (5, None, None, None, None),
        (5, "", "en", "s", 0),
        (5, " \n ", "en", "s", 3),
        (6, "long " * 300_000, "en", "s", 1),
        (7, "menu\nown line of seven", "en", "u", 1),
        (8, "menu\nown line of eight", "en", "u", 1),
    ]


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept_id int, row string, digest int, host_ int"


def odd_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], ODD).repartition(3)


def same(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    rows = odd_rows()
    docs = odd_table(spark, rows)
    # Which of the equal rows stays does not show.
    keep = [rows[0], rows[2], rows[6], *rows[8:14]]
    got = p.near_copies(spark, docs, DATA)
    assert got.columns == docs.columns and same(got) == same(odd_table(spark, keep))
    unique = [r for k, r in enumerate(rows) if k in (0, 1, 8, 11, 12)]
    got = p.near_copies(spark, odd_table(spark, unique), DATA)
    assert got.columns == docs.columns and same(got) == same(odd_table(spark, [unique[0], *unique[2:]]))
    got = p.lines(spark, docs, DATA)

    def without(r):
        text = r[1] if r[3] != "u" else r[1].removeprefix("menu\n")
        return (r[0], text, r[2], r[3], len(text or ""))

    # Of s, two pages of six begin alike but no line is on two of them; the menu is on both pages of u.
    repeated = {rows[2][1], rows[4][1], rows[6][1]}
    want = [(r[0], "" if r[1] in repeated else without(r)[1], r[2], r[3], 0 if r[1] in repeated else without(r)[4]) for r in rows]
    assert got.columns == docs.columns and same(got) == same(odd_table(spark, want))
    for stage in (p.toxicity, p.benchmark):
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns and same(got) == same(docs)
    got = p.tokens(spark, docs, DATA)
    assert sorted((repr((r.doc_id, r.text)) for r in got.collect())) == sorted(repr((r[0], r[1] or "")) for r in rows)


def test_stages_drop_what_they_should(spark):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    rows = [(1, item, "en", "s", 1), (1, "clean words", "en", "s", 1), (None, item, "en", "s", 1), (None, "clean too", "en", "s", 1)]
    got = p.benchmark(spark, odd_table(spark, rows), DATA)
    assert same(got) == same(odd_table(spark, [rows[1], rows[3]]))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    assert p.toxicity(spark, toxic, DATA).count() < toxic.count() / 3


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline as p

    docs = odd_table(spark, odd_rows()).where("false")
    for _, stage in p.STAGES:
        assert stage(spark, docs, DATA).count() == 0
