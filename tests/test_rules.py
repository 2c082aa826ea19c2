"""Rules as a table against testing each rule on each line."""

from __future__ import annotations

import random
import re

import pytest

from tarn.operators import rules, tracker

SCHEMA = "rule string, pattern string, globs array<string>"


def test_literals():
    for pattern, want in {
        "idiot|moron": ["idiot", "moron"],
        r"foo\(bar": ["foo(bar"],
        "abcd?efgh": ["efgh"],
        "abcd+ef": ["abcd"],
        "abc{2}xyz": ["xyz"],
        "(abc|def)ghi": ["ghi"],
        "[abc]defg": ["defg"],
        r"\bword\b": ["word"],
        "ab|cdef": None,
        "a.c": None,
        "(?i)abcdef": None,
        r"\x41bcdef": None,
        r"\Qabc\E": None,
        "": None,
        "abc)": None,
        "(abc": None,
    }.items():
        assert rules.literals(pattern) == want, pattern


def _brute(lines, table, exempt=()):
    out = set()
    for rule, pattern, globs in table:
        if rule is None or pattern is None or not globs:
            continue
        paths = "|".join(tracker.glob_regex(g) for g in globs if g)
        out |= {(rule, p, n) for p, n, t in lines if p and t and paths and re.search(paths, p) and re.search(pattern, t) and not re.search(tracker.EXEMPT, t)}
    return {x for x in out if x not in exempt}


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0, "open_bytes": 200}])
def test_against_every_pair(spark, limits):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    lines = [(f"{rng.choice(['src', 'src/a', 'ios'])}/f{rng.randint(0, 5)}.ts", n, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for n in range(400)]
    lines += [("src/x.ts", 1, "// RULE-EXEMPT(R3): known"), ("src/x.ts", 2, " ".join(words)), (None, 1, "abc"), ("src/y.ts", 1, None), ("src/y.ts", 2, ""), ("src/z.ts", 3, "x" * 20000 + " 😀abc😀 " + words[0]), lines[0]]
    shapes = ["{a}", "{a} {b}", "{a}|{b}", "{a}.*{b}", "({a}|{b})c", "[ab]{a}", "{a}?{b}", r"\b{a}\b", "^{a}"]
    table = [(f"R{n}", rng.choice(shapes).format(a=rng.choice(words), b=rng.choice(words)), rng.choice([["**"], ["src/*.ts"], ["ios/**", "src/a/**"]])) for n in range(150)]
    table += [("R3", "e", ["**"]), ("E", "abc", ["src/z.ts", None]), (None, "abc", ["**"]), ("N", None, ["**"]), ("G", "abc", None), ("H", "abc", []), ("E", "abc", ["src/z.ts", None])]
    exempt = {("R3", "src/x.ts", 1), ("R3", "src/x.ts", 2)}
    df = spark.createDataFrame([(*r, "more") for r in lines], "path string, line int, text string, rule string")
    got = rules.violations(df, spark.createDataFrame(table, SCHEMA), **limits).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == _brute(lines, table, exempt)


def test_five_thousand_rules_are_the_array_form(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    lines = spark.createDataFrame([(f"src/f{n % 40}.ts", n, " ".join(rng.choices(words, k=8))) for n in range(2000)], "path string, line int, text string")
    table = [(f"R{n}", f"{rng.choice(words)}|{rng.choice(words)} {rng.choice(words)}", ["src/**"]) for n in range(5000)]
    got = set(map(tuple, rules.violations(lines, spark.createDataFrame(table, SCHEMA)).collect()))
    some = table[::250]
    want = set(map(tuple, tracker.violations(lines, some).collect()))
    assert {x for x in got if x[0] in {r[0] for r in some}} == want and len(want) > 10


def test_empty(spark):
    none, one = spark.createDataFrame([], "path string, line int, text string"), spark.createDataFrame([("R", "abc", ["**"])], SCHEMA)
    assert rules.violations(none, one).count() == 0
    line = spark.createDataFrame([("a", 1, "abc")], "path string, line int, text string")
    assert rules.violations(line, one.limit(0)).count() == 0
    assert [tuple(r) for r in rules.violations(line, one).collect()] == [("R", "a", 1)]
