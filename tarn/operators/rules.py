"""Rules as a table: lines meet the rules whose literal text they hold, and only those are tested as patterns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators import tracker
from tarn.sources.scratch import Scratch

#: Escapes that stand for one character, place or class of characters; patterns with others are tested on every line.
_SHORT_ESCAPES = frozenset("bBsSdDwWtnrfAzZG")
_GRAM = 3


def literals(pattern: str) -> list[str] | None:
    """Texts one of which each match holds, at least three characters each; None if the pattern does not tell.

    The longest run of plain characters of each branch outside of groups and classes; a character that may be left out
    or repeated ends its run.
    """
    branches: list[list[str]] = [[""]]
    depth = at = 0
    while at < len(pattern):
        c, runs = pattern[at], branches[-1]
        at += 1
        plain = None
        if c == "\\":
            if at == len(pattern):
                return None
            e = pattern[at]
            at += 1
            if e.isalnum() and e not in _SHORT_ESCAPES:
                return None
            plain = None if e.isalnum() else e
        elif c == "[":
            end = at
            while end < len(pattern) and pattern[end] != "]":
                if pattern[end] == "[" or (pattern[end] == "\\" and pattern[end + 1 : end + 2].isalnum() and pattern[end + 1] not in _SHORT_ESCAPES):
                    return None
                end += 2 if pattern[end] == "\\" else 1
            if end >= len(pattern) or pattern[at:end] in ("", "^"):
                return None
            at = end + 1
        elif c == "(":
            if pattern.startswith("?", at) and not pattern.startswith(("?:", "?=", "?!"), at):
                return None
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
        elif c == "|" and not depth:
            branches.append([""])
            continue
        elif c == "{":
            at = pattern.find("}", at) + 1
            if not at:
                return None
        elif c not in ".^$?*+|":
            plain = c
        if depth or plain is None:
            runs.append("")
        elif pattern[at : at + 1] in ("?", "*", "{"):
            runs.append("")
        else:
            runs[-1] += plain
            if pattern[at : at + 1] == "+":
                runs.append("")
    if depth:
        return None
    longest = [max(runs, key=len) for runs in branches]
    return longest if min(map(len, longest)) >= _GRAM else None


def _keys(batches):
    """A row for each gram of each branch: rule, branch and gram; gram null if a rule has none."""
    for batch in batches:
        out: list[tuple] = []
        for rule, pattern in zip(batch.column("rule").to_pylist(), batch.column("pattern").to_pylist(), strict=True):
            texts = literals(pattern)
            if texts is None:
                out.append((rule, pattern, None, None))
            else:
                out.extend((rule, pattern, k, g) for k, t in enumerate(texts) for g in sorted({t[i : i + _GRAM] for i in range(len(t) - _GRAM + 1)}))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["rule", "pattern", "branch", "gram"])


def _grams(text: str) -> Column:
    """The distinct runs of three characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def _path_pattern(globs: str) -> Column:
    """One pattern of all globs of a rule: two stars cross directories, one stays within."""

    def one(g: Column) -> Column:
        plain = F.regexp_replace(g, r"([\\.^$+?()\[\]{}|])", r"\\$1")
        return F.replace(F.replace(F.replace(plain, F.lit("**"), F.lit("\x00")), F.lit("*"), F.lit("[^/]*")), F.lit("\x00"), F.lit(".*"))

    return F.concat(F.lit("^(?:"), F.array_join(F.transform(globs, one), "|"), F.lit(")$"))


def _bytes(df: DataFrame, *names: str) -> int:
    return df.agg(F.sum(sum((F.octet_length(n) for n in names), F.lit(64)))).first()[0] or 0


def violations(lines: DataFrame, rules: DataFrame, found: DataFrame | None = None, *, broadcast_bytes: int = 16 << 20, open_bytes: int = 64 << 10) -> DataFrame:
    """Distinct rule, path, line where a rule's pattern occurs in its paths and no exemption stands on the line or the one before.

    ``rules`` has rule, pattern and globs (an array of strings), thousands of rows or more.  Each branch of a pattern is
    filed under that run of three characters of its literal text which the fewest lines have, counted over all lines.
    A line meets the rules filed under its own runs, and these alone are tested as patterns.  Up to ``broadcast_bytes``
    the file goes to all tasks and lines do not move; beyond that runs and file are joined by run, without the texts,
    which come back by path and line.  Patterns without literal text of three characters (open ones) are tested on
    every line, at most ``open_bytes`` of them in one pass.

    Null texts and paths, rules with a null and rules without globs give nothing; rules of one name are united, as are
    repeated lines.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = lines.sparkSession
    work = Scratch(spark, "rules")
    text = lines.select(F.col("path").cast("string").alias("path"), F.col("line").cast("long").alias("line"), F.col("text").cast("string").alias("text"))
    text = text.where(F.col("path").isNotNull() & F.col("line").isNotNull() & ~F.col("text").rlike(tracker.EXEMPT))
    listed = rules.select("rule", "pattern", F.filter("globs", lambda g: g.isNotNull()).alias("globs")).where("rule is not null and pattern is not null and size(globs) > 0")
    listed = work.keep("rules", listed.select("rule", "pattern", _path_pattern("globs").alias("paths")).distinct())
    keys = work.keep("keys", listed.select("rule", "pattern").distinct().mapInArrow(_keys, "rule string, pattern string, branch int, gram string"))
    filed = keys.where("gram is not null")
    seen = text.select(F.explode(_grams("text")).alias("gram")).join(_small(filed.select("gram").distinct(), broadcast_bytes, "gram"), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(seen, "gram", "left").groupBy("rule", "pattern", "branch").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    # A run that no line has leads nowhere, so its branch cannot match.
    file = work.keep("file", rarest.where("g.n > 0").select("rule", "pattern", F.col("g.gram").alias("gram")).distinct().join(listed, ["rule", "pattern"]))
    test = F.rlike("text", F.col("pattern")) & F.rlike("path", F.col("paths"))
    if _bytes(file, "rule", "pattern", "paths", "gram") <= broadcast_bytes:
        hits = text.select("*", F.explode(_grams("text")).alias("gram")).join(F.broadcast(file), "gram").where(test)
    else:
        met = text.select("path", "line", F.explode(_grams("text")).alias("gram")).join(file.select("gram", "rule", "pattern", "paths"), "gram")
        met = met.where(F.rlike("path", F.col("paths"))).drop("gram").distinct()
        hits = text.join(met, ["path", "line"]).where(test)
    parts = [hits.select("rule", "path", "line")]
    unfiled = keys.where("gram is null").select("rule", "pattern").join(listed, ["rule", "pattern"])
    count = -(-_bytes(unfiled, "rule", "pattern", "paths") // open_bytes)
    number = F.pmod(F.xxhash64("rule", "pattern", "paths"), F.lit(max(1, count)))
    for k in range(count):
        some = unfiled.where(number == k).collect()
        tests = [F.when(F.col("text").rlike(r.pattern) & F.col("path").rlike(r.paths), F.lit(r.rule)) for r in some]
        if tests:
            parts.append(text.select(F.explode(F.array_compact(F.array(*tests))).alias("rule"), "path", "line"))
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    exempt = (found if found is not None else tracker.tags(lines)).where("kind = 'exempt'").select(F.col("id").alias("rule"), "path", F.explode(F.array(F.col("line").cast("long"), F.col("line").cast("long") + 1)).alias("line"))
    return raw.distinct().join(exempt, ["rule", "path", "line"], "left_anti")


def _small(df: DataFrame, limit: int, *names: str) -> DataFrame:
    return F.broadcast(df) if _bytes(df, *names) <= limit else df
