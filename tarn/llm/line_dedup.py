"""Line dedup by site-relative frequency.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, fresh

#: A line of one page only is not repeated, so it is no boilerplate however few pages the host has.
RATIO, MIN_PAGES = 0.02, 2
#: Parts that a host's keys are dealt to by their first two hex digits, so that a look-up goes through few of them.
PARTS = 256


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\n")


def _key(line: Column) -> Column:
    """128-bit key of a line without outer spaces."""
    return F.md5(F.encode(F.trim(line), "UTF-8"))


def _part(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("int")


def boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line key, pages that have the line, pages of the host) of lines on more than ``ratio`` of a host's pages."""
    pages = docs.select(F.col(f"`{host_col}`").cast("string").alias("host"), F.array_distinct(F.transform(F.filter(_lines(text_col), lambda x: F.trim(x) != ""), _key)).alias("lines"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    same = counts["host"].eqNullSafe(totals["host"])
    return counts.join(totals, same).where(F.col("n") > F.col("total") * F.lit(ratio)).select(counts["host"], "line", "n", "total")


def _marked(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, broadcast_bytes: int) -> tuple[DataFrame, str, str]:
    """``docs`` with all lines and those that stay, as arrays under names that ``docs`` does not have."""
    found = boilerplate(docs, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages)
    parts = found.groupBy("host", _part(F.col("line")).alias("part")).agg(F.collect_list("line").alias("lines"))
    hosts = parts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("part", "lines"))).alias("m"), F.sum(F.size("lines")).alias("n"))
    none = F.array().cast("array<string>")
    table = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.coalesce(F.col("m")[k], none))
    host, bad, every, kept = (fresh(docs, x) for x in ("host_", "bad_", "all_", "kept_"))
    small = checkpointed(hosts.select(F.col("host").alias(host), table.alias(bad), "n"))
    size = small.agg(F.sum(F.col("n") * 40 + 16 * PARTS)).first()[0] or 0
    small = small.drop("n")
    side = F.broadcast(small) if size <= broadcast_bytes else small
    joined = docs.join(side, F.col(f"`{host_col}`").cast("string").eqNullSafe(F.col(host)), "left")
    joined = joined.withColumn(every, F.when(F.col(f"`{text_col}`").isNull(), none).otherwise(_lines(text_col)))

    def stays(x: Column) -> Column:
        key = _key(x)
        return (F.trim(x) == "") | ~F.array_contains(F.get(F.col(bad), _part(key)), key)

    return joined.withColumn(kept, F.when(F.col(bad).isNull(), F.col(every)).otherwise(F.filter(every, stays))), every, kept


def line_dedup(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """``docs``, all its columns and rows, with boilerplate lines taken out of the text.

    Pages are the rows, hosts the values of ``host_col``; null is a host of its own.  A line (between \\n, outer spaces
    aside) is boilerplate on a host when more than ``ratio`` of its pages have it, and at least ``min_pages``: without
    that floor every line of a host with fewer than 1 / ratio pages would be dropped, repeated or not.  Several times
    on a page count once; pages that repeat, and pages of one id, are pages of their own.  Blank lines are never
    dropped.  Null text stays null and has no lines, empty text stays empty.  A text of any length is one row and one
    page, its lines are counted apart.

    A host has at most (lines of its average page) / ratio boilerplate lines, whatever the number of its pages, so each
    host's make one array, dealt to PARTS arrays by key.  Their size is summed; up to ``broadcast_bytes`` they are
    broadcast, beyond that joined by host, where Spark may split the pages of a large host.  Columns may have any
    names; an empty table stays empty.
    """
    out, _, kept = _marked(docs, host_col, text_col, ratio, min_pages, broadcast_bytes)
    text = F.when(F.col(f"`{text_col}`").isNotNull(), F.array_join(kept, "\n")).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def line_counts(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: its id, n_lines, n_dropped, and the text that `line_dedup` leaves (null stays null)."""
    out, every, kept = _marked(docs, host_col, text_col, ratio, min_pages, broadcast_bytes)
    text = F.when(F.col(f"`{text_col}`").isNotNull(), F.array_join(kept, "\n")).alias("text")
    return out.select(F.col(f"`{id_col}`").alias(id_col), F.size(every).cast("long").alias("n_lines"), (F.size(every) - F.size(kept)).cast("long").alias("n_dropped"), text)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
