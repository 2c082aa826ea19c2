"""Connected components by alternating large-star and small-star rounds, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node of its component.

    Self-links and repeated links are allowed, links with a null end are ignored; a node without links to others does
    not appear unless it links to itself.  An empty input gives no rows.  Each round halves the longest way at least,
    so the rounds grow with the logarithm of the size.  Each is written as a table, and the one before is removed then,
    so the store holds one.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    loops = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep("links", _down(ends))
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state.n == 0 or state == before:
            break
        before = state
        now = scratch.keep("links", _small_star(_large_star(now)))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return every.unionByName(loops.select("node", F.col("node").alias("root")).join(every.select("node"), "node", "left_anti"))


def _down(pairs: DataFrame) -> DataFrame:
    """Distinct links, from the larger end a to the smaller b."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours link to the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _down(links.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, link to the smallest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    return _down(links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))))
