"""Exact dedup: groups by 128-bit content hash, bytes compared inside the groups.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import fresh, lower_ascii


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical (after lower-casing A-Z if ``fold_case``).  ``keep`` says which id
    of a group stays.  The aggregation's key is (MD5, text): rows are dealt and first compared by hash, and the
    aggregation then compares the bytes, so texts that collide in MD5 form groups of their own.  It combines on the
    map side, so a group that holds a third of all rows leaves each task as one row.  A group's text is dropped right
    after; its rows find it again by SHA-256, of which no two texts are known to agree, in a join whose large side
    Spark may split.

    Null text counts as empty.  A null id takes part with its text; it is kept only if the group has no other id.
    Rows that repeat an id and text are one document: all get the same ``kept``.  A text of any length is one value of
    one row.  Columns other than the two named are ignored, whatever their names.  An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    norm = docs.select(F.col(f"`{id_col}`").alias("id"), (lower_ascii(text) if fold_case else text).alias("norm"))
    keyed = norm.select("id", "norm", F.md5(F.encode("norm", "UTF-8")).alias("h"))
    pick = F.max if keep == "largest" else F.min
    sha = F.sha2(F.encode("norm", "UTF-8"), 256).alias("s")
    groups = keyed.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), pick("id").alias("keep_id")).select(sha, "group_size", "keep_id")
    rows = norm.select("id", sha)
    return rows.join(groups, "s").select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("s").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of ids that repeat, all rows if one of them stays."""
    found = exact_dedup(docs, id_col=id_col, text_col=text_col, fold_case=fold_case, keep=keep)
    name = fresh(docs, "kept_id")
    return docs.join(found.where("kept").select(F.col(f"`{id_col}`").alias(name)).distinct(), F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_semi")
