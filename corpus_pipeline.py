"""A corpus pipeline of five stages; each works on all that the one before kept.

Stages decide about rows, not about ids: rows that repeat an id or have none are judged by their own text.  Texts of any
length are whole values in each stage; null and empty ones have no words, lines or tokens.  All stages but the last
return the columns of their input, whatever they are called; an empty input gives an empty output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe import bpe_decode, bpe_encode
from tarn.llm.common import checkpointed, fresh, shared_base, table
from tarn.llm.decontaminate import without_contaminated
from tarn.llm.jaccard_join import jaccard_join
from tarn.llm.line_dedup import line_dedup
from tarn.llm.queries import vocabulary
from tarn.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is not predicted to be toxic.

    A null or empty text scores as such texts do; repeated rows stay or go together.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the boilerplate lines of their source; n_chars is counted again, if there is such a column.

    Null text stays null and counts 0 characters; rows without a source are a source of their own; repeated rows are
    pages of their own.
    """
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest id, of equal ids that with the smallest text digest.

    A null id is larger than all others.  Rows without words are copies of nothing, so all of them stay.  Where ids are
    distinct they name the rows; where some repeat or are null, rows are numbered first, in a table written for that.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1 or id is null").limit(1).count():
        name = fresh(docs, "kept_id")
        kept = jaccard_join(docs).where("doc_id = component_id").select(F.col("doc_id").alias(name))
        return docs.join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    row = fresh(docs, "row")
    numbered = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_join(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("r"), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("digest"), F.col(row).alias("r"))
    ranked = numbered.select(rank.alias("rank")).join(found, F.col("rank.r") == F.col("r"))
    kept = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.r").alias(row))
    return numbered.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text no benchmark item contaminates; null and empty texts stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: doc_id, token ids, their number, and the text that they decode to (null and empty: no ids, "")."""
    decoded = bpe_decode(bpe_encode(docs, vocabulary()), vocabulary())
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("decoded", "UTF-8").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE encoding and decoding", tokens),
]
#: Learned scores and links between documents are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_base(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
