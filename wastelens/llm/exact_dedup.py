"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

* Texts are equal when identical after each run of blanks became one space; null counts as empty.
* A hash group whose bytes differ is split: the grouping key is (hash, bytes), so a collision never
  merges two texts. Copies collapse in the map-side half of the aggregation, so that a text that
  fills a third of all rows leaves every task as one row.
* Rows with the same id and the same text are one document seen twice: all of them are kept.
* An empty table gives an empty result. Null ids never win against an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import common


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{common.BLANKS}]+", " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The bytes of each text are shuffled once, with its hash, to be compared; the way back from a group
    to its members carries digests alone. Two different texts that shared both digests would stop the
    job instead of being merged.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    rows = rows.select("doc_id", "_text", content_hash(F.col("_text")).alias("_hash"))
    classes = rows.groupBy("_hash", "_text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("_hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    classes = classes.groupBy("_hash", "text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    classes = classes.select(
        F.col("_hash").alias("_h"), F.col("text_sha256").alias("_s"), "keep_id",
        F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("two different texts share both digests"))).alias("group_size"))
    members = rows.select("doc_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    joined = members.join(classes, (F.col("_hash") == F.col("_h")) & (F.col("text_sha256") == F.col("_s")))
    return joined.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Ids must be unique and not null."""
    keep = copies(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    packed = docs.select(common.whole_row(docs).alias("_row"))
    return packed.join(keep, F.col("_row").getField(id_col) == F.col("_kept_id"), "left_semi").select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT doc_id, sha256(body) AS text_sha256, min(doc_id) OVER (PARTITION BY body) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g"""}
