"""Shared pieces: table access, packed rows, and running positions that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wastelens.session import cut_lineage

BLANKS = r"\x20\x09-\x0D"  # fixed by the contracts: the characters between words
WORD = rf"[^{BLANKS}]+"
BUCKETS = 4096
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def running_before(rows: DataFrame, group: str, bucket: str, order: list[str], value: Column, out: str,
                   total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that stand earlier.

    Rows stand by (bucket, order). A group of any size is spread over its buckets: each is summed on
    its own, the bucket sums (at most ``BUCKETS`` a group) give every bucket its offset, and only
    the rows of one bucket meet in one window. ``rows`` is read twice, so hand in a written table.
    Keys must not be null. ``total`` names a further column with the sum of the whole group.
    """
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    by_bucket = Window.partitionBy(group).orderBy(bucket)
    offsets = sums.select(
        F.col(group).alias("_g"), F.col(bucket).alias("_b"),
        (F.sum("_sum").over(by_bucket) - F.col("_sum")).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(group)).alias("_total"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out_rows = (
        rows.join(offsets, (F.col(group) == F.col("_g")) & (F.col(bucket) == F.col("_b")))
        .withColumn(out, F.col("_offset") + F.sum(value).over(inside) - value))
    if total:
        out_rows = out_rows.withColumn(total, F.col("_total"))
    return out_rows.drop("_g", "_b", "_offset", "_total")


def skew_join(many: DataFrame, few: DataFrame, keys: list[str], weight: str, total: int | None = None,
              wanted: Column | None = None) -> DataFrame:
    """Inner join of ``many`` with ``few`` on keys that are unique in ``few`` and never null; ``weight`` is the number of rows a key has in ``many``.

    Keys that hold at least 1 / ``HOT_KEYS`` of all rows are broadcast: their weights add up to at most the total, so there
    are at most ``HOT_KEYS`` of them. Their rows never meet in one task, and no key of the shuffled rest is hot.
    ``wanted`` may thin out the rest; hot keys are matched whether wanted or not, as their rows must not be shuffled.
    Both sides are read twice, so hand in written tables.
    """
    if total is None:
        total = few.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS >= total
    hot, rest = few.filter(is_hot), few.filter(~is_hot)
    if wanted is not None:
        rest = rest.filter(wanted)
    return many.join(F.broadcast(hot), keys).unionByName(
        many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def fresh(columns: list[str], name: str) -> str:
    """A column name that clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["BLANKS", "BUCKETS", "WORD", "cut_lineage", "fresh", "running_before", "skew_join", "table", "text_or_empty", "whole_row"]
