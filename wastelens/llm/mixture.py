"""Mixing sources to target weights: capped water-filling and seeded repetitions.

* Size is the number of words; a null text has none. A null source is a source of its own.
* Water-filling: every source asks for its weight's share of the total. Sources over their cap
  (``max_epochs`` times their size) are clamped and the excess is shared again by weight, until none is
  over. Clamping goes by rising cap per weight, so the level where it ends is the largest of
  (total - caps clamped before) / (weights not clamped before): one sort of the source table instead
  of a loop of jobs.
* Repetitions: with a quota of q words and s words in the source, every document is taken q div s times;
  the remaining q mod s words are taken from whole documents in a seeded order, and the one document
  where they end gives its first words. So each source meets its rounded target exactly, reruns
  agree, and no document is taken more than ``max_epochs`` times.
* Ties and repeated rows: rows with the same id stand next to each other and count one by one.
  A source without words gets target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wastelens.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-17:"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Never null, one value per source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def cycled_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight``: the given weights in turn, sources by code point, null last. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    return sizes.withColumn("weight", F.get(choice, F.pmod(place, F.lit(len(weights)))))


def water_fill(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows (source, source_size, weight): shares of the total of all sizes.

    The windows run over one row per source, the table a mixing recipe lists.
    """
    cap = F.col("source_size") * max_epochs
    every = Window.partitionBy()
    rising = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    total, weights = F.sum("source_size").over(every), F.sum("weight").over(every)
    level = (total - (F.sum(cap).over(rising) - cap)) / (weights - (F.sum("weight").over(rising) - F.col("weight")))
    return (
        sizes.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
        .withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("_level"))).drop("_level"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        keep_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken; with ``keep_rows`` also ``_row``.

    ``weights`` (source, weight) states the recipe, every weight above 0 and every source listed once; without
    it the default weights go round.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    kept = [common.whole_row(docs).alias("_row")] if keep_rows else []
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_order"), *kept)
    rows = common.cut_lineage(
        rows.withColumn("_source", _key(F.col("source"))).withColumn(
            "_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")), "mixture")
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn(
        "source", F.when(F.col("_source") != "", F.substr("_source", F.lit(2))))
    if weights is None:
        sizes = cycled_weights(sizes)
    else:
        listed = weights.select(_key(F.col("source")).alias("_w"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(listed, F.col("_source") == F.col("_w")).drop("_w")
    targets = water_fill(sizes, max_epochs)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("_quota div nullif(source_size, 0)")).otherwise(F.lit(0))
    recipe = targets.withColumn("_quota", quota).withColumn("_whole", whole).select(
        F.col("_source").alias("_s"), "source_size", "target", "_whole",
        (F.col("_quota") - F.col("_whole") * F.col("source_size")).alias("_rest"))
    placed = common.running_before(rows, "_source", "_bucket", ["_order", "doc_id", "size"], F.col("size"), "_before")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("_rest") - F.col("_before")))
    return placed.join(recipe, F.col("_source") == F.col("_s")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + part).alias("taken"),
        *(["_row"] if keep_rows else []))


def repeated(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as taken, its columns unchanged.

    A last part of a document holds its first words with their blanks; ``n_chars``, where there is such
    a column, follows the cut. Documents without words are not taken.
    """
    rows = mix(docs, weights, max_epochs, seed, keep_rows=True).filter("size > 0 AND taken > 0")
    rows = rows.withColumn("_part", F.expr("taken % size")).withColumn("_times", F.expr("taken div size"))
    rows = rows.select("_row", "size", F.explode(F.concat(
        F.array_repeat(F.col("size"), F.col("_times").cast("int")),
        F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(F.array().cast("array<bigint>")))).alias("_words"))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(f"[{common.BLANKS}]*{common.WORD}"), F.lit(0))
    cut = F.when(F.col("_words") == F.col("size"), F.col("_row.text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), ""))
    row = F.col("_row").withField("text", cut)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("_row")).select("_row.*")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixture": op1_mixture}
ORACLES = {"op1_mixture": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-17:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER rising - 3 * source_size))::DOUBLE
             / (sum(weight) OVER () - (sum(weight) OVER rising - weight)) AS lev
      FROM w WINDOW rising AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * max(lev) OVER ()) AS target FROM l),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, CASE WHEN source_size > 0
             THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM d)
SELECT r.doc_id, r.size, q.source_size, q.target,
       (whole * size + least(size, greatest(0, quota - whole * q.source_size - before)))::BIGINT AS taken
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source"""}
