"""Reference forecasts that need no fitting: the yardsticks every model is scored against.

All of them follow from the state of a series at its last training row: running mean, last
value, means of the last 7 and 14 rows and the last seven values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.operators.series import fold_table, holdout_size, indexed

NAIVE = ["media", "ultimo", "media_7", "media_14", "estacional_7"]


def states(series: DataFrame) -> DataFrame:
    """State of every row as if it were the last training row."""
    w = W.partitionBy("serie").orderBy("fecha")
    mean = lambda k: F.avg("cantidad").over(w.rowsBetween(1 - k, 0))
    return indexed(series).withColumns({
        "media": F.avg("cantidad").over(w.rowsBetween(W.unboundedPreceding, 0)), "ultimo": F.col("cantidad"),
        "media_7": mean(7), "media_14": mean(14),
        "semana": F.collect_list("cantidad").over(w.rowsBetween(-6, 0)),
        "previo": F.lag("cantidad").over(w)})


def _long(rows: DataFrame, keys: list[str], step: Column) -> DataFrame:
    """One row per model; ``step`` counts from 1 after the last training row."""
    season = F.get(F.col("semana"), F.pmod(step - 1, F.size("semana")))
    models = [F.struct(F.lit(m).alias("modelo"), (season if m == "estacional_7" else F.col(m)).alias("yhat")) for m in NAIVE]
    return rows.select(*keys, "fecha", "y", "previo", F.explode(F.array(*models)).alias("m")).select(
        *keys, "m.modelo", "fecha", "y", "m.yhat", "previo")


def holdout_predictions(series: DataFrame, min_days: int = 30) -> DataFrame:
    """Test rows of the 80/20 split with every naive forecast."""
    rows = states(series).filter(F.col("n") >= min_days).withColumn("n_train", holdout_size(F.col("n")))
    state = rows.filter("idx = n_train").select("serie", *NAIVE[:4], "semana")
    test = rows.filter("idx > n_train").select(
        "serie", "fecha", F.col("cantidad").alias("y"), "previo", (F.col("idx") - F.col("n_train")).alias("paso"))
    return _long(test.join(state, "serie"), ["serie"], F.col("paso"))


def fold_predictions(series: DataFrame, k: int = 5) -> DataFrame:
    """Validation rows of the walk-forward folds. Blocks are disjoint, so a row belongs to one
    fold at most and the join is an equi-join on (series, fold)."""
    folds = fold_table(series, k)
    rows = states(series)
    state = rows.join(folds.select("serie", "fold", "n_train"), "serie").filter("idx = n_train").select(
        "serie", "fold", "n_train", *NAIVE[:4], "semana")
    shape = folds.groupBy("serie").agg(F.max("k").alias("k"), F.max("n_val").alias("n_val"))
    block = (F.col("k") - F.floor((F.col("n") - F.col("idx")) / F.col("n_val"))).cast("int")
    val = rows.join(shape, "serie").withColumn("fold", block).filter("fold >= 1").select(
        "serie", "fold", "fecha", "idx", F.col("cantidad").alias("y"), "previo")
    return _long(val.join(state, ["serie", "fold"]), ["serie", "fold"], F.col("idx") - F.col("n_train"))


def window_candidates(series_split: DataFrame, windows: list[int]) -> DataFrame:
    """Mean-of-the-last-w candidates on the tuning split (``n_train`` from ``tuning_split``):
    long rows of (series, candidate, y, yhat)."""
    back = F.col("n_train") - F.col("idx")
    train = F.col("idx") <= F.col("n_train")
    sums = series_split.filter(train).groupBy("serie").agg(
        *[F.avg(F.when(back < w, F.col("cantidad"))).alias(f"w{w}") for w in windows])
    options = F.explode(F.array(*[F.struct(F.lit(w).alias("ventana"), F.col(f"w{w}").alias("yhat")) for w in windows]))
    val = series_split.withColumn("previo", F.lag("cantidad").over(W.partitionBy("serie").orderBy("fecha"))).filter(~train)
    return val.join(sums.select("serie", options.alias("o")), "serie").select(
        "serie", "fecha", "o.ventana", F.col("cantidad").alias("y"), "o.yhat", "previo")
