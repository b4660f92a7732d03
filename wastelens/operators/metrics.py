"""Forecast error metrics from a long table of actual and predicted values.

Input columns: the grouping keys, ``y``, ``yhat`` and ``previo`` (the actual value one step
before, which for the first scored row is the last training value; null when unknown).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.functions.scalar import steady_round

METRICS = ["mae", "rmse", "mape", "smape", "u_theil", "r2"]


def score(predictions: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """MAE, RMSE, MAPE, SMAPE, Theil's U2 and R2 per group, in one aggregation."""
    y, previous = F.col("y"), F.col("previo")
    p = F.greatest(F.lit(0.0), F.col("yhat"))
    half_clipped = (F.abs(y) + F.abs(p)) / 2
    sse, naive = F.sum(F.pow(y - p, 2)), F.when(previous.isNotNull(), F.pow(y - previous, 2))
    sums = predictions.filter(F.col("yhat").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
        (F.avg(F.when(y > 0, F.abs((y - p) / y))) * 100).alias("mape"),
        (F.avg(F.when(half_clipped > 0, F.abs(y - p) / half_clipped)) * 100).alias("smape"),
        F.sqrt(F.avg(F.when(previous.isNotNull(), F.pow(y - p, 2)))).alias("rm"), F.sqrt(F.avg(naive)).alias("rn"),
        sse.alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"))
    r2 = F.when(F.col("n") < 2, None).when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        *keys, "n", *[steady_round(F.col(c), digits).alias(c) for c in ("mae", "rmse", "mape", "smape")],
        steady_round(F.when(F.col("rn") > 1e-8, F.col("rm") / F.col("rn")), digits).alias("u_theil"),
        steady_round(r2, digits).alias("r2"))


def with_previous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``previo`` as the actual value of the row before, where no training value is known."""
    return rows.withColumn("previo", F.lag("y").over(W.partitionBy(*keys).orderBy("fecha")))


def ranked(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Position of every model: smallest MAE, ties by RMSE then SMAPE (missing counts as 0);
    models without an MAE stay unranked."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w = W.partitionBy(*keys, F.col("mae").isNull()).orderBy("mae", zero("rmse"), zero("smape"), "modelo")
    return scores.withColumn("posicion", F.when(F.col("mae").isNotNull(), F.row_number().over(w)))


def winners(scores: DataFrame, keys: list[str]) -> DataFrame:
    return ranked(scores, keys).filter("posicion = 1")


def across_folds(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation (n-1; 0 for one fold), minimum and maximum of each metric over the folds."""
    out = []
    for m in METRICS:
        sd = F.when(F.count(m) > 1, F.stddev_samp(m)).when(F.count(m) == 1, 0.0)
        out += [steady_round(F.avg(m), 4).alias(f"{m}_promedio"), steady_round(sd, 4).alias(f"{m}_desviacion"),
                F.min(m).alias(f"{m}_minimo"), F.max(m).alias(f"{m}_maximo")]
    return scores.groupBy(*keys).agg(F.count("mae").alias("folds"), *out)
