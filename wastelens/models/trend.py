"""Piecewise-linear trend plus weekly and yearly Fourier terms. Bends have a Laplace prior, so that most are exactly zero,
seasons a normal one; the fit is the penalised least-squares problem of both over the sums of one series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.models.gram import dot, double_array, gram_sums, int_array, unpacked

KNOTS, WEEKLY, YEARLY = 8, 3, 4
WEEKLY_FROM, YEARLY_FROM, MULTIPLICATIVE_FROM = 14, 365, 60
WIDTH = 2 + KNOTS + 2 * WEEKLY + 2 * YEARLY
BENDS = slice(2, 2 + KNOTS)
LEAST_NOISE = 0.01  # of the largest value: a bend must be worth as much against a history without noise
SWEEPS, SETTLED = 5000, 1e-10


def design(t: Column, day: Column) -> list[Column]:
    """Constant, time, hinges over the first 80 % of the history, weekly and yearly waves."""
    hinges = [F.greatest(F.lit(0.0), t - 0.8 * j / (KNOTS + 1)) for j in range(1, KNOTS + 1)]

    def waves(period: float, order: int) -> list[Column]:
        out = []
        for k in range(1, order + 1):
            angle = day * (2 * math.pi * k / period)
            out += [F.sin(angle), F.cos(angle)]
        return out

    return [F.lit(1.0), t, *hinges, *waves(7.0, WEEKLY), *waves(365.25, YEARLY)]


def _day(fecha: Column) -> Column:
    return F.unix_date(fecha).cast("double")


def rows_with_target(train: DataFrame, keys: list[str], multiplicative: bool | None = None) -> DataFrame:
    part = W.partitionBy(*keys)
    multi = F.col("n") >= MULTIPLICATIVE_FROM if multiplicative is None else F.lit(multiplicative)
    return train.withColumns({
        "n": F.count("*").over(part), "t": F.row_number().over(part.orderBy("fecha")) / F.count("*").over(part),
    }).withColumn("multi", multi).withColumn(
        "target", F.when(F.col("multi"), F.log1p("cantidad")).otherwise(F.col("cantidad")))


def normal_sums(train: DataFrame, keys: list[str], multiplicative: bool | None = None) -> DataFrame:
    rows = rows_with_target(train, keys, multiplicative)
    return gram_sums(rows, keys, [*design(F.col("t"), _day(F.col("fecha"))), F.col("target")])


def bends_of(matrix: np.ndarray, target: np.ndarray, price: np.ndarray) -> np.ndarray:
    """The least b'Mb / 2 - b'c + price * |b|_1 of every row, by coordinate descent over all rows at once."""
    bends = np.zeros_like(target)
    diagonal = np.einsum("sii->si", matrix)
    sound = diagonal > 1e-12 * np.maximum(diagonal.max(1, keepdims=True), 1e-300)
    curve = np.where(sound, diagonal, 1.0)
    for _ in range(SWEEPS):
        most = np.zeros(len(bends))
        for j in range(bends.shape[1]):
            pull = target[:, j] - (matrix[:, j] * bends).sum(1) + diagonal[:, j] * bends[:, j]
            new = np.where(sound[:, j], np.sign(pull) * np.maximum(np.abs(pull) - price, 0.0) / curve[:, j], 0.0)
            most = np.maximum(most, np.abs(new - bends[:, j]))
            bends[:, j] = new
        if (most <= SETTLED * np.maximum(np.abs(bends).max(1), 1.0)).all():
            break
    return bends


_FIT = T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("sse", T.DoubleType())])


@F.pandas_udf(_FIT)
def solve_bends(gram: pd.Series, take: pd.Series, ridge: pd.Series, scale: pd.Series, prior: pd.Series) -> pd.DataFrame:
    """Coefficients (zero outside ``take``) and squared error of each series.

    With noise variance v from the fit without a price, a bend costs v / (prior * scale) per unit, which is the most likely
    fit under a Laplace prior of width ``prior`` on bends of a series scaled to one. Columns other than bends are eliminated first.
    """
    out: list = [(None, None)] * len(gram)
    ready, parts = [], []
    for i, packed in enumerate(gram):
        if packed is None or np.isnan(scale.iloc[i]):
            continue
        full = unpacked(packed)
        n, columns = full[0, 0], np.asarray(take.iloc[i], int)
        free = columns[(columns < BENDS.start) | (columns >= BENDS.stop)]
        if n <= 2 or not np.isfinite(full).all():
            continue
        xx, xy = full[:-1, :-1] + np.diag(np.asarray(ridge.iloc[i], float)), full[:-1, -1]
        whole = np.linalg.pinv(xx[np.ix_(columns, columns)], rcond=1e-12, hermitian=True) @ xy[columns]
        error = full[-1, -1] - 2 * whole @ xy[columns] + whole @ full[np.ix_(columns, columns)] @ whole
        noise = max(error / max(n - len(columns), 1), (LEAST_NOISE * scale.iloc[i]) ** 2, 0.0)
        inner = np.linalg.pinv(xx[np.ix_(free, free)], rcond=1e-12, hermitian=True)
        across = xx[BENDS][:, free] @ inner
        ready.append(i)
        parts.append((full, xx, xy, free, inner, xx[BENDS, BENDS] - across @ xx[free][:, BENDS], xy[BENDS] - across @ xy[free],
                      noise / (prior.iloc[i] * scale.iloc[i]) if scale.iloc[i] > 0 else 0.0))
    if ready:
        bends = bends_of(np.stack([p[5] for p in parts]), np.stack([p[6] for p in parts]), np.array([p[7] for p in parts]))
        for i, b, (full, xx, xy, free, inner, *_) in zip(ready, bends, parts, strict=True):
            coef = np.zeros(len(xy))
            coef[BENDS] = b
            coef[free] = inner @ (xy[free] - xx[free][:, BENDS] @ b)
            error = full[-1, -1] - 2 * coef @ xy + coef @ full[:-1, :-1] @ coef
            out[i] = (coef.tolist(), max(float(error), 0.0))
    return pd.DataFrame(out, columns=["coef", "sse"])


def fit(train: DataFrame, keys: list[str], changepoint_prior_scale: float = 0.05, seasonality_prior_scale: float = 10.0,
        multiplicative: bool | None = None, weekly: bool = True) -> DataFrame:
    """Coefficients per key. Seasons enter only when the history is long enough for them."""
    multi = F.col("n") >= MULTIPLICATIVE_FROM if multiplicative is None else F.lit(multiplicative)
    size = train.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("fecha").alias("fin"), F.max(F.abs("cantidad")).alias("mayor"))
    size = size.withColumn("mayor", F.when(multi, F.log1p("mayor")).otherwise(F.col("mayor")).cast("double"))
    base = range(2 + KNOTS)
    week = range(2 + KNOTS, 2 + KNOTS + 2 * WEEKLY)
    year = range(2 + KNOTS + 2 * WEEKLY, WIDTH)
    none = F.array().cast("array<int>")
    take = F.concat(
        int_array(base), F.when(F.lit(weekly) & (F.col("n") >= WEEKLY_FROM), int_array(week)).otherwise(none),
        F.when(F.col("n") >= YEARLY_FROM, int_array(year)).otherwise(none))
    ridge = [1e-8] * (2 + KNOTS) + [1 / seasonality_prior_scale] * (WIDTH - 2 - KNOTS)
    sums = normal_sums(train, keys, multiplicative).join(size, keys)
    fitted = solve_bends("gram", take, double_array(ridge), F.col("mayor"), F.lit(float(changepoint_prior_scale)))
    return sums.withColumn("fit", fitted).select(
        *keys, "n", "fin", multi.alias("multi"), F.col("fit.coef").alias("coef"), F.col("fit.sse").alias("sse"))


def forecast(fitted: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    ahead = fitted.join(heads.select(*keys, "h"), keys).withColumn("paso", F.explode(F.sequence(F.lit(1), F.col("h"))))
    t = (F.col("n") + F.col("paso")) / F.col("n")
    value = dot(F.col("coef"), F.array(*design(t, _day(F.col("fin")) + F.col("paso"))))
    # A log-scale path is kept inside the range of a double; beyond it the forecast is useless anyway.
    value = F.when(F.col("multi"), F.expm1(F.least(value, F.lit(50.0)))).otherwise(value)
    return ahead.withColumn("v", value).select(
        *keys, "paso", F.when(F.col("v").isNotNull(), F.greatest(F.lit(0.0), F.col("v"))).alias("yhat"))


def fit_predict(train: DataFrame, heads: DataFrame, keys: list[str], **options) -> DataFrame:
    return forecast(fit(train, keys, **options), heads, keys)
