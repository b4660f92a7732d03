"""ARIMA in three steps: a long autoregression gives first innovations, the series is regressed on its own lags and on
lagged innovations for every order, and the coefficients of the best order are refined to the least conditional sum of
squares by Gauss-Newton steps. Estimates differ from full maximum likelihood by the first values, on which the sum is conditional."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.functions.pvalues import normal_two_sided
from wastelens.models.gram import dot, double_array, gram_sums, int_array, solve

MAX_ORDER = 3
LONG_AR = 10
DF_LAGS = 7
GATE = 0.05
# The published response surface of the Dickey-Fuller t-ratio with a constant (MacKinnon 1994). The normal quantile
# of its p-value is a polynomial of the ratio, one up to DF_SPLIT and one above; outside of DF_RANGE p is 0 or 1.
DF_RANGE, DF_SPLIT = (-18.83, 2.74), -1.61
DF_LOW = (2.1659, 1.4412, 0.038269)
DF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
WIDTH = 1 + 2 * MAX_ORDER
ROUNDS, HALVINGS, BLOCK = 12, 6, 256
ORDERS = [(p, q) for p in range(MAX_ORDER + 1) for q in range(MAX_ORDER + 1) if p + q > 0]


def _by(keys):
    return W.partitionBy(*keys).orderBy("fecha")


def _lags(column: str, keys, count: int) -> list[Column]:
    return [F.lag(column, k).over(_by(keys)) for k in range(1, count + 1)]


def quantile_of_ratio(t: Column) -> Column:
    """The normal quantile of the p-value of a Dickey-Fuller ratio with a constant; null outside of ``DF_RANGE``."""
    def polynomial(values):
        out = F.lit(0.0)
        for v in reversed(values):
            out = out * t + v
        return out

    return F.when(t.between(*DF_RANGE), F.when(t <= DF_SPLIT, polynomial(DF_LOW)).otherwise(polynomial(DF_HIGH)))


def p_of_ratio(t: Column) -> Column:
    """The p-value of the ratio; null stays null."""
    z = quantile_of_ratio(t)
    half = normal_two_sided(z) / 2
    return F.when(t < DF_RANGE[0], 0.0).when(t > DF_RANGE[1], 1.0).when(t.isNotNull(), F.when(z < 0, half).otherwise(1 - half))


def stationarity(train: DataFrame, keys: list[str], lags: int = DF_LAGS) -> DataFrame:
    """Dickey-Fuller t-ratio per key with ``lags`` lagged differences, its p-value, and the order of differencing it implies:
    0 below ``GATE``, else 1, also where the ratio cannot be computed."""
    step = train.withColumn("dy", F.col("cantidad") - F.lag("cantidad", 1).over(_by(keys)))
    rows = step.withColumns({"y1": F.lag("cantidad", 1).over(_by(keys)),
                             **{f"d{k}": F.lag("dy", k).over(_by(keys)) for k in range(1, lags + 1)}})
    design = [F.lit(1.0), F.col("y1"), *[F.col(f"d{k}") for k in range(1, lags + 1)], F.col("dy")]
    width = lags + 2
    fit = solve("gram", int_array(range(width)), double_array([0.0] * width))
    tested = gram_sums(rows, keys, design).withColumn("fit", fit).select(*keys, F.get("fit.t", F.lit(1)).alias("t"))
    ids = train.select(*keys).distinct()
    return ids.join(tested, keys, "left").withColumn("p", p_of_ratio(F.col("t"))).select(
        *keys, "t", "p", F.when(F.col("p") < GATE, 0).otherwise(1).alias("d"))


def differenced(train: DataFrame, keys: list[str], order: DataFrame) -> DataFrame:
    """The series differenced ``d`` times as ``w``, null on its first ``d`` days."""
    y, y1, y2 = F.col("cantidad"), F.lag("cantidad", 1).over(_by(keys)), F.lag("cantidad", 2).over(_by(keys))
    diff = F.when(F.col("d") == 0, y).when(F.col("d") == 1, y - y1).otherwise(y - 2 * y1 + y2)
    return train.join(order.select(*keys, "d"), keys).withColumns({"w": diff, "dy": y - y1})


def innovations(train: DataFrame, keys: list[str], order: DataFrame) -> DataFrame:
    """The differenced series ``w`` with its long-autoregression residuals ``e``.

    The long order is a quarter of the history, ``LONG_AR`` at most, so that folds of a few days are fitted too.
    Lags beyond it are zero and not solved for.
    """
    w = differenced(train, keys, order)
    size = F.count("*").over(W.partitionBy(*keys)) - F.col("d")
    w = w.withColumn("largo", F.least(F.lit(LONG_AR), F.greatest(F.lit(1), F.floor(size / 4))).cast("int"))
    used = [F.when(F.col("largo") >= k, lag).otherwise(0.0) for k, lag in enumerate(_lags("w", keys, LONG_AR), 1)]
    w = w.withColumn("x", F.array(F.lit(1.0), *used))
    design = [F.get("x", F.lit(i)) for i in range(LONG_AR + 1)] + [F.col("w")]
    solved = solve("gram", F.sequence(F.lit(0), F.col("largo")), double_array([0.0] * (LONG_AR + 1)))
    coef = gram_sums(w, [*keys, "largo"], design).withColumn("fit", solved)
    return w.join(coef.select(*keys, F.col("fit.coef").alias("c")), keys, "left").withColumn(
        "e", F.col("w") - dot(F.col("c"), F.col("x"))).select(*keys, "fecha", "cantidad", "d", "dy", "w", "e")


def order_fits(rows: DataFrame, keys: list[str], orders=None) -> DataFrame:
    """AIC and coefficients of every candidate order, from one matrix of sums per key."""
    lagged = rows.withColumns({**{f"w{k}": F.lag("w", k).over(_by(keys)) for k in range(1, MAX_ORDER + 1)},
                               **{f"e{k}": F.lag("e", k).over(_by(keys)) for k in range(1, MAX_ORDER + 1)}})
    design = [F.lit(1.0), *[F.col(f"w{k}") for k in range(1, MAX_ORDER + 1)],
              *[F.col(f"e{k}") for k in range(1, MAX_ORDER + 1)], F.col("w")]
    options = F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"),
                 int_array([0, *range(1, p + 1), *range(MAX_ORDER + 1, MAX_ORDER + 1 + q)]).alias("take"))
        for p, q in (orders or ORDERS)])
    sums = gram_sums(lagged, keys, design).withColumn("o", F.explode(options))
    fits = sums.withColumn("fit", solve("gram", "o.take", double_array([0.0] * WIDTH)))
    n, sse = F.col("fit.n"), F.col("fit.sse")
    aic = F.when(sse >= 0, n * F.log(F.greatest(sse, F.lit(1e-9)) / n) + 2 * (F.col("o.p") + F.col("o.q") + 2))
    return fits.select(*keys, "o.p", "o.q", aic.alias("aic"), F.col("fit.coef").alias("coef"))


def best_order(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest AIC; null when no candidate could be solved."""
    best = F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", "p", "q", "coef"))).alias("b")
    return fits.groupBy(*keys).agg(best).select(*keys, "b.*")


def residuals(w: np.ndarray, n: np.ndarray, p: np.ndarray, coef: np.ndarray, used: np.ndarray | None = None) -> tuple:
    """Innovations of every series (a row of ``w``, ``n`` values long) and their sum of squares; they count from day ``p`` on and
    are zero before. With ``used`` (the columns that may move) also the cross products of their derivatives and those with the innovations.
    """
    count, days = w.shape
    w = np.concatenate([np.zeros((count, MAX_ORDER)), w], 1)
    e, one = np.zeros_like(w), np.ones((count, 1))
    past = [np.zeros((count, WIDTH)) for _ in range(MAX_ORDER)]  # derivatives of the last innovations, newest first
    cross, pull = np.zeros((count, WIDTH, WIDTH)), np.zeros((count, WIDTH))
    for t in range(days):
        x = np.concatenate([one, w[:, t:t + MAX_ORDER][:, ::-1], e[:, t:t + MAX_ORDER][:, ::-1]], 1)
        live = (t >= p) & (t < n)
        error = np.where(live, w[:, t + MAX_ORDER] - (coef * x).sum(1), 0.0)
        e[:, t + MAX_ORDER] = error
        if used is not None:
            slope = -x * used
            for j, old in enumerate(past):
                slope -= coef[:, 1 + MAX_ORDER + j, None] * old
            slope = np.where(live[:, None], slope, 0.0)
            past = [slope, *past[:-1]]
            cross += slope[:, :, None] * slope[:, None, :]
            pull += slope * error[:, None]
    return e[:, MAX_ORDER:], (e * e).sum(1), cross, pull


def refine_block(w: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, coef: np.ndarray, rounds: int = ROUNDS):
    """Coefficients, innovations, and the sums of squares before and after at most ``rounds`` Gauss-Newton steps a series.

    A step is halved until the sum falls and left out if it never does, so no series ends worse than it starts.
    """
    lag = np.arange(MAX_ORDER)
    used = np.concatenate([np.ones((len(n), 1), bool), lag < p[:, None], lag < q[:, None]], 1)
    coef = np.where(used, coef, 0.0)
    with np.errstate(all="ignore"):
        start = sse = np.nan_to_num(residuals(w, n, p, coef)[1], nan=np.inf)
        active = np.flatnonzero(np.isfinite(sse))
        for _ in range(rounds):
            if not len(active):
                break
            at = active
            _, _, cross, pull = residuals(w[at], n[at], p[at], coef[at], used[at])
            sound = np.isfinite(cross).all((1, 2)) & np.isfinite(pull).all(1)
            at, cross, pull = at[sound], cross[sound], pull[sound]
            step = -(np.linalg.pinv(cross, rcond=1e-12, hermitian=True) @ pull[:, :, None])[:, :, 0]
            left, moved = np.arange(len(at)), np.zeros(len(at), bool)
            for halving in range(HALVINGS):
                rows = at[left]
                trial = coef[rows] + step[left] * used[rows] / 2 ** halving
                new = residuals(w[rows], n[rows], p[rows], trial)[1]
                better = new < sse[rows]
                gain = better & (sse[rows] - new > 1e-10 * sse[rows])
                coef[rows[better]], sse = trial[better], _put(sse, rows[better], new[better])
                moved[left[gain]] = True
                left = left[~better]
                if not len(left):
                    break
            active = at[moved]
        e = residuals(w, n, p, coef)[0]
    return coef, e, start, sse


def _put(values: np.ndarray, rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[rows] = new
    return out


_REFINED = T.StructType([
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("es", T.ArrayType(T.DoubleType())),
    T.StructField("inicio", T.DoubleType()), T.StructField("sce", T.DoubleType())])


@F.pandas_udf(_REFINED)
def refined(w: pd.Series, p: pd.Series, q: pd.Series, coef: pd.Series) -> pd.DataFrame:
    """Refined coefficients, the last innovations (newest first) and both sums of squares, for blocks of daily series."""
    out: list = [(None, None, None, None)] * len(w)
    ready = [i for i, (values, c) in enumerate(zip(w, coef, strict=True)) if c is not None and values is not None and len(values)]
    for start in range(0, len(ready), BLOCK):
        part = ready[start:start + BLOCK]
        n = np.array([len(w.iloc[i]) for i in part])
        filled = np.zeros((len(part), int(n.max())))
        for row, i in enumerate(part):
            filled[row, :n[row]] = w.iloc[i]
        order = [s.iloc[part].to_numpy().astype("i8") for s in (p, q)]
        found, e, before, after = refine_block(filled, n, *order, np.array([coef.iloc[i] for i in part], "f8"))
        for row, i in enumerate(part):
            last = e[row, max(0, n[row] - MAX_ORDER):n[row]][::-1]
            out[i] = (found[row].tolist(), last.tolist(), float(before[row]), float(after[row]))
    return pd.DataFrame(out, columns=["coef", "es", "inicio", "sce"])


def fit(train: DataFrame, keys: list[str], orders=None, d: int | None = None) -> DataFrame:
    """Order, AIC of the search, refined coefficients and the end-of-history state per key: a row of parameters that
    is all a forecast needs. ``inicio`` and ``sce`` are the sums of squares before and after refinement."""
    order = train.select(*keys).distinct().withColumn("d", F.lit(d)) if d is not None else stationarity(train, keys)
    by_day = F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("fecha", "w"))))
    state = differenced(train, keys, order).groupBy(*keys).agg(
        F.transform(by_day, lambda s: s["w"]).alias("w"),
        F.max_by("cantidad", "fecha").alias("nivel"), F.max_by("dy", "fecha").alias("delta"), F.max("fecha").alias("fin"), F.max("d").alias("d"))
    chosen = best_order(order_fits(innovations(train, keys, order), keys, orders), keys)
    rows = state.join(chosen, keys, "left").withColumn("r", refined("w", "p", "q", "coef"))
    last = F.reverse(F.slice("w", F.greatest(F.lit(1), F.size("w") - MAX_ORDER + 1), MAX_ORDER))
    return rows.select(*keys, last.alias("ws"), "r.es", "nivel", "delta", "fin", "d", "aic", "p", "q", "r.coef", "r.inicio", "r.sce")


def forecast(fitted: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Recursive forecast: future innovations are zero, a differenced series is summed back."""
    zero = F.struct(F.col("ws").alias("ws"), F.col("es").alias("es"), F.col("nivel").alias("nivel"), F.col("delta").alias("delta"),
                    F.array().cast("array<double>").alias("out"))

    def step(acc, _):
        x = F.concat(F.array(F.lit(1.0)), acc["ws"], acc["es"])
        w = dot(F.col("coef"), x)
        delta = F.when(F.col("d") == 2, acc["delta"] + w).otherwise(w)
        level = F.when(F.col("d") == 0, w).otherwise(acc["nivel"] + delta)
        shift = lambda values, new: F.concat(F.array(new), F.slice(values, 1, MAX_ORDER - 1))
        return F.struct(shift(acc["ws"], w).alias("ws"), shift(acc["es"], F.lit(0.0)).alias("es"),
                        level.alias("nivel"), delta.alias("delta"), F.concat(acc["out"], F.array(level)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.col("h")), zero, step, lambda acc: acc["out"])
    ready = F.col("coef").isNotNull() & (F.size("ws") == MAX_ORDER)
    values = F.when(ready, path).otherwise(F.array_repeat(F.lit(None).cast("double"), F.col("h")))
    return fitted.join(heads.select(*keys, "h"), keys).select(*keys, F.posexplode(values).alias("i", "v")).select(
        *keys, (F.col("i") + 1).alias("paso"), F.greatest(F.lit(0.0), "v").alias("g"), "v").select(
        *keys, "paso", F.when(F.col("v").isNotNull(), F.col("g")).alias("yhat"))


def fit_predict(train: DataFrame, heads: DataFrame, keys: list[str], orders=None, d: int | None = None) -> DataFrame:
    return forecast(fit(train, keys, orders, d), heads, keys)
