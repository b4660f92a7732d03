"""Exponential smoothing with additive (damped) trend and additive weekly season.

One row holds the ordered daily values of a key (at most the days of the calendar). A fit takes many such rows at a time: the
states of all series and parameter candidates of a block are arrays, and one loop runs over the days. The smallest squared
error wins and is refined between its neighbours. For given parameters the same recursion is a fold in SQL (``smoothed``)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = 7
REFINE = 3
DAMPED_FROM = 30  # values
BLOCK = 256  # series whose states are held together
ALPHAS, BETAS, GAMMAS, PHIS = (0.05, 0.2, 0.5), (0.01, 0.1), (0.05, 0.2), (0.9, 0.98)


def values(train: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("fecha", "cantidad")))
    return train.groupBy(*keys).agg(ordered.alias("o"), F.max("fecha").alias("fin")).select(
        *keys, "fin", F.transform("o", lambda s: s["cantidad"].cast("double")).alias("y"))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def started(series: DataFrame, seasonal: bool = True) -> DataFrame:
    """Add the state before the first value: level ``l0``, slope ``b0``, season ``s0``, and ``estacional``.

    Without a season (fewer than two weeks, or as told) the season is zero and stays zero; level and slope
    start from the first values alone.
    """
    y = F.col("y")
    use = (F.size(y) >= 2 * PERIOD) & F.lit(seasonal)
    first = F.when(use, _mean(F.slice(y, 1, PERIOD))).otherwise(F.get(y, F.lit(0)))
    slope = F.when(use, (_mean(F.slice(y, PERIOD + 1, PERIOD)) - _mean(F.slice(y, 1, PERIOD))) / PERIOD).otherwise(F.lit(0.0))
    season = F.when(use, F.transform(F.slice(y, 1, PERIOD), lambda v: v - F.col("l0"))).otherwise(F.array_repeat(F.lit(0.0), PERIOD))
    return series.withColumns({"estacional": use, "l0": first, "b0": slope}).withColumn("s0", season)


def _step(acc: Column, v: Column, a: Column, b: Column, g: Column, phi: Column) -> Column:
    """State after one value: level, trend, season (oldest first) and squared error so far."""
    season_now = F.get(acc["s"], F.lit(0))
    base = acc["l"] + phi * acc["b"]
    level = a * (v - season_now) + (1 - a) * base
    trend = b * (level - acc["l"]) + (1 - b) * phi * acc["b"]
    fresh = g * (v - base) + (1 - g) * season_now
    error = v - base - season_now
    return F.struct(level.alias("l"), trend.alias("b"), F.concat(F.slice(acc["s"], 2, PERIOD - 1), F.array(fresh)).alias("s"),
                    (acc["sse"] + error * error).alias("sse"))


def _zero() -> Column:
    return F.struct(F.col("l0").alias("l"), F.col("b0").alias("b"), F.col("s0").alias("s"), F.lit(0.0).alias("sse"))


def smoothed(series: DataFrame, alpha: Column, beta: Column, gamma: Column, phi: Column) -> DataFrame:
    """Final level, trend, season and squared error of each row's ``y`` for its parameters."""
    rows = started(series)
    rows = rows.withColumns({"alpha": alpha, "beta": beta, "phi": phi, "gamma": F.when(F.col("estacional"), gamma).otherwise(F.lit(0.0))})
    fold = F.aggregate("y", _zero(), lambda acc, v: _step(acc, v, F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("phi")))
    return rows.withColumn("f", fold).drop("l0", "b0", "s0", "estacional")


def run_block(y: np.ndarray, n: np.ndarray, start: tuple, grid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Level, slope, season and squared error of every series and candidate.

    ``y`` (series, days) is filled to the longest, the series stand by falling length ``n``; ``start`` is (level, slope, season) per
    series, ``grid`` (4, series, candidates) holds alpha, beta, gamma and phi.
    """
    alpha, beta, gamma, phi = grid
    shape = alpha.shape
    level, slope = (np.repeat(v[:, None], shape[1], 1) for v in start[:2])
    season = [np.repeat(start[2][:, i, None], shape[1], 1) for i in range(PERIOD)]
    sse = np.zeros(shape)
    for t in range(y.shape[1]):
        k = int(np.searchsorted(-n, -t, side="left"))  # series longer than t
        v, a, b, g, p = y[:k, t, None], alpha[:k], beta[:k], gamma[:k], phi[:k]
        s = season[t % PERIOD][:k]
        old = level[:k].copy()
        base = old + p * slope[:k]
        error = v - base - s
        level[:k] = a * (v - s) + (1 - a) * base
        slope[:k] = b * (level[:k] - old) + (1 - b) * p * slope[:k]
        season[t % PERIOD][:k] = g * (v - base) + (1 - g) * s
        sse[:k] += error * error
    places = (n[:, None] + np.arange(PERIOD)) % PERIOD  # oldest first
    stacked = np.stack(season, 2)
    return level, slope, np.take_along_axis(stacked, np.repeat(places[:, None, :], shape[1], 1), 2), sse


def _coarse(damped: np.ndarray) -> np.ndarray:
    """The first grid of every series: two damped slopes or the full one, which then stands twice."""
    rows = np.array(list(product(ALPHAS, BETAS, GAMMAS, range(len(PHIS)))))
    grid = np.repeat(rows.T[:, None, :], len(damped), 1)
    grid[3] = np.where(damped[:, None], np.array(PHIS)[rows[:, 3].astype(int)], 1.0)
    return grid


def _around(best: np.ndarray, reach: float) -> np.ndarray:
    """Candidates around the best one (4, series): each parameter as it is, smaller or larger, all within their bounds."""
    bounds = ((0.001, 0.999), (0.0001, 0.999), (0.0001, 0.999))
    near = [[np.clip(v * (1 + step), *limit) for step in (-reach, 0.0, reach)] for v, limit in zip(best, bounds)]
    phi = np.where(best[3] < 1, np.minimum(0.995, best[3]), best[3])
    return np.stack([np.stack([a, b, g, phi]) for a, b, g in product(*near)], 2)


def _fitter(damped: bool | None, refine: int, names: list[str]):
    def fit_block(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("y")
        n = np.asarray(lists.value_lengths().to_pylist(), "i8")
        order = np.argsort(-n, kind="stable")
        batch, n = batch.take(pa.array(order)), n[order]
        y = np.zeros((len(n), int(n.max(initial=0))))
        for i, values_ in enumerate(batch.column("y")):
            y[i, :n[i]] = np.array(values_.as_py(), "f8")
        start = (*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("l0", "b0")), np.array(batch.column("s0").to_pylist(), "f8"))
        seasonal = batch.column("estacional").to_numpy(zero_copy_only=False).astype(bool)
        best = None
        for i in range(refine + 1):
            grid = _coarse(n >= DAMPED_FROM if damped is None else np.full(len(n), damped)) if best is None else _around(best, 0.5 / 2 ** (i - 1))
            grid[2] *= seasonal[:, None]
            level, slope, season, sse = run_block(y, n, start, grid)
            pick = np.lexsort((*grid[::-1], sse), axis=1)[:, 0]  # smallest error, ties to the smaller parameters
            rows = np.arange(len(n))
            best, found = grid[:, rows, pick], (sse[rows, pick], level[rows, pick], slope[rows, pick], season[rows, pick])
        columns = [found[0], *best, found[1], found[2]]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], *[pa.array(c) for c in columns], pa.array(found[3].tolist(), pa.list_(pa.float64())),
             pa.array(n.astype("i4"))], names=[*names, "sse", "alpha", "beta", "gamma", "phi", "l", "b", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield fit_block(batch.slice(at, BLOCK))

    return run


def fit(train: DataFrame, keys: list[str], damped: bool | None = None, seasonal: bool = True, refine: int = REFINE) -> DataFrame:
    """The best candidate per key with its final state: a coarse grid, then ``refine`` rounds of ever closer neighbours.

    The trend is damped from ``DAMPED_FROM`` values on, or as told."""
    rows = started(values(train, keys), seasonal)
    names = [*keys, "fin"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    order = [f.name for f in rows.schema.fields if f.name in names]
    fitted = rows.mapInArrow(
        _fitter(damped, refine, order),
        f"{kept}, sse double, alpha double, beta double, gamma double, phi double, l double, b double, s array<double>, n int")
    return fitted.select(*keys, "sse", "alpha", "beta", "gamma", "phi", "l", "b", "s", "n", "fin")


def forecast(fitted: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    step, phi = F.col("paso"), F.col("phi")
    damp = F.when(phi < 1, phi * (1 - F.pow(phi, step)) / F.when(phi < 1, 1 - phi).otherwise(1.0)).otherwise(step.cast("double"))
    value = F.col("l") + damp * F.col("b") + F.get("s", F.pmod(step - 1, F.lit(PERIOD)))
    return (
        fitted.join(heads.select(*keys, "h"), keys).withColumn("paso", F.explode(F.sequence(F.lit(1), F.col("h"))))
        .select(*keys, "paso", F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), value)).alias("yhat"))
    )


def fit_predict(train: DataFrame, heads: DataFrame, keys: list[str], **options) -> DataFrame:
    return forecast(fit(train, keys, **options), heads, keys)
