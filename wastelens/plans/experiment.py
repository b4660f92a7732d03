"""The forecast experiment: compare, tune, cross-validate, test and explain, for all series at once.

Series and folds are keys of the data, so one job serves any number of them. The only loops on
the driver run over the short lists of models and of the candidates of closed-form models.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache, partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.functions.constants import SEARCH_SPACES
from wastelens.models import arima, holt_winters, trees, trend
from wastelens.operators import metrics, plan, series as S, tests_stat
from wastelens.session import cut_lineage
from wastelens.sources import runs

FitPredict = Callable[[DataFrame, DataFrame, list[str]], DataFrame]

STATISTICAL: dict[str, FitPredict] = {
    "arima": arima.fit_predict, "tendencia": trend.fit_predict, "holt_winters": holt_winters.fit_predict}
POOLED_KINDS = {"atencion_random_forest": "random_forest", "atencion_gradient_boosting": "gradient_boosting"}
TREES: dict[str, FitPredict] = {name: partial(trees.fit_predict, kind=kind) for name, kind in POOLED_KINDS.items()}
ALL_MODELS: dict[str, FitPredict] = {**STATISTICAL, **TREES}
CRITERION = "menor MAE (empate -> menor RMSE -> menor SMAPE)"
ERROR_LENGTH = 255
NO_FORECAST = "sin pronóstico: historia insuficiente o sistema sin solución"


@dataclass
class Comparison:
    predictions: DataFrame  # serie, modelo, fecha, y, yhat, previo on the test days
    scores: DataFrame       # one row per series and model, failed models included
    best: DataFrame         # the winning row of every series
    failures: dict[str, str] = field(default_factory=dict)


def actuals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scored rows with their step after the training end; rows carry ``idx`` and ``n_train``."""
    return rows.select(*keys, (F.col("idx") - F.col("n_train")).cast("int").alias("paso"), "fecha",
                       F.col("cantidad").alias("y"), "previo")


def with_previous_value(series: DataFrame) -> DataFrame:
    return series.withColumn("previo", F.lag("cantidad").over(W.partitionBy("serie").orderBy("fecha")))


def predict_all(train: DataFrame, heads: DataFrame, keys: list[str], models: dict[str, FitPredict], named: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
    """Forecasts of every model in long form. A model that fails is reported, the others go on.

    Each model's rows are written before the next begins, so that a failure in a task is that model's
    failure; its message is cut to what a stored run keeps. ``named``: the rows say their model themselves.
    """
    out, failures = None, {}
    for name, fit_predict in models.items():
        try:
            rows = fit_predict(train, heads, keys)
            rows = rows if named else rows.withColumn("modelo", F.lit(name))
            rows = cut_lineage(rows if "fallo" in rows.columns else rows.withColumn("fallo", F.lit(None).cast("string")), "modelo")
        except Exception as exc:  # a failing model must not stop the comparison
            failures[name] = str(exc)[:ERROR_LENGTH]
            continue
        out = rows if out is None else out.unionByName(rows)
    return out, failures


def split_failures(forecasts: DataFrame | None, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Forecasts, and one message per key and model whose own fit failed."""
    if forecasts is None:
        return None, None
    failed = forecasts.filter(F.col("fallo").isNotNull()).groupBy(*keys, "modelo").agg(F.min("fallo").alias("fallo"))
    return forecasts.filter(F.col("fallo").isNull()).drop("fallo"), failed


def full_scores(scores: DataFrame, ids: DataFrame, models: list[str], failures: dict[str, str], keys: list[str],
                failed: DataFrame | None = None) -> DataFrame:
    """One row per key and model: failed ones keep null metrics and say why. ``failed`` has messages of single keys."""
    names = F.explode(F.array(*[F.lit(m) for m in models]))
    message = F.lit(NO_FORECAST)
    for name, text in failures.items():
        message = F.when(F.col("modelo") == name, F.lit(text)).otherwise(message)
    grid = ids.select(*keys).withColumn("modelo", names)
    if failed is not None:
        grid = grid.join(failed, [*keys, "modelo"], "left")
        message = F.coalesce(F.col("fallo"), message)
    rows = grid.join(scores, [*keys, "modelo"], "left").withColumn("error", F.when(F.col("mae").isNull(), message))
    return rows.drop("fallo")


def no_scores(series: DataFrame, keys: list[str]) -> DataFrame:
    """The score table when no model gave a forecast."""
    names = ", ".join(f"`{k}` {'string' if k == 'serie' else 'int'}" for k in keys)
    measures = ", ".join(f"{m} double" for m in ("mae", "rmse", "mape", "smape", "u_theil", "r2"))
    return series.sparkSession.createDataFrame([], f"{names}, modelo string, n long, {measures}")


def compare(series: DataFrame, models: dict[str, FitPredict] | None = None, min_days: int = 30) -> Comparison:
    """Hold-out comparison of the models on every series of at least ``min_days`` days."""
    models = models or ALL_MODELS
    split = S.holdout_split(with_previous_value(series), min_days)
    train = split.filter(~F.col("es_test")).select("serie", "fecha", "cantidad")
    test = split.filter("es_test")
    heads = test.groupBy("serie").agg(F.count("*").cast("int").alias("h"))
    forecasts, failures = predict_all(train, heads, ["serie"], models)
    forecasts, failed = split_failures(forecasts, ["serie"])
    if forecasts is None:
        forecasts = series.sparkSession.createDataFrame([], "serie string, paso int, yhat double, modelo string")
    joined = forecasts.join(actuals(test, ["serie"]), ["serie", "paso"]).select("serie", "modelo", "fecha", "y", "yhat", "previo")
    predictions = cut_lineage(joined, "pronosticos")
    scores = full_scores(metrics.score(predictions, ["serie", "modelo"]), heads, list(models), failures, ["serie"], failed)
    ranked = metrics.ranked(scores, ["serie"])
    return Comparison(predictions, ranked, ranked.filter("posicion = 1"), failures)


def future(series: DataFrame, best: DataFrame, horizon: int = 7, models: dict[str, FitPredict] | None = None) -> DataFrame:
    """Forecast of the days after the end of each series by its winner, refitted on all history.
    Every model is fitted only on the series it won."""
    models = models or ALL_MODELS
    out = None
    for name, fit_predict in models.items():
        own = series.join(best.filter(F.col("modelo") == name).select("serie"), "serie", "left_semi").select("serie", "fecha", "cantidad")
        heads = own.groupBy("serie").agg(F.max("fecha").alias("fin")).withColumn("h", F.lit(horizon))
        if name in TREES and own.isEmpty():
            continue
        rows = fit_predict(own, heads, ["serie"])
        rows = rows.filter("fallo IS NULL") if "fallo" in rows.columns else rows
        rows = rows.join(heads.select("serie", "fin"), "serie").select(
            "serie", F.lit(name).alias("modelo"), F.date_add("fin", F.col("paso").cast("int")).alias("fecha"), "yhat")
        out = rows if out is None else out.unionByName(rows)
    return plan.production_plan(out, best, ["serie", "modelo"])


@dataclass
class Folds:
    table: DataFrame  # serie, fold and the bounds of its blocks
    train: DataFrame
    heads: DataFrame
    scored: DataFrame  # the validation rows

    KEYS = ["serie", "fold"]


def time_folds(series: DataFrame, k: int = 5) -> Folds:
    folds = S.fold_table(series, k)
    rows = S.indexed(with_previous_value(series)).join(folds.select("serie", "fold", "n_train", "n_val"), "serie")
    return Folds(folds, rows.filter("idx <= n_train").select("serie", "fold", "fecha", "cantidad"),
                 folds.select("serie", "fold", F.col("n_val").alias("h")),
                 actuals(rows.filter("idx > n_train AND idx <= n_train + n_val"), Folds.KEYS))


def _fold_scores(folds: Folds, forecasts: DataFrame | None, models: list[str], failures: dict[str, str]) -> DataFrame:
    forecasts, failed = split_failures(forecasts, Folds.KEYS)
    if forecasts is None:
        scored = no_scores(folds.table, Folds.KEYS)
    else:
        scored = metrics.score(forecasts.join(folds.scored, [*Folds.KEYS, "paso"]), [*Folds.KEYS, "modelo"])
    return full_scores(scored, folds.table, models, failures, Folds.KEYS, failed).join(folds.table.drop("k"), Folds.KEYS)


def walk_forward(series: DataFrame, models: dict[str, FitPredict] | None = None, k: int = 5) -> DataFrame:
    """Scores per series, model and expanding-window fold, failed folds included.

    Every model takes all folds in one go. A pooled regressor must not see rows of another fold's validation block, so
    it is told to fit each fold on its own rows.
    """
    models = models or ALL_MODELS
    folds = time_folds(series, k)
    by_fold = {m: partial(f, pool=["fold"]) if m in TREES else f for m, f in models.items()}
    forecasts, failures = predict_all(folds.train, folds.heads, Folds.KEYS, by_fold)
    return _fold_scores(folds, forecasts, list(models), failures)


# ---- models of the user ----
UserModel = Callable[[pd.DataFrame, pd.DataFrame], "tuple | Sequence[float]"]


def user_model(function: UserModel) -> FitPredict:
    """A model from a plain function of (training rows, days to forecast), which returns the values or (values, ...).

    It is called once per series (and fold) with daily rows in order of date, side by side on the executors; the days carry no
    values. What one call raises is the failure of that series alone and stands in its row of the scores.
    """
    def fit_predict(train: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
        rows = train.select(*keys, "fecha", F.col("cantidad").cast("double").alias("cantidad")).join(heads.select(*keys, "h"), keys)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
        order = [f.name for f in rows.schema.fields if f.name in keys]

        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("fecha")
            ids, h = group[order].iloc[0].to_dict(), int(group["h"].iloc[0])
            days = pd.DataFrame({"fecha": pd.date_range(group["fecha"].iloc[-1], periods=h + 1)[1:].date})
            try:
                found = function(group[["fecha", "cantidad"]].reset_index(drop=True), days)
                values = [float(v) for v in (found[0] if isinstance(found, tuple) else found)]
                if len(values) != h:
                    raise ValueError(f"{len(values)} values for {h} days")
            except Exception as exc:  # the failure of this group
                return pd.DataFrame([{**ids, "paso": 1, "yhat": None, "fallo": (str(exc) or type(exc).__name__)[:ERROR_LENGTH]}])
            return pd.DataFrame([{**ids, "paso": i, "yhat": v, "fallo": None} for i, v in enumerate(values, 1)])

        return rows.groupBy(*keys).applyInPandas(one, f"{kinds}, paso int, yhat double, fallo string")

    return fit_predict


# ---- hyper-parameter search ----
def search_grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """Every combination of the space, one row each, as JSON."""
    grid = spark.range(1).select()
    for name, options in space.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(json.dumps(v)) for v in options])).alias(name))
    parts = [F.concat(F.lit(f'"{name}": '), F.col(name)) for name in space]
    return grid.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("combinacion"))


def sample_space(spark: SparkSession, space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct combinations in an order fixed by the seed; all of them if fewer exist."""
    rows = search_grid(spark, space).orderBy(F.xxhash64(F.lit(seed), "combinacion"), "combinacion").limit(n).collect()
    return [json.loads(r["combinacion"]) for r in rows]


def _configured(model: str, combo: dict) -> FitPredict:
    if model == "arima":
        return partial(arima.fit_predict, orders=[(combo["p"], combo["q"])], d=combo["d"])
    if model == "tendencia":
        return partial(
            trend.fit_predict, changepoint_prior_scale=combo["changepoint_prior_scale"],
            seasonality_prior_scale=combo["seasonality_prior_scale"],
            multiplicative=combo["seasonality_mode"] == "multiplicative", weekly=combo["weekly_seasonality"])
    if model == "holt_winters":
        return partial(holt_winters.fit_predict, damped=combo["damped_trend"], seasonal=combo["seasonal"] is not None)
    return partial(trees.fit_predict, kind=POOLED_KINDS[model], **combo)


def tune(series: DataFrame, model: str, n: int = 4, seed: int = 42, space: dict[str, list] | None = None) -> DataFrame:
    """Every sampled candidate on the chronological tuning split of every series: one row per
    series and candidate with its error; ``mejor`` marks the smallest MAE of the series."""
    split = S.tuning_split(with_previous_value(series))
    train = split.filter("idx <= n_train").select("serie", "fecha", "cantidad")
    val = split.filter("idx > n_train")
    heads = val.groupBy("serie").agg(F.count("*").cast("int").alias("h"))
    combos = sample_space(series.sparkSession, space or SEARCH_SPACES[model], n, seed)
    named = {json.dumps(c, sort_keys=True): _configured(model, c) for c in combos}
    forecasts, failures = predict_all(train, heads, ["serie"], named)
    forecasts, failed = split_failures(forecasts, ["serie"])
    scored = no_scores(series, ["serie"]) if forecasts is None else metrics.score(
        forecasts.join(actuals(val, ["serie"]), ["serie", "paso"]), ["serie", "modelo"])
    rows = metrics.ranked(full_scores(scored, heads, list(named), failures, ["serie"], failed), ["serie"])
    return rows.select("serie", F.lit(model).alias("modelo"), F.col("modelo").alias("hiperparametros"), "mae", "rmse", "error",
                       F.coalesce(F.col("posicion") == 1, F.lit(False)).alias("mejor"))


def tune_on_folds(series: DataFrame, model: str, n: int = 4, k: int = 5, seed: int = 42, space: dict[str, list] | None = None) -> DataFrame:
    """Random search scored by the mean error over the time folds, for the pooled regressors. All candidates of all folds are fitted together.

    One row per candidate; ``mejor`` marks the smallest MAE, at ties the first text. No candidate is best where none has a score.
    """
    combos = sample_space(series.sparkSession, space or SEARCH_SPACES[model], n, seed)
    kind = POOLED_KINDS[model]
    named = {json.dumps(c, sort_keys=True): (kind, c) for c in combos}
    folds = time_folds(series, k)
    search = {model: partial(trees.fit_predict_many, candidates=named, pool=["fold"])}
    forecasts, failures = predict_all(folds.train, folds.heads, Folds.KEYS, search, named=True)
    cv = _fold_scores(folds, forecasts, list(named), {name: text for text in failures.values() for name in named})
    out = cv.groupBy("modelo").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.max("error").alias("error")).select(
        F.lit(model).alias("modelo"), F.col("modelo").alias("hiperparametros"), "mae", "rmse", "error")
    place = F.row_number().over(W.orderBy(F.col("mae").asc_nulls_last(), "hiperparametros"))  # one row per candidate
    return cut_lineage(out.withColumn("mejor", (place == 1) & F.col("mae").isNotNull()), "busqueda")


def tuned_walk_forward(series: DataFrame, model: str, tuned: DataFrame, k: int = 5) -> DataFrame:
    """Walk-forward scores with each series' own best candidate. The search is not repeated in the
    folds; a candidate is fitted only on the series that chose it. Series without a best candidate keep null scores."""
    best = tuned.filter("mejor").select("serie", "hiperparametros")
    without = series.join(best.select("serie"), "serie", "left_anti")
    out = _fold_scores(time_folds(without, k), None, [model], {})
    for text in [r[0] for r in best.select("hiperparametros").distinct().collect()]:
        own = series.join(best.filter(F.col("hiperparametros") == text).select("serie"), "serie", "left_semi")
        out = out.unionByName(walk_forward(own, {model: _configured(model, json.loads(text))}, k))
    return out


class Run(Mapping):
    """The parts of an experiment by name, each computed when it is first asked for and kept."""

    def __init__(self, parts: dict[str, Callable[[], DataFrame]]):
        self._parts = {name: cache(part) for name, part in parts.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._parts[name]()

    def __iter__(self):
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def run(series: DataFrame, models: dict[str, FitPredict] | None = None, horizon: int = 7, k: int = 5,
        tuning: int = 0, spaces: dict[str, dict[str, list]] | None = None) -> Run:
    """The whole experiment. ``tuning`` candidates per model (0: none): statistical models on the tuning split of each
    series, pooled regressors on the time folds; ``busqueda`` then lists them, and the folds are scored with the best.
    ``spaces`` replaces the search spaces of pooled regressors. Nothing is fitted before a part that needs it is asked for."""
    models = models or ALL_MODELS
    rows = cache(lambda: cut_lineage(series, "series"))
    compared = cache(lambda: compare(rows(), models))

    @cache
    def searched() -> tuple[list[DataFrame], list[DataFrame]]:
        """Searches and fold scores of every model."""
        searches, folds = [], []
        for model in models:
            if model in STATISTICAL:  # every series has its own best candidate
                found = cut_lineage(tune(rows(), model, tuning), "busqueda")
                cv = tuned_walk_forward(rows(), model, found, k)
            elif model in TREES:  # one candidate for the pool, searched on the folds
                found = tune_on_folds(rows(), model, tuning, k, space=(spaces or {}).get(model))
                best_text = found.filter("mejor").select("hiperparametros").collect()
                tuned = _configured(model, json.loads(best_text[0][0])) if best_text else models[model]
                cv = walk_forward(rows(), {model: tuned}, k)
                found = found.withColumn("serie", F.lit(None).cast("string"))
            else:
                found, cv = None, walk_forward(rows(), {model: models[model]}, k)
            searches += [found] if found is not None else []
            folds.append(cv)
        return searches, folds

    winners = lambda: compared().best
    parts = {
        "series": rows, "predicciones": lambda: compared().predictions, "modelos": lambda: compared().scores, "ganadores": winners,
        "futuro": lambda: future(rows(), winners(), horizon, models),
        "pruebas": lambda: tests_stat.all_tests(compared().predictions, winners().select("serie", F.col("modelo").alias("ganador"))),
        "interpretacion": lambda: plan.winner_text(winners()),
        "folds": lambda: reduce(DataFrame.unionByName, searched()[1]) if tuning else walk_forward(rows(), models, k)}
    if tuning and any(m in STATISTICAL or m in TREES for m in models):
        parts["busqueda"] = lambda: reduce(DataFrame.unionByName, searched()[0])
    return Run(parts)


# ---- saved winners ----
def retrain(series: DataFrame, best: DataFrame, root: str, run_id: str, horizon: int = 7) -> None:
    """Refit the winner of every series on all of its history and store it under ``run_id`` with the signature of its data."""
    for name in ALL_MODELS:
        own = series.join(best.filter(F.col("modelo") == name).select("serie"), "serie", "left_semi").select("serie", "fecha", "cantidad")
        if own.isEmpty():
            continue
        marks = S.signature(own, ["serie"])
        if name in STATISTICAL:
            runs.save_parameters(root, run_id, name, runs.PARAMETRIC[name].fit(own, ["serie"]), marks)
            continue
        heads = own.select("serie").distinct().withColumn("h", F.lit(horizon))
        kind = name.removeprefix("atencion_")
        runs.save_pooled(trees.fit(own, heads, ["serie"], kind), root, run_id, name, marks)


def saved_future(series: DataFrame, root: str, horizon: int = 7) -> DataFrame:
    """Forecast of every series by its active saved model, the one stored last of whatever type; nothing is refitted."""
    spark = series.sparkSession
    saved = cut_lineage(runs.list_saved(spark, root), "guardados")
    active = runs.active_models(saved.withColumnRenamed("guardado", "fecha")).filter("activo").select("serie", "modelo")
    out = None
    for name in [r[0] for r in saved.select("modelo").distinct().collect()]:  # at most one per model type
        rows = (runs.saved_forecast(spark, root, name, horizon) if name in STATISTICAL
                else runs.saved_tree_forecast(spark, root, name, series, horizon))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "serie string, modelo string, fecha date, yhat double")
    return out.join(active, ["serie", "modelo"], "left_semi")
