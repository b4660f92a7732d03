"""Registered queries over the forecast models, stored runs, exports, generator and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens import schemas
from wastelens.functions.scalar import fold_latin, steady_round
from wastelens.models import arima, attention, holt_winters, trees, trend
from wastelens.models.gram import double_array, gram_sums, int_array, solve
from wastelens.operators import bi, listing, metrics, naive, plan, series
from wastelens.plans import experiment
from wastelens.session import cut_lineage, shared_dir
from wastelens.sources import export, generate, runs
from wastelens.sources.warehouse import ParquetWarehouse, write_warehouse
from wastelens.streaming import jobs

KEY = ["serie"]


def daily(wh) -> DataFrame:
    return series.continuous(series.daily_series(wh))


def daily_table(wh) -> DataFrame:
    """The same, written once: a model passes over its series several times, and that must not
    read the facts again."""
    return cut_lineage(daily(wh), "series")


def _split(wh):
    """Training rows and horizons of the hold-out split of every category series."""
    rows = series.holdout_split(daily_table(wh))
    train = rows.filter(~F.col("es_test")).select("serie", "fecha", "cantidad")
    heads = rows.filter("es_test").groupBy("serie").agg(F.count("*").cast("int").alias("h"))
    return train, heads


def _forecast(model, wh, **options) -> DataFrame:
    train, heads = _split(wh)
    return model.fit_predict(train, heads, KEY, **options).withColumn("yhat", F.round("yhat", 4))


def _pairs(sums: DataFrame, width: int) -> DataFrame:
    """A packed matrix of sums as (i, j, suma) rows."""
    cells = [(i, j) for i in range(width) for j in range(i, width)]
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("gram", F.lit(k)).alias("s")) for k, (i, j) in enumerate(cells)]))
    return sums.select("serie", rows.alias("c")).select("serie", "c.i", "c.j", steady_round(F.col("c.s"), 4).alias("suma"))


def lag_sums(wh) -> DataFrame:
    w = W.partitionBy("serie").orderBy("fecha")
    rows = daily(wh).withColumns({"l1": F.lag("cantidad", 1).over(w), "l2": F.lag("cantidad", 2).over(w)})
    return _pairs(gram_sums(rows, KEY, [F.lit(1.0), F.col("l1"), F.col("l2"), F.col("cantidad")]), 4)


def first_order(wh) -> DataFrame:
    w = W.partitionBy("serie").orderBy("fecha")
    rows = daily(wh).withColumn("l1", F.lag("cantidad", 1).over(w))
    sums = gram_sums(rows, KEY, [F.lit(1.0), F.col("l1"), F.col("cantidad")])
    fit = sums.withColumn("fit", solve("gram", int_array([0, 1]), double_array([0.0, 0.0])))
    return fit.select("serie", steady_round(F.get("fit.coef", F.lit(0)), 4).alias("constante"),
                      steady_round(F.get("fit.coef", F.lit(1)), 4).alias("pendiente"))


def refined_first_order(wh) -> DataFrame:
    """The refined fit of the one order whose least sum of squares has a closed form."""
    rows = daily_table(wh)
    fitted = arima.fit(rows, KEY, orders=[(1, 0)], d=0).join(rows.groupBy("serie").agg(F.count("*").alias("n")), "serie")
    value = lambda i: steady_round(F.get("coef", F.lit(i)), 4)
    return fitted.select("serie", value(0).alias("constante"), value(1).alias("pendiente"),
                         steady_round(F.sqrt(F.col("sce") / (F.col("n") - 1)), 4).alias("rmse"))


def unlagged_ratio(wh) -> DataFrame:
    """The stationarity test without lagged differences, with the normal quantile of its p-value."""
    tested = arima.stationarity(daily_table(wh), KEY, lags=0)
    return tested.select("serie", steady_round(F.col("t"), 4).alias("t"), steady_round(arima.quantile_of_ratio(F.col("t")), 4).alias("z"), "d")


def design_sums(wh) -> DataFrame:
    return _pairs(trend.normal_sums(daily(wh), KEY, multiplicative=False), trend.WIDTH + 1)


def smoothing_fixed(wh) -> DataFrame:
    run = holt_winters.smoothed(holt_winters.values(daily(wh), KEY), F.lit(0.2), F.lit(0.1), F.lit(0.05), F.lit(0.9))
    return run.select("serie", F.size("y").alias("n"), F.round("f.l", 4).alias("nivel"), F.round("f.b", 4).alias("tendencia"),
                      F.round(F.get("f.s", F.lit(0)), 4).alias("temporada"), F.round(F.sqrt(F.col("f.sse") / F.size("y")), 4).alias("rmse"))


def attention_features(wh) -> DataFrame:
    train, heads = _split(wh)
    rows = trees.series_features(train, KEY).unionByName(trees.ahead_features(train, heads, KEY))
    return attention.expanded(rows, KEY).select(
        "serie", "fecha", "futuro", *[F.round(F.get("x", F.lit(8 + i)), 4).alias(f"atencion_{i}") for i in range(8)])


def _stacked(train, heads, keys, **kw):
    return trees.stacked(train, heads, keys, **kw)[0]


def stacked_forecast(wh) -> DataFrame:
    train, heads = _split(wh)
    return _stacked(train, heads, KEY).withColumn("yhat", F.round("yhat", 4))


def _dish_features(wh) -> DataFrame:
    return series.enriched(series.daily_demand(wh), wh.platos)


def single_models(wh) -> DataFrame:
    features = cut_lineage(_dish_features(wh), "demanda")
    out = None
    for kind, hp in (("random_forest", {}), ("regresion_lineal", {}), ("decision_tree", {})):
        scored = trees.train_single(features, kind, **hp)[1]
        out = scored if out is None else out.unionByName(scored)
    return metrics.score(out, ["modelo"]).select("modelo", "n", "mae", "r2")


def dish_forecast(wh, kind: str = "regresion_lineal", horizon: int = 7) -> DataFrame:
    """Forecast and production plan of every dish for the days after the reporting date."""
    features = cut_lineage(_dish_features(wh), "demanda")
    model, scored = trees.train_single(features, kind)
    scores = metrics.score(scored, ["modelo"])
    latest = features.groupBy("id_plato").agg(F.max("cat_enc").alias("cat_enc"), F.max_by("ventas_7d", "fecha").alias("ventas_7d"))
    future = series.future_rows(latest, wh.as_of.get(), horizon)
    return plan.production_plan(trees.forecast_dishes(model, future, kind), scores, ["modelo"], ["id_plato"])


def three_models(wh) -> DataFrame:
    models = {"arima": arima.fit_predict, "tendencia": trend.fit_predict,
              "hibrido": _stacked}
    return experiment.compare(daily_table(wh), models).scores


def five_models(wh) -> DataFrame:
    return experiment.compare(daily_table(wh)).scores


def future_plan(wh) -> DataFrame:
    rows = daily_table(wh)
    compared = experiment.compare(rows)
    return experiment.future(rows, compared.best, 7)


def folds(wh) -> DataFrame:
    return experiment.walk_forward(daily_table(wh))


def last_week(train, days) -> tuple:
    """A model as a user writes one: the mean of the last seven values, from 800 days of history on."""
    if len(train) < 800:
        raise ValueError("historia corta")
    return [train["cantidad"].tail(7).mean()] * len(days), {}, {"dias": len(train)}


def user_folds(wh) -> DataFrame:
    """Walk-forward scores of a user's function; folds that it refuses keep their rows and say why."""
    rows = experiment.walk_forward(daily_table(wh), {"propio": experiment.user_model(last_week)})
    return rows.select("serie", "fold", "modelo", "n", "mae", "error")


def tuned_smoothing(wh) -> DataFrame:
    return experiment.tune(daily_table(wh), "holt_winters")


def experiment_tests(wh) -> DataFrame:
    return experiment.run(daily(wh))["pruebas"]


def _naive_scores(wh) -> DataFrame:
    return metrics.ranked(metrics.score(naive.holdout_predictions(daily(wh)), KEY + ["modelo"]), KEY)


def _naive_folds(wh) -> DataFrame:
    scores = metrics.score(naive.fold_predictions(daily(wh)), ["serie", "modelo", "fold"])
    return scores.join(series.fold_table(daily(wh)).drop("k"), ["serie", "fold"])


def run_rows(wh) -> DataFrame:
    best = metrics.winners(_naive_scores(wh).drop("posicion"), KEY)
    return runs.run_rows("referencia", daily(wh), best, experiment.CRITERION).select(
        "id_ejecucion", "serie", "modelo_ganador", "criterio_seleccion", "fecha_inicio_datos", "fecha_fin_datos",
        "numero_registros", "estado", "metadata_json")


def run_models(wh) -> DataFrame:
    return runs.model_rows("referencia", _naive_scores(wh)).drop("run_id", "error_mensaje")


def run_folds(wh) -> DataFrame:
    return runs.fold_rows("referencia", _naive_folds(wh)).select(
        "id_ejecucion", "serie", "modelo", "fold", "n_train", "n_val", "fecha_inicio_val", "fecha_fin_val", "mae", "rmse")


def read_back(wh) -> DataFrame:
    """Models with their folds, the nested folds shown as text."""
    folds = F.array_join(F.transform("folds", lambda f: F.concat(f["fold"].cast("string"), F.lit(":"), f["n_train"].cast("string"))), ",")
    return runs.read_back(_naive_scores(wh), _naive_folds(wh)).select("serie", "modelo", "posicion", folds.alias("folds"))


def model_log(wh) -> DataFrame:
    """The winner of every fold as a log of saved models, dated by the end of its training."""
    best = metrics.winners(_naive_folds(wh), ["serie", "fold"])
    return runs.active_models(best.select("serie", "modelo", F.col("fecha_fin_train").alias("fecha")))


def json_properties(wh) -> DataFrame:
    """The JSON properties of the events; text cut in half does not parse and gives nulls."""
    events = wh.spark.read.parquet(f"{wh.root}/events.parquet")
    text = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = runs.parse_metadata(text, "k long")
    return events.select("event_id", parsed["k"].alias("k"))


def csv_export(wh) -> DataFrame:
    path = export.write_csv(bi.daily_sales(wh), shared_dir(wh.spark, "csv"))
    return wh.spark.read.option("header", True).schema("fecha date, total double, num_ventas long").csv(path)


def bundle_export(wh) -> DataFrame:
    """A bundle with a normal and an empty dataset, read back as lines of text per dataset."""
    sheets = export.export_bundle(
        {"Desperdicio por motivo": bi.waste_by_reason(wh), "Platos sin categoria registrada en el menu": listing.dish(wh, -1)},
        shared_dir(wh.spark, "hojas"))
    out = None
    for name, path in sheets.items():
        rows = wh.spark.read.option("header", True).csv(path).agg(F.count("*").alias("filas")).select(F.lit(name).alias("hoja"), "filas")
        out = rows if out is None else out.unionByName(rows)
    return out


def evolved(wh) -> DataFrame:
    """An old-format table beside a new one: missing columns come as nulls, no row is lost."""
    old = schemas.evolve(wh.ventas.select("id_venta", "fecha", "total"), "ventas")
    new = schemas.evolve(wh.ventas_por_local().select("id_venta", "fecha", "hora", "total", "metodo_pago", "id_cliente", "id_restaurante"), "ventas")
    return old.unionByName(new).select("id_venta", "fecha", F.col("total").cast("double").alias("total"), "metodo_pago", "id_restaurante")


def seed_missing(wh) -> DataFrame:
    have = wh.platos.filter("id_plato % 3 = 0").select("id_restaurante", "nombre")
    return listing.seed_missing(have, wh.platos.select("id_plato", "id_restaurante", "nombre"), ["id_restaurante", "nombre"])


def saved_parameters_forecast(wh) -> DataFrame:
    """Fit, save, list, and forecast from the stored parameters only."""
    root, rows = shared_dir(wh.spark, "modelos"), daily_table(wh)
    runs.save_parameters(root, "r1", "holt_winters", holt_winters.fit(rows, KEY), series.signature(rows, KEY))
    return runs.saved_forecast(wh.spark, root, "holt_winters").withColumn("yhat", F.round("yhat", 4))


def retrained_forecast(wh) -> DataFrame:
    """Compare all models, refit each winner on all history, store it, and forecast from what was stored."""
    root, rows = shared_dir(wh.spark, "ganadores"), daily_table(wh)
    experiment.retrain(rows, experiment.compare(rows).best, root, "r1")
    return experiment.saved_future(rows, root).withColumn("yhat", F.round("yhat", 4))


def saved_models(wh) -> DataFrame:
    """Every closed-form model of every series stored, then listed with the signature of its data."""
    root, rows = shared_dir(wh.spark, "modelos"), daily_table(wh)
    marks = series.signature(rows, KEY)
    for name, model in runs.PARAMETRIC.items():
        runs.save_parameters(root, "r1", name, model.fit(rows, KEY), marks)
    return runs.list_saved(wh.spark, root).drop("guardado")


def wide_fold(wh) -> DataFrame:
    """Texts with their letters folded for plain exports."""
    docs = wh.spark.read.parquet(f"{wh.root}/documents.parquet")
    return docs.select("doc_id", fold_latin(F.col("text")).alias("texto"))


def stale_models(wh) -> DataFrame:
    """Signatures of the series one week ago against the signatures now."""
    rows = daily_table(wh)
    before = rows.filter(F.col("fecha") < wh.as_of.get(lambda d: F.date_sub(d, 7))).filter("serie <> 'PROMO'")
    same = rows.filter("serie = 'PROMO'")
    saved = series.signature(before.unionByName(same), KEY).filter("serie <> 'LARGE'")
    return runs.staleness(saved, rows)


def predictions_table(wh) -> DataFrame:
    """Stored forecasts: the mean of the last seven sale days of every dish for the next day."""
    demand = series.trailing_mean(series.daily_demand(wh))
    return demand.groupBy("id_plato").agg(
        F.max("fecha").alias("fin"), F.max_by("ventas_7d", "fecha").alias("demanda_estimada"), F.stddev_pop("cantidad").alias("mae")
    ).select("id_plato", F.date_add("fin", 1).alias("fecha_objetivo"), F.col("fin").cast("timestamp").alias("fecha_generacion"),
             F.lit("media_7").alias("modelo"), "demanda_estimada", F.ceil(F.col("demanda_estimada") * 1.1).cast("long").alias("recomendacion_produccion"),
             F.lit("bajo").alias("riesgo_desperdicio"), "mae", F.lit(None).cast("double").alias("r2"), F.lit(0.5).alias("confianza"))


def stored_scan(wh) -> DataFrame:
    """Tickets written in the month layout and read back with the declared schema."""
    root = shared_dir(wh.spark, "almacen")
    write_warehouse(wh, root, ["ventas"])
    stored = ParquetWarehouse(wh.spark, root, wh.as_of, wh.now, tables=["ventas"])
    return stored.ventas.select("id_venta", "fecha", F.col("total").cast("double").alias("total"), "metodo_pago", "id_cliente")


def generated_tickets(wh) -> DataFrame:
    return generate.tickets(wh.restaurantes, wh.as_of.get()).drop("dia")


def generated_lines(wh) -> DataFrame:
    heads = generate.tickets(wh.restaurantes, wh.as_of.get())
    return generate.ticket_lines(heads, wh.platos).withColumn("subtotal", F.col("subtotal").cast("double"))


def generated_waste(wh) -> DataFrame:
    return generate.waste(generate.production(wh.restaurantes, wh.platos, wh.as_of.get()))


def _stream(wh):
    return jobs.event_stream(wh.spark, wh.root)


def _drained(job: Callable[[DataFrame], DataFrame], purpose: str) -> Callable[..., DataFrame]:
    """A stream job over the whole log, its end included."""
    def run(wh) -> DataFrame:
        marks = shared_dir(wh.spark, "marcas")
        return jobs.drain(job(jobs.event_stream(wh.spark, wh.root, marks=marks)), purpose, marks)

    return run


def outbox_stream(wh) -> DataFrame:
    """Errors of the log appended to an outbox in micro-batches; the undelivered ones."""
    base = shared_dir(wh.spark, "buzon")
    errors = _stream(wh).filter("event_type = 'error'").select("event_id", "user_id", "ts")
    deliver = lambda batch: batch.withColumn("enviado", F.col("user_id") % 2 == 0)
    jobs.to_outbox(errors, f"{base}/filas", f"{base}/control", deliver).awaitTermination()
    rows = wh.spark.read.parquet(f"{base}/filas")
    return rows.filter(~F.col("enviado")).select("event_id", "user_id")


MODELS: dict[str, Callable[..., DataFrame]] = {
    "s01_scan": lambda wh: wh.ventas.select("id_venta", "fecha", F.col("total").cast("double").alias("total"), "metodo_pago", "id_cliente"),
    "s01_stored_scan": stored_scan,
    "s04_evolved": evolved,
    "s05_csv_export": csv_export,
    "s06_bundle_export": bundle_export,
    "s07_run_rows": run_rows,
    "s07_run_models": run_models,
    "s07_run_folds": run_folds,
    "s08_active_models": model_log,
    "s09_saved_parameters": saved_parameters_forecast,
    "s10_saved_models": saved_models,
    "s11_json_properties": json_properties,
    "s12_generated_tickets": generated_tickets,
    "s12_generated_lines": generated_lines,
    "s12_generated_waste": generated_waste,
    "s13_seed_missing": seed_missing,
    "s14_read_back": read_back,
    "a35_stale_models": stale_models,
    "p12_forecast_history": lambda wh: listing.forecast_history(predictions_table(wh), wh.platos),
    "m01_stationarity": lambda wh: arima.stationarity(daily_table(wh), KEY).select(
        "serie", F.round("t", 4).alias("t"), F.round("p", 4).alias("p"), "d"),
    "m01_unlagged_ratio": unlagged_ratio,
    "m02_lag_sums": lag_sums,
    "m02_arima_order": lambda wh: arima.fit(daily_table(wh), KEY).select("serie", "p", "d", "q", F.round("aic", 4).alias("aic")),
    "m03_first_order": first_order,
    "m03_refined_first_order": refined_first_order,
    "m03_arima_forecast": lambda wh: _forecast(arima, wh),
    "m04_design_sums": design_sums,
    "m04_trend_forecast": lambda wh: _forecast(trend, wh),
    "m05_smoothing_fixed": smoothing_fixed,
    "m05_grid_fit": lambda wh: holt_winters.fit(daily_table(wh), KEY, refine=0).select(
        "serie", "alpha", "beta", "gamma", "phi", F.round("sse", 4).alias("sse"), F.round("l", 4).alias("nivel")),
    "m05_holt_winters": lambda wh: _forecast(holt_winters, wh),
    "m06_attention_features": attention_features,
    "m07_attention_forest": lambda wh: _forecast(trees, wh, kind="random_forest"),
    "m08_attention_boosting": lambda wh: _forecast(trees, wh, kind="gradient_boosting"),
    "m09_stacked_hybrid": stacked_forecast,
    "m10_single_models": single_models,
    "m11_dish_forecast": dish_forecast,
    "m12_three_models": three_models,
    "m13_five_models": five_models,
    "m13_future_plan": future_plan,
    "m14_user_model": user_folds,
    "m16_tuned_smoothing": tuned_smoothing,
    "m18_walk_forward": folds,
    "m19_experiment_tests": experiment_tests,
    "m20_retrained_forecast": retrained_forecast,
    "f07_wide_fold": wide_fold,
    "x01_stream_daily": _drained(jobs.daily_totals, "diario"),
    "x02_stream_weekly": _drained(jobs.weekly_totals, "semanal"),
    "x03_stream_cooldown": lambda wh: _drained(jobs.cooled_alerts, "pausa")(wh).select("event_type", "user_id", "ts"),
    "x04_stream_outbox": outbox_stream,
    "x05_stream_sessions": _drained(jobs.sessions, "sesiones"),
}
