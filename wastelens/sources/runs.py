"""Stored experiment runs, saved models and the tables derived from them.

Everything is append-only Parquet. Every attempt to store a run writes its rows under an id of its own; the manifest, written last, names the
attempt that counts. A job that dies half way leaves rows that nobody reads, a repetition stands alone, and of two
writers of one run the one that ends last counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.models import arima, holt_winters, trees, trend
from wastelens.operators.series import signature

RUN_TABLES = ("ejecuciones", "resultados_modelo", "resultados_fold", "resultados_prueba")
PARAMETRIC = {"arima": arima, "tendencia": trend, "holt_winters": holt_winters}
TREE_MODELS = {"atencion_random_forest": RandomForestRegressionModel, "atencion_gradient_boosting": GBTRegressionModel}


def run_key(run_id: str) -> F.Column:
    """Id of one series' part of a run."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), F.col("serie")), 256), 1, 16)


def run_rows(run_id: str, series: DataFrame, best: DataFrame, criterion: str, metadata: dict[str, str] | None = None) -> DataFrame:
    span = series.groupBy("serie").agg(
        F.min("fecha").alias("fecha_inicio_datos"), F.max("fecha").alias("fecha_fin_datos"), F.count("*").alias("numero_registros"))
    extra = F.to_json(F.create_map(*[F.lit(v) for kv in (metadata or {"origen": "experimento"}).items() for v in kv]))
    return span.join(best.select("serie", F.col("modelo").alias("modelo_ganador")), "serie").select(
        F.lit(run_id).alias("run_id"), run_key(run_id).alias("id_ejecucion"), "serie", "modelo_ganador",
        F.lit(criterion).alias("criterio_seleccion"), "fecha_inicio_datos", "fecha_fin_datos", "numero_registros",
        F.lit("completado").alias("estado"), extra.alias("metadata_json"))


def model_rows(run_id: str, scores: DataFrame) -> DataFrame:
    kind = F.when(F.col("modelo").startswith("atencion"), "hibrido").otherwise("clasico")
    error = F.col("error") if "error" in scores.columns else F.lit(None).cast("string")
    return scores.select(
        F.lit(run_id).alias("run_id"), run_key(run_id).alias("id_ejecucion"), "serie", "modelo", kind.alias("categoria"),
        "mae", "rmse", "mape", "smape", "u_theil", "r2", "posicion", error.alias("error_mensaje"))


def fold_rows(run_id: str, folds: DataFrame) -> DataFrame:
    return folds.withColumn("run_id", F.lit(run_id)).withColumn("id_ejecucion", run_key(run_id))


def test_rows(run_id: str, tests: DataFrame) -> DataFrame:
    return tests.withColumn("run_id", F.lit(run_id)).withColumn("id_ejecucion", run_key(run_id))


def save_run(root: str, run_id: str, result: Mapping[str, DataFrame], criterion: str) -> str:
    """Write the four tables of a run under a new attempt, then the manifest row that makes it count. Returns the attempt."""
    spark, attempt = result["series"].sparkSession, f"i-{uuid.uuid4().hex}"
    frames = (run_rows(run_id, result["series"], result["ganadores"], criterion), model_rows(run_id, result["modelos"]),
              fold_rows(run_id, result["folds"]), test_rows(run_id, result["pruebas"]))
    for name, frame in zip(RUN_TABLES, frames):
        frame.withColumn("intento", F.lit(attempt)).write.mode("append").partitionBy("intento").parquet(f"{root}/{name}")
    spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("intento"), F.current_timestamp().alias("terminado")).write.mode(
        "append").parquet(f"{root}/manifiesto")
    return attempt


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The attempt that counts for every run: run_id, intento."""
    last = F.max_by("intento", F.struct("terminado", "intento"))
    return spark.read.parquet(f"{root}/manifiesto").groupBy("run_id").agg(last.alias("intento"))


def stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of the attempts that count; the folders of other attempts are pruned."""
    return spark.read.parquet(f"{root}/{table}").join(committed(spark, root), ["run_id", "intento"], "left_semi").drop("intento")


def read_back(models: DataFrame, folds: DataFrame) -> DataFrame:
    """Models of a run in order of position (unranked last) with their folds nested in order.
    A model has at most five folds, so the nested array stays small."""
    fold = F.struct("fold", "n_train", "n_val", "mae", "rmse", "smape")
    nested = folds.groupBy("serie", "modelo").agg(F.sort_array(F.collect_list(fold)).alias("folds"))
    return models.join(nested, ["serie", "modelo"], "left").orderBy("serie", F.col("posicion").asc_nulls_last())


def parse_metadata(column: F.Column, schema: str) -> F.Column:
    """JSON column to a struct; text that cannot be read becomes an empty struct."""
    return F.coalesce(F.from_json(column, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))


# ---- saved models ----
def active_models(log: DataFrame) -> DataFrame:
    """The log with ``activo`` true on the latest row of every series."""
    latest = W.partitionBy("serie").orderBy(F.desc("fecha"), F.desc("modelo"))
    return log.withColumn("activo", F.row_number().over(latest) == 1)


def save_parameters(root: str, run_id: str, model: str, fitted: DataFrame, metadata: DataFrame) -> None:
    """Fitted parameter rows of a closed-form model beside the signature of their data."""
    if model not in PARAMETRIC:
        raise ValueError(f"unknown model type {model!r}")
    fitted.join(metadata, "serie").withColumns({"run_id": F.lit(run_id), "guardado": F.current_timestamp()}).write.mode(
        "append").parquet(f"{root}/parametros/{model}")


def load_parameters(spark: SparkSession, root: str, model: str) -> DataFrame:
    """The active (latest) parameter row of every series."""
    if model not in PARAMETRIC:
        raise ValueError(f"unknown model type {model!r}")
    return _active(spark.read.parquet(f"{root}/parametros/{model}"))


def saved_forecast(spark: SparkSession, root: str, model: str, horizon: int = 7) -> DataFrame:
    """Forecast from stored parameters, nothing is refitted."""
    fitted = load_parameters(spark, root, model)
    heads = fitted.select("serie").withColumn("h", F.lit(horizon))
    rows = PARAMETRIC[model].forecast(fitted, heads, ["serie"])
    return rows.join(fitted.select("serie", "fin"), "serie").select(
        "serie", F.lit(model).alias("modelo"), F.date_add("fin", F.col("paso").cast("int")).alias("fecha"), "yhat")


def save_tree(model, root: str, name: str) -> str:
    if name not in TREE_MODELS:
        raise ValueError(f"unknown model type {name!r}")
    path = f"{root}/arboles/{name}"
    model.write().overwrite().save(path)
    return path


def load_tree(root: str, name: str):
    if name not in TREE_MODELS:
        raise ValueError(f"unknown model type {name!r}")
    return TREE_MODELS[name].load(f"{root}/arboles/{name}")


def save_pooled(model: DataFrame, root: str, run_id: str, name: str, metadata: DataFrame) -> None:
    """The trees of a pooled model of one run, beside the signature of every series that it was fitted on."""
    if name not in TREE_MODELS:
        raise ValueError(f"unknown model type {name!r}")
    model.write.mode("overwrite").parquet(f"{root}/ajustes/{run_id}/{name}")
    metadata.withColumns({"run_id": F.lit(run_id), "guardado": F.current_timestamp()}).write.mode("append").parquet(f"{root}/agrupados/{name}")


def _active(rows: DataFrame) -> DataFrame:
    latest = W.partitionBy("serie").orderBy(F.desc("guardado"), F.desc("run_id"))
    return rows.withColumn("r", F.row_number().over(latest)).filter("r = 1").drop("r")


def saved_tree_forecast(spark: SparkSession, root: str, name: str, rows: DataFrame, horizon: int = 7) -> DataFrame:
    """Forecast of every series by the pooled model of the latest run that holds it; ``rows`` is the history its features need.

    The driver steps over the stored runs that are still active, not over series.
    """
    if name not in TREE_MODELS:
        raise ValueError(f"unknown model type {name!r}")
    active = _active(spark.read.parquet(f"{root}/agrupados/{name}"))
    out = None
    for run_id in [r[0] for r in active.select("run_id").distinct().orderBy("run_id").collect()]:
        own = rows.join(active.filter(F.col("run_id") == run_id).select("serie"), "serie", "left_semi").select("serie", "fecha", "cantidad")
        heads = own.groupBy("serie").agg(F.max("fecha").alias("fin")).withColumn("h", F.lit(horizon))
        part = trees.predict(spark.read.parquet(f"{root}/ajustes/{run_id}/{name}"), own, heads, ["serie"]).join(heads.select("serie", "fin"), "serie")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "serie string, modelo string, fecha date, yhat double")
    return out.select("serie", F.lit(name).alias("modelo"), F.date_add("fin", F.col("paso").cast("int")).alias("fecha"), "yhat")


def list_saved(spark: SparkSession, root: str) -> DataFrame:
    """Saved series per model type, closed-form and pooled; types never saved are left out."""
    out = None
    for model in [*PARAMETRIC, *TREE_MODELS]:
        try:
            rows = load_parameters(spark, root, model) if model in PARAMETRIC else _active(spark.read.parquet(f"{root}/agrupados/{model}"))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # this type was never saved
        part = rows.select("serie", F.lit(model).alias("modelo"), "hash_datos", "n_registros", "guardado")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "serie string, modelo string, hash_datos string, n_registros long, guardado timestamp")


def staleness(saved: DataFrame, current_rows: DataFrame) -> DataFrame:
    """Saved signature against the signature of the data now, with advice."""
    now = signature(current_rows, ["serie"]).select("serie", F.col("hash_datos").alias("hash_actual"))
    same = F.col("hash_datos") == F.col("hash_actual")
    return now.join(saved.select("serie", "hash_datos"), "serie", "left").select(
        "serie", F.col("hash_datos").isNotNull().alias("existe"), F.coalesce(same, F.lit(False)).alias("vigente"),
        (~F.coalesce(same, F.lit(False))).alias("recomienda_reentrenar"),
        F.when(F.col("hash_datos").isNull(), "No hay modelo guardado para este plato.")
        .when(same, "El modelo guardado sigue vigente para los datos actuales.")
        .otherwise("Los datos históricos cambiaron desde el último entrenamiento.").alias("motivo"))
