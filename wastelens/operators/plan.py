"""From forecasts to production plans and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.functions.scalar import confidence, fixed_text, recommended_production, waste_risk


def production_plan(forecasts: DataFrame, scores: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Recommended production, waste risk and confidence of every forecast (``yhat``), from the
    error of the model that made it. ``carry`` names further columns to keep."""
    demand = F.greatest(F.lit(0.0), F.col("yhat"))
    mae = F.coalesce(F.col("mae"), F.lit(1.0))
    scored = forecasts.join(scores.select(*keys, "mae", "r2"), keys, "left").withColumns({"d": demand, "e": mae})
    scored = scored.withColumn("recomendacion", recommended_production(F.col("d"), F.col("e")))
    return scored.select(
        *keys, *(carry or []), "fecha", F.round("d", 2).alias("demanda_estimada"), "recomendacion",
        waste_risk(F.col("d"), F.col("recomendacion"), F.col("e")).alias("riesgo"), F.col("e").alias("mae"),
        confidence(F.col("r2")).alias("confianza"))


def winner_text(best: DataFrame) -> DataFrame:
    return best.select("serie", F.concat(
        F.lit("El modelo "), "modelo", F.lit(" fue seleccionado automáticamente por presentar el menor error absoluto medio (MAE = "),
        fixed_text(F.col("mae"), 4), F.lit(").")).alias("texto"))
