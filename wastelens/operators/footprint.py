"""Carbon and water footprint of waste."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.asof import trailing
from wastelens.functions import constants as K
from wastelens.functions.scalar import keyword_factor, steady_round, to_kg
from wastelens.operators.common import total


def _filled(name: str):
    return F.nullif(F.col(name), F.lit(""))


def footprint_lines(wh, days: int = 30, co2=K.CO2_FACTORS, water=K.WATER_FACTORS) -> DataFrame:
    """Waste per (ingredient, dish, unit) with its name, category, kg, CO2 and water.

    The facts shrink to that grain first (exact integer and decimal sums); names and factors are
    attached afterwards, once per group and not once per waste record.
    """
    grouped = trailing(wh.desperdicios, wh.as_of, days).groupBy("id_insumo", "id_plato", "unidad_medida").agg(
        F.sum("cantidad").alias("cantidad"), F.sum("costo_estimado").alias("costo"))
    ingredients = wh.insumos.select("id_insumo", F.col("nombre").alias("n_i"), F.col("categoria").alias("c_i"))
    dishes = wh.platos.select("id_plato", F.col("nombre").alias("n_p"), F.col("categoria").alias("c_p"))
    name = F.coalesce(_filled("n_i"), _filled("n_p"), F.lit("Otros"))
    named = (
        grouped.join(ingredients, "id_insumo", "left").join(dishes, "id_plato", "left")
        .withColumn("nombre", name)
        .withColumn("categoria", F.coalesce(_filled("c_i"), _filled("c_p"), F.col("nombre")))
        .withColumn("kg", to_kg(F.col("cantidad"), F.col("unidad_medida")))
    )
    return named.select(
        "nombre", "categoria", "kg", "costo",
        (F.col("kg") * keyword_factor(F.col("nombre"), co2, K.CO2_DEFAULT)).alias("co2"),
        (F.col("kg") * keyword_factor(F.col("nombre"), water, K.WATER_DEFAULT)).alias("agua"))


def footprint_totals(wh, days: int = 30, co2=K.CO2_FACTORS, water=K.WATER_FACTORS) -> DataFrame:
    sums = footprint_lines(wh, days, co2, water).agg(
        total("co2").alias("co2"), total("agua").alias("agua"), total("kg").alias("kg"), total("costo").alias("costo"))
    c, a = F.col("co2"), F.col("agua")
    return sums.select(
        F.lit(days).alias("periodo_dias"),
        steady_round(c, 2).alias("total_co2_kg"), steady_round(a, 0).alias("total_agua_litros"),
        steady_round(F.col("kg"), 3).alias("total_kg_desperdiciado"), steady_round(F.col("costo"), 2).alias("total_costo_soles"),
        steady_round(c / K.KG_CO2_PER_TREE_YEAR, 1).alias("arboles_anuales"),
        steady_round(c / K.KG_CO2_PER_CAR_KM, 1).alias("km_en_auto"),
        steady_round(a / K.LITRES_PER_SHOWER, 0).alias("duchas_perdidas"))


def footprint_by_category(wh, days: int = 30, co2=K.CO2_FACTORS, water=K.WATER_FACTORS) -> DataFrame:
    return (
        footprint_lines(wh, days, co2, water).groupBy(F.initcap("categoria").alias("categoria"))
        .agg(
            steady_round(total("co2"), 2).alias("co2_kg"), steady_round(total("agua"), 0).alias("agua_litros"),
            steady_round(total("kg"), 3).alias("kg_desperdiciado"), steady_round(total("costo"), 2).alias("costo"))
        .orderBy(F.desc("co2_kg"), "categoria")
    )


def item_factors(wh, co2=K.CO2_FACTORS, water=K.WATER_FACTORS) -> DataFrame:
    """The factors every dish name resolves to (first keyword in list order wins)."""
    return wh.platos.select(
        "id_plato", "nombre", keyword_factor(F.col("nombre"), co2, K.CO2_DEFAULT).alias("co2_por_kg"),
        keyword_factor(F.col("nombre"), water, K.WATER_DEFAULT).alias("agua_por_kg"))
