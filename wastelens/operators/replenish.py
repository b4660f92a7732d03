"""Stock views, recipe expansion and purchase suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.asof import days_after, today, trailing
from wastelens.functions.scalar import rd
from wastelens.operators.common import units_by_dish


def stock_flags(wh) -> DataFrame:
    """Every ingredient with the critical-stock flag; nulls count as zero."""
    stock = F.coalesce("stock_disponible", F.lit(0).cast("decimal(10,3)"))
    floor = F.coalesce("stock_minimo", F.lit(0).cast("decimal(10,3)"))
    return wh.insumos.select(
        "id_insumo", "nombre", stock.cast("double").alias("stock_disponible"),
        floor.cast("double").alias("stock_minimo"), (stock <= floor).alias("stock_critico"))


def critical_stock(wh) -> DataFrame:
    return wh.insumos.filter(F.col("estado") & (F.col("stock_disponible") <= F.col("stock_minimo")))


def expiring(wh, days: int = 7) -> DataFrame:
    """Active ingredients that expire between the reporting date and ``days`` later, with days left."""
    due = F.col("fecha_vencimiento")
    return wh.insumos.filter(
        F.col("estado") & (due >= wh.as_of.get(today)) & (due <= wh.as_of.get(days_after(days)))
    ).withColumn("dias", F.datediff(due, wh.as_of.get(today)))


def expiry_status(wh, days: int = 7) -> DataFrame:
    """Expired and soon-to-expire ingredients, most urgent first."""
    left = F.datediff("fecha_vencimiento", wh.as_of.get(today))
    return (
        wh.insumos.filter(F.col("estado") & F.col("fecha_vencimiento").isNotNull())
        .withColumn("dias", left).filter(F.col("dias") <= days)
        .select(
            "id_insumo", F.col("nombre").alias("insumo"),
            F.coalesce(F.col("stock_disponible").cast("double"), F.lit(0.0)).alias("stock"),
            F.col("unidad_medida").alias("unidad"), "fecha_vencimiento", "dias",
            F.when(F.col("dias") < 0, "VENCIDO").otherwise("Por vencer").alias("estado_vencimiento"))
        .orderBy("dias", "id_insumo")
    )


def sale_days(wh, days: int = 30) -> DataFrame:
    """Distinct dates with tickets in the trailing window; never less than one."""
    n = trailing(wh.ventas, wh.as_of, days).agg(F.countDistinct("fecha").alias("n"))
    return n.select(F.greatest("n", F.lit(1)).alias("n"))


def ingredient_need(wh, horizon: int = 7, base: int = 30) -> DataFrame:
    """Ingredient need of the next ``horizon`` days at the average pace of the trailing window.

    Demand is one row per dish before it meets the recipes; the sum per ingredient combines
    map-side, so an ingredient used by very many dishes does not gather in one task.
    """
    demand = units_by_dish(wh, lambda v: trailing(v, wh.as_of, base)).select("id_plato", "vendidos")
    used = F.sum(F.col("vendidos") * F.col("cantidad_usada")).cast("double")
    pace = sale_days(wh, base).scalar()
    return (
        demand.join(wh.recetas, "id_plato").groupBy("id_insumo").agg(used.alias("usado"))
        .select("id_insumo", (F.col("usado") / pace * horizon).alias("necesario"))
    )


def purchase_suggestions(wh, horizon: int = 7, base: int = 30) -> DataFrame:
    stock = F.coalesce(F.col("stock_disponible").cast("double"), F.lit(0.0))
    missing = F.col("necesario") - F.col("stock_actual")
    return (
        ingredient_need(wh, horizon, base).join(wh.insumos.filter("estado"), "id_insumo")
        .withColumn("stock_actual", stock)
        .withColumn("faltante", missing).filter("faltante > 0")
        .select(
            "id_insumo", F.col("nombre").alias("insumo"),
            F.coalesce(F.nullif("proveedor", F.lit("")), F.lit("Sin proveedor")).alias("proveedor"),
            F.col("unidad_medida").alias("unidad"),
            rd(F.col("stock_actual"), 3).alias("stock_actual"),
            rd(F.col("necesario"), 3).alias("necesario"),
            rd(F.col("faltante"), 3).alias("cantidad_pedido"),
            rd(F.col("faltante") * F.coalesce(F.col("costo_unitario").cast("double"), F.lit(0.0)), 2).alias("costo_estimado"))
    )


def purchase_list(wh, horizon: int = 7, base: int = 30) -> DataFrame:
    return purchase_suggestions(wh, horizon, base).orderBy("proveedor", "id_insumo")


def _cost_total(name: str):
    return F.coalesce(F.sum(F.col("costo_estimado").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias(name)


def purchase_totals(wh, horizon: int = 7, base: int = 30) -> DataFrame:
    return purchase_suggestions(wh, horizon, base).agg(
        F.count("*").alias("total_items"), _cost_total("total_costo_estimado")
    ).select(F.lit(horizon).alias("dias_proyeccion"), sale_days(wh, base).scalar().alias("dias_base_calculo"),
             "total_items", "total_costo_estimado")


def orders_by_supplier(wh, horizon: int = 7, base: int = 30) -> DataFrame:
    return purchase_suggestions(wh, horizon, base).groupBy("proveedor").agg(
        F.count("*").alias("items"), _cost_total("subtotal"))


def ingredient_in_restaurant(wh, wanted: DataFrame) -> DataFrame:
    """Resolve (restaurant, ingredient name) pairs to ids; unknown pairs drop out."""
    return wanted.join(
        wh.insumos.select("id_insumo", "id_restaurante", F.col("nombre").alias("insumo")),
        ["id_restaurante", "insumo"])
