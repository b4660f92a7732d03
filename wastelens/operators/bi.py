"""Business indicators and period summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.asof import days_before, in_period, month_start, previous, today, trailing, year_start
from wastelens.functions import constants as K
from wastelens.functions.scalar import or_zero, pct, rd
from wastelens.operators.common import (
    dated_lines, joined_text, one_row, total, total_long, units_by_name,
)


def _month_to_date(wh, df: DataFrame) -> DataFrame:
    return in_period(df, wh.as_of, first=month_start)


def _critical_stock(wh) -> DataFrame:
    return wh.insumos.filter(F.col("estado") & (F.col("stock_disponible") <= F.col("stock_minimo")))


def kpis(wh) -> DataFrame:
    open_high = wh.alertas.filter(F.col("nivel_riesgo").isin("ALTO", "CRITICO") & (F.col("estado") == "pendiente"))
    return one_row(
        wh.spark,
        _month_to_date(wh, wh.ventas).agg(total("total").alias("ventas_mes")),
        in_period(wh.ventas, wh.as_of, first=today, last=today).agg(F.count("*").alias("num_ventas_hoy")),
        _month_to_date(wh, wh.desperdicios).agg(total("costo_estimado").alias("costo_desperdicio_mes")),
        _critical_stock(wh).agg(F.count("*").alias("stock_critico")),
        open_high.agg(F.count("*").alias("alertas_criticas")),
    )


def summary(wh) -> DataFrame:
    """Month and year to date. One scan of the tickets of the year serves both periods."""
    in_month = F.col("fecha") >= wh.as_of.get(month_start)
    sales = in_period(wh.ventas, wh.as_of, first=year_start).agg(
        total(F.when(in_month, F.col("total"))).alias("total_ventas_mes"),
        total("total").alias("total_ventas_anio"),
        F.count(F.when(in_month, 1)).alias("num_ventas_mes"),
    )
    return one_row(
        wh.spark,
        sales,
        _month_to_date(wh, wh.desperdicios).agg(total("costo_estimado").alias("total_desperdicio_mes")),
        _month_to_date(wh, wh.producciones).agg(total_long("sobrante").alias("sobrante_mes")),
    )


def daily_sales(wh, days: int = 30) -> DataFrame:
    return (
        trailing(wh.ventas, wh.as_of, days)
        .groupBy("fecha")
        .agg(total("total").alias("total"), F.count("*").alias("num_ventas"))
        .orderBy("fecha")
    )


def monthly_sales(wh, days: int = 365) -> DataFrame:
    return (
        trailing(wh.ventas, wh.as_of, days)
        .groupBy(F.date_format("fecha", "yyyy-MM").alias("mes"))
        .agg(total("total").alias("total"), F.count("*").alias("num"))
        .orderBy("mes")
    )


def monthly_waste(wh, days: int = 365) -> DataFrame:
    return (
        trailing(wh.desperdicios, wh.as_of, days)
        .groupBy(F.date_format("fecha", "yyyy-MM").alias("mes"))
        .agg(total("costo_estimado").alias("costo"), F.count("*").alias("num"))
        .orderBy("mes")
    )


def waste_by_reason(wh, days: int = 30) -> DataFrame:
    return (
        trailing(wh.desperdicios, wh.as_of, days)
        .groupBy("motivo")
        .agg(total("costo_estimado").alias("costo"), F.count("*").alias("cantidad"))
    )


def top_dishes(wh, days: int = 30, n: int = 10) -> DataFrame:
    ranked = units_by_name(wh, lambda v: trailing(v, wh.as_of, days))
    return ranked.orderBy(F.desc("vendidos"), "nombre").limit(n).withColumnRenamed("nombre", "plato")


def efficiency(wh, days: int = 30) -> DataFrame:
    """0.4 production + 0.3 alert handling + 0.3 waste trend, each 0..100."""
    prod = trailing(wh.producciones, wh.as_of, days).agg(
        total("sobrante").alias("sobrante"), total("preparada").alias("preparada"))
    alerts = wh.alertas.agg(
        F.count("*").alias("alertas"),
        F.count(F.when(F.col("estado").isin("resuelta", "leida"), 1)).alias("gestionadas"))
    recent = F.col("fecha") >= wh.as_of.get(days_before(days))
    cost = in_period(wh.desperdicios, wh.as_of, first=days_before(2 * days)).agg(
        total(F.when(recent, F.col("costo_estimado"))).alias("costo_actual"),
        total(F.when(~recent, F.col("costo_estimado"))).alias("costo_anterior"))
    made, left = F.col("preparada"), F.col("sobrante")
    now, before = F.col("costo_actual"), F.col("costo_anterior")
    scored = one_row(wh.spark, prod, alerts, cost).select(
        F.when(made > 0, F.round(F.greatest(F.lit(0.0), 1 - left / made * 2) * 100, 1))
        .otherwise(50.0).alias("puntaje_produccion"),
        F.when(F.col("alertas") > 0, F.round(F.col("gestionadas") / F.col("alertas") * 100, 1))
        .otherwise(100.0).alias("puntaje_alertas"),
        F.when(before > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 70 - (now - before) / before * 100)), 1))
        .when(now == 0, 100.0).otherwise(50.0).alias("puntaje_desperdicio"),
    )
    index = F.round(
        F.col("puntaje_produccion") * 0.4 + F.col("puntaje_alertas") * 0.3 + F.col("puntaje_desperdicio") * 0.3, 1)
    return scored.withColumn("indice", index).withColumn(
        "color", F.when(F.col("indice") >= 80, "verde").when(F.col("indice") >= 60, "amarillo").otherwise("rojo"))


def status(ratio, limit: float):
    return F.when(ratio < limit, F.lit(K.STATUS_OK)).otherwise(F.lit(K.STATUS_ALERT))


def daily_summaries(wh, period=lambda df: df, limit: float = K.WASTE_LIMIT_PCT) -> DataFrame:
    """The day summary of every day in ``period`` that has a ticket."""
    sales = period(wh.ventas).groupBy("fecha").agg(total("total").alias("ventas"), F.count("*").alias("tickets"))
    waste = period(wh.desperdicios).groupBy("fecha").agg(
        total("costo_estimado").alias("desperdicio"), total("cantidad").alias("desperdicio_cantidad"))
    # Per (day, dish) first, so that no day is gathered row by row.
    named = (
        dated_lines(wh, period).groupBy("fecha", "id_plato").agg(F.sum("cantidad").alias("u"))
        .join(wh.platos.select("id_plato", "nombre"), "id_plato")
        .groupBy("fecha", "nombre").agg(F.sum("u").alias("u"))
        .groupBy("fecha").agg(
            F.sum("u").cast("long").alias("platos_vendidos"),
            F.min_by("nombre", F.struct(-F.col("u"), F.col("nombre"))).alias("top_plato"))
    )
    ratio = pct(or_zero(F.col("desperdicio")), F.col("ventas"))
    return sales.join(waste, "fecha", "left").join(named, "fecha", "left").select(
        "fecha",
        rd(F.col("ventas"), 2).alias("ventas_total"),
        "tickets",
        F.coalesce("platos_vendidos", F.lit(0).cast("long")).alias("platos_vendidos"),
        rd(or_zero(F.col("desperdicio")), 2).alias("desperdicio_total"),
        rd(or_zero(F.col("desperdicio_cantidad")), 2).alias("desperdicio_cantidad"),
        rd(ratio, 2).alias("porcentaje_desperdicio"),
        F.coalesce("top_plato", F.lit("Sin ventas")).alias("top_plato"),
        status(ratio, limit).alias("estado"),
    )


def daily_summary(wh) -> DataFrame:
    """The summary of the reporting date."""
    return daily_summaries(wh, lambda df: in_period(df, wh.as_of, first=today, last=today))


def _closed(wh, days: int):
    return lambda df: in_period(df, wh.as_of, first=days_before(days), last=today)


def weekly_summary(wh, limit: float = K.WASTE_LIMIT_PCT) -> DataFrame:
    week = _closed(wh, 6)
    sales = week(wh.ventas).agg(total("total").alias("ventas"), F.count("*").alias("tickets_semana"))
    waste = week(wh.desperdicios).agg(total("costo_estimado").alias("costo"))
    top = units_by_name(wh, week).orderBy(F.desc("vendidos"), "nombre").limit(5)
    top = joined_text(top, [-F.col("vendidos"), F.col("nombre")],
                      F.concat("nombre", F.lit(": "), F.col("vendidos").cast("string"), F.lit(" und.")))
    reasons = week(wh.desperdicios).groupBy("motivo").agg(F.count("*").alias("n"))
    reasons = joined_text(reasons.orderBy(F.desc("n"), "motivo").limit(3), [-F.col("n"), F.col("motivo")],
                          F.concat("motivo", F.lit(": "), F.col("n").cast("string")))
    span = F.concat(wh.as_of.get(lambda d: F.date_sub(d, 6).cast("string")), F.lit(" al "),
                    wh.as_of.get(lambda d: d.cast("string")))
    ratio = pct(F.col("costo"), F.col("ventas"))
    return one_row(
        wh.spark, sales, waste, top.withColumnRenamed("texto", "top_5_platos"),
        reasons.withColumnRenamed("texto", "motivos_principales"),
    ).select(
        span.alias("periodo"),
        rd(F.col("ventas"), 2).alias("ventas_semana"),
        "tickets_semana",
        rd(F.col("ventas") / 7, 2).alias("promedio_diario"),
        rd(F.col("costo"), 2).alias("desperdicio_semana"),
        rd(ratio, 2).alias("porcentaje_desperdicio"),
        "top_5_platos", "motivos_principales",
        status(ratio, limit).alias("estado"),
    )


def sales_and_waste(wh, period) -> DataFrame:
    """Totals and ratio of one closed period: the head of the period reports."""
    sales = period(wh.ventas).agg(total("total").alias("ventas"), F.count("*").alias("tickets"))
    waste = period(wh.desperdicios).agg(
        total("costo_estimado").alias("desperdicio"), total("cantidad").alias("cantidad"), F.count("*").alias("casos"))
    return one_row(wh.spark, sales, waste).withColumn(
        "porcentaje", rd(pct(F.col("desperdicio"), F.col("ventas")), 2))


def tickets_of_day(wh) -> DataFrame:
    return in_period(wh.ventas, wh.as_of, first=today, last=today).select(
        "id_venta", "hora", F.col("total").cast("double").alias("total"), "metodo_pago")


def waste_of_day(wh) -> DataFrame:
    return in_period(wh.desperdicios, wh.as_of, first=today, last=today).select(
        "tipo", "cantidad", "motivo", F.col("costo_estimado").cast("double").alias("costo"))


def weekly_sales_days(wh) -> DataFrame:
    return (
        _closed(wh, 6)(wh.ventas).groupBy("fecha")
        .agg(total("total").alias("total"), F.count("*").alias("tickets")).orderBy("fecha")
    )


def weekly_top(wh, n: int = 10) -> DataFrame:
    return (
        units_by_name(wh, _closed(wh, 6)).orderBy(F.desc("vendidos"), "nombre").limit(n)
        .select(F.col("nombre").alias("plato"), F.col("vendidos").alias("cantidad"))
    )


def weekly_sales_total(wh) -> DataFrame:
    return _closed(wh, 6)(wh.ventas).agg(
        total("total").alias("total"), F.count("*").alias("tickets"), rd(total("total") / 7, 2).alias("promedio_diario"))


def monthly_waste_report(wh) -> DataFrame:
    return sales_and_waste(wh, lambda df: in_period(df, wh.as_of, first=month_start, last=today))


def monthly_waste_reasons(wh) -> DataFrame:
    return (
        in_period(wh.desperdicios, wh.as_of, first=month_start, last=today)
        .groupBy("motivo").agg(F.count("*").alias("casos"))
    )


def executive_totals(wh) -> DataFrame:
    return sales_and_waste(wh, _closed(wh, 30))


def executive_top(wh, n: int = 10) -> DataFrame:
    return (
        units_by_name(wh, _closed(wh, 30)).orderBy(F.desc("vendidos"), "nombre").limit(n)
        .select(F.col("nombre").alias("plato"), F.col("vendidos").alias("unidades"))
    )


def restaurant_comparison(wh, days: int = 30) -> DataFrame:
    """Every restaurant, with zero where a period holds no row. Facts are aggregated to one row
    per restaurant before they meet the dimension."""
    period = _closed(wh, days)
    tickets = wh.ventas_por_local() if hasattr(wh, "ventas_por_local") else wh.ventas
    sales = period(tickets).groupBy("id_restaurante").agg(F.sum("total").cast("double").alias("v"))
    waste = period(wh.desperdicios).groupBy("id_restaurante").agg(F.sum("costo_estimado").cast("double").alias("w"))
    v, w = or_zero(F.col("v")), or_zero(F.col("w"))
    return (
        wh.restaurantes.join(sales, "id_restaurante", "left").join(waste, "id_restaurante", "left")
        .select(
            "id_restaurante", "nombre", F.coalesce("distrito", F.lit("")).alias("distrito"),
            v.alias("ventas"), w.alias("desperdicio"), rd(pct(w, v), 2).alias("porcentaje"))
    )


def top_waste_dishes(wh, days: int = 30, n: int = 8) -> DataFrame:
    per_dish = (
        trailing(wh.desperdicios, wh.as_of, days).filter("id_plato IS NOT NULL").groupBy("id_plato")
        .agg(F.sum("cantidad").alias("c"), F.sum("costo_estimado").alias("k"))
    )
    return (
        per_dish.join(wh.platos.select("id_plato", "nombre"), "id_plato").groupBy("nombre")
        .agg(total("c").alias("cantidad"), total("k").alias("costo"))
        .orderBy(F.desc("costo"), "nombre").limit(n).withColumnRenamed("nombre", "plato")
    )


def week_waste_totals(wh, days: int = 7) -> DataFrame:
    return trailing(wh.desperdicios, wh.as_of, days).agg(
        F.count("*").alias("registros"), total("costo_estimado").alias("costo"))


def month_context(wh) -> DataFrame:
    first_open = wh.restaurantes.filter("estado").agg(F.min_by("nombre", "id_restaurante").alias("restaurante"))
    return one_row(
        wh.spark,
        first_open.select(F.coalesce("restaurante", F.lit("el restaurante")).alias("restaurante")),
        _month_to_date(wh, wh.ventas).agg(total("total").alias("ventas_mes")),
        _month_to_date(wh, wh.desperdicios).agg(total("costo_estimado").alias("desperdicio_mes")),
        wh.platos.filter("estado").agg(F.count("*").alias("platos_activos")),
    )


def top_reasons_with_cost(wh, days: int = 30, n: int = 3) -> DataFrame:
    """The n most frequent reasons first, and only then those that cost something."""
    return (
        trailing(wh.desperdicios, wh.as_of, days).groupBy("motivo")
        .agg(F.count("*").alias("frecuencia"), total("costo_estimado").alias("costo"))
        .orderBy(F.desc("frecuencia"), "motivo").limit(n).filter("costo > 0")
    )


def waste_over_limit(wh, limit: float = K.WASTE_LIMIT_PCT) -> DataFrame:
    """Days whose waste cost exceeds ``limit`` percent of their sales."""
    return daily_summaries(wh).filter(F.col("porcentaje_desperdicio") > limit).select(
        "fecha", "porcentaje_desperdicio", "desperdicio_total", "ventas_total",
        F.lit(limit).alias("umbral_permitido"))


def savings(wh, days: int = 30) -> DataFrame:
    """Waste cost of this period, the one before and since 2020-01-01, in one scan."""
    f, c = F.col("fecha"), F.col("costo_estimado")
    now, before = wh.as_of.get(days_before(days)), wh.as_of.get(days_before(2 * days))
    history = F.lit("2020-01-01").cast("date")
    sums = wh.desperdicios.filter(f >= F.least(history, before)).agg(
        total(F.when(f >= now, c)).alias("a"),
        total(F.when((f >= before) & (f < now), c)).alias("p"),
        total(F.when(f >= history, c)).alias("h"))
    a, p = F.col("a"), F.col("p")
    return sums.select(
        F.lit(days).alias("periodo_dias"), rd(a, 2).alias("costo_actual"), rd(p, 2).alias("costo_anterior"),
        rd(p - a, 2).alias("ahorro_periodo"), rd(pct(p - a, p), 1).alias("porcentaje_mejora"),
        rd(F.col("h"), 2).alias("total_historico"),
        F.when(p - a > 0, "mejora").when(p - a == 0, "igual").otherwise("empeora").alias("tendencia"))
