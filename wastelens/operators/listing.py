"""Row listings, look-ups, ticket views and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wastelens.asof import days_before, in_period, month_start, previous, today, trailing, year_start
from wastelens.functions import constants as K
from wastelens.functions import scalar as S
from wastelens.operators.common import dated_lines, join_known

BROADCAST_TICKETS = 10_000  # some 100 bytes each


def active(dim: DataFrame) -> DataFrame:
    return dim.filter("estado")


def active_dishes(wh) -> DataFrame:
    return active(wh.platos).select("id_plato", "nombre", "categoria", F.col("precio_venta").cast("double").alias("precio_venta"))


def recent_waste(wh, days: int = 30) -> DataFrame:
    return trailing(wh.desperdicios, wh.as_of, days).select("fecha", "tipo", "motivo", "cantidad")


def week_tickets(wh) -> DataFrame:
    return in_period(wh.ventas, wh.as_of, first=days_before(6), last=today).select("id_venta", "fecha")


def previous_production(wh, days: int = 30) -> DataFrame:
    return previous(wh.producciones, wh.as_of, days).select("id_plato", "fecha", "preparada", "sobrante")


def to_date_tickets(wh) -> DataFrame:
    """Tickets of the year to date, flagged when they are of the month to date."""
    return in_period(wh.ventas, wh.as_of, first=year_start).select(
        "id_venta", "fecha", (F.col("fecha") >= wh.as_of.get(month_start)).alias("del_mes"))


def audit_log(wh, module: str | None = None, result: str | None = None, limit: int | None = 100) -> DataFrame:
    """Audit log, newest id first, with optional equality filters."""
    log = wh.bitacora
    for column, value in (("modulo", module), ("resultado", result)):
        if value:
            log = log.filter(F.col(column) == value)
    log = log.select("id_evento", "fecha", "hora", "id_usuario", "rol", "modulo", "accion", "resultado")
    log = log.orderBy(F.desc("id_evento"))
    return log if limit is None else log.limit(limit)


def audit_report(wh, days: int = 7, limit: int = 500) -> DataFrame:
    """The latest audit rows of a closed range of days."""
    first, last = wh.now.get(lambda t: F.date_sub(F.to_date(t), days)), wh.now.get(lambda t: F.to_date(t))
    return (
        wh.bitacora.filter(F.col("fecha").between(first, last))
        .select("id_evento", "fecha", "hora", "id_usuario", "rol", "modulo", "accion", "resultado")
        .orderBy(F.desc("fecha"), F.desc("hora"), F.desc("id_evento")).limit(limit)
    )


def filtered_alerts(wh, kinds: list[str], state: str) -> DataFrame:
    return wh.alertas.filter(F.col("tipo_alerta").isin(kinds) & (F.col("estado") == state)).select(
        "id_alerta", "tipo_alerta", "nivel_riesgo", "estado")


def dish(wh, id_plato: int) -> DataFrame:
    """One dish; an empty frame means "not found"."""
    return wh.platos.filter(F.col("id_plato") == id_plato).select("id_plato", "nombre", "categoria", "estado")


def ingredient_values(wh) -> DataFrame:
    """Stock value per ingredient with nulls as zero."""
    stock, cost = S.or_zero(F.col("stock_disponible").cast("double")), S.or_zero(F.col("costo_unitario").cast("double"))
    return wh.insumos.select(
        "id_insumo", stock.alias("stock_disponible"), cost.alias("costo_unitario"), S.rd(stock * cost, 2).alias("valor"))


def forecast_history(predictions: DataFrame, dishes: DataFrame, limit: int = 100) -> DataFrame:
    """Latest forecasts with the dish name, rounded per column, confidence in percent."""
    latest = predictions.orderBy(F.desc("fecha_generacion"), F.desc("fecha_objetivo"), F.desc("id_plato")).limit(limit)
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return latest.join(dishes.select("id_plato", "nombre"), "id_plato", "left").select(
        "id_plato", F.coalesce("nombre", F.lit("")).alias("plato"), "fecha_objetivo", "modelo",
        F.round("demanda_estimada", 2).alias("demanda"), "recomendacion_produccion", "riesgo_desperdicio",
        F.round(value("mae"), 2).alias("mae"), F.round(value("r2"), 3).alias("r2"),
        F.round(value("confianza") * 100, 1).alias("confianza_pct"))


def latest_tickets(wh, limit: int = 200) -> DataFrame:
    return wh.ventas.orderBy(F.desc("fecha"), F.desc("hora"), F.desc("id_venta")).limit(limit).select(
        "id_venta", "fecha", "hora", F.col("total").cast("double").alias("total"), "metodo_pago")


def ticket_lines(wh, limit: int = 200) -> DataFrame:
    """The latest tickets with their lines and dish names, one row per line. Up to ``BROADCAST_TICKETS``
    tickets are a proven small side: they are broadcast and the lines are filtered where they lie, so a
    ticket with very many lines is never gathered. More tickets are left to size-based planning."""
    head = latest_tickets(wh, limit)
    if limit <= BROADCAST_TICKETS:
        head = F.broadcast(head)
    lines = wh.detalle_ventas.select("id_venta", "id_plato", "cantidad", "subtotal").join(head, "id_venta")
    return lines.join(wh.platos.select("id_plato", "nombre"), "id_plato", "left").select(
        "id_venta", "fecha", "total", "id_plato", F.coalesce("nombre", F.lit("")).alias("plato"), "cantidad",
        F.col("subtotal").cast("double").alias("subtotal"))


def ticket_pricing(wh) -> DataFrame:
    """Stored total of every ticket beside the total recomputed from dish price times quantity."""
    priced = wh.detalle_ventas.join(wh.platos.select("id_plato", "precio_venta"), "id_plato")
    again = priced.groupBy("id_venta").agg(F.sum(F.col("precio_venta") * F.col("cantidad")).alias("r"), F.sum("subtotal").alias("s"))
    return wh.ventas.join(again, "id_venta").select(
        "id_venta", F.col("total").cast("double").alias("total"), F.col("r").cast("double").alias("recalculado"),
        F.col("s").cast("double").alias("suma_lineas"), (F.col("total") == F.col("r")).alias("coincide"))


def has_permission(role: Column, module: Column, action: Column) -> Column:
    """Permission test against the fixed role matrix; one hashed set lookup per row."""
    allowed = [f"{r}|{m}|{a}" for r, mods in K.PERMISSIONS.items() for m, acts in mods.items() for a in acts]
    wildcard = [r for r, mods in K.PERMISSIONS.items() if "todos" in mods]
    target = F.when(role.isin(wildcard), F.lit("todos")).otherwise(module)
    return F.coalesce(F.concat_ws("|", role, target, action).isin(allowed), F.lit(False))


def permission_audit(wh) -> DataFrame:
    """Log rows by role, module and action, with whether the role holds that permission."""
    return wh.bitacora.groupBy("rol", "modulo", "accion").agg(F.count("*").alias("n")).withColumn(
        "permitido", has_permission(F.col("rol"), F.col("modulo"), F.col("accion")))


def quality_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per named rule (a flag that should hold), one pass over ``df``."""
    counts = df.agg(F.count("*").alias("filas"), *[F.count(F.when(~ok, 1)).alias(name) for name, ok in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("regla"), F.col(n).alias("violaciones")) for n in rules]))
    return counts.select("filas", pairs.alias("p")).select("p.regla", "filas", "p.violaciones")


def contacts(wh) -> DataFrame:
    """Contact columns in the raw text form that a form would deliver."""
    key, name = F.col("id_cliente"), F.col("nombre")
    return wh.clientes.select(
        "id_cliente", "nombre",
        F.when(key % 5 == 0, name).otherwise(F.concat(F.replace(F.lower(name), F.lit("#"), F.lit(".")), F.lit("@correo.pe"))).alias("correo"),
        F.when(key % 7 == 0, key.cast("string")).otherwise(F.lpad(key.cast("string"), 11, "2")).alias("ruc"),
        F.when(key % 11 == 0, "").when(key % 6 == 0, F.concat(F.lit("tel "), key.cast("string")))
        .otherwise(F.concat(F.lit("+51 900"), F.lpad(key.cast("string"), 6, "0"))).alias("telefono"),
        F.when(key % 9 == 0, "n/a").otherwise((key - 20).cast("string")).alias("credito"),
        F.concat(F.lit("pw"), key.cast("string")).alias("clave"))


def contact_quality(wh) -> DataFrame:
    return quality_counts(contacts(wh), {
        "correo": S.valid_email(F.col("correo")), "ruc": S.valid_tax_id(F.col("ruc")),
        "telefono": S.valid_phone(F.col("telefono")), "nombre": S.not_blank(F.col("nombre")),
        "credito": S.not_negative(F.col("credito")), "clave": S.valid_password(F.col("clave"))})


def waste_listing(wh) -> DataFrame:
    """Waste rows with both names, newest first."""
    dishes = wh.platos.select("id_plato", F.col("nombre").alias("p"))
    ingredients = wh.insumos.select("id_insumo", F.col("nombre").alias("i"))
    return (
        join_known(join_known(wh.desperdicios, dishes, "id_plato"), ingredients, "id_insumo")
        .select("fecha", "tipo", F.coalesce("p", F.lit("")).alias("plato"), F.coalesce("i", F.lit("")).alias("insumo"),
                "cantidad", "unidad_medida", "motivo", F.col("costo_estimado").cast("double").alias("costo_estimado"))
        .orderBy(F.desc("fecha"))
    )


def production_listing(wh) -> DataFrame:
    return (
        wh.producciones.join(wh.platos.select("id_plato", "nombre"), "id_plato", "left")
        .select("fecha", "id_plato", F.coalesce("nombre", F.lit("")).alias("plato"), "preparada", "vendida", "sobrante")
        .orderBy(F.desc("fecha"))
    )


def recipe_listing(wh, id_plato: int | None = None) -> DataFrame:
    recipes = wh.recetas if id_plato is None else wh.recetas.filter(F.col("id_plato") == id_plato)
    return (
        recipes.join(wh.platos.select("id_plato", F.col("nombre").alias("plato")), "id_plato", "left")
        .join(wh.insumos.select("id_insumo", F.col("nombre").alias("insumo")), "id_insumo", "left")
        .select("id_plato", "id_insumo", F.coalesce("plato", F.lit("")).alias("plato"),
                F.coalesce("insumo", F.lit("")).alias("insumo"), F.col("cantidad_usada").cast("double").alias("cantidad_usada"))
    )


def over_limit_dishes(wh, limit: float = K.WASTE_LIMIT_PCT, days: int = 30) -> DataFrame:
    """Dishes that made something and wasted more than the configured share of it."""
    made = trailing(wh.producciones, wh.as_of, days).groupBy("id_plato").agg(
        F.sum("sobrante").cast("double").alias("s"), F.sum("preparada").cast("double").alias("m"))
    return (
        made.filter("m > 0").withColumn("porcentaje", F.col("s") / F.col("m") * 100).filter(F.col("porcentaje") > limit)
        .join(wh.platos.select("id_plato", "nombre"), "id_plato")
        .select("id_plato", "nombre", S.rd(F.col("porcentaje"), 2).alias("porcentaje"))
    )


def text_formats(wh) -> DataFrame:
    """Display texts of every ticket: money, date, weekday and month name."""
    return wh.ventas.select(
        "id_venta", S.money_text(F.col("total")).alias("total_texto"), S.date_text(F.col("fecha")).alias("fecha_texto"),
        S.weekday_name(F.weekday("fecha")).alias("dia"), S.month_name(F.month("fecha")).alias("mes"))


def sales_lines(wh, id_plato: int | None = None) -> DataFrame:
    """Ticket lines with date, category and list price; the dish filter reaches the line scan."""
    lines = dated_lines(wh)
    if id_plato is not None:
        lines = lines.filter(F.col("id_plato") == id_plato)
    return lines.join(wh.platos.select("id_plato", "categoria", F.col("precio_venta").cast("double").alias("precio")), "id_plato").select(
        "id_venta", "id_plato", "fecha", "cantidad", "categoria", "precio")


def production_by_dish(wh) -> DataFrame:
    made = wh.producciones.groupBy("id_plato").agg(
        F.sum("preparada").cast("long").alias("preparada"), F.sum("sobrante").cast("long").alias("sobrante"))
    return made.join(wh.platos.select("id_plato", "nombre"), "id_plato").select("id_plato", "nombre", "preparada", "sobrante")


def waste_named(wh) -> DataFrame:
    """Waste cost by the first non-empty of ingredient and dish category."""
    grouped = wh.desperdicios.groupBy("id_insumo", "id_plato").agg(F.sum("costo_estimado").alias("c"), F.count("*").alias("n"))
    name = F.coalesce(F.nullif("ci", F.lit("")), F.nullif("cp", F.lit("")), F.lit("Otros"))
    return (
        grouped.join(wh.insumos.select("id_insumo", F.col("categoria").alias("ci")), "id_insumo", "left")
        .join(wh.platos.select("id_plato", F.col("categoria").alias("cp")), "id_plato", "left")
        .groupBy(name.alias("categoria")).agg(F.sum("c").cast("double").alias("costo"), F.sum("n").cast("long").alias("registros"))
    )


def seed_missing(existing: DataFrame, rows: DataFrame, natural_key: list[str]) -> DataFrame:
    """Rows whose natural key is not stored yet: the idempotent part of a master-data load."""
    return rows.join(existing.select(*natural_key), natural_key, "left_anti").select(*rows.columns)
