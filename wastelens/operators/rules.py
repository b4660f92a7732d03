"""Alert rules. Each rule returns every candidate at once in the common alert shape; the
cool-down against the alert history is one anti join for all rules of a resource kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wastelens.asof import days_before, in_period, trailing
from wastelens.functions import constants as K
from wastelens.functions.scalar import (
    expiry_level, expiry_risk_pct, fixed_text, level_by_cuts, level_rank, or_zero, rd,
)
from wastelens.functions.text import render
from wastelens.operators import bi, replenish
from wastelens.operators.common import dated_lines


def advice_context(weather: int, event: int) -> str:
    if weather != 3 and event < 1:
        return ""
    return K.ADVICE_CONTEXT.format(
        clima=K.WEATHER_LABELS.get(weather, ""), evento=K.EVENT_LABELS.get(event, ""),
        efecto="aumentar" if event >= 1 else "reducir")


def _shape(kind: str, context: str, level: Column, risk: Column, resource: str = "id_plato",
           predicted: Column | None = None, actual: Column | None = None, **slots: Column) -> Column:
    """The common alert shape as one struct column."""
    none_long, none = F.lit(None).cast("long"), F.lit(None).cast("double")
    slots = {"nombre": F.col("nombre"), **slots}
    return F.struct(
        F.lit(kind).alias("tipo_alerta"), level.alias("nivel_riesgo"),
        render(K.ALERT_TITLES[kind], **slots).alias("titulo"),
        render(K.ALERT_DESCRIPTIONS[kind], **slots).alias("descripcion"),
        F.concat(render(K.ALERT_ADVICE[kind], **slots), F.lit(context)).alias("recomendacion"),
        (F.col("id_plato") if resource == "id_plato" else none_long).alias("id_plato"),
        (F.col("id_insumo") if resource == "id_insumo" else none_long).alias("id_insumo"),
        (none if predicted is None else predicted).cast("double").alias("valor_predicho"),
        (none if actual is None else actual).cast("double").alias("valor_actual"),
        risk.cast("double").alias("porcentaje_riesgo"))


def _emit(df: DataFrame, condition: Column, shape: Column) -> DataFrame:
    return df.filter(condition).select(shape.alias("a")).select("a.*")


# ---- measures the rules look at ----
def leftovers_by_dish(wh, days: int = 30) -> DataFrame:
    """Leftover share per dish over the trailing window."""
    return (
        trailing(wh.producciones, wh.as_of, days).groupBy("id_plato")
        .agg(F.sum("sobrante").cast("long").alias("sobrante"), F.sum("preparada").cast("long").alias("preparada"))
        .filter("preparada > 0").withColumn("pct", F.col("sobrante").cast("double") / F.col("preparada") * 100)
    )


def leftovers(wh, days: int = 30) -> DataFrame:
    return leftovers_by_dish(wh, days).join(wh.platos.select("id_plato", "nombre"), "id_plato")


def demand_by_dish(wh, days: int = 30) -> DataFrame:
    """Units of this and the previous window per dish, from one scan of both."""
    recent = F.col("fecha") >= wh.as_of.get(days_before(days))
    return (
        dated_lines(wh, lambda v: in_period(v, wh.as_of, first=days_before(2 * days)))
        .groupBy("id_plato").agg(
            F.sum(F.when(recent, F.col("cantidad"))).cast("long").alias("r"),
            F.sum(F.when(~recent, F.col("cantidad"))).cast("long").alias("p"),
            F.count(F.when(recent, 1)).alias("n"))
    )


def _with_change(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.withColumns({
        "reciente": F.coalesce("r", zero), "previo": F.coalesce("p", zero), "ventas_recientes": F.coalesce("n", zero),
    }).drop("r", "p", "n").withColumn(
        "caida", F.when(F.col("previo") > 0, (F.col("previo") - F.col("reciente")) / F.col("previo") * 100))


def demand_change(wh, days: int = 30) -> DataFrame:
    """Demand of this and the previous window for every active dish."""
    dishes = wh.platos.filter("estado").select("id_plato", "nombre", "estado")
    return _with_change(dishes.join(demand_by_dish(wh, days), "id_plato", "left"))


def waste_by_dish(wh, days: int = 30) -> DataFrame:
    return trailing(wh.desperdicios, wh.as_of, days).filter("id_plato IS NOT NULL").groupBy("id_plato").agg(
        F.sum("costo_estimado").cast("double").alias("costo"), F.sum("cantidad").cast("double").alias("cantidad"))


def waste_cost(wh, days: int = 30) -> DataFrame:
    return waste_by_dish(wh, days).join(wh.platos.select("id_plato", "nombre"), "id_plato")


def dish_measures(wh, days: int = 30) -> DataFrame:
    """All measures side by side: every fact is read once and reduced to one row per dish."""
    return _with_change(
        wh.platos.select("id_plato", "nombre", "estado")
        .join(leftovers_by_dish(wh, days), "id_plato", "left")
        .join(demand_by_dish(wh, days), "id_plato", "left")
        .join(waste_by_dish(wh, days), "id_plato", "left"))


# ---- rules: condition and alert shape over the measures ----
def dish_rules(context: str = "") -> dict[str, tuple[Column, Column]]:
    pct, drop, cost = F.col("pct"), F.col("caida"), F.col("costo")
    return {
        K.OVERPRODUCTION: (pct >= 10, _shape(
            K.OVERPRODUCTION, context, level_by_cuts(pct, K.CUTS[K.OVERPRODUCTION]), rd(pct, 2),
            predicted=F.col("preparada") - F.col("sobrante"), actual=F.col("sobrante"), pct=fixed_text(pct, 1),
            sobrante=F.col("sobrante"), preparada=F.col("preparada"), ajuste=F.least(F.floor(pct * 0.8), F.lit(40)))),
        K.LOW_DEMAND: (F.col("estado") & (drop >= 20), _shape(
            K.LOW_DEMAND, context, level_by_cuts(drop, K.CUTS[K.LOW_DEMAND]), rd(drop, 2), predicted=F.col("previo"),
            actual=F.col("reciente"), pct=fixed_text(drop, 1), previo=F.col("previo"), reciente=F.col("reciente"))),
        K.HIGH_WASTE: (cost >= 20, _shape(
            K.HIGH_WASTE, context, level_by_cuts(cost, K.CUTS[K.HIGH_WASTE]), rd(F.least(cost / 2, F.lit(100.0)), 2),
            predicted=F.lit(0.0), actual=cost, costo=fixed_text(cost, 2), cantidad=fixed_text(F.col("cantidad"), 2))),
        K.MENU: (F.col("estado") & (F.col("ventas_recientes") == 0), _shape(
            K.MENU, context, F.lit("BAJO"), F.lit(0.0), actual=F.lit(0.0))),
        K.CRITICAL: (F.col("estado") & (drop >= 20) & (cost >= K.CUTS[K.HIGH_WASTE][1]), _critical(context)),
    }


def _critical(context: str) -> Column:
    return _shape(K.CRITICAL, context, F.lit("CRITICO"), F.lit(100.0))


def overproduction(wh, context: str = "") -> DataFrame:
    return _emit(leftovers(wh), *dish_rules(context)[K.OVERPRODUCTION])


def low_demand(wh, context: str = "") -> DataFrame:
    return _emit(demand_change(wh), *dish_rules(context)[K.LOW_DEMAND])


def high_waste(wh, context: str = "") -> DataFrame:
    return _emit(waste_cost(wh), *dish_rules(context)[K.HIGH_WASTE])


def unsold(wh, context: str = "") -> DataFrame:
    return _emit(demand_change(wh), *dish_rules(context)[K.MENU])


def combined_risk(wh, context: str = "") -> DataFrame:
    """Low demand and costly waste at once, both judged at the reporting date."""
    return _emit(demand_change(wh).join(waste_by_dish(wh), "id_plato"), *dish_rules(context)[K.CRITICAL])


def combined_risk_history(wh, context: str = "") -> DataFrame:
    """As :func:`combined_risk`, but the low-demand side is the pending alerts of the history, and
    only waste alerts that pass the cool-down count."""
    low = wh.alertas.filter((F.col("tipo_alerta") == K.LOW_DEMAND) & (F.col("estado") == "pendiente"))
    costly = without_recent(wh, high_waste(wh), "id_plato").filter(F.col("nivel_riesgo").isin("ALTO", "CRITICO"))
    ids = costly.select("id_plato").intersect(low.filter("id_plato IS NOT NULL").select("id_plato"))
    return wh.platos.select("id_plato", "nombre").join(ids, "id_plato", "left_semi").select(
        _critical(context).alias("a")).select("a.*")


def expiring_soon(wh, context: str = "") -> DataFrame:
    stock, days = F.coalesce(F.col("stock_disponible").cast("double"), F.lit(0.0)), F.col("dias")
    return _emit(replenish.expiring(wh), F.lit(True), _shape(
        K.EXPIRING, context, expiry_level(days), expiry_risk_pct(days), resource="id_insumo", predicted=stock, actual=days,
        dias=days, fecha=F.col("fecha_vencimiento"), stock=fixed_text(stock, 2), unidad=F.col("unidad_medida")))


def overstock(wh, context: str = "") -> DataFrame:
    stock, floor, ratio = F.col("stock_disponible"), F.col("stock_minimo"), F.col("ratio")
    rated = wh.insumos.filter(F.col("estado") & (floor > 0)).withColumn("ratio", stock.cast("double") / floor.cast("double"))
    return _emit(rated, stock > floor * 3, _shape(
        K.OVERSTOCK, context, level_by_cuts(ratio, K.CUTS[K.OVERSTOCK]), rd(F.least(ratio * 10, F.lit(100.0)), 2),
        resource="id_insumo", predicted=floor, actual=stock, stock=fixed_text(stock, 2), unidad=F.col("unidad_medida"),
        ratio=fixed_text(ratio, 1)))


def recent_pending(wh, hours: int = 24) -> DataFrame:
    since = wh.now.get(lambda t: t - F.make_dt_interval(hours=F.lit(hours)))
    return wh.alertas.filter((F.col("estado") == "pendiente") & (F.col("fecha_generacion") >= since))


def without_recent(wh, candidates: DataFrame, resource: str, hours: int = 24) -> DataFrame:
    """Drop candidates whose resource has a pending alert of the same type in the last hours."""
    recent = recent_pending(wh, hours).select("tipo_alerta", resource)
    return candidates.join(recent, ["tipo_alerta", resource], "left_anti").select(*candidates.columns)


def all_candidates(wh, context: str = "", strict_reference: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates of the dish rules and of the ingredient rules, before the cool-down."""
    rules = dish_rules(context)
    if strict_reference:
        del rules[K.CRITICAL]
    hits = F.explode(F.array_compact(F.array(*[F.when(c, shape) for c, shape in rules.values()])))
    dishes = dish_measures(wh).select(hits.alias("a")).select("a.*")
    if strict_reference:
        dishes = dishes.unionByName(combined_risk_history(wh, context))
    return dishes, expiring_soon(wh, context).unionByName(overstock(wh, context))


def generate_alerts(wh, weather: int = 2, event: int = 0, strict_reference: bool = False) -> DataFrame:
    dishes, ingredients = all_candidates(wh, advice_context(weather, event), strict_reference)
    return without_recent(wh, dishes, "id_plato").unionByName(without_recent(wh, ingredients, "id_insumo"))


def cooled_down(wh) -> DataFrame:
    """The candidates that the cool-down holds back."""
    dishes, ingredients = all_candidates(wh)
    held = [
        c.join(recent_pending(wh).select("tipo_alerta", key), ["tipo_alerta", key], "left_semi")
        for c, key in ((dishes, "id_plato"), (ingredients, "id_insumo"))
    ]
    return held[0].unionByName(held[1]).select("tipo_alerta", "id_plato", "id_insumo")


def run_summary(wh, **kw) -> DataFrame:
    """Alerts of one run by type and by level, with the grand total."""
    return (
        generate_alerts(wh, **kw)
        .groupingSets([[F.col("tipo_alerta")], [F.col("nivel_riesgo")], []], "tipo_alerta", "nivel_riesgo")
        .agg(F.count("*").alias("n"))
    )


def dish_risk(wh, days: int = 30) -> DataFrame:
    """Waste-risk score 0..100 of every dish."""
    left = trailing(wh.producciones, wh.as_of, days).groupBy("id_plato").agg(
        F.sum("sobrante").cast("double").alias("s"), F.sum("preparada").cast("double").alias("m"))
    cost = trailing(wh.desperdicios, wh.as_of, days).filter("id_plato IS NOT NULL").groupBy("id_plato").agg(
        F.sum("costo_estimado").cast("double").alias("c"))
    share = F.when(F.col("m") > 0, F.col("s") / F.col("m") * 100).otherwise(0.0)
    score = F.least(share * 0.6 + F.least(or_zero(F.col("c")) / 10, F.lit(50.0)) * 0.4, F.lit(100.0))
    return (
        wh.platos.select("id_plato", "nombre").join(left, "id_plato", "left").join(cost, "id_plato", "left")
        .select("id_plato", "nombre", score.alias("p"))
        .select("id_plato", "nombre", rd(F.col("p"), 2).alias("porcentaje"),
                level_by_cuts(F.col("p"), K.CUTS["RIESGO_PLATO"]).alias("nivel"))
    )


# ---- alert lists ----
def active_alerts(wh, limit: int = 50, kind: str | None = None, level: str | None = None,
                  state: str | None = "pendiente") -> DataFrame:
    """The latest ``limit`` alerts, and only then ordered by severity."""
    alerts = wh.alertas
    for column, value in (("estado", state), ("tipo_alerta", kind), ("nivel_riesgo", level)):
        if value:
            alerts = alerts.filter(F.col(column) == value)
    latest = alerts.orderBy(F.desc("fecha_generacion"), F.desc("id_alerta")).limit(limit)
    return (
        latest.join(wh.platos.select("id_plato", F.col("nombre").alias("plato")), "id_plato", "left")
        .join(wh.insumos.select("id_insumo", F.col("nombre").alias("insumo")), "id_insumo", "left")
        .select("id_alerta", "tipo_alerta", "nivel_riesgo", "fecha_generacion", "estado", "id_plato", "id_insumo",
                "plato", "insumo", "valor_actual")
        .orderBy(level_rank(F.col("nivel_riesgo")), F.desc("fecha_generacion"), F.desc("id_alerta"))
    )


def current_states(changes: DataFrame) -> DataFrame:
    """Latest state per alert from the append-only log of changes; of several at the same moment the last in the order of
    ``K.STATES`` counts (names that are not listed come before, by name), so that the result does not depend on the order of rows."""
    place = F.array_position(F.array(*[F.lit(s) for s in K.STATES]), F.col("estado"))
    return changes.groupBy("id_alerta").agg(
        F.max_by("estado", F.struct("momento", place.alias("lugar"), "estado")).alias("estado"), F.max("momento").alias("momento"), F.count("*").alias("cambios"))


def counts_by_level(alerts: DataFrame) -> DataFrame:
    level = F.col("nivel_riesgo")
    return alerts.agg(
        F.count("*").alias("total"),
        *[F.count(F.when(level == name, 1)).alias(name.lower()) for name in K.LEVEL_ORDER])


def to_notify(wh, **kw) -> DataFrame:
    """The alerts of this run, or all pending ones when the run created none."""
    columns = ["tipo_alerta", "nivel_riesgo", "id_plato", "id_insumo"]
    new = generate_alerts(wh, **kw).select(*columns)
    created = new.agg(F.count("*").alias("n")).scalar()
    pending = wh.alertas.filter(F.col("estado") == "pendiente").filter(created == 0).select(*columns)
    return new.unionByName(pending)


def _advice(df: DataFrame, kind: str, severity: Column, module: str, **slots: Column) -> DataFrame:
    title, text = K.RECOMMENDATIONS[kind]
    return df.select(
        F.lit(kind).alias("tipo"), severity.alias("severidad"), render(title, **slots).alias("titulo"),
        render(text, **slots).alias("descripcion"), F.lit(module).alias("modulo"))


def recommendations(wh, limit: float = K.WASTE_LIMIT_PCT) -> DataFrame:
    name, unit = F.col("nombre"), F.col("unidad_medida")
    stock = _advice(
        replenish.critical_stock(wh), "stock_bajo", F.lit("alta"), "insumos", nombre=name, unidad=unit,
        stock=F.col("stock_disponible").cast("double"), minimo=F.col("stock_minimo").cast("double"))
    due = _advice(
        replenish.expiring(wh), "vencimiento", F.when(F.col("dias") <= 2, "alta").otherwise("media"), "insumos",
        nombre=name, dias=F.col("dias"), fecha=F.col("fecha_vencimiento"))
    over = _advice(
        leftovers(wh).filter(F.col("pct") > limit), "sobreproduccion", F.lit("media"), "produccion", nombre=name,
        pct=fixed_text(F.col("pct"), 1))
    reasons = _advice(
        bi.top_reasons_with_cost(wh), "motivo_desperdicio", F.lit("baja"), "desperdicio", motivo=F.col("motivo"),
        frecuencia=F.col("frecuencia"), costo=fixed_text(F.col("costo"), 2))
    return stock.unionByName(due).unionByName(over).unionByName(reasons)


def recommendations_by_severity(wh) -> DataFrame:
    return recommendations(wh).groupBy("severidad").agg(F.count("*").alias("n"))


def dashboard_alerts(wh) -> DataFrame:
    def note(df, kind, severity, **slots):
        title, text = K.DASHBOARD_ALERTS[kind]
        return df.select(F.lit(kind).alias("tipo"), F.lit(severity).alias("severidad"),
                         render(title, **slots).alias("titulo"), render(text, **slots).alias("mensaje"))

    low = note(replenish.critical_stock(wh), "stock_bajo", "advertencia", nombre=F.col("nombre"),
               stock=F.col("stock_disponible").cast("double"), unidad=F.col("unidad_medida"))
    due = note(replenish.expiring(wh), "vencimiento", "critica", nombre=F.col("nombre"), fecha=F.col("fecha_vencimiento"))
    return low.unionByName(due)


def waste_outbox(wh, limit: float = K.WASTE_LIMIT_PCT, delivered: Column | None = None) -> DataFrame:
    """Outbox rows for the days over the waste limit; undelivered ones are the ones to resend."""
    title, text = K.OUTBOX_WASTE
    pct = fixed_text(F.col("porcentaje_desperdicio"), 2)
    sent = F.lit(False) if delivered is None else delivered
    return bi.waste_over_limit(wh, limit).select(
        F.lit("desperdicio").alias("tipo"), render(title, pct=pct).alias("titulo"),
        F.substring(render(text, pct=pct, umbral=str(limit)), 1, 1000).alias("mensaje"),
        F.lit("critica").alias("severidad"), sent.alias("enviado"),
        F.when(sent, F.col("fecha")).alias("fecha_envio"), "fecha")


def to_resend(outbox: DataFrame) -> DataFrame:
    return outbox.filter(~F.col("enviado"))
