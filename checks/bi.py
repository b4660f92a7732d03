"""SQL twins of wastelens.operators.bi."""

from checks.prelude import num, pct, sql

MONTH = "fecha >= date_trunc('month', (SELECT d FROM hoy))"
YEAR = "fecha >= date_trunc('year', (SELECT d FROM hoy))"
D30 = "fecha >= (SELECT d FROM hoy) - 30"
WEEK = "fecha BETWEEN (SELECT d FROM hoy) - 6 AND (SELECT d FROM hoy)"
C30 = "fecha BETWEEN (SELECT d FROM hoy) - 30 AND (SELECT d FROM hoy)"
DAY = "fecha = (SELECT d FROM hoy)"
MTD = f"{MONTH} AND fecha <= (SELECT d FROM hoy)"


def tot(c):
    return f"coalesce(CAST(sum({c}) AS DOUBLE), 0.0)"


def named(where):
    return f"""
por_nombre AS (
  SELECT nombre, CAST(sum(cantidad) AS BIGINT) AS vendidos, CAST(sum(subtotal) AS DOUBLE) AS ingreso
  FROM detalle JOIN ventas USING (id_venta) JOIN platos USING (id_plato) WHERE {where} GROUP BY nombre)"""


DAILY = """
v AS (SELECT fecha, CAST(sum(total) AS DOUBLE) AS ventas, count(*) AS tickets FROM ventas GROUP BY fecha),
w AS (SELECT fecha, CAST(sum(costo_estimado) AS DOUBLE) AS c, CAST(sum(cantidad) AS DOUBLE) AS q FROM desperdicios GROUP BY fecha),
n AS (SELECT fecha, nombre, sum(cantidad) AS u FROM detalle JOIN ventas USING (id_venta) JOIN platos USING (id_plato) GROUP BY 1, 2),
t AS (SELECT fecha, CAST(sum(u) AS BIGINT) AS platos_vendidos FROM n GROUP BY fecha),
r AS (SELECT fecha, nombre FROM n QUALIFY row_number() OVER (PARTITION BY fecha ORDER BY u DESC, nombre) = 1),
dia AS (
  SELECT v.fecha, {ventas} AS ventas_total, tickets, coalesce(platos_vendidos, 0) AS platos_vendidos,
         {coste} AS desperdicio_total, {cant} AS desperdicio_cantidad, {ratio} AS porcentaje_desperdicio,
         coalesce(r.nombre, 'Sin ventas') AS top_plato,
         CASE WHEN {raw} < 15 THEN 'OK - Bajo control' ELSE 'ALERTA - Supera umbral' END AS estado
  FROM v LEFT JOIN w USING (fecha) LEFT JOIN t USING (fecha) LEFT JOIN r USING (fecha))
""".format(
    ventas=num("ventas", 2), coste=num("coalesce(c, 0)", 2), cant=num("coalesce(q, 0)", 2),
    ratio=num(pct("coalesce(c, 0)", "ventas"), 2), raw=pct("coalesce(c, 0)", "ventas"))

PERIOD = """
SELECT *, {r} AS porcentaje FROM
 (SELECT {v} AS ventas, count(*) AS tickets FROM ventas WHERE {w}),
 (SELECT {c} AS desperdicio, {q} AS cantidad, count(*) AS casos FROM desperdicios WHERE {w})"""


def period(where):
    return sql(PERIOD.format(v=tot("total"), c=tot("costo_estimado"), q=tot("cantidad"), w=where,
                             r=num(pct("desperdicio", "ventas"), 2)))


ORACLES = {
    "a01_kpis": sql(f"""
SELECT (SELECT {tot('total')} FROM ventas WHERE {MONTH}) AS ventas_mes,
       (SELECT count(*) FROM ventas WHERE {DAY}) AS num_ventas_hoy,
       (SELECT {tot('costo_estimado')} FROM desperdicios WHERE {MONTH}) AS costo_desperdicio_mes,
       (SELECT count(*) FROM insumos WHERE estado AND stock_disponible <= stock_minimo) AS stock_critico,
       (SELECT count(*) FROM alertas WHERE nivel_riesgo IN ('ALTO','CRITICO') AND estado = 'pendiente') AS alertas_criticas"""),
    "a02_summary": sql(f"""
SELECT (SELECT {tot('total')} FROM ventas WHERE {MONTH}) AS total_ventas_mes,
       (SELECT {tot('total')} FROM ventas WHERE {YEAR}) AS total_ventas_anio,
       (SELECT count(*) FROM ventas WHERE {MONTH}) AS num_ventas_mes,
       (SELECT {tot('costo_estimado')} FROM desperdicios WHERE {MONTH}) AS total_desperdicio_mes,
       (SELECT CAST(coalesce(sum(sobrante), 0) AS BIGINT) FROM producciones WHERE {MONTH}) AS sobrante_mes"""),
    "a03_daily_sales": sql(f"SELECT fecha, {tot('total')} AS total, count(*) AS num_ventas FROM ventas WHERE {D30} GROUP BY fecha"),
    "a04_monthly_sales": sql(f"""
SELECT strftime(fecha, '%Y-%m') AS mes, {tot('total')} AS total, count(*) AS num
FROM ventas WHERE fecha >= (SELECT d FROM hoy) - 365 GROUP BY 1"""),
    "a05_monthly_waste": sql(f"""
SELECT strftime(fecha, '%Y-%m') AS mes, {tot('costo_estimado')} AS costo, count(*) AS num
FROM desperdicios WHERE fecha >= (SELECT d FROM hoy) - 365 GROUP BY 1"""),
    "a06_waste_by_reason": sql(f"""
SELECT motivo, {tot('costo_estimado')} AS costo, count(*) AS cantidad FROM desperdicios WHERE {D30} GROUP BY motivo"""),
    "a07_efficiency": sql("""
SELECT puntaje_produccion, puntaje_alertas, puntaje_desperdicio, indice,
       CASE WHEN indice >= 80 THEN 'verde' WHEN indice >= 60 THEN 'amarillo' ELSE 'rojo' END AS color
FROM (SELECT *, round(puntaje_produccion * 0.4::DOUBLE + puntaje_alertas * 0.3::DOUBLE + puntaje_desperdicio * 0.3::DOUBLE, 1) AS indice FROM puntos)""", f"""
p AS (SELECT {tot('sobrante')} AS s, {tot('preparada')} AS m FROM producciones WHERE {D30}),
a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (estado IN ('resuelta','leida')) AS DOUBLE) AS g FROM alertas),
c AS (SELECT (SELECT {tot('costo_estimado')} FROM desperdicios WHERE {D30}) AS now,
             (SELECT {tot('costo_estimado')} FROM desperdicios WHERE fecha >= (SELECT d FROM hoy) - 60 AND fecha < (SELECT d FROM hoy) - 30) AS prev),
puntos AS (
  SELECT CASE WHEN m > 0 THEN round(greatest(0.0, 1 - s / m * 2) * 100, 1) ELSE 50.0 END AS puntaje_produccion,
         CASE WHEN n > 0 THEN round(g / n * 100, 1) ELSE 100.0 END AS puntaje_alertas,
         CASE WHEN prev > 0 THEN round(greatest(0.0, least(100.0, 70 - (now - prev) / prev * 100)), 1)
              WHEN now = 0 THEN 100.0 ELSE 50.0 END AS puntaje_desperdicio
  FROM p, a, c)"""),
    "a12_savings": sql(f"""
SELECT 30 AS periodo_dias, round(a, 2) AS costo_actual, round(p, 2) AS costo_anterior, round(p - a, 2) AS ahorro_periodo,
       {num(pct('p - a', 'p'), 1)} AS porcentaje_mejora, round(h, 2) AS total_historico,
       CASE WHEN p - a > 0 THEN 'mejora' WHEN p - a = 0 THEN 'igual' ELSE 'empeora' END AS tendencia
FROM (SELECT (SELECT {tot('costo_estimado')} FROM desperdicios WHERE {D30}) AS a,
             (SELECT {tot('costo_estimado')} FROM desperdicios WHERE fecha >= (SELECT d FROM hoy) - 60 AND fecha < (SELECT d FROM hoy) - 30) AS p,
             (SELECT {tot('costo_estimado')} FROM desperdicios WHERE fecha >= DATE '2020-01-01') AS h)"""),
    "a13_daily_summary": sql(f"SELECT * FROM dia WHERE {DAY}", DAILY),
    "a13_daily_summaries": sql("SELECT * FROM dia", DAILY),
    "a14_weekly_summary": sql(f"""
SELECT CAST((SELECT d - 6 FROM hoy) AS VARCHAR) || ' al ' || CAST((SELECT d FROM hoy) AS VARCHAR) AS periodo,
       round(v, 2) AS ventas_semana, n AS tickets_semana, round(v / 7, 2) AS promedio_diario, round(c, 2) AS desperdicio_semana,
       {num(pct('c', 'v'), 2)} AS porcentaje_desperdicio,
       coalesce((SELECT string_agg(nombre || ': ' || vendidos || ' und.', ', ' ORDER BY vendidos DESC, nombre) FROM
          (SELECT * FROM por_nombre ORDER BY vendidos DESC, nombre LIMIT 5)), 'Sin datos') AS top_5_platos,
       coalesce((SELECT string_agg(motivo || ': ' || k, ', ' ORDER BY k DESC, motivo) FROM
          (SELECT motivo, count(*) AS k FROM desperdicios WHERE {WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)), 'Sin datos') AS motivos_principales,
       CASE WHEN {pct('c', 'v')} < 15 THEN 'OK - Bajo control' ELSE 'ALERTA - Supera umbral' END AS estado
FROM (SELECT {tot('total')} AS v, count(*) AS n FROM ventas WHERE {WEEK}),
     (SELECT {tot('costo_estimado')} AS c FROM desperdicios WHERE {WEEK})""", named(WEEK)),
    "a15_day_tickets": sql(f"SELECT id_venta, hora, CAST(total AS DOUBLE) AS total, metodo_pago FROM ventas WHERE {DAY}"),
    "a15_day_waste": sql(f"SELECT tipo, cantidad, motivo, CAST(costo_estimado AS DOUBLE) AS costo FROM desperdicios WHERE {DAY}"),
    "a15_day_totals": period(DAY),
    "a16_week_days": sql(f"SELECT fecha, {tot('total')} AS total, count(*) AS tickets FROM ventas WHERE {WEEK} GROUP BY fecha"),
    "a16_week_top": sql("SELECT nombre AS plato, vendidos AS cantidad FROM por_nombre ORDER BY vendidos DESC, nombre LIMIT 10", named(WEEK)),
    "a16_week_total": sql(f"SELECT {tot('total')} AS total, count(*) AS tickets, round({tot('total')} / 7, 2) AS promedio_diario FROM ventas WHERE {WEEK}"),
    "a17_month_waste": period(MTD),
    "a17_month_reasons": sql(f"SELECT motivo, count(*) AS casos FROM desperdicios WHERE {MTD} GROUP BY motivo"),
    "a18_executive_totals": period(C30),
    "a18_executive_top": sql("SELECT nombre AS plato, vendidos AS unidades FROM por_nombre ORDER BY vendidos DESC, nombre LIMIT 10", named(C30)),
    "a19_top_waste_dishes": sql(f"""
SELECT nombre AS plato, {tot('cantidad')} AS cantidad, {tot('d.costo_estimado')} AS costo
FROM desperdicios d JOIN platos p USING (id_plato) WHERE {D30} GROUP BY nombre ORDER BY sum(d.costo_estimado) DESC, nombre LIMIT 8"""),
    "a19_week_waste_totals": sql(f"SELECT count(*) AS registros, {tot('costo_estimado')} AS costo FROM desperdicios WHERE fecha >= (SELECT d FROM hoy) - 7"),
    "a20_month_context": sql(f"""
SELECT (SELECT nombre FROM restaurantes ORDER BY id_restaurante LIMIT 1) AS restaurante,
       (SELECT {tot('total')} FROM ventas WHERE {MONTH}) AS ventas_mes,
       (SELECT {tot('costo_estimado')} FROM desperdicios WHERE {MONTH}) AS desperdicio_mes,
       (SELECT count(*) FROM platos WHERE estado) AS platos_activos"""),
    "j11_restaurant_comparison": sql(f"""
SELECT id_restaurante, nombre, distrito, coalesce(v, 0.0::DOUBLE) AS ventas, coalesce(w, 0.0::DOUBLE) AS desperdicio,
       {num(pct('coalesce(w, 0)', 'coalesce(v, 0)'), 2)} AS porcentaje
FROM restaurantes
LEFT JOIN (SELECT id_restaurante, CAST(sum(total) AS DOUBLE) AS v FROM ventas_por_local WHERE {C30} GROUP BY 1) USING (id_restaurante)
LEFT JOIN (SELECT id_restaurante, CAST(sum(costo_estimado) AS DOUBLE) AS w FROM desperdicios WHERE {C30} GROUP BY 1) USING (id_restaurante)"""),
    "t01_top_dishes": sql("SELECT nombre AS plato, vendidos, ingreso FROM por_nombre ORDER BY vendidos DESC, nombre LIMIT 10", named(D30)),
    "t02_top_reasons_with_cost": sql(f"""
SELECT * FROM (SELECT motivo, count(*) AS frecuencia, {tot('costo_estimado')} AS costo FROM desperdicios WHERE {D30}
GROUP BY motivo ORDER BY 2 DESC, 1 LIMIT 3) WHERE costo > 0"""),
    "r14_waste_over_limit": sql("""
SELECT fecha, porcentaje_desperdicio, desperdicio_total, ventas_total, 0.05::DOUBLE AS umbral_permitido
FROM dia WHERE porcentaje_desperdicio > 0.05""", DAILY),
}
