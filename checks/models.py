"""SQL twins of stored runs, generator, streams and the closed-form parts of the models."""

import math

from checks.forecast import BEST, FOLDS, FSCORES
from checks.prelude import pick, sql, sql_list
from checks.series import CONT, LINES
from wastelens.functions import constants as K
from wastelens.models.trend import KNOTS, WEEKLY, YEARLY
from wastelens.sources.generate import HOURS, MODULUS, PAYMENTS


def rnd(expr):
    return f"CAST(round(CAST({expr} AS DECIMAL(38,9)), 4) AS DOUBLE)"


def draw(salt, *keys):
    value = f"CAST({salt} AS BIGINT)"
    for k in keys:
        value = f"(({value} * 7919 + CAST({k} AS BIGINT) * 104729 + 17) % {MODULUS})"
    return value


def waves(period, order):
    out = []
    for k in range(1, order + 1):
        f = repr(2 * math.pi * k / period)
        out += [f"sin(dia * {f}::DOUBLE)", f"cos(dia * {f}::DOUBLE)"]
    return out


_z = ["1.0::DOUBLE", "t", *[f"greatest(0.0, t - {0.8 * j / (KNOTS + 1)!r}::DOUBLE)" for j in range(1, KNOTS + 1)],
      *waves(7.0, WEEKLY), *waves(365.25, YEARLY), "cantidad"]
DESIGN = CONT + f""",
base AS (SELECT serie, cantidad, CAST(row_number() OVER (PARTITION BY serie ORDER BY fecha) AS DOUBLE) / count(*) OVER (PARTITION BY serie) AS t,
   CAST(fecha - DATE '1970-01-01' AS DOUBLE) AS dia FROM cont),
z AS (SELECT serie, [{', '.join(_z)}] AS z FROM base),
ij AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM range({len(_z)}) a(i), range({len(_z)}) b(j) WHERE a.i <= b.j)"""
RETR = CONT + """,
lags AS (SELECT *, lag(cantidad, 1) OVER o AS l1, lag(cantidad, 2) OVER o AS l2 FROM cont WINDOW o AS (PARTITION BY serie ORDER BY fecha)),
z AS (SELECT serie, [1.0::DOUBLE, l1, l2, cantidad] AS z FROM lags WHERE l2 IS NOT NULL),
ij AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM range(4) a(i), range(4) b(j) WHERE a.i <= b.j)"""
SUMS = f"SELECT serie, i, j, {rnd('sum(z[i + 1] * z[j + 1])')} AS suma FROM z, ij GROUP BY 1, 2, 3"
SMOOTH = CONT + """,
num AS (SELECT serie, cantidad AS y, CAST(row_number() OVER (PARTITION BY serie ORDER BY fecha) AS INTEGER) AS idx FROM cont),
ini AS (SELECT serie, avg(y) FILTER (idx <= 7) AS l0, (avg(y) FILTER (idx BETWEEN 8 AND 14) - avg(y) FILTER (idx <= 7)) / 7 AS b0,
   list(y ORDER BY idx) FILTER (idx <= 7) AS s, count(*) AS n FROM num GROUP BY serie)"""
_RID = "substr(sha256('referencia|' || serie), 1, 16) AS id_ejecucion"
GEN = f"""
dias AS (SELECT id_restaurante, fecha, CAST(fecha - DATE '1970-01-01' AS BIGINT) AS dia FROM
  (SELECT id_restaurante, CAST(unnest(generate_series((SELECT d FROM hoy) - $N, (SELECT d FROM hoy) - 1, INTERVAL 1 DAY)) AS DATE) AS fecha FROM restaurantes)),
boletas AS (SELECT id_restaurante, fecha, dia, CAST(unnest(range(1, k + 1)) AS INTEGER) AS ticket FROM
  (SELECT *, CASE WHEN isodow(fecha) >= 6 THEN 15 + {draw(1, 'id_restaurante', 'dia')} % 21 ELSE 8 + {draw(1, 'id_restaurante', 'dia')} % 13 END AS k FROM dias)),
menu AS (SELECT id_restaurante, id_plato, precio_venta, costo_estimado, row_number() OVER (PARTITION BY id_restaurante ORDER BY id_plato) - 1 AS puesto,
   count(*) OVER (PARTITION BY id_restaurante) AS platos FROM platos),
cuantos AS (SELECT id_restaurante, max(platos) AS platos FROM menu GROUP BY 1)"""

SAVED = CONT + """,
firma AS (SELECT serie, count(*) AS n_registros, substr(sha256(count(*) || '|' || min(fecha) || '|' || max(fecha) || '|' ||
   CAST(CAST(sum(cantidad) AS DECIMAL(20,2)) AS VARCHAR)), 1, 16) AS hash_datos FROM cont GROUP BY 1)"""
FOLD_TO = "aeiounuAEIOUNUo--\"\"" + "''''"  # the last two are quotes, doubled as SQL wants them

ORACLES = {
    "s10_saved_models": sql("""SELECT serie, modelo, hash_datos, n_registros
FROM firma, (SELECT unnest(['arima', 'tendencia', 'holt_winters']) AS modelo)""", SAVED),
    "f07_wide_fold": f"SELECT doc_id, translate(text, 'áéíóúñüÁÉÍÓÚÑÜ°–—“”‘’', '{FOLD_TO}') AS texto FROM documents",
    "s01_scan": sql("SELECT id_venta, fecha, CAST(total AS DOUBLE) AS total, metodo_pago, id_cliente FROM ventas"),
    "s01_stored_scan": sql("SELECT id_venta, fecha, CAST(total AS DOUBLE) AS total, metodo_pago, id_cliente FROM ventas"),
    "s04_evolved": sql("""SELECT id_venta, fecha, CAST(total AS DOUBLE) AS total, NULL AS metodo_pago, CAST(NULL AS BIGINT) AS id_restaurante FROM ventas
UNION ALL SELECT id_venta, fecha, CAST(total AS DOUBLE) AS total, metodo_pago, id_restaurante FROM ventas_por_local"""),
    "s05_csv_export": sql("""SELECT fecha, CAST(sum(total) AS DOUBLE) AS total, count(*) AS num_ventas FROM ventas
WHERE fecha >= (SELECT d FROM hoy) - 30 GROUP BY 1"""),
    "s06_bundle_export": sql("""SELECT 'Desperdicio por motivo' AS hoja, count(DISTINCT motivo) AS filas FROM desperdicios WHERE fecha >= (SELECT d FROM hoy) - 30
UNION ALL SELECT 'Platos sin categoria registrada en el menu', 1"""),
    "s07_run_rows": sql(f"""SELECT {_RID}, serie, ganador AS modelo_ganador, 'menor MAE (empate -> menor RMSE -> menor SMAPE)' AS criterio_seleccion,
ini AS fecha_inicio_datos, fin AS fecha_fin_datos, n AS numero_registros, 'completado' AS estado, '{{"origen":"experimento"}}' AS metadata_json
FROM mejor JOIN (SELECT serie, min(fecha) AS ini, max(fecha) AS fin, count(*) AS n FROM cont GROUP BY 1) USING (serie)""", BEST),
    "s07_run_models": sql(f"SELECT {_RID}, serie, modelo, 'clasico' AS categoria, mae, rmse, mape, smape, u_theil, r2, posicion FROM rank", BEST),
    "s07_run_folds": sql(f"""SELECT {_RID}, serie, modelo, fold, n_train, n_val, fecha_inicio_val, fecha_fin_val, mae, rmse
FROM fpuntos JOIN folds USING (serie, fold)""", FSCORES),
    "s08_active_models": sql("""SELECT serie, modelo, fecha, row_number() OVER (PARTITION BY serie ORDER BY fecha DESC, modelo DESC) = 1 AS activo
FROM (SELECT serie, modelo, fecha_fin_train AS fecha FROM fpuntos JOIN folds USING (serie, fold)
QUALIFY row_number() OVER (PARTITION BY serie, fold ORDER BY mae, coalesce(rmse, 0), coalesce(smape, 0), modelo) = 1)""", FSCORES),
    "s11_json_properties": """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS k FROM events""",
    "s12_generated_tickets": sql(f"""SELECT id_restaurante, fecha, ticket, {pick(PAYMENTS, 'p')} AS metodo_pago,
lpad(CAST(([{', '.join(map(str, HOURS))}])[p % 6 + 1] AS VARCHAR), 2, '0') || ':' || lpad(CAST(p % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p // 60 % 60 AS VARCHAR), 2, '0') AS hora
FROM (SELECT *, {draw(2, 'id_restaurante', 'dia', 'ticket')} AS p FROM boletas)""", GEN.replace("$N", "90")),
    "s12_generated_lines": sql(f"""SELECT id_restaurante, fecha, ticket, linea, id_plato, 1 + {draw(5, 'id_restaurante', 'dia', 'ticket', 'linea')} % 3 AS cantidad,
CAST(precio_venta * (1 + {draw(5, 'id_restaurante', 'dia', 'ticket', 'linea')} % 3) AS DOUBLE) AS subtotal
FROM (SELECT b.*, c.platos AS total_platos, CAST(unnest(range(1, 2 + {draw(3, 'id_restaurante', 'dia', 'ticket')} % 4)) AS INTEGER) AS linea FROM boletas b JOIN cuantos c USING (id_restaurante)) x
JOIN menu m USING (id_restaurante) WHERE m.puesto = {draw(4, 'id_restaurante', 'dia', 'ticket', 'linea')} % total_platos""", GEN.replace("$N", "90")),
    "s12_generated_waste": sql(f"""SELECT id_restaurante, fecha, id_plato, 'plato' AS tipo, s AS cantidad, 'porción' AS unidad_medida,
({sql_list(K.REASONS)})[{draw(10, 'id_restaurante', 'dia')} % 5 + 1] AS motivo, CAST(s * costo_estimado AS DOUBLE) AS costo_estimado
FROM (SELECT *, prep - (prep * 6 // 10 + {draw(9, 'id_restaurante', 'dia')} % (prep - prep * 6 // 10 + 1)) AS s FROM
  (SELECT d.*, c.platos AS total_platos, 15 + {draw(7, 'id_restaurante', 'dia')} % 26 AS prep FROM dias d JOIN cuantos c USING (id_restaurante)
   WHERE {draw(6, 'id_restaurante', 'dia')} % 10 < 6)) x
JOIN menu m USING (id_restaurante) WHERE m.puesto = {draw(8, 'id_restaurante', 'dia')} % total_platos AND s * 100 > prep * 15""", GEN.replace("$N", "90")),
    "s13_seed_missing": sql("""SELECT id_plato, id_restaurante, nombre FROM platos p WHERE NOT EXISTS
(SELECT 1 FROM platos q WHERE q.id_plato % 3 = 0 AND q.id_restaurante = p.id_restaurante AND q.nombre = p.nombre)"""),
    "s14_read_back": sql("""SELECT serie, modelo, posicion, folds FROM rank JOIN
(SELECT serie, modelo, string_agg(fold || ':' || n_train, ',' ORDER BY fold) AS folds FROM (SELECT DISTINCT serie, modelo, fold FROM fpred) JOIN folds USING (serie, fold) GROUP BY 1, 2) USING (serie, modelo)""",
                         BEST + FOLDS[FOLDS.index(",\nfolds AS ("):]),
    "a35_stale_models": sql("""SELECT serie, serie <> 'LARGE' AS existe, serie = 'PROMO' AS vigente, serie <> 'PROMO' AS recomienda_reentrenar,
CASE WHEN serie = 'LARGE' THEN 'No hay modelo guardado para este plato.' WHEN serie = 'PROMO' THEN 'El modelo guardado sigue vigente para los datos actuales.'
ELSE 'Los datos históricos cambiaron desde el último entrenamiento.' END AS motivo FROM cont GROUP BY 1""", CONT),
    "p12_forecast_history": sql("""SELECT id_plato, coalesce(nombre, '') AS plato, fin + 1 AS fecha_objetivo, 'media_7' AS modelo, round(d, 2) AS demanda,
CAST(ceil(d * 1.1::DOUBLE) AS BIGINT) AS recomendacion_produccion, 'bajo' AS riesgo_desperdicio, round(mae, 2) AS mae, 0.0::DOUBLE AS r2, 50.0::DOUBLE AS confianza_pct
FROM (SELECT id_plato, max(fecha) AS fin, arg_max(v, fecha) AS d, stddev_pop(cantidad) AS mae FROM
  (SELECT *, avg(cantidad) OVER (PARTITION BY id_plato ORDER BY fecha ROWS 6 PRECEDING) AS v FROM demanda) GROUP BY 1 ORDER BY fin DESC, id_plato DESC LIMIT 100)
LEFT JOIN platos USING (id_plato)""", LINES),
    "m02_lag_sums": sql(SUMS, RETR),
    "m03_first_order": sql(f"SELECT serie, {rnd('regr_intercept(cantidad, l1)')} AS constante, {rnd('regr_slope(cantidad, l1)')} AS pendiente FROM lags GROUP BY 1", RETR),
    "m03_refined_first_order": sql(f"""SELECT serie, {rnd('a')} AS constante, {rnd('b')} AS pendiente, {rnd('sqrt((yy - b * b * xx) / n)')} AS rmse FROM
(SELECT serie, regr_intercept(cantidad, l1) AS a, regr_slope(cantidad, l1) AS b, regr_syy(cantidad, l1) AS yy, regr_sxx(cantidad, l1) AS xx,
 regr_count(cantidad, l1) AS n FROM lags GROUP BY 1)""", RETR),
    "m01_unlagged_ratio": sql(f"""SELECT serie, {rnd('t')} AS t, {rnd('z')} AS z, CASE WHEN t < -18.83 OR z < -1.6448536269514722 THEN 0 ELSE 1 END AS d FROM
(SELECT serie, t, CASE WHEN t < -18.83 OR t > 2.74 THEN NULL WHEN t <= -1.61 THEN 2.1659::DOUBLE + 1.4412::DOUBLE * t + 0.038269::DOUBLE * t * t
 ELSE 1.7339::DOUBLE + 0.93202::DOUBLE * t - 0.12745::DOUBLE * t * t - 0.010368::DOUBLE * t * t * t END AS z FROM
 (SELECT serie, b / sqrt((yy - b * b * xx) / (n - 2) / xx) AS t FROM
  (SELECT serie, regr_slope(cantidad - l1, l1) AS b, regr_syy(cantidad - l1, l1) AS yy, regr_sxx(cantidad - l1, l1) AS xx,
   regr_count(cantidad - l1, l1) AS n FROM lags GROUP BY 1)))""", RETR),
    "m04_design_sums": sql(SUMS, DESIGN),
    "m05_smoothing_fixed": sql("""SELECT serie, CAST(paso AS INTEGER) AS n, round(l, 4) AS nivel, round(b, 4) AS tendencia, round(rec.s[1], 4) AS temporada, round(sqrt(sse / paso), 4) AS rmse
FROM rec JOIN ini USING (serie) WHERE paso = n""", SMOOTH + """,
rec AS (SELECT serie, 0 AS paso, l0 AS l, b0 AS b, list_transform(s, lambda v: v - l0) AS s, 0.0::DOUBLE AS sse FROM ini
  UNION ALL
  SELECT r.serie, r.paso + 1, 0.2::DOUBLE * (y - r.s[1]) + 0.8::DOUBLE * (r.l + 0.9::DOUBLE * r.b),
   0.1::DOUBLE * (0.2::DOUBLE * (y - r.s[1]) + 0.8::DOUBLE * (r.l + 0.9::DOUBLE * r.b) - r.l) + 0.9::DOUBLE * 0.9::DOUBLE * r.b,
   list_append(r.s[2:7], 0.05::DOUBLE * (y - r.l - 0.9::DOUBLE * r.b) + 0.95::DOUBLE * r.s[1]),
   r.sse + (y - r.l - 0.9::DOUBLE * r.b - r.s[1]) ** 2
  FROM rec r JOIN num ON num.serie = r.serie AND num.idx = r.paso + 1)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "m05_grid_fit": sql("""SELECT serie, alpha, beta, gamma, phi, round(sse, 4) AS sse, round(l, 4) AS nivel FROM rec JOIN ini USING (serie) WHERE paso = n
QUALIFY row_number() OVER (PARTITION BY serie ORDER BY sse, alpha, beta, gamma, phi) = 1""", SMOOTH + """,
grid AS (SELECT unnest([0.05, 0.2, 0.5])::DOUBLE AS alpha, beta, g AS gamma0, phi, amort FROM
  (SELECT unnest([0.01, 0.1])::DOUBLE AS beta, g, phi, amort FROM (SELECT unnest([0.05, 0.2])::DOUBLE AS g, phi, amort FROM
    (SELECT unnest([0.9, 0.98])::DOUBLE AS phi, true AS amort UNION ALL SELECT 1.0::DOUBLE, false)))),
rec AS (SELECT serie, alpha, beta, CASE WHEN n >= 14 THEN gamma0 ELSE 0.0 END AS gamma, phi, 0 AS paso,
   CASE WHEN n >= 14 THEN l0 ELSE s[1] END AS l, CASE WHEN n >= 14 THEN b0 ELSE 0.0 END AS b,
   CASE WHEN n >= 14 THEN list_transform(s, lambda v: v - l0) ELSE [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0] END AS s, 0.0::DOUBLE AS sse
   FROM ini JOIN grid ON grid.amort = (ini.n >= 30)
  UNION ALL
  SELECT r.serie, alpha, beta, gamma, phi, r.paso + 1, alpha * (y - r.s[1]) + (1 - alpha) * (r.l + phi * r.b),
   beta * (alpha * (y - r.s[1]) + (1 - alpha) * (r.l + phi * r.b) - r.l) + (1 - beta) * phi * r.b,
   list_append(r.s[2:7], gamma * (y - (r.l + phi * r.b)) + (1 - gamma) * r.s[1]), r.sse + (y - (r.l + phi * r.b) - r.s[1]) ** 2
  FROM rec r JOIN num ON num.serie = r.serie AND num.idx = r.paso + 1)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "x01_stream_daily": """SELECT CAST(ts AS DATE) AS dia, event_type, count(*) AS eventos, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS valor
FROM events GROUP BY 1, 2""",
    "x02_stream_weekly": """SELECT desde, CAST(desde + 7 AS DATE) AS hasta, event_type, count(*) AS eventos, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS valor
FROM (SELECT *, CAST(CAST(ts AS DATE) - k AS DATE) AS desde FROM events, (SELECT CAST(unnest(range(7)) AS INTEGER) AS k)) GROUP BY 1, 2, 3""",
    "x03_stream_cooldown": """WITH RECURSIVE acc AS (SELECT event_type, user_id, min(ts) AS ts FROM events GROUP BY 1, 2
UNION ALL SELECT a.event_type, a.user_id, min(e.ts) FROM acc a JOIN events e ON e.event_type = a.event_type AND e.user_id = a.user_id
  AND e.ts >= a.ts + INTERVAL 24 HOUR GROUP BY a.event_type, a.user_id)
SELECT event_type, user_id, ts FROM acc""",
    "x04_stream_outbox": "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 1",
    "x05_stream_sessions": """SELECT user_id, inicio, fin, eventos FROM (SELECT user_id, min(ts) AS inicio, max(ts) + INTERVAL 30 MINUTE AS fin, count(*) AS eventos
FROM (SELECT *, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
 (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nueva FROM events)) GROUP BY user_id, s)""",
}
