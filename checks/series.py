"""SQL twins of the cleaning, series and exploratory operators."""

from checks.prelude import sql
from wastelens.functions import constants as K
from wastelens.operators.eda import CORRELATED
from wastelens.operators.series import LAGS, MEANS

WEEKDAYS = "[" + ", ".join(f"'{d}'" for d in K.WEEKDAYS) + "]"
HOLIDAYS = ", ".join(f"'{d}'" for d in K.HOLIDAYS)

LINES = """
lineas AS (SELECT id_venta, id_plato, fecha, cantidad, categoria, nombre, marca, CAST(precio_venta AS DOUBLE) AS precio
  FROM detalle JOIN ventas USING (id_venta) JOIN platos USING (id_plato)),
demanda AS (SELECT fecha, id_plato, categoria, CAST(sum(cantidad) AS BIGINT) AS cantidad, max(precio) AS precio
  FROM lineas WHERE categoria IS NOT NULL GROUP BY 1, 2, 3)"""

CONT = LINES + """,
diaria AS (SELECT categoria AS serie, fecha, CAST(sum(cantidad) AS DOUBLE) AS y FROM lineas GROUP BY 1, 2),
eje AS (SELECT serie, CAST(unnest(generate_series(min(fecha), max(fecha), INTERVAL 1 DAY)) AS DATE) AS fecha FROM diaria GROUP BY serie),
hueco AS (SELECT serie, fecha, y, CASE WHEN y IS NOT NULL THEN fecha END AS fo FROM eje LEFT JOIN diaria USING (serie, fecha)),
vecinos AS (SELECT serie, fecha, y,
   last_value(y IGNORE NULLS) OVER atras AS y0, last_value(fo IGNORE NULLS) OVER atras AS f0,
   first_value(y IGNORE NULLS) OVER adelante AS y1, first_value(fo IGNORE NULLS) OVER adelante AS f1
  FROM hueco WINDOW atras AS (PARTITION BY serie ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    adelante AS (PARTITION BY serie ORDER BY fecha ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cont AS (SELECT serie, fecha, CASE WHEN y IS NOT NULL THEN y ELSE y0 + (y1 - y0) * (fecha - f0) / (f1 - f0) END AS cantidad,
   y IS NULL AS interpolado FROM vecinos)"""

_lags = ", ".join(f"lag(cantidad, {k}) OVER o AS lag_{k}" for k in LAGS)
_means = ", ".join(f"avg(cantidad) OVER (PARTITION BY serie ORDER BY fecha ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS media_movil_{w}"
                   for w in MEANS)
PAST = ["cantidad", *[f"lag_{k}" for k in LAGS], *[f"media_movil_{w}" for w in MEANS]]
PREP = CONT + f""",
pasado AS (SELECT *, {_lags}, {_means} FROM cont WINDOW o AS (PARTITION BY serie ORDER BY fecha)),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY serie ORDER BY fecha) AS INTEGER) AS idx, count(*) OVER (PARTITION BY serie) AS n FROM pasado),
tam AS (SELECT *, greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS INTEGER)) AS nt FROM num),
bloques AS (SELECT * EXCLUDE (nt), CASE WHEN idx <= n - 2 * nt THEN 'train' WHEN idx <= n - nt THEN 'val' ELSE 'test' END AS bloque FROM tam)"""
_stats = ", ".join(f"avg(coalesce({c}, 0)) AS {c}_m, stddev_pop(coalesce({c}, 0)) AS {c}_s" for c in PAST)
_scaled = ", ".join(f"round((coalesce({c}, 0) - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 4) AS {c}_esc" for c in PAST)
HOLD = CONT + """,
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY serie ORDER BY fecha) AS INTEGER) AS idx, count(*) OVER (PARTITION BY serie) AS n FROM cont),
hold AS (SELECT *, CAST(least(greatest(floor(n * 0.8::DOUBLE), n - 20), n - 5) AS INTEGER) AS n_train FROM num WHERE n >= 30)"""
FEAT = LINES + f""",
codigos AS (SELECT categoria, CAST(dense_rank() OVER (ORDER BY categoria) - 1 AS INTEGER) AS cat_enc FROM (SELECT DISTINCT categoria FROM platos)),
rasgos AS (SELECT fecha, id_plato, categoria, cantidad, precio, cat_enc,
   CAST(isodow(fecha) - 1 AS INTEGER) AS dia_semana, CAST(month(fecha) AS INTEGER) AS mes, CAST(day(fecha) AS INTEGER) AS dia_mes,
   CAST(isodow(fecha) >= 6 AS INTEGER) AS es_finde, CAST((fecha - DATE '1970-01-01') % 3 + 1 AS INTEGER) AS clima,
   CASE WHEN day(fecha) = 15 THEN 1 WHEN strftime(fecha, '%m-%d') IN ({HOLIDAYS}) THEN 2 ELSE 0 END AS evento,
   avg(cantidad) OVER (PARTITION BY id_plato ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ventas_7d
  FROM demanda JOIN codigos USING (categoria))"""
STATS = CONT + """,
est AS (SELECT serie, count(*) AS n, avg(cantidad) AS media, stddev_samp(cantidad) AS sd, min(cantidad) AS lo, max(cantidad) AS hi,
   quantile_cont(cantidad, 0.25) AS q1, quantile_cont(cantidad, 0.5) AS q2, quantile_cont(cantidad, 0.75) AS q3 FROM cont GROUP BY serie),
lim AS (SELECT serie, q1 - 1.5::DOUBLE * (q3 - q1) AS a, q3 + 1.5::DOUBLE * (q3 - q1) AS b FROM est),
fuera AS (SELECT serie, fecha, cantidad < a OR cantidad > b AS es FROM cont JOIN lim USING (serie)),
atip AS (SELECT serie, count(*) FILTER (es) AS cantidad, round(any_value(a), 4) AS limite_inferior, round(any_value(b), 4) AS limite_superior,
   array_to_string(list_sort(coalesce(list(CAST(fecha AS VARCHAR)) FILTER (es), []))[1:20], ',') AS fechas
  FROM fuera JOIN lim USING (serie) GROUP BY serie),
descr AS (SELECT serie, round(media, 4) AS media, round(q2, 4) AS mediana, round(CASE WHEN n > 1 THEN sd ELSE 0 END, 4) AS desviacion_estandar,
   round(lo, 4) AS minimo, round(hi, 4) AS maximo, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS rango_intercuartilico FROM est),
cob AS (SELECT categoria AS serie, count(*) AS registros_transacciones, count(DISTINCT fecha) AS dias_con_venta,
   max(fecha) - min(fecha) + 1 AS dias_cubiertos, min(fecha) AS fecha_inicio, max(fecha) AS fecha_fin FROM lineas GROUP BY 1)"""
STATS = STATS.replace("max(fecha) - min(fecha) + 1", "CAST(max(fecha) - min(fecha) + 1 AS INTEGER)")
HIST = STATS + """,
borde AS (SELECT serie, CAST(least(10, greatest(3, floor(sqrt(n)))) AS INTEGER) AS bins,
   CASE WHEN lo = hi THEN lo - 0.5::DOUBLE ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5::DOUBLE ELSE hi END AS hi FROM est),
cuenta AS (SELECT serie, CAST(least(floor((cantidad - lo) / (hi - lo) * bins), bins - 1) AS INTEGER) AS bin, count(*) AS f FROM cont JOIN borde USING (serie) GROUP BY 1, 2),
cajas AS (SELECT serie, lo, hi, bins, CAST(unnest(range(0, bins)) AS INTEGER) AS bin FROM borde)"""
RAW = """
crudo AS (SELECT id_venta, id_plato, linea, cantidad AS q,
   CASE WHEN cantidad <> 23 THEN fecha END AS fecha,
   CASE WHEN cantidad NOT IN (13, 17) THEN CAST(cantidad - 2 AS DOUBLE) END AS c
  FROM detalle JOIN ventas USING (id_venta)),
valido AS (SELECT id_venta, id_plato, linea, fecha, greatest(coalesce(c, 0.0), 0.0) AS cantidad, c FROM crudo WHERE fecha IS NOT NULL),
limpio AS (SELECT id_venta, id_plato, linea, fecha, cantidad FROM valido
   QUALIFY row_number() OVER (PARTITION BY id_venta, id_plato ORDER BY linea, fecha, cantidad) = 1)"""
SIG = LINES + """,
firma AS (SELECT id_plato, count(*) AS n_registros, substr(sha256(count(*) || '|' || min(fecha) || '|' || max(fecha) || '|' ||
   CAST(CAST(sum(cantidad) AS DECIMAL(20,2)) AS VARCHAR)), 1, 16) AS hash_datos FROM lineas GROUP BY 1)"""
FUT = CONT + f""",
ult AS (SELECT serie, avg(cantidad) AS ventas_7d, max(fecha) AS fin FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY fecha DESC) AS a FROM cont) WHERE a <= 7 GROUP BY 1),
codigos AS (SELECT categoria, CAST(dense_rank() OVER (ORDER BY categoria) - 1 AS INTEGER) AS cat_enc FROM (SELECT DISTINCT categoria FROM platos))"""
_corr = " UNION ALL ".join(
    f"SELECT categoria AS serie, '{a}' AS variable_a, '{b}' AS variable_b, "
    f"CASE WHEN var_samp({a}) > 0 AND var_samp({b}) > 0 THEN round(corr({a}, {b}), 4) END AS correlacion FROM rasgos GROUP BY 1"
    for a in CORRELATED for b in CORRELATED)
COLUMNS = ["id_venta", "id_plato", "fecha", "cantidad"]

ORACLES = {
    "c01_clean": sql("SELECT * FROM limpio", RAW),
    "c01_cleaning_warnings": sql("""SELECT (SELECT count(*) FROM crudo WHERE fecha IS NULL) AS fechas_invalidas,
(SELECT count(*) FROM valido WHERE c IS NULL) AS cantidades_nulas, (SELECT count(*) FROM valido WHERE c < 0) AS cantidades_negativas,
(SELECT count(*) FROM valido) - (SELECT count(*) FROM limpio) AS duplicados""", RAW),
    "t08_keep_first": sql("""SELECT id_venta, id_plato, linea FROM detalle QUALIFY row_number() OVER (PARTITION BY id_venta, id_plato ORDER BY linea, cantidad, subtotal) = 1"""),
    "a21_daily_demand": sql("SELECT * FROM demanda", LINES),
    "a22_daily_series": sql("SELECT serie, fecha, y AS cantidad FROM diaria", CONT),
    "a22_brand_series": sql("SELECT marca AS serie, fecha, CAST(sum(cantidad) AS DOUBLE) AS cantidad FROM lineas GROUP BY 1, 2", LINES),
    "a23_descriptive": sql("SELECT * FROM descr", STATS),
    "a24_null_counts": sql(" UNION ALL ".join(
        f"SELECT id_restaurante, '{c}' AS columna, count(*) - count({c}) AS nulos FROM desperdicios GROUP BY 1" for c in
        ("id_plato", "id_insumo", "fecha", "momento", "tipo", "cantidad", "unidad_medida", "motivo", "costo_estimado"))),
    "a24_null_counts_lines": sql(" UNION ALL ".join(
        f"SELECT categoria, '{c}' AS columna, count(*) - count({c}) AS nulos FROM lineas GROUP BY 1" for c in
        ("id_venta", "id_plato", "fecha", "cantidad", "precio")), LINES),
    "a25_duplicates": sql("""SELECT categoria, CAST(sum(n - 1) AS BIGINT) AS duplicados, CAST(sum(n) AS BIGINT) AS filas
FROM (SELECT categoria, id_venta, id_plato, count(*) AS n FROM lineas GROUP BY ALL) GROUP BY 1""", LINES),
    "a26_histogram": sql("""SELECT serie, bin, round(lo + (hi - lo) / bins * bin, 2) AS rango_inicio, round(lo + (hi - lo) / bins * (bin + 1), 2) AS rango_fin,
coalesce(f, 0) AS frecuencia FROM cajas LEFT JOIN cuenta USING (serie, bin)""", HIST),
    "a27_by_weekday": sql(f"""SELECT serie, ({WEEKDAYS})[i] AS dia_semana, coalesce(round(avg(cantidad), 4), 0) AS demanda_promedio,
coalesce(round(sum(cantidad), 2), 0) AS demanda_total, count(cantidad) AS n
FROM (SELECT serie, unnest(range(1, 8)) AS i FROM est) LEFT JOIN cont c USING (serie) WHERE isodow(c.fecha) = i GROUP BY serie, i""", STATS),
    "a28_by_month": sql("""SELECT serie, strftime(fecha, '%Y-%m') AS mes, round(avg(cantidad), 4) AS demanda_promedio, round(sum(cantidad), 2) AS demanda_total, count(*) AS n
FROM cont WHERE serie IN (SELECT serie FROM cont GROUP BY serie HAVING max(fecha) - min(fecha) + 1 >= 60) GROUP BY 1, 2""", CONT),
    "a29_correlations": sql(_corr, FEAT),
    "a30_code_counts": sql("""SELECT categoria AS serie, 'clima' AS variable, clima AS codigo, count(*) AS n FROM rasgos GROUP BY ALL
UNION ALL SELECT categoria AS serie, 'evento' AS variable, evento AS codigo, count(*) AS n FROM rasgos GROUP BY ALL""", FEAT),
    "a31_coverage": sql("SELECT * FROM cob", STATS),
    "a34_signature": sql("SELECT * FROM firma", SIG),
    "a39_box_positions": sql("""SELECT serie, """ + ", ".join(
        f"round(greatest(0, least(100, ({q} - lo) / coalesce(nullif(hi - lo, 0), 1) * 100)), 4) AS {n}"
        for q, n in (("q1", "pos_q1"), ("q2", "pos_mediana"), ("q3", "pos_q3"))) + " FROM est", STATS),
    "c02_continuous": sql("SELECT serie, fecha, round(cantidad, 4) AS cantidad, interpolado FROM cont", CONT),
    "c03_lags_and_means": sql("SELECT serie, fecha, interpolado, " + ", ".join(f"round({c}, 4) AS {c}" for c in PAST) + " FROM pasado", PREP),
    "c04_scaler_parameters": sql(" UNION ALL ".join(
        f"""SELECT serie, '{c}' AS columna, round(avg(coalesce({c}, 0)), 4) AS media, round(CASE WHEN stddev_pop(coalesce({c}, 0)) = 0 THEN 1
ELSE stddev_pop(coalesce({c}, 0)) END, 4) AS escala FROM bloques WHERE bloque = 'train' GROUP BY 1""" for c in PAST), PREP),
    "c05_prepared": sql(f"SELECT serie, fecha, idx, bloque, {_scaled} FROM bloques JOIN esc USING (serie)",
                        PREP + f", esc AS (SELECT serie, {_stats} FROM bloques WHERE bloque = 'train' GROUP BY serie)"),
    "c05_warnings": sql("SELECT serie, count(*) AS dias, count(*) FILTER (interpolado) AS interpolados FROM cont GROUP BY 1", CONT),
    "c06_features": sql("SELECT * REPLACE (round(ventas_7d, 4) AS ventas_7d) FROM rasgos", FEAT),
    "c07_future_rows": sql("""SELECT serie, cat_enc, round(ventas_7d, 4) AS ventas_7d, fecha, CAST(isodow(fecha) - 1 AS INTEGER) AS dia_semana, CAST(month(fecha) AS INTEGER) AS mes,
CAST(day(fecha) AS INTEGER) AS dia_mes, CAST(isodow(fecha) >= 6 AS INTEGER) AS es_finde, 2 AS clima, 0 AS evento
FROM (SELECT serie, cat_enc, ventas_7d, CAST(unnest(generate_series(fin + 1, fin + 7, INTERVAL 1 DAY)) AS DATE) AS fecha
      FROM ult JOIN codigos ON categoria = serie)""", FUT),
    "c08_eda_bundle": sql("""SELECT cob.*, descr.* EXCLUDE (serie), atip.cantidad AS outliers, limite_inferior, limite_superior
FROM cob JOIN descr USING (serie) JOIN atip USING (serie)""", STATS),
    "c09_outliers": sql("SELECT * FROM atip", STATS),
    "w01_trailing_mean": sql("""SELECT fecha, id_plato, round(avg(cantidad) OVER (PARTITION BY id_plato ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS ventas_7d
FROM demanda""", LINES),
    "w05_split": sql("SELECT serie, fecha, idx, bloque FROM bloques", PREP),
    "w06_holdout": sql("SELECT serie, fecha, n_train, idx > n_train AS es_test FROM hold", HOLD),
    "w07_tuning_split": sql("""SELECT serie, fecha, idx <= n - nv AS es_train FROM (SELECT *, greatest(3, CAST(floor(n * 0.2::DOUBLE) AS INTEGER)) AS nv FROM num)
WHERE n - nv >= 5""", HOLD),
    "w08_folds": sql("""SELECT serie, fold, n_train, n_val, k, ini AS fecha_inicio_train, CAST(ini + (n_train - 1) AS DATE) AS fecha_fin_train,
CAST(ini + n_train AS DATE) AS fecha_inicio_val, CAST(ini + (n_train + n_val - 1) AS DATE) AS fecha_fin_val
FROM (SELECT *, CAST(n - (k - fold + 1) * n_val AS INTEGER) AS n_train FROM
 (SELECT *, CAST(unnest(range(1, k + 1)) AS INTEGER) AS fold, CAST(n // (k + 1) AS INTEGER) AS n_val FROM
  (SELECT serie, count(*) AS n, min(fecha) AS ini, CAST(least(5, count(*) - 1) AS INTEGER) AS k FROM cont GROUP BY serie) WHERE k >= 2))""", CONT),
    "w09_last_week_mean": sql("SELECT serie, round(ventas_7d, 4) AS ventas_7d, fin FROM ult", FUT),
}


def _tall(part: str, query: str, serie: str, keys: list[str], numbers: list[str], texts: list[str]) -> str:
    """The long form of one part, from the twin of its own query."""
    key = f"concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})" if keys else "''"
    rows = [f"('{n}', CAST({n} AS DOUBLE), CAST(NULL AS VARCHAR))" for n in numbers] + [f"('{t}', CAST(NULL AS DOUBLE), CAST({t} AS VARCHAR))" for t in texts]
    return (f"SELECT {serie} AS serie, '{part}' AS parte, {key} AS clave, medida, valor, texto FROM ({ORACLES[query]}) AS p, "
            f"LATERAL (VALUES {', '.join(rows)}) AS m(medida, valor, texto)")


_statistics = ["media", "mediana", "desviacion_estandar", "minimo", "maximo", "q1", "q3", "rango_intercuartilico"]
ORACLES["c08_eda_complete"] = " UNION ALL ".join([
    _tall("cobertura", "a31_coverage", "serie", [], ["registros_transacciones", "dias_con_venta", "dias_cubiertos"], ["fecha_inicio", "fecha_fin"]),
    _tall("nulos", "a24_null_counts_lines", "categoria", ["columna"], ["nulos"], []),
    _tall("duplicados", "a25_duplicates", "categoria", [], ["duplicados", "filas"], []),
    _tall("descriptivas", "a23_descriptive", "serie", [], _statistics, []),
    _tall("atipicos", "c09_outliers", "serie", [], ["cantidad", "limite_inferior", "limite_superior"], ["fechas"]),
    _tall("dia_semana", "a27_by_weekday", "serie", ["dia_semana"], ["demanda_promedio", "demanda_total", "n"], []),
    _tall("mes", "a28_by_month", "serie", ["mes"], ["demanda_promedio", "demanda_total", "n"], []),
    _tall("histograma", "a26_histogram", "serie", ["bin"], ["rango_inicio", "rango_fin", "frecuencia"], []),
    _tall("correlaciones", "a29_correlations", "serie", ["variable_a", "variable_b"], ["correlacion"], []),
    _tall("codigos", "a30_code_counts", "serie", ["variable", "codigo"], ["n"], [])])
