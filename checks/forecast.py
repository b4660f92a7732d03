"""SQL twins of splits, naive forecasts, metrics and test statistics."""

from checks.prelude import sql
from checks.series import CONT, HOLD, ORACLES as SERIES

STATES = HOLD + """,
st AS (SELECT *, avg(cantidad) OVER (PARTITION BY serie ORDER BY fecha ROWS UNBOUNDED PRECEDING) AS media, cantidad AS ultimo,
   avg(cantidad) OVER (PARTITION BY serie ORDER BY fecha ROWS 6 PRECEDING) AS media_7,
   avg(cantidad) OVER (PARTITION BY serie ORDER BY fecha ROWS 13 PRECEDING) AS media_14,
   lag(cantidad) OVER (PARTITION BY serie ORDER BY fecha) AS previo FROM num),
modelos AS (SELECT unnest(['media', 'ultimo', 'media_7', 'media_14', 'estacional_7']) AS modelo)"""
YHAT = """CASE modelo WHEN 'media' THEN s.media WHEN 'ultimo' THEN s.ultimo WHEN 'media_7' THEN s.media_7
 WHEN 'media_14' THEN s.media_14 ELSE r.cantidad END"""
PRED = STATES + f""",
pred AS (SELECT t.serie, modelo, t.fecha, t.cantidad AS y, {YHAT} AS yhat, t.previo
  FROM (SELECT st.*, n_train FROM st JOIN (SELECT DISTINCT serie, n_train FROM hold) USING (serie) WHERE idx > n_train) t
  JOIN st s ON s.serie = t.serie AND s.idx = t.n_train
  JOIN st r ON r.serie = t.serie AND r.idx = t.n_train - 6 + (t.idx - t.n_train - 1) % 7, modelos)"""
_folds = SERIES["w08_folds"][SERIES["w08_folds"].rindex("SELECT serie, fold, n_train, n_val, k"):]
FOLDS = STATES + f""",
folds AS ({_folds}),
fpred AS (SELECT t.serie, t.fold, modelo, t.fecha, t.cantidad AS y, {YHAT} AS yhat, t.previo
  FROM (SELECT st.*, fold, n_train FROM st JOIN folds USING (serie) WHERE idx > n_train AND idx <= n_train + n_val) t
  JOIN st s ON s.serie = t.serie AND s.idx = t.n_train
  JOIN st r ON r.serie = t.serie AND r.idx = t.n_train - 6 + (t.idx - t.n_train - 1) % 7, modelos)"""


def rnd(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,9)), 4) AS DOUBLE)"


def score(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, n, {rnd('mae')} AS mae, {rnd('sqrt(mse)')} AS rmse, {rnd('mape')} AS mape, {rnd('smape')} AS smape,
  {rnd('CASE WHEN sqrt(mn) > 1e-8 THEN sqrt(mse) / sqrt(mn) END')} AS u_theil,
  {rnd('CASE WHEN n < 2 THEN NULL WHEN sst > 0 THEN 1 - mse * n / sst WHEN mse = 0 THEN 1 ELSE 0 END')} AS r2
FROM (SELECT {keys}, count(*) AS n, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse,
   avg(abs(y - p) / y) FILTER (y > 0) * 100 AS mape, avg(abs(y - p) * 2 / (y + p)) FILTER (y + p > 0) * 100 AS smape,
   avg((y - previo) * (y - previo)) AS mn, var_pop(y) * count(*) AS sst
  FROM (SELECT *, greatest(0, yhat) AS p FROM {source}) GROUP BY {keys})"""


SCORES = PRED + f", puntos AS ({score('pred', 'serie, modelo')})"
BEST = SCORES + """,
rank AS (SELECT *, CAST(row_number() OVER (PARTITION BY serie ORDER BY mae, coalesce(rmse, 0), coalesce(smape, 0), modelo) AS INTEGER) AS posicion FROM puntos),
mejor AS (SELECT serie, modelo AS ganador FROM rank WHERE posicion = 1),
err AS (SELECT serie, modelo, fecha, CAST(CAST(abs(y - greatest(0, yhat)) AS DECIMAL(38,9)) AS DOUBLE) AS e FROM pred),
par AS (SELECT a.serie, a.modelo, ganador, a.fecha, a.e AS ec, b.e AS eg FROM err a JOIN mejor USING (serie)
   JOIN err b ON b.serie = a.serie AND b.modelo = ganador AND b.fecha = a.fecha WHERE a.modelo <> ganador)"""
DM = BEST + """,
dif AS (SELECT *, ec * ec - eg * eg AS d FROM par),
dif1 AS (SELECT *, lag(d) OVER (PARTITION BY serie, modelo ORDER BY fecha) AS d1 FROM dif),
dm AS (SELECT serie, modelo, ganador, count(*) AS n, avg(d) AS m, (var_samp(d) + 2 * covar_samp(d, d1)) / count(*) AS v FROM dif1 GROUP BY 1, 2, 3)"""


def friedman(source: str, keys: str) -> str:
    return f"""
fr AS (SELECT {keys}, modelo, fecha, e, rank() OVER (PARTITION BY {keys}, fecha ORDER BY e) + (count(*) OVER (PARTITION BY {keys}, fecha, e) - 1) / 2.0::DOUBLE AS rango,
   count(*) OVER (PARTITION BY {keys}, fecha, e) AS t FROM {source}),
fs AS (SELECT {keys}, count(DISTINCT modelo) AS k, count(DISTINCT fecha) AS n, sum(t * t - 1) AS t FROM fr GROUP BY ALL),
fm AS (SELECT {keys}, sum(r * r) AS ss FROM (SELECT {keys}, modelo, sum(rango) AS r FROM fr GROUP BY ALL) GROUP BY ALL),
chi AS (SELECT {keys}, CAST(k AS INTEGER) AS k, n,
   (12.0::DOUBLE / (k * n * (k + 1)) * ss - 3.0::DOUBLE * n * (k + 1)) / (1 - CAST(t AS DOUBLE) / (CAST(n AS DOUBLE) * k * (k * k - 1))) AS chi2
  FROM fs JOIN fm USING ({keys})),
chip AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2) AS p FROM chi)"""


WIL = BEST + """,
wd AS (SELECT *, abs(d) AS a FROM (SELECT *, CAST(CAST(eg - ec AS DECIMAL(38,9)) AS DOUBLE) AS d FROM par)),
wr AS (SELECT *, rank() OVER (PARTITION BY serie, modelo ORDER BY a) + (count(*) OVER (PARTITION BY serie, modelo, a) - 1) / 2.0::DOUBLE AS r,
   count(*) OVER (PARTITION BY serie, modelo, a) AS t FROM wd WHERE d <> 0),
ws AS (SELECT serie, modelo, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS mas, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS menos, CAST(sum(t * t - 1) AS BIGINT) AS empates FROM wr GROUP BY 1, 2),
wn AS (SELECT serie, modelo, ganador, count(*) AS n, count(*) FILTER (d = 0) AS ceros FROM wd GROUP BY 1, 2, 3)"""


def two_sided(z: str) -> str:
    """P(|N(0,1)| >= |z|): one minus the error function, whose series has positive terms only."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    term = f"exp((2 * i + 1) * ln({x}) + 2 * i * ln(2.0::DOUBLE) + lgamma(i + 1.0::DOUBLE) - lgamma(2.0::DOUBLE * i + 2))"
    return (f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0::DOUBLE WHEN abs({z}) > 8 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, "
            f"1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 200), lambda i: {term}))) END")


def text4(p: str) -> str:
    return f"CAST(CAST(round({p}, 4) AS DECIMAL(20,4)) AS VARCHAR)"


NULLS = "CAST(NULL AS VARCHAR)"
DM_TESTS = DM + f""",
dmz AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN v > 0 THEN m / sqrt(v) ELSE 0.0::DOUBLE END AS z FROM dm),
dmp AS (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN v <= 0 THEN 1.0::DOUBLE ELSE {two_sided('z')} END AS p FROM dmz),
dm_prueba AS (SELECT serie, 'diebold_mariano' AS prueba, modelo AS modelo_a, ganador AS modelo_b, n, round(z, 4) AS estadistico, round(p, 4) AS p_valor,
   CAST(NULL AS DOUBLE) AS p_valor_ajustado, coalesce(p < 0.05, false) AS significativo, z IS NOT NULL AS aplicable,
   CASE WHEN z IS NULL THEN 'Muestra insuficiente para la prueba DM (mín. 3 obs.)'
        WHEN v <= 0 THEN 'Varianza nula — ambos modelos producen errores idénticos'
        WHEN p < 0.05 THEN 'Diferencia significativa al 5 % — ' || CASE WHEN z > 0 THEN ganador ELSE modelo END || ' presenta mayor precisión predictiva'
        ELSE 'Sin diferencia estadísticamente significativa entre ' || modelo || ' y ' || ganador || ' (p = ' || {text4('p')} || ')' END AS interpretacion FROM dmp)"""
# The counts of subset sums of 1..n give the exact distribution of the signed-rank sum.
WIL_TESTS = f""",
modos AS (SELECT * FROM (WITH RECURSIVE m(k, ways) AS (SELECT 0, [1.0::DOUBLE] UNION ALL
   SELECT k + 1, list_transform(range(1, (k + 1) * (k + 2) // 2 + 2), lambda i: CASE WHEN i <= len(ways) THEN ways[i] ELSE 0 END
      + CASE WHEN i > k + 1 THEN ways[i - k - 1] ELSE 0 END) FROM m WHERE k < 50) SELECT k, ways FROM m)),
wz AS (SELECT serie, modelo, ganador, n, ceros, n - ceros AS c, coalesce(empates, 0) AS empates,
   CASE WHEN n < 5 THEN NULL ELSE coalesce(least(mas, menos), 0.0::DOUBLE) END AS w FROM wn LEFT JOIN ws USING (serie, modelo)),
wy AS (SELECT *, (w - c * (c + 1) / 4.0::DOUBLE) / nullif(sqrt((c * (c + 1) * (2 * c + 1) - empates / 2.0::DOUBLE) / 24), 0) AS z FROM wz),
wp AS (SELECT wy.*, round(CASE WHEN w IS NULL THEN NULL WHEN c = 0 THEN 1.0::DOUBLE
   WHEN c <= 50 AND empates = 0 AND ceros = 0 THEN least(1.0::DOUBLE, 2 * list_sum(ways[1:CAST(floor(w) AS BIGINT) + 1]) / list_sum(ways))
   ELSE {two_sided('z')} END, 4) AS p FROM wy LEFT JOIN modos ON k = c),
wh AS (SELECT *, round(max(s) OVER (PARTITION BY serie ORDER BY p, modelo ROWS UNBOUNDED PRECEDING), 4) AS pa FROM
   (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY serie) - row_number() OVER (PARTITION BY serie ORDER BY p, modelo) + 1) * p) AS s FROM wp WHERE p IS NOT NULL)),
wt AS (SELECT wp.*, pa, '(p original = ' || {text4('wp.p')} || ', p ajustado = ' || {text4('pa')} AS detalle_p FROM wp LEFT JOIN wh USING (serie, modelo)),
wil_prueba AS (SELECT serie, 'wilcoxon' AS prueba, ganador AS modelo_a, modelo AS modelo_b, n, round(w, 4) AS estadistico, p AS p_valor, pa AS p_valor_ajustado,
   coalesce(pa <= 0.05, false) AS significativo, w IS NOT NULL AS aplicable,
   CASE WHEN w IS NULL THEN 'Muestra insuficiente (' || n || ' obs.) para Wilcoxon (mín. 5).' WHEN ceros = n THEN 'Errores idénticos entre ambos modelos en todas las observaciones.'
        WHEN pa <= 0.05 THEN 'Diferencia significativa tras corrección Holm-Bonferroni ' || detalle_p || ' < 0.05).'
        ELSE 'Sin diferencia significativa tras corrección Holm-Bonferroni ' || detalle_p || ' >= 0.05).' END AS interpretacion FROM wt)"""
FR_TESTS = "," + friedman("err", "serie") + f""",
fr_prueba AS (SELECT serie, 'friedman' AS prueba, {NULLS} AS modelo_a, {NULLS} AS modelo_b, n, round(chi2, 4) AS estadistico, round(p, 4) AS p_valor,
   CAST(NULL AS DOUBLE) AS p_valor_ajustado, coalesce(p < 0.05, false) AS significativo, chi2 IS NOT NULL AS aplicable,
   CASE WHEN chi2 IS NULL THEN 'Muestra insuficiente o menos de tres modelos para Friedman.'
        WHEN p < 0.05 THEN 'Diferencia estadísticamente significativa entre los ' || k || ' modelos (p = ' || {text4('p')} || ' < 0.05).'
        ELSE 'Sin diferencia estadísticamente significativa entre los ' || k || ' modelos (p = ' || {text4('p')} || ' >= 0.05).' END AS interpretacion FROM chip)"""
METRICS = ["mae", "rmse", "mape", "smape", "u_theil", "r2"]
ACROSS = ", ".join(f"{rnd(f'avg({m})')} AS {m}_promedio, {rnd(f'stddev_samp({m})')} AS {m}_desviacion, min({m}) AS {m}_minimo, max({m}) AS {m}_maximo"
                   for m in METRICS)
FSCORES = FOLDS + f", fpuntos AS ({score('fpred', 'serie, modelo, fold')})"
FHOLM = FOLDS + ", ferr AS (SELECT serie, fold, modelo, fecha, CAST(CAST(abs(y - greatest(0, yhat)) AS DECIMAL(38,9)) AS DOUBLE) AS e FROM fpred)," + friedman("ferr", "serie, fold") + """,
pr AS (SELECT serie, fold, round(p, 4) AS p_valor FROM chip),
esc AS (SELECT *, least(1, (count(*) OVER (PARTITION BY serie) - row_number() OVER (PARTITION BY serie ORDER BY p_valor, fold) + 1) * p_valor) AS s FROM pr)"""
TUNE = STATES + """,
tam AS (SELECT *, n - greatest(3, CAST(floor(n * 0.2::DOUBLE) AS INTEGER)) AS nt FROM st WHERE n - greatest(3, CAST(floor(n * 0.2::DOUBLE) AS INTEGER)) >= 5),
cand AS (SELECT serie, ventana, avg(cantidad) AS yhat FROM tam, (SELECT unnest([1, 3, 7, 14, 28]) AS ventana) WHERE idx <= nt AND nt - idx < ventana GROUP BY 1, 2),
tpred AS (SELECT serie, CAST(ventana AS INTEGER) AS ventana, fecha, cantidad AS y, yhat, previo FROM tam JOIN cand USING (serie) WHERE idx > nt),
tpuntos AS (""" + score("tpred", "serie, ventana") + ")"

ORACLES = {
    "j13_aligned_errors": sql("SELECT serie, modelo, ganador, fecha, round(ec, 4) AS ec, round(eg, 4) AS eg FROM par", BEST),
    "j14_fold_slices": sql("""SELECT serie, fold, count(*) AS transacciones, CAST(sum(cantidad) AS BIGINT) AS unidades
FROM folds JOIN lineas ON categoria = serie AND fecha BETWEEN fecha_inicio_train AND fecha_fin_train GROUP BY 1, 2""", FOLDS),
    "e06_holdout_scores": sql("SELECT * FROM puntos", SCORES),
    "e06_fold_scores": sql("SELECT * FROM fpuntos", FSCORES),
    "a33_across_folds": sql(f"SELECT serie, modelo, count(mae) AS folds, {ACROSS} FROM fpuntos GROUP BY 1, 2", FSCORES),
    "m13_holdout_predictions": sql("SELECT serie, modelo, fecha, round(y, 4) AS y, round(yhat, 4) AS yhat, round(previo, 4) AS previo FROM pred", PRED),
    "m16_window_search": sql("""SELECT serie, arg_min(ventana, (mae, ventana)) AS ventana, min(mae) AS mae FROM tpuntos GROUP BY 1""", TUNE),
    "m18_fold_predictions": sql("SELECT serie, fold, modelo, fecha, round(y, 4) AS y, round(yhat, 4) AS yhat, round(previo, 4) AS previo FROM fpred", FOLDS),
    "m14_user_model": sql("""SELECT f.serie, f.fold, 'propio' AS modelo, CASE WHEN n_train >= 800 THEN n END AS n,
CASE WHEN n_train >= 800 THEN mae END AS mae, CASE WHEN n_train < 800 THEN 'historia corta' END AS error
FROM fpuntos AS f JOIN folds USING (serie, fold) WHERE f.modelo = 'media_7'""", FSCORES),
    "w10_model_ranking": sql("SELECT serie, modelo, mae, posicion FROM rank", BEST),
    "w11_winners": sql("SELECT serie, ganador FROM mejor", BEST),
    "w13_friedman_ranks": sql("SELECT serie, modelo, fecha, rango FROM fr", BEST + "," + friedman("err", "serie")),
    "w15_dm_statistic": sql("SELECT serie, modelo, ganador, n, round(CASE WHEN v > 0 THEN m / sqrt(v) ELSE 0 END, 4) AS dm FROM dm", DM),
    "e08_friedman": sql("""SELECT serie, n, round(chi2, 4) AS estadistico, round(p, 4) AS p_valor, p < 0.05 AS significativo FROM chip""",
                        BEST + "," + friedman("err", "serie")),
    "w14_wilcoxon_statistic": sql("""SELECT serie, modelo, ganador, n, ceros, coalesce(empates, 0) AS empates, coalesce(least(mas, menos), 0) AS w
FROM wn LEFT JOIN ws USING (serie, modelo)""", WIL),
    "e07_diebold_mariano": sql("SELECT * FROM dm_prueba", DM_TESTS),
    "e09_wilcoxon": sql("SELECT * FROM wil_prueba", WIL + WIL_TESTS),
    "u04_all_tests": sql("SELECT * FROM fr_prueba UNION ALL SELECT * FROM wil_prueba UNION ALL SELECT * FROM dm_prueba",
                         DM_TESTS + FR_TESTS + WIL.removeprefix(BEST) + WIL_TESTS),
    "e10_holm": sql("""SELECT serie, fold, p_valor, round(max(s) OVER (PARTITION BY serie ORDER BY p_valor, fold ROWS UNBOUNDED PRECEDING), 4) AS p_valor_ajustado FROM esc""", FHOLM),
    "e11_winner_text": sql("""SELECT serie, 'El modelo ' || modelo || ' fue seleccionado automáticamente por presentar el menor error absoluto medio (MAE = ' ||
CAST(CAST(mae AS DECIMAL(20,4)) AS VARCHAR) || ').' AS texto FROM rank WHERE posicion = 1""", BEST),
    "f12_naive_plan": sql("""
SELECT serie, modelo, fecha, round(d, 2) AS demanda_estimada, prod AS recomendacion,
 CASE WHEN d <= 0 THEN 'alto' WHEN mae / d * 100 > 40 OR (prod - d) / d * 100 > 25 THEN 'alto'
      WHEN mae / d * 100 > 20 OR (prod - d) / d * 100 > 15 THEN 'medio' ELSE 'bajo' END AS riesgo, mae,
 coalesce(greatest(0, least(1, r2)), 0) AS confianza
FROM (SELECT serie, modelo, fecha, yhat AS d, mae, r2, CAST(ceil(greatest(yhat * 1.1::DOUBLE, yhat + mae * 0.5::DOUBLE)) AS BIGINT) AS prod FROM pred JOIN puntos USING (serie, modelo))""", SCORES),
}
