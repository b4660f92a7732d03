import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wastelens.models import arima, attention, gram, holt_winters, trees, trend
from wastelens.operators import series as S
from wastelens.plans import experiment
from wastelens.sources import runs

KEY = ["serie"]
T = np.arange(40)
WEEKLY = np.maximum(0, 10 + 3 * np.sin(2 * np.pi * T / 7) + np.random.default_rng(5).normal(0, 1, 40))


def heads(train, h=7):
    return train.select("serie").distinct().withColumn("h", F.lit(h))


def test_gram_and_solve_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 50)
    rows = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y)], "k string, a double, b double, c double, y double")
    rows = rows.unionByName(spark.createDataFrame([("a", None, 1.0, 1.0, 1.0)], rows.schema))
    design = [F.lit(1.0), F.col("a"), F.col("b"), F.col("c"), F.col("y")]
    sums = gram.gram_sums(rows.repartition(5), ["k"], design)
    fit = sums.select(gram.solve("gram", gram.int_array(range(4)), gram.double_array([0.0] * 4)).alias("f")).first()["f"]
    z = np.column_stack([np.ones(50), x])
    beta, sse, *_ = np.linalg.lstsq(z, y, rcond=None)
    assert fit["coef"] == pytest.approx(beta.tolist()) and fit["sse"] == pytest.approx(float(sse[0])) and fit["n"] == 50
    part = sums.select(gram.solve("gram", gram.int_array([0, 2]), gram.double_array([0.0] * 4)).alias("f")).first()["f"]
    assert part["coef"][1] == 0.0 and part["coef"][3] == 0.0


def test_collinear_columns_still_predict(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0) for _ in range(6)], "k string, x double, y double")
    sums = gram.gram_sums(rows, ["k"], [F.lit(1.0), F.col("x"), F.col("y")])
    fit = sums.select(gram.solve("gram", gram.int_array([0, 1]), gram.double_array([0.0] * 2)).alias("f")).first()["f"]
    assert sum(fit["coef"]) == pytest.approx(5.0) and fit["sse"] == pytest.approx(0.0, abs=1e-9)


def test_constant_history(make_series):
    train = make_series(a=[7.0] * 60)
    for model in (arima, trend, holt_winters):
        out = model.fit_predict(train, heads(train, 3), KEY).collect()
        assert [r["yhat"] for r in out] == pytest.approx([7.0] * 3, abs=0.05)


@pytest.mark.parametrize("model", [arima, trend, holt_winters])
def test_forecast_shape_and_sign(make_series, model):
    out = model.fit_predict(make_series(a=WEEKLY, b=WEEKLY + 5), heads(make_series(a=[1], b=[1])), KEY).orderBy("serie", "paso").collect()
    assert [(r["serie"], r["paso"]) for r in out] == [(s, i) for s in "ab" for i in range(1, 8)]
    assert all(r["yhat"] is not None and r["yhat"] >= 0 for r in out)


def test_too_short_history_is_isolated(make_series):
    train = make_series(largo=WEEKLY, corto=[3, 4, 5])
    out = arima.fit_predict(train, heads(train), KEY).collect()
    assert {r["yhat"] is None for r in out if r["serie"] == "corto"} == {True}
    assert {r["yhat"] is None for r in out if r["serie"] == "largo"} == {False}


def test_ar1_is_recovered(make_series):
    rng, y = np.random.default_rng(8), [50.0]
    for _ in range(400):
        y.append(10 + 0.8 * y[-1] + rng.normal(0, 1))
    fitted = arima.fit(make_series(a=y), KEY, orders=[(1, 0)], d=0).first()
    assert fitted["coef"][1] == pytest.approx(0.8, abs=0.08)
    assert arima.stationarity(make_series(a=y), KEY).first()["d"] == 0
    walk = np.cumsum(rng.normal(0, 1, 400)) + 100
    assert arima.stationarity(make_series(a=walk), KEY).first()["d"] == 1


def test_p_value_of_the_ratio_agrees_with_the_published_table(spark):
    table = {-3.43: 0.01, -3.12: 0.025, -2.86: 0.05, -2.57: 0.10, -0.44: 0.90, -0.07: 0.95}
    rows = spark.createDataFrame([(t,) for t in (*table, -30.0, 5.0, None)], "t double").select("t", arima.p_of_ratio(F.col("t")).alias("p")).collect()
    got = {r["t"]: r["p"] for r in rows}
    assert all(got[t] == pytest.approx(p, abs=0.01) for t, p in table.items())
    assert (got[-30.0], got[5.0], got[None]) == (0.0, 1.0, None)


def reference_innovations(w, p, coef):
    e = []
    for t, v in enumerate(w):
        past = [w[t - k] if t >= k else 0.0 for k in (1, 2, 3)] + [e[t - k] if t >= k else 0.0 for k in (1, 2, 3)]
        e.append(v - coef[0] - sum(a * b for a, b in zip(coef[1:], past)) if t >= p else 0.0)
    return np.array(e)


def test_refinement_finds_the_least_sum_of_squares(make_series):
    rng = np.random.default_rng(21)
    noise = rng.normal(0, 1, 600)
    both = np.zeros(600)
    for t in range(1, 600):
        both[t] = 4 + 0.6 * both[t - 1] + noise[t] + 0.5 * noise[t - 1]
    data = make_series(larga=both, corta=both[:90])
    for row in arima.fit(data, KEY, orders=[(1, 1)], d=0).collect():
        w = both if row["serie"] == "larga" else both[:90]
        coef, total = np.array(row["coef"]), lambda c: (reference_innovations(w, 1, c) ** 2).sum()
        assert row["sce"] == pytest.approx(total(coef)) and row["sce"] <= row["inicio"]
        assert row["es"] == pytest.approx(reference_innovations(w, 1, coef)[:-4:-1])
        for i in (0, 1, 4):  # no neighbour is better
            for shift in (-1e-3, 1e-3):
                moved = coef.copy()
                moved[i] += shift
                assert total(moved) > row["sce"]
        if row["serie"] == "larga":
            assert coef[1] == pytest.approx(0.6, abs=0.1) and coef[4] == pytest.approx(0.5, abs=0.1)


def test_refinement_never_ends_worse(make_series):
    rng = np.random.default_rng(4)
    data = make_series(**{f"s{i}": np.abs(rng.normal(10, 4, 40 + 7 * i)) * (i % 3 + 1) for i in range(12)}, plana=[3.0] * 50, salto=[0.0] * 30 + [1e9] * 30)
    rows = arima.fit(data, KEY).filter("coef IS NOT NULL").collect()
    assert len(rows) >= 13 and all(r["sce"] <= r["inicio"] for r in rows)
    assert sum(r["sce"] < r["inicio"] for r in rows) > 5


def test_differenced_forecast_continues_a_line(make_series):
    line = [5 + 2 * i + (i % 3) * 0.01 for i in range(60)]
    for d in (1, 2):
        out = arima.fit_predict(make_series(a=line), heads(make_series(a=[1]), 5), KEY, orders=[(1, 0)], d=d).orderBy("paso").collect()
        assert [r["yhat"] for r in out] == pytest.approx([5 + 2 * (60 + i) for i in range(5)], abs=0.5)


def test_trend_follows_a_seasonal_series(make_series):
    t = np.arange(120)
    y = 50 + 0.2 * t + 10 * np.sin(2 * np.pi * t / 7)
    out = trend.fit_predict(make_series(a=y[:113]), heads(make_series(a=[1])), KEY, multiplicative=False).orderBy("paso").collect()
    naive = np.abs(y[113:] - y[:113].mean()).mean()
    assert np.abs(y[113:] - [r["yhat"] for r in out]).mean() < naive / 3


def test_one_true_bend_leaves_few_knots(make_series):
    t = np.arange(1, 201) / 200
    rng = np.random.default_rng(9)
    bent = 40 + 30 * t - 80 * np.maximum(0, t - 0.8 * 4 / 9)
    fitted = trend.fit(make_series(ruido=bent + rng.normal(0, 1, 200), glatt=bent, recta=20 + 10 * t + rng.normal(0, 1, 200)), KEY, multiplicative=False).collect()
    knots = {r["serie"]: np.array(r["coef"][2:10]) for r in fitted}
    for name in ("ruido", "glatt"):
        assert 1 <= np.count_nonzero(knots[name]) <= 3 and np.argmin(knots[name]) in (2, 3, 4)
    assert np.count_nonzero(knots["recta"]) <= 1


def test_bends_are_the_least_of_the_penalised_sum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 60, 8)).cumsum(1)
    y = np.einsum("sij,j->si", x, [0, 2, 0, 0, -3, 0, 0, 0.5]) + rng.normal(size=(5, 60))
    matrix, target, price = np.einsum("sij,sik->sjk", x, x), np.einsum("sij,si->sj", x, y), np.array([0.0, 1.0, 50.0, 500.0, 1e9])
    found = trend.bends_of(matrix, target, price)
    for m, c, cost, b in zip(matrix, target, price, found):
        value = lambda v: v @ m @ v / 2 - v @ c + cost * np.abs(v).sum()
        assert all(value(b + step * np.eye(8)[j]) >= value(b) - 1e-9 * abs(value(b)) for j in range(8) for step in (-1e-3, 1e-3))
    assert found[0] == pytest.approx(np.linalg.solve(matrix[0], target[0]), rel=1e-5)
    assert not found[4].any()


def reference_smoothing(y, a, b, g, p):
    level, slope = np.mean(y[:7]), (np.mean(y[7:14]) - np.mean(y[:7])) / 7
    season, sse = [v - level for v in y[:7]], 0.0
    for v in y:
        base, s = level + p * slope, season.pop(0)
        sse += (v - base - s) ** 2
        new = a * (v - s) + (1 - a) * base
        slope = b * (new - level) + (1 - b) * p * slope
        season.append(g * (v - base) + (1 - g) * s)
        level = new
    return level, slope, season, sse


def test_smoothing_fold_equals_a_loop(make_series):
    run = holt_winters.smoothed(holt_winters.values(make_series(a=WEEKLY), KEY), F.lit(0.3), F.lit(0.1), F.lit(0.2), F.lit(0.9)).first()["f"]
    level, slope, season, sse = reference_smoothing(WEEKLY, 0.3, 0.1, 0.2, 0.9)
    assert (run["l"], run["b"], run["sse"]) == pytest.approx((level, slope, sse)) and run["s"] == pytest.approx(season)


@pytest.mark.parametrize("n, seasonal, damped", [(10, False, False), (20, True, False), (40, True, True)])
def test_smoothing_components_by_length(make_series, n, seasonal, damped):
    r = holt_winters.fit(make_series(a=WEEKLY[:n]), KEY).first()
    assert (r["phi"] < 1) == damped and (any(r["s"]) if seasonal else not any(r["s"]))


def direct_attention(x, w):
    heads_, width = w["q"].shape[0], w["q"].shape[2]
    mixed = []
    for h in range(heads_):
        s = (x @ w["q"][h]) @ (x @ w["k"][h]).T / np.sqrt(width)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        mixed.append(e / (e.sum(axis=1, keepdims=True) + 1e-9) @ (x @ w["v"][h]))
    norm = lambda m: (m - m.mean(1, keepdims=True)) / (m.std(1, keepdims=True) + 1e-9)
    out = norm(np.concatenate(mixed, 1) @ w["o"] + x)
    return norm(np.maximum(0, out @ w["f1"]) @ w["f2"] + out)


def test_blocked_attention_equals_direct():
    x = np.random.default_rng(1).normal(size=(1200, 8))
    w = attention.projections(8, 2, 8)
    assert np.allclose(attention.encode(x, w), direct_attention(x, w))
    assert np.array_equal(attention.projections(8, 2, 8)["f2"], w["f2"])
    first = np.random.default_rng(42).normal(0, np.sqrt(2 / 16), (8, 8))
    assert np.array_equal(w["q"][0], first)


def test_attention_sizes():
    assert [attention.size_for(n) for n in (30, 50, 100, 200)] == [(2, 4), (2, 8), (4, 8), (4, 16)]


def test_expanded_features_are_reproducible(make_series):
    train = make_series(a=WEEKLY, b=WEEKLY * 2)
    rows = trees.series_features(train, KEY).unionByName(trees.ahead_features(train, heads(train), KEY))
    one = {(r["serie"], r["fecha"]): r["x"] for r in attention.expanded(rows, KEY).collect()}
    two = {(r["serie"], r["fecha"]): r["x"] for r in attention.expanded(rows.repartition(3, "fecha"), KEY).collect()}
    assert len(one) == 94 and one == two and {len(x) for x in one.values()} == {16}


@pytest.mark.parametrize("kind, hp", [("random_forest", {"n_estimators": 5, "max_depth": 4}), ("gradient_boosting", {"n_estimators": 3})])
def test_pooled_trees(make_series, kind, hp):
    train = make_series(a=WEEKLY, b=WEEKLY * 3)
    out = trees.fit_predict(train, heads(train), KEY, kind=kind, **hp).collect()
    mean = {s: np.mean([r["yhat"] for r in out if r["serie"] == s]) for s in "ab"}
    assert len(out) == 14 and all(r["yhat"] >= 0 for r in out) and mean["b"] > 2 * mean["a"]


def test_stacking_weights(make_series):
    train = make_series(a=WEEKLY, b=WEEKLY * 3)
    stack = {"rf": ("random_forest", {"n_estimators": 3, "max_depth": 3}), "lr": ("regresion_lineal", {})}
    out, weights = trees.stacked(train, heads(train), KEY, folds=2, stack=stack)
    assert out.count() == 14 and {r["modelo"] for r in weights.collect()} == {"rf", "lr"}


def test_search_sample(spark):
    space = {"p": [1, 2, 3], "q": ["x", None]}
    six = experiment.sample_space(spark, space, 6)
    assert len({tuple(c.items()) for c in six}) == 6
    assert experiment.sample_space(spark, {"p": [1, 2]}, 10) == experiment.sample_space(spark, {"p": [1, 2]}, 10)
    assert len(experiment.sample_space(spark, {"p": [1, 2]}, 10)) == 2
    assert experiment.sample_space(spark, space, 3) == six[:3]


def failing(train, heads, keys):
    raise ValueError("sin memoria")


def test_comparison_isolates_a_failing_model(make_series):
    models = {"holt_winters": holt_winters.fit_predict, "roto": failing, "tendencia": trend.fit_predict}
    out = experiment.compare(make_series(a=WEEKLY, corto=[1, 2, 3]), models)
    rows = {r["modelo"]: r for r in out.scores.collect()}
    assert set(rows) == {"holt_winters", "roto", "tendencia"} and rows["roto"]["error"] == "sin memoria"
    assert rows["roto"]["posicion"] is None and rows["holt_winters"]["mae"] is not None
    assert out.best.count() == 1


def test_run_is_stored_and_read_back(spark, make_series, tmp_path, day):
    models = {"holt_winters": holt_winters.fit_predict, "tendencia": trend.fit_predict, "arima": arima.fit_predict}
    result = experiment.run(make_series(a=WEEKLY, b=WEEKLY + 2), models, horizon=3, k=2)
    future = result["futuro"].orderBy("serie", "fecha").collect()
    assert len(future) == 6 and future[0]["fecha"] == day(40) and all(r["recomendacion"] >= r["demanda_estimada"] for r in future)
    runs.save_run(str(tmp_path), "r1", result, experiment.CRITERION)
    assert runs.stored(spark, str(tmp_path), "ejecuciones").count() == 2
    assert runs.stored(spark, str(tmp_path), "resultados_modelo").count() == 6
    assert runs.stored(spark, str(tmp_path), "resultados_fold").count() == 12
    back = runs.read_back(runs.stored(spark, str(tmp_path), "resultados_modelo"), runs.stored(spark, str(tmp_path), "resultados_fold")).collect()
    assert [r["posicion"] for r in back if r["serie"] == "a"] == [1, 2, 3] and all([f["fold"] for f in r["folds"]] == [1, 2] for r in back)
    result["modelos"].limit(0).write.parquet(f"{tmp_path}/vacio")
    unfinished = result["series"].limit(1).select(F.lit("r2").alias("run_id"))
    unfinished.write.mode("append").parquet(f"{tmp_path}/ejecuciones_r2")
    assert runs.stored(spark, str(tmp_path), "ejecuciones").select("run_id").distinct().count() == 1


def small_run(spark, day, n_models=2):
    """The parts of a run of one series, without fitting anything."""
    series = spark.createDataFrame([("a", day(i), float(i)) for i in range(5)], "serie string, fecha date, cantidad double")
    scores = spark.createDataFrame([("a", f"m{i}", 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, i + 1) for i in range(n_models)],
                                   "serie string, modelo string, mae double, rmse double, mape double, smape double, u_theil double, r2 double, posicion int")
    folds = spark.createDataFrame([("a", "m0", i) for i in (1, 2)], "serie string, modelo string, fold int")
    tests = spark.createDataFrame([("a", "friedman")], "serie string, prueba string")
    return {"series": series, "ganadores": scores.filter("posicion = 1"), "modelos": scores, "folds": folds, "pruebas": tests}


def counted(spark, root, run_id="007"):
    return [runs.stored(spark, root, t).filter(F.col("run_id") == run_id).count() for t in runs.RUN_TABLES]


def test_a_failed_attempt_leaves_nothing_that_counts(spark, tmp_path, day):
    root, good = str(tmp_path / "s"), small_run(spark, day)
    broken = {**good, "pruebas": good["pruebas"].withColumn("prueba", F.raise_error(F.lit("roto")).cast("string"))}
    with pytest.raises(Exception, match="roto"):
        runs.save_run(root, "007", broken, "c")
    runs.save_run(root, "007", good, "c")
    assert counted(spark, root) == [1, 2, 2, 1]
    runs.save_run(root, "008", good, "c")
    assert counted(spark, root) == counted(spark, root, "008") == [1, 2, 2, 1]


def test_two_writers_of_one_run_leave_one(spark, tmp_path, day):
    root = str(tmp_path / "d")
    attempts = [runs.save_run(root, "007", small_run(spark, day, n), "c") for n in (2, 3)]
    assert attempts[0] != attempts[1] and counted(spark, root) == [1, 3, 2, 1]
    assert [r["intento"] for r in runs.committed(spark, root).collect()] == attempts[1:]


def test_tuning_and_tuned_folds(make_series):
    rows = make_series(a=WEEKLY)
    found = experiment.tune(rows, "holt_winters", 4)
    assert found.count() == 4 and found.filter("mejor").count() == 1
    best = found.filter("mejor").first()["mae"]
    assert best == min(r["mae"] for r in found.collect())
    cv = experiment.tuned_walk_forward(rows, "holt_winters", found, 2)
    assert sorted(r["fold"] for r in cv.collect()) == [1, 2]


def test_parameters_round_trip_and_staleness(spark, make_series, tmp_path):
    rows = make_series(a=WEEKLY, b=WEEKLY + 2)
    runs.save_parameters(str(tmp_path), "r1", "holt_winters", holt_winters.fit(rows, KEY), S.signature(rows, KEY))
    runs.save_parameters(str(tmp_path), "r2", "holt_winters", holt_winters.fit(rows, KEY), S.signature(rows, KEY))
    out = runs.saved_forecast(spark, str(tmp_path), "holt_winters", 3).orderBy("serie", "fecha").collect()
    fresh = holt_winters.fit_predict(rows, heads(rows, 3), KEY).orderBy("serie", "paso").collect()
    assert [r["yhat"] for r in out] == [r["yhat"] for r in fresh]
    listed = runs.list_saved(spark, str(tmp_path))
    assert listed.count() == 2
    changed = make_series(a=WEEKLY, b=WEEKLY + 3, c=WEEKLY)
    state = {r["serie"]: r for r in runs.staleness(listed, changed).collect()}
    assert state["a"]["vigente"] and not state["b"]["vigente"] and not state["c"]["existe"]
    with pytest.raises(ValueError):
        runs.save_parameters(str(tmp_path), "r1", "../otro", holt_winters.fit(rows, KEY), S.signature(rows, KEY))


def test_tree_model_round_trip(spark, make_series, tmp_path):
    train = make_series(a=WEEKLY)
    rows = trees.attended(train, heads(train), KEY)
    model = trees.regressor("random_forest", n_estimators=3, max_depth=3).fit(rows.filter("NOT futuro"))
    runs.save_tree(model, str(tmp_path), "atencion_random_forest")
    again = runs.load_tree(str(tmp_path), "atencion_random_forest")
    pick = lambda m: [r["prediction"] for r in m.transform(rows.filter("futuro")).orderBy("fecha").collect()]
    assert pick(model) == pick(again) and len(trees.importances(again)) == 8


def test_single_model_split_is_stable(spark):
    rows = spark.range(1000).select(F.col("id").alias("id_plato"), F.lit("2026-01-01").cast("date").alias("fecha"))
    a = trees.hash_split(rows, ["fecha", "id_plato"]).filter("es_test").count()
    b = trees.hash_split(rows.repartition(7), ["fecha", "id_plato"]).filter("es_test").count()
    assert a == b and 150 < a < 250


def test_linear_model_on_dish_rows(spark, day):
    pdf = pd.DataFrame([{"id_plato": p, "fecha": day(i), "cantidad": 3 * p + i % 7, "dia_semana": i % 7, "mes": 1, "dia_mes": i + 1, "es_finde": 0,
                         "clima": 1, "evento": 0, "cat_enc": p, "ventas_7d": 3.0 * p} for p in range(1, 6) for i in range(30)])
    model, scored = trees.train_single(spark.createDataFrame(pdf), "regresion_lineal")
    assert scored.agg(F.avg(F.abs(F.col("y") - F.col("yhat")))).first()[0] < 0.5


def test_a_forest_on_many_dish_rows_grows_from_cells(spark, day, monkeypatch):
    """Over the bound the forest grows from cells, and is as good as MLlib's."""
    pdf = pd.DataFrame([{"id_plato": p, "fecha": day(i), "cantidad": 3 * (p % 5) + i % 7, "dia_semana": i % 7, "mes": 1 + i // 31, "dia_mes": i % 31 + 1,
                         "es_finde": int(i % 7 > 4), "clima": 1 + i % 3, "evento": 0, "cat_enc": p % 5, "ventas_7d": 3.0 * (p % 5)} for p in range(40) for i in range(60)])
    rows = spark.createDataFrame(pdf)
    error = lambda scored: scored.agg(F.avg(F.abs(F.col("y") - F.col("yhat")))).first()[0]
    model, scored = trees.train_single(rows)
    assert type(model).__name__ == "RandomForestRegressionModel"
    monkeypatch.setattr(trees, "FOREST_ROWS", 100)
    cells, found = trees.train_single(rows)
    assert isinstance(cells, trees.CellForest) and cells.trees.count() == 100 and found.columns == scored.columns
    assert found.count() == scored.count() and abs(error(found) - error(scored)) < 0.1 and error(found) < 0.2
    shares = dict(trees.importances(cells))
    assert sum(shares.values()) == pytest.approx(1.0) and shares["dia_semana"] == pytest.approx(dict(trees.importances(model))["dia_semana"], abs=0.1)
    assert trees.forecast_dishes(cells, rows.limit(3), "random_forest").count() == 3
    again = trees.train_single(rows.repartition(5))[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))
    monkeypatch.setattr(trees.forest, "LOCAL_CELLS", 10)  # more cells than a task holds: MLlib again
    assert type(trees.train_single(rows)[0]).__name__ == "RandomForestRegressionModel"


def test_random_search_on_time_folds(make_series):
    space = {"n_estimators": [2, 3], "max_depth": [2]}
    out = experiment.tune_on_folds(make_series(a=WEEKLY, b=WEEKLY + 4), "atencion_random_forest", n=2, k=2, space=space).collect()
    assert len({r["hiperparametros"] for r in out}) == 2 and all(r["mae"] > 0 for r in out)
    assert [r["mae"] for r in out if r["mejor"]] == [min(r["mae"] for r in out)]


def test_smoothing_without_a_season_has_none(make_series):
    """A weekly peak must not come back in a forecast that was told to have no season."""
    peaks = [60.0 if i % 7 == 0 else 10.0 for i in range(28)]
    heads = make_series(a=[1.0]).select("serie").withColumn("h", F.lit(14))
    plain = [r["yhat"] for r in holt_winters.fit_predict(make_series(a=peaks), heads, KEY, seasonal=False).orderBy("paso").collect()]
    assert max(abs(a - b) for a, b in zip(plain, plain[1:])) < 5
    fitted = holt_winters.fit(make_series(a=peaks), KEY, seasonal=False).first()
    assert fitted["gamma"] == 0 and set(fitted["s"]) == {0.0}


def test_refinement_never_fits_worse(make_series):
    noisy = make_series(a=[20 + i * 0.3 + (i % 7) * 2 + (i * 37 % 11) for i in range(60)])
    errors = [holt_winters.fit(noisy, KEY, refine=n).first()["sse"] for n in (0, 1, 3)]
    assert errors[0] > errors[1] >= errors[2]


def test_failure_in_a_task_is_that_models_failure(make_series):
    from wastelens.plans import experiment

    def breaks(train, heads, keys):
        return heads.select(*keys, F.lit(1).alias("paso"), F.raise_error(F.lit("roto")).cast("double").alias("yhat"))

    series = make_series(a=[10 + i % 7 for i in range(40)])
    scores = {r["modelo"]: r for r in experiment.compare(series, {"holt_winters": holt_winters.fit_predict, "roto": breaks}).scores.collect()}
    assert "roto" in scores["roto"]["error"] and scores["holt_winters"]["mae"] is not None
    alone = experiment.compare(series, {"roto": breaks})
    assert alone.scores.count() == 1 and alone.predictions.count() == 0


def test_series_code_reaches_the_pooled_trees(make_series):
    train = make_series(a=[10 + i % 3 for i in range(30)], b=[50 + i % 5 for i in range(30)])
    heads = train.select("serie").distinct().withColumn("h", F.lit(2))
    rows = trees.attended(train, heads, KEY).collect()
    codes = {(r["serie"], r["features"][len(r["features"]) - 1]) for r in rows}
    assert len(codes) == 2 and len({c for _, c in codes}) == 2


def test_short_histories_are_fitted(make_series):
    """Folds of a month leave few days; every model but the shortest ARIMA still forecasts."""
    for n in (8, 10, 15, 25):
        short = make_series(a=WEEKLY[:n])
        for model in (arima, trend):
            out = [r["yhat"] for r in model.fit_predict(short, heads(short, 3), KEY).orderBy("paso").collect()]
            assert len(out) == 3 and all(v is not None and 0 <= v < 100 for v in out), (n, model.__name__, out)
    alone = make_series(a=[4.0])
    assert [r["yhat"] for r in arima.fit_predict(alone, heads(alone, 2), KEY).collect()] == [None, None]


def test_long_histories_keep_the_full_first_step(spark, make_series):
    """From 44 days on, the residuals are those of a plain autoregression of order ten."""
    y = np.concatenate([WEEKLY, WEEKLY[::-1]])
    rows = arima.innovations(make_series(a=y), KEY, spark.createDataFrame([("a", 0)], "serie string, d int")).orderBy("fecha").collect()
    x = np.array([[1.0, *y[i - 10:i][::-1]] for i in range(10, len(y))])
    beta = np.linalg.lstsq(x, y[10:], rcond=None)[0]
    assert [r["e"] for r in rows[10:]] == pytest.approx((y[10:] - x @ beta).tolist(), abs=1e-6)
    assert all(r["e"] is None for r in rows[:10])


def test_saved_winners_forecast_like_fresh_ones(spark, make_series, tmp_path):
    rows = make_series(a=WEEKLY, b=WEEKLY + 2, c=WEEKLY * 2)
    best = spark.createDataFrame([("a", "holt_winters"), ("b", "atencion_gradient_boosting"), ("c", "atencion_gradient_boosting")], "serie string, modelo string")
    scores = best.withColumns({"mae": F.lit(1.0), "rmse": F.lit(1.0), "r2": F.lit(0.5)})
    experiment.retrain(rows, best, str(tmp_path), "r1", 3)
    saved = {(r["serie"], r["modelo"], r["fecha"]): r["yhat"] for r in experiment.saved_future(rows, str(tmp_path), 3).collect()}
    fresh = experiment.future(rows, scores, 3).collect()
    assert {(r["serie"], r["modelo"], r["fecha"]) for r in fresh} == set(saved) and len(saved) == 9
    for r in fresh:
        assert r["demanda_estimada"] == pytest.approx(saved[r["serie"], r["modelo"], r["fecha"]], abs=0.006)
    # a later run of another type takes a series over
    experiment.retrain(rows, best.filter("serie = 'b'").withColumn("modelo", F.lit("tendencia")), str(tmp_path), "r2", 3)
    now = {r["serie"]: r["modelo"] for r in experiment.saved_future(rows, str(tmp_path), 3).select("serie", "modelo").distinct().collect()}
    assert now == {"a": "holt_winters", "b": "tendencia", "c": "atencion_gradient_boosting"}
    with pytest.raises(ValueError):
        runs.saved_tree_forecast(spark, str(tmp_path), "../otro", rows)


def test_experiment_tunes_every_kind_of_model(make_series):
    space = {"atencion_random_forest": {"n_estimators": [2, 3], "max_depth": [2]}}
    models = {m: experiment.ALL_MODELS[m] for m in ("holt_winters", "atencion_random_forest")}
    small = {**models, "atencion_random_forest": experiment._configured("atencion_random_forest", {"n_estimators": 2, "max_depth": 2})}
    out = experiment.run(make_series(a=WEEKLY, b=WEEKLY + 4), small, 3, 2, tuning=2, spaces=space)
    found = out["busqueda"].collect()
    assert {(r["serie"], r["modelo"]) for r in found if r["mejor"]} == {
        ("a", "holt_winters"), ("b", "holt_winters"), (None, "atencion_random_forest")}
    folds = out["folds"].collect()
    assert {(r["modelo"], r["fold"]) for r in folds} == {(m, f) for m in models for f in (1, 2)} and len(folds) == 8


def test_a_search_of_failing_candidates_scores_none(make_series, monkeypatch):
    rows = make_series(a=WEEKLY)
    monkeypatch.setattr(experiment, "_configured", lambda model, combo: failing)
    found = experiment.tune(rows, "holt_winters", 2)
    assert [(r["mae"], r["error"], r["mejor"]) for r in found.collect()] == [(None, "sin memoria", False)] * 2
    folds = experiment.tuned_walk_forward(rows, "holt_winters", found, 2).collect()
    assert [(r["fold"], r["mae"]) for r in sorted(folds, key=lambda r: r["fold"])] == [(1, None), (2, None)]
    out = experiment.run(rows, {"holt_winters": failing}, 3, 2, tuning=2)
    assert out["busqueda"].count() == 2 and out["folds"].count() == 2


def test_parts_of_a_run_are_computed_when_asked_for(make_series):
    called = []

    def counting(train, heads, keys):
        called.append(keys)
        return holt_winters.fit_predict(train, heads, keys)

    out = experiment.run(make_series(a=WEEKLY), {"holt_winters": counting, "tendencia": trend.fit_predict}, 3, 2)
    assert called == [] and set(out) >= {"pruebas", "folds", "futuro"}
    out["pruebas"].count(), out["modelos"].count()
    assert called == [["serie"]]


def test_folds_and_candidates_share_their_fits(make_series):
    """All folds in one call give what every fold alone gives."""
    rows = make_series(a=WEEKLY, b=WEEKLY + 4)
    folds = experiment.time_folds(rows, 2)
    model = {"kind": "random_forest", "n_estimators": 4, "max_depth": 3}
    together = trees.fit_predict(folds.train, folds.heads, ["serie", "fold"], pool=["fold"], **model).collect()
    alone = [r for i in (1, 2) for r in trees.fit_predict(
        folds.train.filter(F.col("fold") == i), folds.heads.filter(F.col("fold") == i), ["serie", "fold"], **model).collect()]
    key = lambda r: (r["serie"], r["fold"], r["paso"])
    assert [r["yhat"] for r in sorted(together, key=key)] == pytest.approx([r["yhat"] for r in sorted(alone, key=key)])


def test_a_poisoned_series_fails_alone(make_series):
    """An exception of the user's function is the failure of one series; wrong lengths and tuples are handled too."""
    def model(train, days):
        if train["cantidad"].max() > 900:
            raise ValueError("serie envenenada")
        return [float(train["cantidad"].mean())] * len(days), {"mae": 0.0}, {}

    rows = make_series(a=WEEKLY, malo=[*WEEKLY[:-20], 1000.0, *WEEKLY[-19:]], b=WEEKLY + 1)
    models = {"propio": experiment.user_model(model), "corto": experiment.user_model(lambda train, days: [1.0]), "tendencia": trend.fit_predict}
    compared = experiment.compare(rows, models)
    got = {(r["serie"], r["modelo"]): r for r in compared.scores.collect()}
    assert len(got) == 9 and got["malo", "propio"]["error"] == "serie envenenada" and got["malo", "propio"]["posicion"] is None
    assert all(got[s, "propio"]["mae"] is not None for s in "ab") and all(got[s, "tendencia"]["mae"] is not None for s in ("a", "malo"))
    assert all("values for" in got[s, "corto"]["error"] for s in ("a", "b", "malo"))
    folds = {(r["serie"], r["fold"]): r["error"] for r in experiment.walk_forward(rows, {"propio": models["propio"]}, 2).collect()}
    assert folds["a", 1] is None and folds["malo", 2] == "serie envenenada"
