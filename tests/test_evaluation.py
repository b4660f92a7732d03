import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wastelens.functions import pvalues
from wastelens.operators import metrics, plan, tests_stat

NAN = float("nan")


def scored(spark, y, p, previo=None):
    prev = [previo, *y[:-1]] if previo is not None else [None, *y[:-1]]
    rows = [("m", float(a), float(b), None if c is None else float(c)) for a, b, c in zip(y, p, prev)]
    return metrics.score(spark.createDataFrame(rows, "modelo string, y double, yhat double, previo double"), ["modelo"]).first()


def test_pinned_metric_values(spark):
    assert scored(spark, [0, 0, 10], [0, 5, 8])["smape"] == 111.1111
    assert scored(spark, [12, 14, 16], [11.5, 13.5, 15.5], previo=10)["u_theil"] == 0.25
    assert scored(spark, [12, 14, 16], [10, 12, 14], previo=10)["u_theil"] == 1.0
    assert scored(spark, [5, 5, 5], [4, 4, 4], previo=5)["u_theil"] is None
    assert scored(spark, [1, 2, 3], [-5, 2, 3])["mae"] == 0.3333
    one = scored(spark, [5], [4])
    assert one["r2"] is None and one["mae"] == 1.0
    zeros = scored(spark, [0, 0], [0, 0])
    assert zeros["mape"] is None and zeros["smape"] is None and zeros["mae"] == 0.0


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(1, 20, 50).astype(float), rng.normal(10, 5, 50)
    r, q = scored(spark, y.tolist(), p.tolist()), np.maximum(0, p)
    assert r["rmse"] == pytest.approx(np.sqrt(np.mean((y - q) ** 2)), abs=1e-4)
    assert r["mape"] == pytest.approx(np.mean(np.abs(y - q) / y) * 100, abs=1e-4)
    assert r["r2"] == pytest.approx(1 - ((y - q) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)


def test_doubling_quantities_doubles_mae(spark):
    y, p = [3.0, 7.0, 9.0], [4.0, 5.0, 9.5]
    assert scored(spark, [2 * v for v in y], [2 * v for v in p])["mae"] == pytest.approx(2 * scored(spark, y, p)["mae"], abs=2e-4)


def test_ranking_ignores_missing_and_breaks_ties(spark):
    rows = [("s", "a", 3.0, 1.0, 1.0), ("s", "b", 4.0, 1.0, 1.0), ("s", "c", 2.0, 1.0, 1.0), ("s", "d", None, None, None), ("s", "e", 2.5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "serie string, modelo string, mae double, rmse double, smape double")
    got = {r["modelo"]: r["posicion"] for r in metrics.ranked(df, ["serie"]).collect()}
    assert got == {"a": 3, "b": 4, "c": 1, "d": None, "e": 2}
    tie = spark.createDataFrame([("s", "x", 1.0, 2.0, 0.0), ("s", "y", 1.0, 1.5, 9.0)], df.schema)
    assert metrics.winners(tie, ["serie"]).first()["modelo"] == "y"


def errs(spark, day, **models):
    rows = [("s", m, day(i), None if math.isnan(v) else float(v)) for m, values in models.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "serie string, modelo string, fecha date, e double")


def best(spark, name):
    return spark.createDataFrame([("s", name)], "serie string, ganador string")


def test_dm_small_identical_and_clear(spark, day):
    small = tests_stat.diebold_mariano(tests_stat.pairs_with_best(errs(spark, day, a=[1, 2], b=[2, 3]), best(spark, "a"))).first()
    assert small["p_valor"] is None and not small["aplicable"]
    same = tests_stat.diebold_mariano(tests_stat.pairs_with_best(errs(spark, day, a=[1, 2, 3, 1, 2], b=[1, 2, 3, 1, 2]), best(spark, "a"))).first()
    assert same["p_valor"] == 1.0 and not same["significativo"]
    rng = np.random.default_rng(0)
    bad, good = np.abs(rng.normal(5, .5, 60)), np.abs(rng.normal(1, .2, 60))
    clear = tests_stat.diebold_mariano(tests_stat.pairs_with_best(errs(spark, day, malo=bad, bueno=good), best(spark, "bueno"))).first()
    d = bad ** 2 - good ** 2
    var = (d.var(ddof=1) + 2 * np.cov(d[1:], d[:-1], ddof=1)[0, 1]) / 60
    assert clear["estadistico"] == pytest.approx(d.mean() / math.sqrt(var), abs=1e-4)
    assert clear["p_valor"] < 0.05 and clear["estadistico"] > 0


def test_friedman_against_direct_ranks(spark, day):
    rng = np.random.default_rng(4)
    data = {m: rng.integers(0, 6, 15).astype(float) for m in "abc"}
    data["c"][3] = NAN
    row = tests_stat.friedman(errs(spark, day, **data)).first()
    table = np.array([[data[m][i] for m in "abc"] for i in range(15) if i != 3])
    ranks = np.array([[(np.sum(r < v) + (np.sum(r == v) + 1) / 2) for v in r] for r in table])
    n, k = ranks.shape
    ties = sum(t ** 3 - t for r in table for t in np.unique(r, return_counts=True)[1])
    chi = (12 / (k * n * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    assert row["n"] == n and row["estadistico"] == pytest.approx(chi, abs=1e-4)
    assert row["p_valor"] == pytest.approx(math.exp(-chi / 2), abs=1e-4)


def test_friedman_needs_three_models(spark, day):
    row = tests_stat.friedman(errs(spark, day, a=[1, 2, 3, 4], b=[2, 3, 4, 5])).first()
    assert row["p_valor"] is None and not row["aplicable"]


def exact_wilcoxon(d):
    """Brute force over every assignment of signs."""
    a = np.abs(d)
    ranks = np.array([np.sum(a < v) + (np.sum(a == v) + 1) / 2 for v in a])
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return w, min(1.0, 2 * np.mean(np.array(sums) <= w))


def test_wilcoxon_exact(spark, day):
    a, b = np.array([1.0, 2.5, 3.1, 0.2, 4.4, 2.0, 1.1]), np.array([1.6, 2.0, 4.9, 1.3, 4.1, 4.2, 3.9])
    row = tests_stat.wilcoxon(tests_stat.pairs_with_best(errs(spark, day, g=a, c=b), best(spark, "g"))).first()
    w, p = exact_wilcoxon(a - b)
    assert row["estadistico"] == w and row["p_valor"] == pytest.approx(p, abs=1e-4)


def test_wilcoxon_small_and_identical(spark, day):
    few = tests_stat.wilcoxon(tests_stat.pairs_with_best(errs(spark, day, g=[1, 2, 3], c=[2, 3, 4]), best(spark, "g"))).first()
    assert few["p_valor"] is None and not few["aplicable"]
    same = tests_stat.wilcoxon(tests_stat.pairs_with_best(errs(spark, day, g=[1] * 6, c=[1] * 6), best(spark, "g"))).first()
    assert same["p_valor"] == 1.0 and not same["significativo"]


def test_holm(spark):
    rows = [("s", "a", 0.01), ("s", "b", 0.04), ("s", "c", 0.03), ("s", "d", None)]
    out = tests_stat.holm(spark.createDataFrame(rows, "serie string, modelo_b string, p_valor double"), ["serie"]).collect()
    got = {r["modelo_b"]: r["p_valor_ajustado"] for r in out}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06, "d": None}


def test_all_tests_never_pit_the_winner_against_itself(spark, day):
    rows = [("s", m, day(i), 10.0, 10.0 + k * (i % 4), 9.0) for k, m in enumerate("abc") for i in range(12)]
    df = spark.createDataFrame(rows, "serie string, modelo string, fecha date, y double, yhat double, previo double")
    out = tests_stat.all_tests(df, best(spark, "a")).collect()
    assert sorted(r["prueba"] for r in out) == ["diebold_mariano"] * 2 + ["friedman"] + ["wilcoxon"] * 2
    assert all("a" not in (r["modelo_b"],) for r in out if r["prueba"] == "wilcoxon")
    assert all(r["p_valor_ajustado"] >= r["p_valor"] for r in out if r["prueba"] == "wilcoxon")


def test_chi_square_tail_odd_and_even(spark):
    df = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (11.070498, 5)], "x double, k int")
    for r in df.select(pvalues.chi2_tail("x", "k").alias("p")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-6)


def test_production_plan_pinned(spark, day):
    f = spark.createDataFrame([("s", "m", day(i), 4.0) for i in range(3)], "serie string, modelo string, fecha date, yhat double")
    s = spark.createDataFrame([("s", "m", 1.5, 0.3)], "serie string, modelo string, mae double, r2 double")
    rows = plan.production_plan(f, s, ["serie", "modelo"]).collect()
    assert {(r["demanda_estimada"], r["recomendacion"], r["riesgo"], r["confianza"]) for r in rows} == {(4.0, 5, "medio", 0.3)}
    none = plan.production_plan(f.withColumn("yhat", F.lit(0.0)), s, ["serie", "modelo"]).first()
    assert none["riesgo"] == "alto"
