import datetime as dt

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from wastelens.operators import cleaning, eda, naive, series

SEED7 = np.random.default_rng(7).integers(1, 20, 40)


def test_seed_matches_the_pinned_fixture():
    assert SEED7[:10].tolist() == [18, 12, 13, 18, 11, 15, 16, 5, 2, 6]


def test_gap_is_interpolated_and_flagged(spark, day):
    rows = [("a", day(i), float(i + 1)) for i in range(10) if i != 4]
    out = series.continuous(spark.createDataFrame(rows, "serie string, fecha date, cantidad double")).orderBy("fecha").collect()
    assert len(out) == 10 and out[4]["cantidad"] == 5.0 and out[4]["interpolado"]
    assert sum(r["interpolado"] for r in out) == 1


def test_single_day_series_stays_one_row(spark, day):
    df = spark.createDataFrame([("a", day(0), 3.0)], "serie string, fecha date, cantidad double")
    assert [tuple(r) for r in series.continuous(df).collect()] == [("a", day(0), 3.0, False)]


def test_lags_and_past_means(make_series):
    rows = series.lags_and_means(make_series(a=SEED7)).orderBy("fecha").collect()
    assert rows[10]["lag_1"] == SEED7[9] and rows[10]["lag_7"] == SEED7[3]
    assert rows[10]["media_movil_7"] == pytest.approx(73 / 7)
    assert rows[0]["lag_1"] is None and rows[0]["media_movil_7"] is None


def test_the_future_does_not_change_the_past(make_series):
    changed = SEED7.astype(float).copy()
    changed[15:] = 999
    a = series.lags_and_means(make_series(a=SEED7)).orderBy("fecha").collect()
    b = series.lags_and_means(make_series(a=changed)).orderBy("fecha").collect()
    assert [r["media_movil_14"] for r in a[:16]] == [r["media_movil_14"] for r in b[:16]]


def test_row_order_does_not_matter(make_series):
    df = make_series(a=SEED7, b=SEED7[::-1])
    shuffled = df.orderBy(F.xxhash64("serie", "fecha")).repartition(3)
    key = lambda d: sorted(map(tuple, series.prepared_rows(d).collect()), key=str)
    assert key(df) == key(shuffled)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 30, 40])
def test_split_is_chronological_and_complete(make_series, n):
    out = series.chronological_split(make_series(a=range(n))).orderBy("fecha").collect()
    blocks = [r["bloque"] for r in out]
    test = max(1, int(round(n * 0.15)))
    train, val = n - 2 * test, test
    if train < 1:
        train = max(1, n - 2)
        val = max(0, (n - train) // 2)
    assert blocks == ["train"] * train + ["val"] * val + ["test"] * (n - train - val)


def test_scaler_uses_train_only(make_series):
    values = list(range(1, 35)) + [1000] * 6
    split = series.chronological_split(make_series(a=values))
    out = series.scaled(split, ["cantidad"]).orderBy("fecha").collect()
    train = np.array([r["cantidad"] for r in out if r["bloque"] == "train"])
    assert out[0]["cantidad_esc"] == pytest.approx((1 - train.mean()) / train.std())
    flat = series.scaled(series.chronological_split(make_series(a=[5] * 20)), ["cantidad"]).collect()
    assert {r["cantidad_esc"] for r in flat} == {0.0}


@pytest.mark.parametrize("n, folds, block", [(60, 5, 10), (30, 5, 5), (4, 3, 1), (2, 0, 0)])
def test_folds(make_series, day, n, folds, block):
    out = series.fold_table(make_series(a=range(n))).orderBy("fold").collect()
    assert len(out) == folds
    for i, row in enumerate(out):
        assert row["n_val"] == block
        assert row["n_train"] == n - (folds - i) * block
        assert row["fecha_inicio_val"] == day(row["n_train"]) and row["fecha_fin_train"] == day(row["n_train"] - 1)


def test_holdout_is_between_5_and_20(make_series):
    for n in (30, 60, 200):
        rows = series.holdout_split(make_series(a=range(n))).filter("es_test").count()
        n_train = min(max(int(n * 0.8), n - 20), n - 5)
        assert rows == n - n_train and 5 <= rows <= 20
    assert series.holdout_split(make_series(a=range(29))).count() == 0


def test_naive_forecasts_against_loops(make_series):
    y = SEED7.astype(float)
    out = naive.holdout_predictions(make_series(a=y)).collect()
    n_train = min(max(int(40 * 0.8), 20), 35)
    by = {(r["modelo"], r["fecha"]): r for r in out}
    for i in range(n_train, 40):
        fecha = dt.date(2026, 1, 1) + dt.timedelta(days=i)
        assert by["media", fecha]["yhat"] == pytest.approx(y[:n_train].mean())
        assert by["ultimo", fecha]["yhat"] == y[n_train - 1]
        assert by["media_7", fecha]["yhat"] == pytest.approx(y[n_train - 7:n_train].mean())
        assert by["estacional_7", fecha]["yhat"] == y[n_train - 7 + (i - n_train) % 7]
        assert by["media", fecha]["previo"] == y[i - 1]


def raw_rows(spark):
    rows = [(1, 1, "2026-01-01", "18"), (2, 1, "2026-01-02", "-5"), (3, 1, "2026-01-03", None), (1, 1, "2026-01-01", "18"),
            (4, 1, "no", "3"), (5, 1, "2026-01-05", "abc")]
    return spark.createDataFrame(rows, "id_venta long, id_plato long, fecha string, cantidad string")


def test_cleaning(spark):
    out = cleaning.clean(raw_rows(spark)).orderBy("id_venta").collect()
    assert [(r["id_venta"], r["cantidad"]) for r in out] == [(1, 18.0), (2, 0.0), (3, 0.0), (5, 0.0)]
    warn = cleaning.cleaning_warnings(raw_rows(spark)).first()
    assert tuple(warn) == (1, 2, 1, 1)


def test_empty_input(spark):
    empty = raw_rows(spark).limit(0)
    assert cleaning.clean(empty).count() == 0
    assert tuple(cleaning.cleaning_warnings(empty).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("kind", ["int", "long", "double", "string"])
def test_the_first_row_is_the_smallest_at_any_size(spark, kind):
    """Quantities beyond any packed width, equal tie-breaks, nulls: the same row in any order and for any type."""
    draw = random.Random(3)
    rows = [(k, k % 3, draw.choice(["2026-01-01", "2026-01-02", "0001-01-01", "9999-12-31"]),
             draw.choice(["900000000000", "200000000000", "1e300", "0.0000001", "0.0000002", "7", None, "-3"]), draw.choice([1, 2, None]))
            for k in range(60) for _ in range(draw.randint(1, 6))]
    df = spark.createDataFrame(rows, "id_venta long, id_plato long, fecha string, cantidad string, linea int").withColumn("linea", F.col("linea").cast(kind))
    want = {}
    for v, p, f, q, n in rows:
        q = max(float(q or 0), 0.0)
        place = ((n is not None, n or 0), f, q)
        want[v] = min(want.get(v, place), place)
    for order in (df, df.orderBy(F.desc("cantidad")), df.repartition(5)):
        got = cleaning.clean(order, ["linea"]).collect()
        assert {r["id_venta"]: ((r["linea"] is not None, int(float(r["linea"] or 0))), str(r["fecha"]), r["cantidad"]) for r in got} == want
    two = spark.createDataFrame([(1, 1, "2026-01-01", "900000000000", 1), (1, 1, "2026-01-01", "200000000000", 1)], df.schema.simpleString()[7:-1].replace(":", " ")) \
        if kind == "int" else None
    if two is not None:
        assert [r["cantidad"] for r in cleaning.clean(two, ["linea"]).collect()] == [2e11]


def test_cleaning_counts_come_with_the_pass(spark):
    frame, found = cleaning.clean_observed(raw_rows(spark))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
    assert frame.count() == 4
    assert found.get() == cleaning.cleaning_warnings(raw_rows(spark)).first().asDict()


def test_hot_key_keeps_one_row(spark):
    hot = spark.range(20000).select(F.lit(1).alias("id_venta"), F.lit(1).alias("id_plato"), F.lit("2026-01-01").alias("fecha"),
                                    F.col("id").cast("string").alias("cantidad"))
    assert [r["cantidad"] for r in cleaning.clean(hot).collect()] == [0.0]


def test_descriptive_statistics(make_series):
    r = eda.descriptive(make_series(a=range(1, 11))).first()
    assert tuple(r)[1:] == (5.5, 5.5, 3.0277, 1.0, 10.0, 3.25, 7.75, 4.5)
    assert eda.descriptive(make_series(a=[4])).first()["desviacion_estandar"] == 0.0


def test_outlier_among_constants(make_series):
    values = [5.0] * 20
    values[10] = 500.0
    r = eda.outliers(make_series(a=values)).first()
    assert (r["cantidad"], r["limite_inferior"], r["limite_superior"], r["fechas"]) == (1, 5.0, 5.0, "2026-01-11")


def test_histogram_matches_numpy(make_series):
    rows = eda.histogram(make_series(a=SEED7, b=[3] * 12)).orderBy("serie", "bin").collect()
    got = [r["frecuencia"] for r in rows if r["serie"] == "a"]
    assert got == np.histogram(SEED7, bins=6)[0].tolist()
    assert [r["frecuencia"] for r in rows if r["serie"] == "b"] == np.histogram([3] * 12, bins=3)[0].tolist()


def test_all_weekdays_present(make_series):
    rows = eda.by_weekday(make_series(a=[1, 2])).collect()
    assert len(rows) == 7 and sum(r["n"] for r in rows) == 2
    assert {r["dia_semana"]: r["demanda_total"] for r in rows}["Jueves"] == 1.0


def test_month_gate(make_series):
    assert eda.by_month(make_series(a=range(20))).count() == 0
    assert eda.by_month(make_series(a=range(70))).count() == 3


def test_correlations_match_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 50, 60), rng.normal(size=60)
    df = spark.createDataFrame([("a", int(p), float(q), 1.0) for p, q in zip(x, y)], "g string, p long, q double, r double")
    got = {(r["variable_a"], r["variable_b"]): r["correlacion"] for r in eda.correlations(df, "g", ["p", "q", "r"]).collect()}
    assert got["p", "q"] == got["q", "p"] == round(float(np.corrcoef(x, y)[0, 1]), 4)
    assert got["p", "p"] == 1.0 and got["p", "r"] is None


def test_signature_pinned(spark, day):
    rows = [("a", day(0), 43.21)] + [("a", day(i % 58 + 1), 5.0) for i in range(98)] + [("a", day(59), 10.0)]
    df = spark.createDataFrame(rows, "serie string, fecha date, cantidad double")
    r = series.signature(df, ["serie"]).first()
    assert (r["n_registros"], r["hash_datos"]) == (100, "aa9a94beea06b721")


def test_event_and_weekend_codes(spark):
    dates = [dt.date(2026, 7, 28), dt.date(2026, 8, 15), dt.date(2026, 1, 3), dt.date(2026, 1, 5)]
    df = spark.createDataFrame([(d, 1.0) for d in dates], "fecha date, cantidad double")
    rows = {r["fecha"]: r for r in series.calendar_features(df).collect()}
    assert [rows[d]["evento"] for d in dates] == [2, 1, 0, 0]
    assert rows[dates[2]]["es_finde"] == 1 and rows[dates[3]]["dia_semana"] == 0


def test_correlations_use_complete_pairs_and_leave_constants_null(spark):
    rows = [("a", 1.0, 2.0, 33.33), ("a", 2.0, 4.0, 33.33), ("a", 3.0, 6.0, 33.33), ("a", 10.0, None, 33.33), ("b", 1.0, 1.0, 0.1)]
    frame = spark.createDataFrame(rows, "g string, x double, y double, z double")
    got = {(r["serie"], r["variable_a"], r["variable_b"]): r["correlacion"] for r in eda.correlations(frame, "g", ["x", "y", "z"]).collect()}
    assert got["a", "x", "y"] == got["a", "y", "x"] == 1.0 and got["a", "x", "x"] == 1.0
    assert all(v is None for k, v in got.items() if "z" in k or k[0] == "b")
    far = spark.createDataFrame([("a", 1e9 + i, 1e9 + (i % 7)) for i in range(1000)], "g string, x double, y double")
    value = [r["correlacion"] for r in eda.correlations(far, "g", ["x", "y"]).collect() if r["variable_a"] != r["variable_b"]][0]
    assert value == round(float(np.corrcoef(np.arange(1000), np.arange(1000) % 7)[0, 1]), 4)


def test_parts_by_key_follow_the_size(spark, monkeypatch):
    """Cleaning and counting duplicates: a task holds a bounded number of rows, also where keys lie in very small partitions."""
    from wastelens.operators import common
    monkeypatch.setattr(common, "PART_ROWS", 500)
    n = 6000
    raw = spark.range(n).select(F.col("id").alias("id_venta"), (F.col("id") % 7).alias("id_plato"), F.lit("2026-01-01").alias("fecha"),
                                F.lit("1").alias("cantidad"), (F.col("id") % 3).alias("categoria")).unionByName(
        spark.createDataFrame([(1, 1, "2026-01-01", "2", 1), (None, None, "2026-01-01", "2", None), (None, None, "2026-01-01", "3", None)],
                              "id_venta long, id_plato long, fecha string, cantidad string, categoria long"))
    out = cleaning.clean(raw, size=n)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n + 1 and len(sizes) == 12 and max(sizes) < 1000
    assert tuple(cleaning.cleaning_warnings(raw, n).first()) == (0, 0, 0, 2)
    count = cleaning.duplicate_count(raw, ["categoria"], n)
    assert sorted(map(tuple, count.collect()), key=str) == [(0, 0, 2000), (1, 1, 2001), (2, 0, 2000), (None, 1, 2)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (out, cleaning.cleaning_warnings(raw, n), count):
        assert "12), REPARTITION_BY_NUM" in plan(df)
