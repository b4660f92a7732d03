"""The tree learner against MLlib, against a plain recursion, and wide growth against local growth."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from wastelens.models import forest


def table(spark, n=400, pools=("a",), seed=3, levels=20):
    rng, rows = np.random.default_rng(seed), []
    for pool in pools:
        x = rng.integers(0, levels, (n, 4)).astype(float)
        y = 3 * x[:, 0] + np.where(x[:, 1] > 9, 25, 0) * (x[:, 2] < 5) + rng.normal(0, 1, n)
        rows += [(pool, i, float(v), [float(a) for a in r]) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "pool string, rid long, label double, x array<double>")


def predicted(rows, trees, carried=("pool", "rid")):
    return {(r["candidate"], r["pool"], r["rid"]): r["prediction"] for r in forest.predict(rows, trees, list(carried)).collect()}


def test_tree_and_boosting_equal_mllib(spark):
    rows = table(spark)
    vectors = rows.withColumn("features", array_to_vector("x")).repartition(1).cache()
    specs = {"dt": forest.spec("decision_tree", max_depth=5), "gb": forest.spec("gradient_boosting", n_estimators=6, max_depth=3, learning_rate=0.1)}
    got = predicted(rows, forest.fit(rows, specs))
    for name, model in (("dt", DecisionTreeRegressor(maxDepth=5)), ("gb", GBTRegressor(maxIter=6, maxDepth=3, stepSize=0.1))):
        for r in model.fit(vectors).transform(vectors).collect():
            assert got[name, "a", r["rid"]] == pytest.approx(r["prediction"], abs=1e-6)
    vectors.unpersist()


@pytest.mark.parametrize("kind, hp", [
    ("random_forest", {"n_estimators": 3, "max_depth": 6}), ("random_forest", {"n_estimators": 2, "max_depth": 5, "max_features": "sqrt", "min_samples_leaf": 4}),
    ("decision_tree", {"max_depth": 5}), ("gradient_boosting", {"n_estimators": 3, "max_depth": 3, "subsample": 0.7})])
def test_wide_growth_equals_local_growth(spark, kind, hp):
    rows, specs = table(spark, pools=("a", "b")), {"m": forest.spec(kind, **hp)}
    local, wide = (predicted(rows.repartition(p), forest.fit(rows.repartition(p), specs, n)) for p, n in ((2, 10_000), (5, 60)))
    assert set(local) == set(wide) and len(local) == 800
    assert [wide[k] for k in sorted(wide)] == pytest.approx([local[k] for k in sorted(wide)], abs=1e-9)


def test_a_forest_learns_and_repeats_itself(spark):
    rows = table(spark, 600, ("a", "b"), levels=1000)
    specs = {"f": forest.spec("random_forest", n_estimators=20, max_depth=8), "g": forest.spec("gradient_boosting", n_estimators=30)}
    trees = forest.fit(rows, specs)
    got = predicted(rows, trees)
    assert got == predicted(rows, forest.fit(rows.repartition(7), specs))
    label = {(r["pool"], r["rid"]): r["label"] for r in rows.collect()}
    spread = np.std(list(label.values()))
    for name in "fg":
        assert np.mean([abs(v - label[k[1:]]) for k, v in got.items() if k[0] == name]) < 0.2 * spread
    assert trees.groupBy("candidate", "pool").count().filter("count = CASE candidate WHEN 'f' THEN 20 ELSE 30 END").count() == 4
    share = {(r["candidate"], r["pool"], r["feature"]): r["importance"] for r in forest.importances(trees).collect()}
    assert sum(v for k, v in share.items() if k[:2] == ("f", "a")) == pytest.approx(1.0) and share["f", "a", 0] > 0.5


def test_edge_cases(spark):
    constant = spark.createDataFrame([("a", i, 5.0, [1.0, 2.0]) for i in range(9)], "pool string, rid long, label double, x array<double>")
    specs = {"f": forest.spec("random_forest", n_estimators=3, max_depth=None), "g": forest.spec("gradient_boosting", n_estimators=3)}
    assert set(predicted(constant, forest.fit(constant, specs)).values()) == {5.0}
    one = constant.limit(1)
    assert len(predicted(one, forest.fit(one, {"t": forest.spec("decision_tree")}))) == 1
    empty = constant.limit(0)
    assert forest.fit(empty, specs).count() == 0 and predicted(empty, forest.fit(constant, specs)) == {}
    with pytest.raises(ValueError):
        forest.spec("bosque")


def test_no_row_is_grouped_beyond_the_bound(spark):
    """Wide sets: groups of the local step hold at most local_rows rows."""
    rows = table(spark, 500)
    trees = forest.fit(rows, {"m": forest.spec("decision_tree", max_depth=4)}, 100)
    assert trees.select(F.size("value")).first()[0] > 7


@pytest.mark.parametrize("hp", [{"n_estimators": 4, "max_depth": 6}, {"n_estimators": 3, "max_depth": 5, "max_features": "sqrt", "min_samples_leaf": 4}])
def test_cells_give_the_trees_of_their_rows(spark, monkeypatch, hp):
    """Equal rows summed before growth: the same forest, also where a cell that is found often is spread over parts and chunks."""
    rows, s = table(spark, 500, levels=3).filter("x[3] < 2 OR rid % 5 > 0"), forest.spec("random_forest", **hp)
    want = predicted(rows, forest.fit(rows, {"m": s}))
    for part_rows, partitions in ((250_000, 3), (7, 2)):
        monkeypatch.setattr(forest, "PART_ROWS", part_rows)
        grown = forest.fit_cells(rows.repartition(partitions), s)
        assert grown.count() == hp["n_estimators"]
        got = {r["rid"]: r["p"] for r in rows.select("rid", forest.scorer(grown.collect())(F.col("x")).alias("p")).collect()}
        assert sorted(got) == sorted(k[2] for k in want)
        assert [got[k[2]] for k in want] == pytest.approx(list(want.values()), abs=1e-9)
    assert forest.fit_cells(rows, s, rows.select("x").distinct().count() - 1) is None


def test_cells_of_odd_rows(spark):
    rows, s = table(spark, 40, levels=3), forest.spec("random_forest", n_estimators=3, max_depth=4)
    assert forest.fit_cells(rows.limit(0), s).count() == 0
    constant = rows.withColumns({"label": F.lit(5.0), "x": F.array(F.lit(1.0), F.lit(2.0))})
    assert {r[0] for r in constant.select(forest.scorer(forest.fit_cells(constant, s).collect())(F.col("x"))).collect()} == {5.0}
    with pytest.raises(Exception, match="labels must not be null"):
        forest.fit_cells(rows.withColumn("label", F.when(F.col("rid") > 3, F.col("label"))), s)
    with pytest.raises(ValueError):
        forest.fit_cells(rows, forest.spec("gradient_boosting"))


def test_edges_at_quantiles_part_the_rows_equally(spark):
    rows = spark.range(6400).select(F.lit("").alias("pool"), F.array(F.pow(F.col("id").cast("double"), F.lit(3)), (F.col("id") % 3).cast("double")).alias("x"))
    many, few = forest.edges(rows, at_quantiles=True)[""]
    share = np.bincount(np.searchsorted(many, np.arange(6400.0) ** 3, side="left"), minlength=forest.BINS)
    assert len(share) == forest.BINS and abs(share - 200).max() <= 5 and few.tolist() == [0.5, 1.5]
