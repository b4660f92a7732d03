"""Tree models on daily features, pooled over all series.

One model serves every series: the target is demand relative to the series' own training mean, so
series of any level share the trees and the number of series does not multiply the fits. Folds and candidates are
fitted together by ``forest``; models of single dishes are MLlib's, but for forests over more than ``FOREST_ROWS`` rows.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.models import attention, forest
from wastelens.models.gram import double_array, gram_sums, int_array, solve
from wastelens.operators.series import FEATURES, calendar_features
from wastelens.session import cut_lineage

SEED = 42
MIN_ROWS = 5
DEEPEST = 30  # MLlib's limit
SERIES_CODES = 1 << 31  # series of equal code cannot be told apart by the trees
NODE_MEMORY_MB = 128  # per-task statistics of one group of tree nodes
FOREST_ROWS = 1_000_000  # MLlib visits every row once per tree and level; forests over more rows grow from cells of equal bins


def regressor(kind: str, **hp):
    """A regressor by name; ``hp`` uses the names of the search spaces.

    No ``max_depth`` (None) means MLlib's deepest tree, 30. MLlib bounds the rows of children, not of the node
    that is split: ``min_samples_split`` asks half as many of each child, which no smaller node can give.
    """
    depth = hp.get("max_depth")
    leaf = max(hp.get("min_samples_leaf", 1), -(-hp.get("min_samples_split", 2) // 2), 1)
    if kind == "random_forest":
        subset = {None: "all", "sqrt": "sqrt", "log2": "log2"}[hp.get("max_features")]
        return RandomForestRegressor(
            numTrees=hp.get("n_estimators", 150), maxDepth=min(depth or DEEPEST, DEEPEST) if "max_depth" in hp else 10,
            minInstancesPerNode=leaf, featureSubsetStrategy=subset, seed=SEED,
            maxMemoryInMB=NODE_MEMORY_MB, cacheNodeIds=True)
    if kind == "gradient_boosting":
        return GBTRegressor(
            maxIter=hp.get("n_estimators", 100), stepSize=hp.get("learning_rate", 0.08), maxDepth=depth or 4,
            minInstancesPerNode=leaf, subsamplingRate=hp.get("subsample", 1.0), seed=SEED)
    if kind == "decision_tree":
        return DecisionTreeRegressor(maxDepth=depth or 8, seed=SEED)
    if kind == "regresion_lineal":
        return LinearRegression()
    raise ValueError(f"unknown regressor {kind!r}")


def series_features(train: DataFrame, keys: list[str]) -> DataFrame:
    """Feature rows of a daily history: calendar, codes and the 7-row mean."""
    w = W.partitionBy(*keys).orderBy("fecha").rowsBetween(-6, 0)
    rows = calendar_features(train).withColumn("ventas_7d", F.avg("cantidad").over(w))
    return rows.withColumns({"cat_enc": F.lit(0), "futuro": F.lit(False), "y": F.col("cantidad").cast("double")}).select(
        *keys, "fecha", "futuro", "y", *FEATURES)


def ahead_features(train: DataFrame, heads: DataFrame, keys: list[str], weather: int = 2, event: int = 0) -> DataFrame:
    """Feature rows of the forecast days: constant weather, event and last-week mean."""
    last = W.partitionBy(*keys).orderBy(F.desc("fecha"))
    reference = train.withColumn("r", F.row_number().over(last)).filter("r <= 7").groupBy(*keys).agg(
        F.avg("cantidad").alias("ventas_7d"), F.max("fecha").alias("fin"))
    days = reference.join(heads.select(*keys, "h"), keys).withColumn(
        "fecha", F.explode(F.sequence(F.date_add("fin", 1), F.date_add("fin", F.col("h")))))
    return calendar_features(days).withColumns({
        "clima": F.lit(weather), "evento": F.lit(event), "cat_enc": F.lit(0), "futuro": F.lit(True),
        "y": F.lit(None).cast("double")}).select(*keys, "fecha", "futuro", "y", *FEATURES)


def attended(train: DataFrame, heads: DataFrame, keys: list[str], weather: int = 2, event: int = 0, codes: int = SERIES_CODES) -> DataFrame:
    """Past and future rows with their expanded features, as an array and as a vector, and the relative target.

    Attention works inside one series, where a code is constant; the code of the series (a hash below ``codes``) is a feature of the
    pooled regressor, behind the expanded ones.
    """
    rows = series_features(train, keys).unionByName(ahead_features(train, heads, keys, weather, event))
    code = F.pmod(F.xxhash64(F.lit(SEED), keys[0]), F.lit(codes)).cast("double")
    rows = attention.expanded(rows, keys).withColumn("x", F.concat("x", F.array(code)))
    return rows.select(
        *keys, "fecha", "futuro", "y", "media", "x", array_to_vector("x").alias("features"),
        (F.col("y") / F.when(F.col("media") > 0, F.col("media"))).alias("label"))


def _steps(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    step = F.row_number().over(W.partitionBy(*keys).orderBy("fecha"))
    return rows.withColumn("paso", step).select(*keys, "paso", F.greatest(F.lit(0.0), value * F.col("media")).alias("yhat"))


def _pooled(train: DataFrame, heads: DataFrame, keys: list[str], pool: list[str]) -> DataFrame:
    """Features, written once, with the pool that fits them together and a number for every row."""
    rows = attended(train, heads, keys).drop("features")
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in pool]) if pool else F.lit("")
    return cut_lineage(rows.withColumns({"pool": name, "rid": F.xxhash64(*keys, "fecha")}), "rasgos")


def _past(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("futuro") & F.col("label").isNotNull())


def fit_predict_many(train: DataFrame, heads: DataFrame, keys: list[str], candidates: dict[str, tuple[str, dict]],
                     pool: list[str] | None = None) -> DataFrame:
    """Forecasts of every candidate, ``name: (kind, settings)``, as ``modelo``. One fit per candidate and value of ``pool`` (key
    columns, such as the fold), all in the same jobs; no pool sees rows of another."""
    rows = _pooled(train, heads, keys, pool or [])
    grown = forest.fit(_past(rows), {name: forest.spec(kind, **hp) for name, (kind, hp) in candidates.items()})
    found = forest.predict(rows.filter("futuro"), grown, [*keys, "fecha", "media"]).withColumnRenamed("candidate", "modelo")
    return _steps(found, [*keys, "modelo"], F.col("prediction"))


def fit_predict(train: DataFrame, heads: DataFrame, keys: list[str], kind: str = "random_forest",
                pool: list[str] | None = None, **hp) -> DataFrame:
    """Attention features, then one pooled regressor per value of ``pool``."""
    return fit_predict_many(train, heads, keys, {kind: (kind, hp)}, pool).drop("modelo")


def fit(train: DataFrame, heads: DataFrame, keys: list[str], kind: str = "random_forest", **hp) -> DataFrame:
    """The trees alone, to be stored; ``predict`` with the same history and horizons gives what ``fit_predict`` gives."""
    return forest.fit(_past(_pooled(train, heads, keys, [])), {kind: forest.spec(kind, **hp)})


def predict(trees: DataFrame, train: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast of fitted trees for the days after each history; nothing is refitted."""
    rows = _pooled(train, heads, keys, []).filter("futuro")
    return _steps(forest.predict(rows, trees, [*keys, "fecha", "media"]), keys, F.col("prediction"))


STACK = {"rf": ("random_forest", {"n_estimators": 150, "max_depth": 10}),
         "gbr": ("gradient_boosting", {"n_estimators": 100, "learning_rate": 0.08, "max_depth": 4}),
         "lr": ("regresion_lineal", {}), "dt": ("decision_tree", {"max_depth": 7})}
X_WIDTH = 2 * len(FEATURES) + 1  # scaled, attended, code


def linear_coefficients(rows: DataFrame, ridge: float = 0.0) -> DataFrame:
    """Least squares of the label on the features for every pool: pool, coef (constant first)."""
    x = [F.get("x", F.lit(i)) for i in range(X_WIDTH)]
    sums = gram_sums(rows, ["pool"], [F.lit(1.0), *x, F.col("label")])
    fitted = solve("gram", int_array(range(X_WIDTH + 1)), double_array([0.0, *[ridge] * X_WIDTH]))
    return sums.select("pool", fitted.alias("f")).select("pool", "f.coef")


def stacked(train: DataFrame, heads: DataFrame, keys: list[str], folds: int = 5, stack=None,
            ridge: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Four regressors combined by a ridge meta-learner that is fitted on out-of-fold predictions
    (contiguous blocks of each series). Returns (predictions, meta weights).

    Scaling and attention are part of the features and see a series' whole training history, also where a
    block of it is predicted out of fold. Every block, and the whole history, is a pool; all are fitted together."""
    stack = stack or STACK
    names, whole = list(stack), "todo"
    rows = _pooled(train, heads, keys, [])
    position = F.row_number().over(W.partitionBy(*keys).orderBy("fecha")) - 1
    block = F.floor(position * folds / F.count("*").over(W.partitionBy(*keys))).cast("int").cast("string")
    past = cut_lineage(_past(rows).withColumn("bloque", block), "bloques")
    pools = F.filter(F.array(*[F.lit(str(f)) for f in range(folds)], F.lit(whole)), lambda p: p != F.col("bloque"))
    fit_on = past.withColumn("pool", F.explode(pools))
    apply_to = past.withColumn("pool", F.col("bloque")).drop("bloque").unionByName(rows.filter("futuro").withColumn("pool", F.lit(whole)))
    carried = [*keys, "fecha", "futuro", "pool", "label", "media"]
    trees = {n: forest.spec(kind, **hp) for n, (kind, hp) in stack.items() if kind != "regresion_lineal"}
    long = forest.predict(apply_to, forest.fit(fit_on, trees), carried) if trees else None
    if len(trees) < len(stack):
        line = apply_to.join(linear_coefficients(fit_on).withColumnRenamed("pool", "_p"), F.col("pool") == F.col("_p"))
        terms = F.zip_with("x", F.slice("coef", 2, X_WIDTH), lambda x, c: x * c)
        value = F.get("coef", F.lit(0)) + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
        for name in (n for n in names if n not in trees):
            part = line.select(*carried, F.lit(name).alias("candidate"), value.alias("prediction"))
            long = part if long is None else long.unionByName(part)
    at = lambda n: F.greatest(F.lit(0.0), F.max(F.when(F.col("candidate") == n, F.col("prediction"))))
    wide = cut_lineage(long.groupBy(*carried).agg(*[at(n).alias(n) for n in names]), "pila")
    sums = gram_sums(wide.filter("NOT futuro").withColumn("todo", F.lit(1)), ["todo"], [F.lit(1.0), *[F.col(n) for n in names], F.col("label")])
    width = len(names) + 1
    meta = sums.withColumn("fit", solve("gram", int_array(range(width)), double_array([0.0, *[ridge] * len(names)]))).select(
        F.col("fit.coef").alias("c"))
    weight = meta.scalar()
    value = F.get(weight, F.lit(0))
    for i, n in enumerate(names):
        value = value + F.get(weight, F.lit(i + 1)) * F.col(n)
    weights = meta.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("modelo"), F.get("c", F.lit(i + 1)).alias("peso")) for i, n in enumerate(names)])).alias("p")).select("p.*")
    return _steps(wide.filter("futuro"), keys, value), weights


def importances(model, names: list[str] = FEATURES) -> list[tuple[str, float]]:
    """Importance of the original features of a fitted tree model (bounded by its feature list)."""
    values = model.featureImportances.toArray()
    return [(n, float(values[i])) for i, n in enumerate(names)]


def assembled(features: DataFrame) -> DataFrame:
    """Dish-level demand rows with the eight features as a vector."""
    filled = features.fillna(0, subset=FEATURES)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled).withColumn("label", F.col("cantidad").cast("double"))


def hash_split(rows: DataFrame, columns: list[str], test_pct: int = 20) -> DataFrame:
    """Random 80/20 assignment from the row's own key: the same on every run and cluster."""
    return rows.withColumn("es_test", F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(100)) < test_pct)


def feature_array() -> Column:
    """What ``assembled`` puts into the vector."""
    return F.array(*[F.col(c).cast("double") for c in FEATURES])


class CellForest:
    """A forest grown from cells, used as a fitted MLlib model is, on rows with the eight features; the driver holds its trees, as it does MLlib's."""

    def __init__(self, trees: DataFrame):
        self.trees = trees

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", forest.scorer(self.trees.collect())(feature_array()))

    @property
    def featureImportances(self):  # noqa: N802, MLlib's name
        found = {r["feature"]: r["importance"] for r in forest.importances(self.trees).collect()}
        return Vectors.dense([found.get(i, 0.0) for i in range(len(FEATURES))])


def fit_single(train: DataFrame, kind: str, **hp):
    """The fitted regressor. A forest over more than ``FOREST_ROWS`` rows grows from cells unless these are too many for a task
    (``forest.LOCAL_CELLS``): the same trees, depth, bins, bagging and bounds as MLlib's, with draws that do not depend on partitions."""
    if kind == "random_forest" and train.count() > FOREST_ROWS:
        rid = F.xxhash64(F.lit(SEED), "fecha", "id_plato", "label", *FEATURES)
        rows = train.select(F.lit("").alias("pool"), rid.alias("rid"), "label", feature_array().alias("x"))
        grown = forest.fit_cells(rows, forest.spec(kind, **hp))
        if grown is not None:
            return CellForest(grown)
    return regressor(kind, **hp).fit(train)


def train_single(features: DataFrame, kind: str = "random_forest", **hp):
    """One pooled model on dish-level rows; returns (model, test rows with ``y`` and ``yhat``)."""
    hp = hp or {"random_forest": {"n_estimators": 100, "max_depth": 10}}.get(kind, {})
    rows = hash_split(assembled(features), ["fecha", "id_plato"])
    model = fit_single(rows.filter(~F.col("es_test")), kind, **hp)
    scored = model.transform(rows.filter("es_test")).select(
        F.lit(kind).alias("modelo"), "id_plato", "fecha", F.col("label").alias("y"), F.col("prediction").alias("yhat"),
        F.lit(None).cast("double").alias("previo"))
    return model, scored


def forecast_dishes(model, future: DataFrame, kind: str) -> DataFrame:
    """Forecast rows of every dish for its future feature rows."""
    filled = future.fillna(0, subset=FEATURES)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled)
    return model.transform(vector).select(
        F.lit(kind).alias("modelo"), "id_plato", "fecha", F.greatest(F.lit(0.0), F.col("prediction")).alias("yhat"))
