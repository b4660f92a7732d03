"""Daily demand series, features and chronological splits, for all series at once.

A series frame has the columns ``serie, fecha, cantidad``. Facts are summed per (series, day)
before any window, so the partition of a window is bounded by the days of the calendar however
many transactions one series holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.functions import scalar as S
from wastelens.operators.common import dated_lines, everything

LAGS = (1, 7, 14)
MEANS = (7, 14)
FEATURES = ["dia_semana", "mes", "dia_mes", "es_finde", "clima", "evento", "cat_enc", "ventas_7d"]


def _order():
    return W.partitionBy("serie").orderBy("fecha")


def _whole():
    return W.partitionBy("serie")


def daily_demand(wh, period=everything, keep_null_category: bool = False) -> DataFrame:
    """Units per (date, dish) with category and price."""
    units = dated_lines(wh, period).groupBy("fecha", "id_plato").agg(F.sum("cantidad").cast("long").alias("cantidad"))
    dishes = wh.platos if keep_null_category else wh.platos.filter("categoria IS NOT NULL")
    return units.join(
        dishes.select("id_plato", "categoria", F.col("precio_venta").cast("double").alias("precio")), "id_plato"
    ).select("fecha", "id_plato", "categoria", "cantidad", "precio")


def daily_series(wh, key: str = "categoria", period=everything) -> DataFrame:
    """Units per (series, date); ``key`` is any column of the dishes."""
    if key == "id_plato":
        lines = dated_lines(wh, period).withColumn("serie", F.col("id_plato").cast("string"))
        return lines.groupBy("serie", "fecha").agg(F.sum("cantidad").cast("double").alias("cantidad"))
    by_dish = dated_lines(wh, period).groupBy("fecha", "id_plato").agg(F.sum("cantidad").alias("q"))
    return (
        by_dish.join(wh.platos.select("id_plato", F.col(key).cast("string").alias("serie")), "id_plato")
        .groupBy("serie", "fecha").agg(F.sum("q").cast("double").alias("cantidad"))
    )


def continuous(series: DataFrame) -> DataFrame:
    """One row for every day from the first to the last of each series; gaps by linear interpolation.

    Every observed row emits the days up to the next observation, so no calendar is joined.
    """
    gap = F.datediff("f1", "fecha")
    days = F.explode(F.sequence(F.col("fecha"), F.coalesce(F.date_sub("f1", 1), F.col("fecha"))))
    offset = F.datediff("dia", "fecha")
    return (
        series.withColumns({"f1": F.lead("fecha").over(_order()), "y1": F.lead("cantidad").over(_order())})
        .select("serie", "fecha", F.col("cantidad").alias("y0"), "y1", gap.alias("gap"), days.alias("dia"))
        .select(
            "serie", F.col("dia").alias("fecha"),
            F.when(offset == 0, F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * offset / F.col("gap")).alias("cantidad"),
            (offset > 0).alias("interpolado"))
    )


def lags_and_means(series: DataFrame, lags=LAGS, means=MEANS) -> DataFrame:
    """Past-only features: row t sees t-1 and earlier."""
    new = {f"lag_{k}": F.lag("cantidad", k).over(_order()) for k in lags}
    new |= {f"media_movil_{w}": F.avg("cantidad").over(_order().rowsBetween(-w, -1)) for w in means}
    return series.withColumns(new)


def trailing_mean(demand: DataFrame, rows: int = 7) -> DataFrame:
    """Mean over the last ``rows`` sale days of a dish, the current one included."""
    w = W.partitionBy("id_plato").orderBy("fecha").rowsBetween(1 - rows, 0)
    return demand.withColumn("ventas_7d", F.avg("cantidad").over(w))


def indexed(series: DataFrame) -> DataFrame:
    """Position ``idx`` (from 1) and length ``n`` of every row's series."""
    return series.withColumns({"idx": F.row_number().over(_order()), "n": F.count("*").over(_whole())})


def split_sizes(n: Column, val_size: float = 0.15, test_size: float = 0.15) -> tuple[Column, Column]:
    """(train, validation) sizes; the rest is test. Half-even rounding, at least one row each."""
    test = F.greatest(F.lit(1), F.bround(n * test_size).cast("int"))
    val = F.greatest(F.lit(1), F.bround(n * val_size).cast("int"))
    train = n - val - test
    small_train = F.greatest(F.lit(1), n - 2)
    small_val = F.greatest(F.lit(0), F.floor((n - small_train) / 2)).cast("int")
    return F.when(train < 1, small_train).otherwise(train), F.when(train < 1, small_val).otherwise(val)


def chronological_split(series: DataFrame, val_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    train, val = split_sizes(F.col("n"), val_size, test_size)
    return indexed(series).withColumn(
        "bloque", F.when(F.col("idx") <= train, "train").when(F.col("idx") <= train + val, "val").otherwise("test"))


def holdout_size(n: Column) -> Column:
    """Train rows of the 80/20 split whose test part is kept between 5 and 20 rows."""
    return F.least(F.greatest(F.floor(n * 0.8), n - 20), n - 5).cast("int")


def holdout_split(series: DataFrame, min_days: int = 30) -> DataFrame:
    """Series of at least ``min_days`` rows with ``n_train`` and the test flag."""
    return indexed(series).filter(F.col("n") >= min_days).withColumn("n_train", holdout_size(F.col("n"))).withColumn(
        "es_test", F.col("idx") > F.col("n_train"))


def tuning_split(series: DataFrame, val_size: float = 0.2) -> DataFrame:
    n = F.col("n")
    val = F.greatest(F.lit(3), F.floor(n * val_size)).cast("int")
    return indexed(series).filter(n - val >= 5).withColumn("n_train", (n - val).cast("int"))


def fold_table(series: DataFrame, k: int = 5) -> DataFrame:
    """Walk-forward folds per series: expanding train, equal validation blocks at the tail.

    The input is a continuous series, so the dates follow from the first date and positions.
    """
    size = series.groupBy("serie").agg(F.count("*").alias("n"), F.min("fecha").alias("inicio"))
    folds = F.least(F.lit(k), F.col("n") - 1).cast("int")
    size = size.withColumn("k", folds).filter("k >= 2").withColumn("bloque", F.floor(F.col("n") / (F.col("k") + 1)).cast("int"))
    at = lambda i: F.date_add("inicio", (i - 1).cast("int"))
    return (
        size.withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("k"))))
        .withColumn("n_train", (F.col("n") - (F.col("k") - F.col("fold") + 1) * F.col("bloque")).cast("int"))
        .select("serie", "fold", "n_train", F.col("bloque").alias("n_val"), "k",
                F.col("inicio").alias("fecha_inicio_train"), at(F.col("n_train")).alias("fecha_fin_train"),
                at(F.col("n_train") + 1).alias("fecha_inicio_val"), at(F.col("n_train") + F.col("bloque")).alias("fecha_fin_val"))
    )


def scaled(split: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scaling with the mean and population deviation of the train block only."""
    train = F.col("bloque") == "train"
    stats, out = {}, {}
    for c in columns:
        value = F.coalesce(F.col(c), F.lit(0.0))
        stats[f"{c}_m"] = F.avg(F.when(train, value)).over(_whole())
        stats[f"{c}_s"] = F.stddev_pop(F.when(train, value)).over(_whole())
        deviation = F.when(F.col(f"{c}_s") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_s"))
        out[f"{c}_esc"] = (value - F.col(f"{c}_m")) / deviation
    return split.withColumns(stats).withColumns(out).drop(*stats)


def scaler_parameters(split: DataFrame, columns: list[str]) -> DataFrame:
    values = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    stats = F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(f"m{i}").alias("media"),
                 F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("escala"))
        for i, c in enumerate(columns)])).alias("p")
    return split.filter("bloque = 'train'").groupBy("serie").agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)],
    ).select("serie", stats).select("serie", "p.*")


def category_codes(dishes: DataFrame) -> DataFrame:
    """Index of every category in the sorted list of categories (the menu's fixed short list)."""
    names = dishes.agg(F.array_sort(F.collect_set(F.col("categoria").cast("string"))).alias("c"))
    return names.select(F.posexplode("c").alias("cat_enc", "categoria"))


def calendar_features(df: DataFrame) -> DataFrame:
    f = F.col("fecha")
    return df.withColumns({
        "dia_semana": S.weekday(f), "mes": F.month(f), "dia_mes": F.dayofmonth(f), "es_finde": S.is_weekend(f),
        "clima": S.weather_code(f), "evento": S.event_code(f)})


def enriched(demand: DataFrame, dishes: DataFrame) -> DataFrame:
    """The eight model features beside every (date, dish) demand row."""
    coded = demand.join(category_codes(dishes), "categoria")
    return trailing_mean(calendar_features(coded))


def future_rows(reference: DataFrame, start: Column, horizon: int, weather: int = 2, event: int = 0) -> DataFrame:
    """Feature rows of the ``horizon`` days after ``start`` for every row of ``reference``
    (which carries ``cat_enc`` and ``ventas_7d``)."""
    days = F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, horizon)))
    f = F.col("fecha")
    return reference.withColumn("fecha", days).withColumns({
        "dia_semana": S.weekday(f), "mes": F.month(f), "dia_mes": F.dayofmonth(f), "es_finde": S.is_weekend(f),
        "clima": F.lit(weather), "evento": F.lit(event)})


def last_week_mean(series: DataFrame, rows: int = 7) -> DataFrame:
    """Mean of the last ``rows`` days of each series."""
    back = F.row_number().over(W.partitionBy("serie").orderBy(F.desc("fecha")))
    return series.withColumn("atras", back).filter(F.col("atras") <= rows).groupBy("serie").agg(
        F.avg("cantidad").alias("ventas_7d"), F.max("fecha").alias("fin"))


def prepared(wh, key: str = "categoria") -> DataFrame:
    """The full preparation of a warehouse's demand."""
    return prepared_rows(daily_series(wh, key))


def prepared_rows(daily: DataFrame) -> DataFrame:
    """Continuous series, past-only features, split, train-only scaling."""
    series = lags_and_means(continuous(daily))
    columns = ["cantidad", *[f"lag_{k}" for k in LAGS], *[f"media_movil_{w}" for w in MEANS]]
    return scaled(chronological_split(series), columns)


def preparation_warnings(series: DataFrame) -> DataFrame:
    """Interpolated days per continuous series."""
    return series.groupBy("serie").agg(
        F.count("*").alias("dias"), F.count(F.when(F.col("interpolado"), 1)).alias("interpolados"))


def signature(lines: DataFrame, by: list[str]) -> DataFrame:
    """Light dataset signature per group: count, first and last date, total quantity."""
    text = F.concat_ws("|", F.col("n").cast("string"), F.col("ini").cast("string"), F.col("fin").cast("string"),
                       F.col("q").cast("decimal(20,2)").cast("string"))
    return lines.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("fecha").alias("ini"), F.max("fecha").alias("fin"), F.sum("cantidad").alias("q")
    ).select(*by, F.col("n").alias("n_registros"), F.substring(F.sha2(text, 256), 1, 16).alias("hash_datos"))
