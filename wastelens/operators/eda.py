"""Exploratory statistics per series."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.functions.scalar import weekday_name
from wastelens.operators import cleaning

CORRELATED = ["cantidad", "precio", "dia_semana", "mes", "es_finde", "clima", "evento", "ventas_7d"]
KNOWN = [c for c in CORRELATED if c != "precio"]  # never null in feature rows


def quartiles(series: DataFrame) -> DataFrame:
    """Exact quartiles and moments; a group holds at most the days of the calendar."""
    return series.groupBy("serie").agg(
        F.count("*").alias("n"), F.avg("cantidad").alias("media"), F.stddev_samp("cantidad").alias("sd"),
        F.min("cantidad").alias("minimo"), F.max("cantidad").alias("maximo"),
        F.expr("percentile(cantidad, array(0.25, 0.5, 0.75))").alias("q"))


def descriptive(series: DataFrame) -> DataFrame:
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    r = lambda c: F.round(c, 4)
    return quartiles(series).select(
        "serie", r(F.col("media")).alias("media"), r(q2).alias("mediana"),
        r(F.when(F.col("n") > 1, F.col("sd")).otherwise(0.0)).alias("desviacion_estandar"),
        r(F.col("minimo")).alias("minimo"), r(F.col("maximo")).alias("maximo"),
        r(q1).alias("q1"), r(q3).alias("q3"), r(q3 - q1).alias("rango_intercuartilico"))


def outliers(series: DataFrame, first: int = 20) -> DataFrame:
    """1.5 IQR outliers: count, bounds and the first dates (a series has at most one row per day)."""
    q1, q3 = F.col("q")[0], F.col("q")[2]
    bounds = quartiles(series).select(
        "serie", (q1 - 1.5 * (q3 - q1)).alias("lo"), (q3 + 1.5 * (q3 - q1)).alias("hi"))
    out = (F.col("cantidad") < F.col("lo")) | (F.col("cantidad") > F.col("hi"))
    return (
        series.join(bounds, "serie").groupBy("serie", "lo", "hi").agg(
            F.count(F.when(out, 1)).alias("cantidad"),
            F.array_sort(F.collect_list(F.when(out, F.col("fecha").cast("string")))).alias("f"))
        .select("serie", "cantidad", F.round("lo", 4).alias("limite_inferior"), F.round("hi", 4).alias("limite_superior"),
                F.array_join(F.slice("f", 1, first), ",").alias("fechas"))
    )


def histogram(series: DataFrame) -> DataFrame:
    """Equal-width histogram, last bin closed, empty bins kept."""
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    edges = (
        series.groupBy("serie").agg(F.count("*").alias("n"), F.min("cantidad").alias("lo"), F.max("cantidad").alias("hi"))
        .select("serie", F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.sqrt(n)))).cast("int").alias("bins"),
                F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"))
    )
    place = F.least(F.floor((F.col("cantidad") - lo) / (hi - lo) * F.col("bins")), F.col("bins") - 1).cast("int")
    counts = series.join(edges, "serie").groupBy("serie", place.alias("bin")).agg(F.count("*").alias("f"))
    edge = lambda i: F.round(lo + (hi - lo) / F.col("bins") * i, 2)
    return (
        edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
        .join(counts, ["serie", "bin"], "left")
        .select("serie", "bin", edge(F.col("bin")).alias("rango_inicio"), edge(F.col("bin") + 1).alias("rango_fin"),
                F.coalesce("f", F.lit(0).cast("long")).alias("frecuencia"))
    )


def by_weekday(series: DataFrame) -> DataFrame:
    """All seven weekdays per series, zero where a weekday has no row."""
    day = F.weekday("fecha")
    values = [F.when(day == i, F.col("cantidad")) for i in range(7)]
    sums = series.groupBy("serie").agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(values)],
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)])
    rows = F.explode(F.array(*[F.struct(
        F.lit(i).alias("indice"), F.coalesce(F.round(f"m{i}", 4), F.lit(0.0)).alias("demanda_promedio"),
        F.coalesce(F.round(f"s{i}", 2), F.lit(0.0)).alias("demanda_total"), F.col(f"n{i}").alias("n")) for i in range(7)]))
    return sums.select("serie", rows.alias("d")).select(
        "serie", weekday_name(F.col("d.indice")).alias("dia_semana"), "d.demanda_promedio", "d.demanda_total", "d.n")


def by_month(series: DataFrame, min_days: int = 60) -> DataFrame:
    """Monthly demand of the series that cover at least ``min_days`` days."""
    w = W.partitionBy("serie")
    monthly = series.groupBy("serie", F.date_format("fecha", "yyyy-MM").alias("mes")).agg(
        F.avg("cantidad").alias("m"), F.sum("cantidad").alias("s"), F.count("*").alias("n"),
        F.min("fecha").alias("a"), F.max("fecha").alias("b"))
    covered = F.datediff(F.max("b").over(w), F.min("a").over(w)) + 1
    return monthly.withColumn("dias", covered).filter(F.col("dias") >= min_days).select(
        "serie", "mes", F.round("m", 4).alias("demanda_promedio"), F.round("s", 2).alias("demanda_total"), "n")


def correlations(rows: DataFrame, by: str, columns: list[str] | None = None, complete: Collection[str] = ()) -> DataFrame:
    """Pearson matrix per group in long form over pairwise complete rows, null where a variable is constant there.

    One pass of built-in aggregates, whose co-moments merge map-side; those of a constant are exactly zero. ``complete`` names
    columns that hold no null: beside one, the other's spread is that of all its rows and is taken once for all such pairs. The diagonal is 1.
    """
    names = columns or CORRELATED
    x = [F.col(c).cast("double") for c in names]
    spreads: dict[str, Column] = {}

    def spread(i: int, j: int) -> Column:
        """Of variable i on the rows where j is known."""
        whole = i == j or names[j] in complete
        name = f"s{i}" if whole else f"s{i}_{j}"
        spreads[name] = F.stddev_pop(x[i] if whole else F.when(x[j].isNotNull(), x[i])).alias(name)
        return F.col(name)

    pairs = {(i, j): spread(i, j) * spread(j, i) for i, j in combinations(range(len(names)), 2)}
    diagonal = [spread(i, i) for i in range(len(names))]
    sums = rows.groupBy(by).agg(*[F.covar_pop(x[i], x[j]).alias(f"r{i}_{j}") for i, j in pairs], *spreads.values())

    def cell(i: int, j: int) -> Column:
        if i == j:
            return F.when(diagonal[i] > 0, F.lit(1.0))
        both = pairs[min(i, j), max(i, j)]
        return F.col(f"r{min(i, j)}_{max(i, j)}") / F.when(both > 0, both)

    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(i, j).alias("r"))
        for i, a in enumerate(names) for j, b in enumerate(names)])
    value = F.round(F.col("c.r"), 4)
    return sums.select(F.col(by).alias("serie"), F.explode(cells).alias("c")).select(
        "serie", F.col("c.a").alias("variable_a"), F.col("c.b").alias("variable_b"), value.alias("correlacion"))


def code_counts(rows: DataFrame, by: str) -> DataFrame:
    """Rows per weather code and per event code, long form."""
    pairs = F.explode(F.array(
        F.struct(F.lit("clima").alias("variable"), F.col("clima").cast("int").alias("codigo"), F.col("n")),
        F.struct(F.lit("evento").alias("variable"), F.col("evento").cast("int").alias("codigo"), F.col("n"))))
    return (
        rows.groupBy(by, "clima", "evento").agg(F.count("*").alias("n"))
        .select(F.col(by).alias("serie"), pairs.alias("p")).groupBy("serie", "p.variable", "p.codigo")
        .agg(F.sum("p.n").cast("long").alias("n"))
    )


def coverage(lines: DataFrame, by: str) -> DataFrame:
    """Transactions, sale days, covered days and date range."""
    per_day = lines.groupBy(by, "fecha").agg(F.count("*").alias("t"))
    return per_day.groupBy(F.col(by).alias("serie")).agg(
        F.sum("t").cast("long").alias("registros_transacciones"), F.count("*").alias("dias_con_venta"),
        (F.datediff(F.max("fecha"), F.min("fecha")) + 1).alias("dias_cubiertos"),
        F.min("fecha").alias("fecha_inicio"), F.max("fecha").alias("fecha_fin"))


def box_positions(series: DataFrame) -> DataFrame:
    """Quartiles as a position (0..100) inside the range, for a box plot."""
    span = F.coalesce(F.nullif(F.col("maximo") - F.col("minimo"), F.lit(0.0)), F.lit(1.0))
    at = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (c - F.col("minimo")) / span * 100)), 4)
    return quartiles(series).select(
        "serie", *[at(F.col("q")[i]).alias(name) for i, name in enumerate(("pos_q1", "pos_mediana", "pos_q3"))])


def bundle(lines: DataFrame, series: DataFrame, by: str) -> DataFrame:
    """Coverage, descriptive statistics and outliers of every series in one row."""
    out = outliers(series).withColumnRenamed("cantidad", "outliers").drop("fechas")
    return coverage(lines, by).join(descriptive(series), "serie").join(out, "serie")


def tall(frame: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """One row per measure: serie, parte, clave, medida, valor (numbers) or texto (anything else)."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    measures = []
    for name in [c for c in frame.columns if c not in ("serie", *keys)]:
        numeric = isinstance(kinds[name], T.NumericType)
        value = F.col(name).cast("double") if numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if numeric else F.col(name).cast("string")
        measures.append(F.struct(F.lit(name).alias("medida"), value.alias("valor"), text.alias("texto")))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return frame.select("serie", F.lit(part).alias("parte"), key.alias("clave"), F.explode(F.array(*measures)).alias("m")).select(
        "serie", "parte", "clave", "m.*")


def complete_bundle(lines: DataFrame, series: DataFrame, features: DataFrame, by: str, size: int | None = None) -> DataFrame:
    """All parts of the exploration as one long table: coverage, quality, statistics, outliers with their dates, weekdays,
    months, histogram, correlations, weather and event codes. ``size`` is about how many lines there are."""
    parts = [
        ("cobertura", coverage(lines, by), []), ("nulos", cleaning.null_counts(lines, [by]).withColumnRenamed(by, "serie"), ["columna"]),
        ("duplicados", cleaning.duplicate_count(lines, [by], size).withColumnRenamed(by, "serie"), []),
        ("descriptivas", descriptive(series), []), ("atipicos", outliers(series), []), ("dia_semana", by_weekday(series), ["dia_semana"]),
        ("mes", by_month(series), ["mes"]), ("histograma", histogram(series), ["bin"]),
        ("correlaciones", correlations(features, by, complete=KNOWN), ["variable_a", "variable_b"]), ("codigos", code_counts(features, by), ["variable", "codigo"])]
    return reduce(DataFrame.unionByName, [tall(frame, name, keys) for name, frame, keys in parts])
