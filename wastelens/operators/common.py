"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Period = Callable[[DataFrame], DataFrame]
PART_ROWS = 250_000  # rows that one task aggregates by a key that hardly repeats


def everything(df: DataFrame) -> DataFrame:
    return df


def total(c: str | Column) -> Column:
    """Empty-safe sum as double. Decimal and integer columns are summed exactly first."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def total_long(c: str | Column) -> Column:
    return F.coalesce(F.sum(c).cast("long"), F.lit(0).cast("long"))


def one_row(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """Put several one-row aggregates side by side, as scalar subqueries of a single row."""
    names = [(i, c) for i, f in enumerate(frames) for c in f.columns]
    base = spark.range(1).select(
        *[f.select(F.struct(*f.columns).alias("s")).scalar().alias(f"s{i}") for i, f in enumerate(frames)]
    )
    return base.select(*[F.col(f"s{i}.{c}").alias(c) for i, c in names])


def dated_lines(wh, period: Period = everything) -> DataFrame:
    """Ticket lines with their date. The date filter is applied to the tickets before the join,
    or to the lines themselves where the stored layout already carries the date."""
    lines = wh.detalle_ventas
    if "fecha" in lines.columns:
        return period(lines)
    return lines.join(period(wh.ventas).select("id_venta", "fecha"), "id_venta")


def join_known(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join of facts to a dimension. Rows without a key can match nothing, so they pass by the join: however many they are, they
    are neither shuffled nor gathered under one key. The price is a second scan of the facts, with the null test pushed down."""
    passed = rows.filter(F.col(key).isNull()).select("*", *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name != key])
    known = rows.filter(F.col(key).isNotNull()).join(other, key, "left")
    return known.select(*passed.columns).union(passed)


def in_parts(rows: DataFrame, key: list[str], size: int | None = None) -> DataFrame:
    """Rows by key in parts of about ``PART_ROWS`` of ``size`` rows, or as many as the session's shuffles have. An aggregation by
    the key then keeps the part's rows in memory however large the table; partitions that are sized by their compressed bytes hold millions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size is None else max(1, -(-size // PART_ROWS))
    return rows.repartition(parts, *key)


def units_by_dish(wh, period: Period = everything) -> DataFrame:
    """Units and revenue per dish: combined map-side, one row per dish after the shuffle."""
    return (
        dated_lines(wh, period)
        .groupBy("id_plato")
        .agg(F.sum("cantidad").alias("vendidos"), F.sum("subtotal").alias("ingreso"))
    )


def units_by_name(wh, period: Period = everything) -> DataFrame:
    """As above per dish *name*: equal names of several restaurants merge, unknown ids drop out."""
    return (
        units_by_dish(wh, period)
        .join(wh.platos.select("id_plato", "nombre"), "id_plato")
        .groupBy("nombre")
        .agg(
            F.sum("vendidos").cast("long").alias("vendidos"),
            F.sum("ingreso").cast("double").alias("ingreso"),
        )
    )


def joined_text(df: DataFrame, order: list[Column], text: Column, default: str = "Sin datos") -> DataFrame:
    """One row with the texts of a *bounded* (top-k) frame joined in order."""
    items = F.sort_array(F.collect_list(F.struct(*order, text.alias("texto"))))
    text = F.array_join(F.transform(items, lambda s: s["texto"]), ", ")
    return df.agg(F.when(text == "", F.lit(default)).otherwise(text).alias("texto"))
