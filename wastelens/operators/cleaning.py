"""Validation and cleaning of raw transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wastelens.functions.scalar import parse_date, parse_number
from wastelens.operators.common import in_parts

TRANSACTION_KEY = ["id_venta", "id_plato"]
DAILY_KEY = ["fecha", "id_plato"]


def natural_key(df: DataFrame) -> list[str]:
    """(ticket, dish) for transactions, (date, dish) for rows already aggregated by day."""
    return TRANSACTION_KEY if set(TRANSACTION_KEY) <= set(df.columns) else [c for c in DAILY_KEY if c in df.columns]


def parsed(raw: DataFrame) -> DataFrame:
    """Typed rows with the repairs flagged. Unparseable dates and quantities become null."""
    return (
        raw.withColumn("fecha", parse_date(F.col("fecha"))).withColumn("q", parse_number(F.col("cantidad")))
        .withColumns({"fecha_invalida": F.col("fecha").isNull(), "nulo": F.col("q").isNull(), "negativo": F.coalesce(F.col("q") < 0, F.lit(False))})
        .withColumn("cantidad", F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(0.0))).drop("q")
    )


def clean(raw: DataFrame, tie_break: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Drop undated rows, impute missing and negative quantities with 0, keep the first row of a key.

    "First" is the smallest (tie-break columns, then date and quantity, then the rest; nulls first), compared as values of their own type, so
    it does not depend on row order. ``size`` is about how many rows there are; their parts follow it.
    """
    return _first(parsed(raw), tie_break, size)


def _first(rows: DataFrame, tie_break: list[str] | None, size: int | None) -> DataFrame:
    rows = rows.filter(~F.col("fecha_invalida")).drop("fecha_invalida", "nulo", "negativo")
    key = natural_key(rows)
    rest = [c for c in (tie_break or []) if c not in key]
    rest += [c for c in ("fecha", "cantidad") if c not in key + rest]
    rest += [c for c in rows.columns if c not in key + rest]
    return smallest(in_parts(rows, key, size), key, rest).select(*rows.columns)


def smallest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The smallest row of every key by ``order``, which names all other columns; nulls come first.

    One column is decided after the other, from the last on: the smallest value of a column among rows that agree in all
    columns before it, and what belongs to that value. Every step is a hash aggregation, whatever the types of
    the columns, so raw rows are never sorted; where they do not lie by key yet, a key repeated very often moves as one row a task.
    """
    if not order:
        return rows.select(*key).distinct()
    for i in range(len(order) - 1, -1, -1):
        column, later = order[i], order[i + 1:]
        by = [*key, *order[:i]]
        # a null is the smallest: where one was seen its row counts, else the row of the minimum
        rows = rows.groupBy(*by).agg(
            F.min(column).alias(column), F.max(F.col(column).isNull()).alias("_nulo"),
            *[F.min_by(c, column).alias(c) for c in later],
            *[F.max(F.when(F.col(column).isNull(), F.col(c))).alias(f"_{c}") for c in later])
        rows = rows.select(
            *by, F.when(~F.col("_nulo"), F.col(column)).alias(column),
            *[F.when(F.col("_nulo"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in later])
    return rows


class Repairs:
    """Counts that the cleaning pass takes along; known after an action on the cleaned frame."""

    def __init__(self) -> None:
        self.read, self.kept = Observation(), Observation()

    def get(self) -> dict[str, int]:
        read, kept = self.read.get, self.kept.get
        return {"fechas_invalidas": read["i"], "cantidades_nulas": read["n"], "cantidades_negativas": read["g"],
                "duplicados": read["v"] - kept["k"]}


def clean_observed(raw: DataFrame, tie_break: list[str] | None = None, size: int | None = None) -> tuple[DataFrame, Repairs]:
    """``clean``, and the counts of ``cleaning_warnings`` from the same pass: the facts are scanned and shuffled once."""
    found, valid = Repairs(), ~F.col("fecha_invalida")
    rows = parsed(raw).observe(
        found.read, F.count(F.when(~valid, 1)).alias("i"), F.count(F.when(valid, 1)).alias("v"),
        F.count(F.when(valid & F.col("nulo"), 1)).alias("n"), F.count(F.when(valid & F.col("negativo"), 1)).alias("g"))
    return _first(rows, tie_break, size).observe(found.kept, F.count(F.lit(1)).alias("k")), found


def cleaning_warnings(raw: DataFrame, size: int | None = None) -> DataFrame:
    """How many rows each repair touched, one row. ``size`` is about how many rows there are; their parts follow it."""
    rows = parsed(raw)
    key = natural_key(rows)
    rows = in_parts(rows.select(*key, "fecha_invalida", "nulo", "negativo"), key, size)
    valid = ~F.col("fecha_invalida")
    per_key = rows.groupBy(*key).agg(
        F.count(F.when(~valid, 1)).alias("i"), F.count(F.when(valid, 1)).alias("v"),
        F.count(F.when(valid & F.col("nulo"), 1)).alias("n"), F.count(F.when(valid & F.col("negativo"), 1)).alias("g"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return per_key.agg(
        total("i", "fechas_invalidas"), total("n", "cantidades_nulas"), total("g", "cantidades_negativas"),
        total(F.greatest(F.col("v") - 1, F.lit(0)), "duplicados"))


def duplicate_count(df: DataFrame, by: list[str], size: int | None = None) -> DataFrame:
    """Rows beyond the first of their natural key, per group. ``size`` is about how many rows there are; their parts follow it."""
    key = natural_key(df)
    rows = in_parts(df.select(*dict.fromkeys([*by, *key])), key, size)
    per_key = rows.groupBy(*by, *key).agg(F.count("*").alias("n"))
    return per_key.groupBy(*by).agg(F.sum(F.col("n") - 1).cast("long").alias("duplicados"), F.sum("n").cast("long").alias("filas"))


def null_counts(df: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """Nulls per column (all but the group's, if none are named) and group, long form, one pass."""
    columns = columns or [c for c in df.columns if c not in by]
    counted = df.groupBy(*by).agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counted.unpivot(by, columns, "columna", "nulos")


def raw_transactions(wh) -> DataFrame:
    """The ticket lines in the text form of an import, with the defects of their source values:
    some quantities are missing, not numbers or negative, some dates are not dates."""
    q = F.col("cantidad")
    lines = wh.detalle_ventas.join(wh.ventas.select("id_venta", "fecha"), "id_venta")
    return lines.select(
        "id_venta", "id_plato", "linea",
        F.when(q == 23, "sin fecha").otherwise(F.col("fecha").cast("string")).alias("fecha"),
        F.when(q == 13, F.lit(None)).when(q == 17, "x").otherwise((q - 2).cast("string")).alias("cantidad"))
