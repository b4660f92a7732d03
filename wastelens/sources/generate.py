"""Synthetic sales history for given restaurants and dishes.

Every value is integer arithmetic on its own key, so the data is the same on any cluster and any
partitioning, and rows are made where they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.functions import constants as K

PAYMENTS = ["efectivo", "yape", "tarjeta", "plin"]
HOURS = [12, 13, 14, 19, 20, 21]
MODULUS = 1_000_003
BLOCK = 4096  # dishes of a restaurant that are numbered together


def draw(salt: int, *keys: Column) -> Column:
    """A pseudo-random integer in [0, MODULUS) of the keys."""
    value = F.lit(salt).cast("long")
    for k in keys:
        value = F.pmod(value * 7919 + k.cast("long") * 104729 + 17, F.lit(MODULUS))
    return value


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def days(restaurants: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Every restaurant and day of the ``n`` days before ``as_of``."""
    span = F.explode(F.sequence(F.date_sub(as_of, n), F.date_sub(as_of, 1)))
    return restaurants.select("id_restaurante", span.alias("fecha")).withColumn("dia", F.unix_date("fecha"))


def tickets(restaurants: DataFrame, as_of: Column, n: int = 90) -> DataFrame:
    """15-35 tickets on weekend days, 8-20 on others."""
    rest, day = F.col("id_restaurante"), F.col("dia")
    count = F.when(F.weekday("fecha") >= 5, 15 + F.pmod(draw(1, rest, day), F.lit(21))).otherwise(8 + F.pmod(draw(1, rest, day), F.lit(13)))
    rows = days(restaurants, as_of, n).withColumn("ticket", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    pick = draw(2, rest, day, F.col("ticket"))
    return rows.select(
        "id_restaurante", "fecha", "dia", "ticket", _pick(PAYMENTS, pick).alias("metodo_pago"),
        F.format_string("%02d:%02d:%02d", _pick(HOURS, pick), F.pmod(pick, F.lit(60)), F.pmod(F.floor(pick / 60), F.lit(60))).alias("hora"))


def numbered(dishes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every dish with its position in its restaurant by id, from 0, and the restaurant's number of dishes.

    The range of a restaurant's ids is cut into about one piece per ``block`` dishes. A position is the number of dishes in earlier
    pieces plus the place within the piece, so no window runs over all dishes of a restaurant."""
    rest, piece = W.partitionBy("id_restaurante"), W.partitionBy("id_restaurante", "_pieza")
    rows = dishes.select("id_restaurante", "id_plato", "precio_venta", "costo_estimado")
    span = rows.groupBy("id_restaurante").agg(
        F.count("*").alias("platos"), F.min("id_plato").alias("_lo"), F.max("id_plato").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("platos") / block)
    rows = rows.join(span, "id_restaurante").withColumn(
        "_pieza", F.coalesce(F.floor((F.col("id_plato") - F.col("_lo")) / width), F.lit(0))).drop("_lo", "_hi")
    sizes = rows.groupBy("id_restaurante", "_pieza").agg(F.count("*").alias("_n"))
    before = sizes.select("id_restaurante", "_pieza", (F.sum("_n").over(rest.orderBy("_pieza")) - F.col("_n")).alias("_antes"))
    rows = rows.withColumn("_puesto", F.row_number().over(piece.orderBy("id_plato")) - 1)
    return rows.join(before, ["id_restaurante", "_pieza"]).select(
        "id_restaurante", "id_plato", "precio_venta", "costo_estimado", (F.col("_antes") + F.col("_puesto")).alias("puesto"), "platos")


def ticket_lines(heads: DataFrame, dishes: DataFrame) -> DataFrame:
    """1-4 lines per ticket, 1-3 units each, of a dish of the same restaurant."""
    menu = numbered(dishes)
    size = dishes.groupBy("id_restaurante").agg(F.count("*").alias("platos"))
    key = [F.col(c) for c in ("id_restaurante", "dia", "ticket")]
    lines = heads.join(size, "id_restaurante").withColumn(
        "linea", F.explode(F.sequence(F.lit(1), (1 + F.pmod(draw(3, *key), F.lit(4))).cast("int"))))
    chosen = draw(4, *key, F.col("linea"))
    lines = lines.withColumns({"puesto": F.pmod(chosen, F.col("platos")), "cantidad": 1 + F.pmod(draw(5, *key, F.col("linea")), F.lit(3))})
    return lines.join(menu.drop("platos"), ["id_restaurante", "puesto"]).select(
        "id_restaurante", "fecha", "ticket", "linea", "id_plato", "cantidad",
        (F.col("precio_venta") * F.col("cantidad")).cast("decimal(12,2)").alias("subtotal"))


def production(restaurants: DataFrame, dishes: DataFrame, as_of: Column, n: int = 90) -> DataFrame:
    """A production row on about 60 % of the days of every restaurant: 15-40 made, 60-100 % sold."""
    menu = numbered(dishes)
    size = dishes.groupBy("id_restaurante").agg(F.count("*").alias("platos"))
    rest, day = F.col("id_restaurante"), F.col("dia")
    made = 15 + F.pmod(draw(7, rest, day), F.lit(26))
    rows = days(restaurants, as_of, n).filter(F.pmod(draw(6, rest, day), F.lit(10)) < 6).join(size, "id_restaurante")
    rows = rows.withColumns({"puesto": F.pmod(draw(8, rest, day), F.col("platos")), "preparada": made})
    low = F.floor(F.col("preparada") * 6 / 10)
    sold = low + F.pmod(draw(9, rest, day), F.col("preparada") - low + 1)
    return rows.withColumn("vendida", sold.cast("long")).join(menu.drop("platos"), ["id_restaurante", "puesto"]).select(
        "id_restaurante", "fecha", "dia", "id_plato", "preparada", "vendida",
        (F.col("preparada") - F.col("vendida")).alias("sobrante"), "costo_estimado")


def waste(produced: DataFrame) -> DataFrame:
    """A waste row where more than 15 % of the production was left over."""
    reason = _pick(K.REASONS, draw(10, F.col("id_restaurante"), F.col("dia")))
    return produced.filter(F.col("sobrante") * 100 > F.col("preparada") * 15).select(
        "id_restaurante", "fecha", "id_plato", F.lit("plato").alias("tipo"), F.col("sobrante").alias("cantidad"),
        F.lit("porción").alias("unidad_medida"), reason.alias("motivo"),
        (F.col("sobrante") * F.col("costo_estimado")).cast("double").alias("costo_estimado"))
