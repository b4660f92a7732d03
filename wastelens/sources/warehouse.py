"""A warehouse is the set of domain frames plus the two clocks.

``as_of`` is the reporting date of sales, production and waste; ``now`` is the instant used by
log-like tables (audit log, alert history). Operators only see this interface.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.asof import AsOf
from wastelens.schemas import FACTS_BY_MONTH, TABLES, conform, empty, evolve, stored_schema

ROWS_PER_FILE = 20_000_000


class Warehouse:
    """Frames given directly, e.g. by a caller that already has them, or by a test."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], as_of: AsOf | None = None,
                 now: AsOf | None = None):
        self.spark = spark
        self._frames = frames
        if as_of is not None:
            self.as_of = as_of
        if now is not None:
            self.now = now

    @cached_property
    def as_of(self) -> AsOf:
        return AsOf.latest(self.ventas, "fecha")

    @cached_property
    def now(self) -> AsOf:
        return AsOf.latest(self.bitacora, "momento")

    def holds(self, name: str) -> bool:
        return name in self._frames or hasattr(type(self), name)

    def table(self, name: str) -> DataFrame:
        """A declared table. One that this warehouse does not hold has no rows; an unknown name is an error."""
        if name not in TABLES:
            raise KeyError(f"unknown table {name!r}")
        if name in self._frames:
            return evolve(self._frames[name], name)
        if hasattr(type(self), name):
            return evolve(getattr(self, name), name)
        return empty(self.spark, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


class ParquetWarehouse(Warehouse):
    """Domain tables stored one directory each; facts partitioned by ``mes``.

    Files are read with the declared schema: columns added later are null in older files, and no
    footer is opened to find that out. ``extra`` names further stored columns of a table as DDL.
    """

    def __init__(self, spark: SparkSession, root: str, as_of: AsOf | None = None, now: AsOf | None = None,
                 tables: list[str] | None = None, extra: dict[str, str] | None = None):
        frames = {}
        for name in tables or list(TABLES):
            more = T.StructType.fromDDL(extra[name]).fields if extra and name in extra else []
            frames[name] = spark.read.schema(T.StructType([*stored_schema(name).fields, *more])).parquet(f"{root}/{name}")
        super().__init__(spark, frames, as_of, now)


class JdbcWarehouse(Warehouse):
    """Domain tables in a relational database, read in parallel by ranges of the numeric key.

    ``bounds[name] = (column, lower, upper)`` splits a table into ``partitions`` range queries;
    tables without bounds are read by one task, so give bounds for every fact.
    """

    def __init__(self, spark: SparkSession, url: str, bounds: dict[str, tuple[str, int, int]],
                 partitions: int = 64, properties: dict[str, str] | None = None,
                 as_of: AsOf | None = None, now: AsOf | None = None, tables: list[str] | None = None):
        frames = {}
        for name in tables or list(TABLES):
            split = {}
            if name in bounds:
                column, low, high = bounds[name]
                split = {"column": column, "lowerBound": low, "upperBound": high, "numPartitions": partitions}
            frames[name] = spark.read.jdbc(url, name, properties=properties or {}, **split)
        super().__init__(spark, frames, as_of, now)


def write_warehouse(wh: Warehouse, root: str, tables: list[str]) -> None:
    """Write domain tables in the layout :class:`ParquetWarehouse` reads.

    Ticket lines get the ticket date and the dish category, so that the demand queries need no
    join with tickets or dishes. Facts are rebalanced by month before the write: small months
    share a writer, and a heavy month is split into as many as its size asks for. A table that
    the warehouse does not hold is an error, so nothing is overwritten with an empty one.
    """
    absent = [name for name in tables if not wh.holds(name)]
    if absent:
        raise KeyError(f"not in this warehouse: {absent}")
    for name in tables:
        df = wh.table(name)
        if name == "detalle_ventas" and "fecha" not in df.columns:
            df = df.join(wh.ventas.select("id_venta", "fecha"), "id_venta")
        if name == "detalle_ventas" and "categoria" not in df.columns:
            df = df.join(wh.platos.select("id_plato", "categoria"), "id_plato", "left")
        df = conform(df.drop("momento") if name not in ("bitacora", "cambios_alerta") else df, name)
        if name in FACTS_BY_MONTH:
            df = df.withColumn("mes", F.date_format("fecha", "yyyy-MM"))
            df = df.hint("rebalance", F.col("mes"))
            df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("mes").parquet(f"{root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
