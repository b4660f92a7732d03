"""Domain frames derived from order / line-item / part / supplier style tables.

Each frame is a lazy projection, so filters and column lists of the operators reach the scan.
Money is cast from the stored column to decimal first and only then multiplied: sums stay exact
whatever the order in which partitions are merged.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.asof import AsOf
from wastelens.functions import constants as K
from wastelens.sources.warehouse import Warehouse


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _money(name: str, kind: str = "decimal(12,2)") -> Column:
    return F.col(name).cast(kind)


class TradeWarehouse(Warehouse):
    def __init__(self, spark: SparkSession, root: str, as_of: AsOf | None = None, now: AsOf | None = None):
        self.root = root
        super().__init__(spark, {}, as_of, now)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def as_of(self) -> AsOf:
        return AsOf.latest(self._read("orders"), F.to_date("o_orderdate"))

    @cached_property
    def now(self) -> AsOf:
        return AsOf.latest(self._read("events"), "ts")

    # ---- dimensions ----
    @cached_property
    def restaurantes(self) -> DataFrame:
        nation, region = self._read("nation"), self._read("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("long").alias("id_restaurante"),
            F.col("n_name").alias("nombre"),
            F.col("r_name").alias("distrito"),
            F.lit(True).alias("estado"),
        )

    @cached_property
    def platos(self) -> DataFrame:
        price = _money("p_retailprice", "decimal(10,2)")
        return self._read("part").select(
            F.col("p_partkey").alias("id_plato"),
            (F.col("p_partkey") % 25).alias("id_restaurante"),
            F.col("p_name").alias("nombre"),
            F.col("p_type").alias("categoria"),
            F.col("p_brand").alias("marca"),
            price.alias("precio_venta"),
            (price * F.lit(0.4).cast("decimal(2,1)")).alias("costo_estimado"),
            (F.col("p_size") > 2).alias("estado"),
        )

    @cached_property
    def insumos(self) -> DataFrame:
        supplier, nation, region = self._read("supplier"), self._read("nation"), self._read("region")
        key = F.col("s_suppkey")
        due = (F.pmod(key, F.lit(31)) - 5).cast("int")
        return (
            supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(
                key.alias("id_insumo"),
                (key % 25).alias("id_restaurante"),
                F.col("s_name").alias("nombre"),
                F.col("r_name").alias("categoria"),
                _pick(K.UNITS[:4], key).alias("unidad_medida"),
                _money("s_acctbal", "decimal(10,3)").alias("stock_disponible"),
                (500 + 100 * (key % 50)).cast("decimal(10,3)").alias("stock_minimo"),
                (1 + key % 20).cast("decimal(10,2)").alias("costo_unitario"),
                F.when(key % 17 != 3, F.date_add(self.as_of.get(), due)).alias("fecha_vencimiento"),
                F.nullif(F.col("n_name"), F.lit("NATION_7")).alias("proveedor"),
                (key % 13 != 0).alias("estado"),
            )
        )

    @cached_property
    def recetas(self) -> DataFrame:
        pairs = self._read("lineitem").select("l_partkey", "l_suppkey").distinct()
        units = (1 + (F.col("l_partkey") + F.col("l_suppkey")) % 5).cast("decimal(9,2)")
        return pairs.select(
            F.col("l_partkey").alias("id_plato"),
            F.col("l_suppkey").alias("id_insumo"),
            (units * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(10,3)").alias("cantidad_usada"),
            F.lit("kg").alias("unidad_medida"),
        )

    # ---- facts ----
    @cached_property
    def ventas(self) -> DataFrame:
        return self._read("orders").select(
            F.col("o_orderkey").alias("id_venta"),
            F.to_date("o_orderdate").alias("fecha"),
            F.col("o_orderdate").alias("momento"),
            F.date_format("o_orderdate", "HH:mm:ss").alias("hora"),
            _money("o_totalprice").alias("total"),
            F.col("o_orderpriority").alias("metodo_pago"),
            F.col("o_custkey").alias("id_cliente"),
        )

    @cached_property
    def clientes(self) -> DataFrame:
        return self._read("customer").select(
            F.col("c_custkey").alias("id_cliente"),
            F.col("c_name").alias("nombre"),
            F.col("c_nationkey").cast("long").alias("id_restaurante"),
        )

    def ventas_por_local(self) -> DataFrame:
        """Tickets with their restaurant; only operators that group by restaurant pay this join."""
        return self.ventas.join(self.clientes.select("id_cliente", "id_restaurante"), "id_cliente")

    @cached_property
    def detalle_ventas(self) -> DataFrame:
        return self._read("lineitem").select(
            F.col("l_orderkey").alias("id_venta"),
            F.col("l_partkey").alias("id_plato"),
            F.col("l_quantity").cast("long").alias("cantidad"),
            _money("l_extendedprice").alias("subtotal"),
            F.col("l_linenumber").alias("linea"),
        )

    @cached_property
    def producciones(self) -> DataFrame:
        left = F.floor(F.col("l_quantity") * F.col("l_discount") * 8).cast("long")
        made = F.col("l_quantity").cast("long")
        return self._read("lineitem").select(
            (F.col("l_suppkey") % 25).alias("id_restaurante"),
            F.col("l_partkey").alias("id_plato"),
            F.to_date("l_shipdate").alias("fecha"),
            F.col("l_shipdate").alias("momento"),
            made.alias("preparada"),
            (made - left).alias("vendida"),
            left.alias("sobrante"),
        )

    @cached_property
    def desperdicios(self) -> DataFrame:
        line = F.col("l_linenumber")
        of_ingredient = line % 3 == 0
        cost = (
            _money("l_extendedprice") * _money("l_discount", "decimal(4,2)") * F.lit(0.02).cast("decimal(4,2)")
        )
        return (
            self._read("lineitem")
            .filter(F.col("l_returnflag") == "R")
            .select(
                (F.col("l_suppkey") % 25).alias("id_restaurante"),
                F.when(~of_ingredient, F.col("l_partkey")).alias("id_plato"),
                F.when(of_ingredient, F.col("l_suppkey")).alias("id_insumo"),
                F.to_date("l_shipdate").alias("fecha"),
                F.col("l_shipdate").alias("momento"),
                F.when(of_ingredient, "insumo").otherwise("plato").alias("tipo"),
                F.col("l_quantity").cast("long").alias("cantidad"),
                _pick(K.UNITS[:4], line).alias("unidad_medida"),
                _pick(K.REASONS, line).alias("motivo"),
                cost.alias("costo_estimado"),
            )
        )

    # ---- logs ----
    @cached_property
    def bitacora(self) -> DataFrame:
        kind = F.col("event_type")
        module = (
            F.when(kind == "click", "ventas")
            .when(kind == "view", "dashboard")
            .when(kind == "signup", "clientes")
            .when(kind == "purchase", "insumos")
            .otherwise("configuracion")
        )
        return self._read("events").select(
            F.col("event_id").alias("id_evento"),
            F.col("ts").alias("momento"),
            F.to_date("ts").alias("fecha"),
            F.date_format("ts", "HH:mm:ss").alias("hora"),
            F.col("user_id").alias("id_usuario"),
            _pick(K.ROLES, F.col("user_id")).alias("rol"),
            module.alias("modulo"),
            _pick(K.ACTIONS, F.col("event_id")).alias("accion"),
            F.when(kind == "error", "error").otherwise("exito").alias("resultado"),
        )

    @cached_property
    def alertas(self) -> DataFrame:
        kind = _pick(K.ALERT_TYPES, F.col("event_id"))
        of_dish = kind.isin(K.DISH_ALERTS)
        return self._read("events").select(
            F.col("event_id").alias("id_alerta"),
            kind.alias("tipo_alerta"),
            _pick(["BAJO", "MEDIO", "ALTO", "CRITICO"], F.floor(F.col("event_id") / 7)).alias("nivel_riesgo"),
            _pick(K.STATES, F.col("user_id")).alias("estado"),
            F.col("ts").alias("fecha_generacion"),
            F.when(of_dish, F.col("user_id") * 13 + F.col("event_id") % 13).alias("id_plato"),
            F.when(~of_dish, F.col("user_id")).alias("id_insumo"),
            F.col("value").alias("valor_actual"),
        )

    @cached_property
    def cambios_alerta(self) -> DataFrame:
        """Log of state changes: three consecutive events change the state of one alert."""
        return self._read("events").select(
            F.floor(F.col("event_id") / 3).cast("long").alias("id_alerta"),
            F.col("ts").alias("momento"),
            _pick(K.STATES, F.col("user_id")).alias("estado"),
        )


# Footprint factors for the words of these tables' item names, in matching order
# ("old" comes before the nouns and wins in "old bolt"; "ring" is also found inside longer words).
CO2_BY_WORD = {"old": 2.2, "widget": 25.0, "ring": 6.9, "red": 9.8, "bolt": 3.0, "gear": 1.4, "cold": 0.9, "rod": 0.5}
WATER_BY_WORD = {"widget": 15400.0, "ring": 4300.0, "bolt": 590.0, "gear": 1600.0, "plate": 322.0}
