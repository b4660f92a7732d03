"""Explicit table schemas and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "restaurantes": "id_restaurante long, nombre string, distrito string, estado boolean",
    "platos": "id_plato long, id_restaurante long, nombre string, categoria string, marca string, "
    "precio_venta decimal(10,2), costo_estimado decimal(10,2), estado boolean",
    "insumos": "id_insumo long, id_restaurante long, nombre string, categoria string, "
    "unidad_medida string, stock_disponible decimal(10,3), stock_minimo decimal(10,3), "
    "costo_unitario decimal(10,2), fecha_vencimiento date, proveedor string, estado boolean",
    "recetas": "id_plato long, id_insumo long, cantidad_usada decimal(10,3), unidad_medida string",
    "ventas": "id_venta long, fecha date, hora string, total decimal(12,2), metodo_pago string, "
    "id_cliente long, id_restaurante long",
    "clientes": "id_cliente long, nombre string, id_restaurante long",
    "detalle_ventas": "id_venta long, id_plato long, cantidad long, subtotal decimal(12,2), linea int",
    "producciones": "id_restaurante long, id_plato long, fecha date, preparada long, "
    "vendida long, sobrante long",
    "desperdicios": "id_restaurante long, id_plato long, id_insumo long, fecha date, tipo string, "
    "cantidad long, unidad_medida string, motivo string, costo_estimado decimal(18,6)",
    "bitacora": "id_evento long, momento timestamp, fecha date, hora string, id_usuario long, "
    "rol string, modulo string, accion string, resultado string",
    "alertas": "id_alerta long, tipo_alerta string, nivel_riesgo string, titulo string, "
    "descripcion string, recomendacion string, estado string, fecha_generacion timestamp, "
    "id_plato long, id_insumo long, valor_predicho double, valor_actual double, "
    "porcentaje_riesgo double",
    "cambios_alerta": "id_alerta long, momento timestamp, estado string",
    "predicciones": "id_plato long, fecha_objetivo date, fecha_generacion timestamp, modelo string, "
    "demanda_estimada double, recomendacion_produccion long, riesgo_desperdicio string, "
    "mae double, r2 double, confianza double",
}

TABLES = tuple(_DDL)

# Facts that are written partitioned by month, so that date windows prune directories.
FACTS_BY_MONTH = ("ventas", "detalle_ventas", "producciones", "desperdicios", "bitacora")


# Columns that the stored layout adds to a table.
STORED = {"detalle_ventas": "fecha date, categoria string"}


def stored_schema(table: str) -> T.StructType:
    """The declared columns and those of the stored layout; a file without one of them gives nulls."""
    return T.StructType([*schema_of(table).fields, *T.StructType.fromDDL(STORED.get(table, "")).fields] if table in STORED else schema_of(table).fields)


def schema_of(table: str) -> T.StructType:
    """The declared schema (parsed by the running session)."""
    return T.StructType.fromDDL(_DDL[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))


def evolve(df: DataFrame, table: str) -> DataFrame:
    """Add the declared columns that ``df`` lacks (as nulls); keep every row and extra column."""
    have = set(df.columns)
    missing = [f for f in schema_of(table).fields if f.name not in have]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df


def conform(df: DataFrame, table: str) -> DataFrame:
    """The stored form of a table: declared columns in their declared types, missing ones null, extra ones kept."""
    kinds = {f.name: f.dataType for f in stored_schema(table).fields}
    return evolve(df, table).select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in evolve(df, table).columns])
