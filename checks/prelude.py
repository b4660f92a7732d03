"""The domain frames as SQL common table expressions over the stored tables."""

from wastelens.functions import constants as K


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({sql_list(values)})[({index}) % {len(values)} + 1]"


def num(expr: str, digits: int) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def pct(part: str, whole: str) -> str:
    p, w = f"CAST({part} AS DOUBLE)", f"CAST({whole} AS DOUBLE)"
    return f"(CASE WHEN {w} > 0 THEN {p} / {w} * 100 ELSE 0.0::DOUBLE END)"


def txt(expr: str, digits: int) -> str:
    return f"CAST(CAST(round(CAST({expr} AS DOUBLE), {digits}) AS DECIMAL(20,{digits})) AS VARCHAR)"


def level(value: str, cuts) -> str:
    low, mid, high = cuts
    return (
        f"(CASE WHEN {value} < {low} THEN 'BAJO' WHEN {value} < {mid} THEN 'MEDIO' "
        f"WHEN {value} < {high} THEN 'ALTO' ELSE 'CRITICO' END)"
    )


_DISH = sql_list(K.DISH_ALERTS)

CTES = f"""
hoy AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders),
ahora AS (SELECT max(ts) AS t FROM events),
restaurantes AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id_restaurante, n_name AS nombre, r_name AS distrito
  FROM nation JOIN region ON n_regionkey = r_regionkey),
platos AS (
  SELECT p_partkey AS id_plato, p_partkey % 25 AS id_restaurante, p_name AS nombre, p_type AS categoria,
         p_brand AS marca, CAST(p_retailprice AS DECIMAL(10,2)) AS precio_venta,
         CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.4 AS DECIMAL(2,1)) AS costo_estimado,
         p_size > 2 AS estado
  FROM part),
insumos AS (
  SELECT s_suppkey AS id_insumo, s_suppkey % 25 AS id_restaurante, s_name AS nombre, r_name AS categoria,
         {pick(K.UNITS[:4], 's_suppkey')} AS unidad_medida,
         CAST(s_acctbal AS DECIMAL(10,3)) AS stock_disponible,
         CAST(500 + 100 * (s_suppkey % 50) AS DECIMAL(10,3)) AS stock_minimo,
         CAST(1 + s_suppkey % 20 AS DECIMAL(10,2)) AS costo_unitario,
         CASE WHEN s_suppkey % 17 <> 3 THEN (SELECT d FROM hoy) + CAST(s_suppkey % 31 - 5 AS INTEGER) END AS fecha_vencimiento,
         nullif(n_name, 'NATION_7') AS proveedor,
         s_suppkey % 13 <> 0 AS estado
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
recetas AS (
  SELECT l_partkey AS id_plato, l_suppkey AS id_insumo,
         CAST(CAST(1 + (l_partkey + l_suppkey) % 5 AS DECIMAL(9,2)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(10,3)) AS cantidad_usada
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)),
ventas AS (
  SELECT o_orderkey AS id_venta, CAST(o_orderdate AS DATE) AS fecha, strftime(o_orderdate, '%H:%M:%S') AS hora,
         CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderpriority AS metodo_pago, o_custkey AS id_cliente
  FROM orders),
ventas_por_local AS (
  SELECT v.*, CAST(c_nationkey AS BIGINT) AS id_restaurante FROM ventas v JOIN customer ON c_custkey = id_cliente),
detalle AS (
  SELECT l_orderkey AS id_venta, l_partkey AS id_plato, CAST(l_quantity AS BIGINT) AS cantidad,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal, l_linenumber AS linea
  FROM lineitem),
producciones AS (
  SELECT l_suppkey % 25 AS id_restaurante, l_partkey AS id_plato, CAST(l_shipdate AS DATE) AS fecha,
         CAST(l_quantity AS BIGINT) AS preparada,
         CAST(floor(l_quantity * l_discount * 8) AS BIGINT) AS sobrante
  FROM lineitem),
desperdicios AS (
  SELECT l_suppkey % 25 AS id_restaurante,
         CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS id_plato,
         CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END AS id_insumo,
         CAST(l_shipdate AS DATE) AS fecha, l_shipdate AS momento,
         CASE WHEN l_linenumber % 3 = 0 THEN 'insumo' ELSE 'plato' END AS tipo,
         CAST(l_quantity AS BIGINT) AS cantidad,
         {pick(K.UNITS[:4], 'l_linenumber')} AS unidad_medida,
         {pick(K.REASONS, 'l_linenumber')} AS motivo,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) * CAST(0.02 AS DECIMAL(4,2)) AS costo_estimado
  FROM lineitem WHERE l_returnflag = 'R'),
bitacora AS (
  SELECT event_id AS id_evento, ts AS momento, CAST(ts AS DATE) AS fecha, strftime(ts, '%H:%M:%S') AS hora,
         user_id AS id_usuario, {pick(K.ROLES, 'user_id')} AS rol,
         CASE event_type WHEN 'click' THEN 'ventas' WHEN 'view' THEN 'dashboard' WHEN 'signup' THEN 'clientes'
              WHEN 'purchase' THEN 'insumos' ELSE 'configuracion' END AS modulo,
         {pick(K.ACTIONS, 'event_id')} AS accion,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'exito' END AS resultado
  FROM events),
alertas AS (
  SELECT *, CASE WHEN list_contains({_DISH}, tipo_alerta) THEN user_id * 13 + id_alerta % 13 END AS id_plato,
         CASE WHEN NOT list_contains({_DISH}, tipo_alerta) THEN user_id END AS id_insumo
  FROM (SELECT event_id AS id_alerta, {pick(K.ALERT_TYPES, 'event_id')} AS tipo_alerta,
               {pick(['BAJO', 'MEDIO', 'ALTO', 'CRITICO'], 'event_id // 7')} AS nivel_riesgo,
               {pick(K.STATES, 'user_id')} AS estado, ts AS fecha_generacion, value AS valor_actual, user_id
        FROM events)),
cambios_alerta AS (
  SELECT event_id // 3 AS id_alerta, ts AS momento, {pick(K.STATES, 'user_id')} AS estado FROM events)
"""


def sql(body: str, ctes: str = "") -> str:
    """The domain CTEs, then extra CTEs, then the query."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {CTES.strip()}{extra}\n{body.strip()}"
