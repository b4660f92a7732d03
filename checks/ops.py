"""SQL twins of the listing, replenishment, footprint and rule operators."""

from checks.bi import D30, DAILY, tot
from checks.prelude import level, num, pct, pick, sql, sql_list, txt
from wastelens.functions import constants as K
from wastelens.functions.text import _SLOT
from wastelens.operators.rules import advice_context
from wastelens.sources.trade_tables import CO2_BY_WORD, WATER_BY_WORD


def render(template, **slots):
    parts = []
    for i, piece in enumerate(_SLOT.split(template)):
        if i % 2:
            parts.append(f"CAST({slots[piece]} AS VARCHAR)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


def dec(expr, digits):
    return f"CAST(round(CAST({expr} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def factor(name, factors, default):
    folded = f"translate(lower({name}), 'áéíóúñ', 'aeioun')"
    cases = " ".join(f"WHEN contains({folded}, '{k}') THEN {v}::DOUBLE" for k, v in factors.items())
    return f"(CASE {cases} ELSE {default}::DOUBLE END)"


D60 = "fecha >= (SELECT d FROM hoy) - 60"
NEED = f"""
dias AS (SELECT greatest(count(DISTINCT fecha), 1) AS n FROM ventas WHERE {D30}),
dem AS (SELECT id_plato, sum(cantidad) AS u FROM detalle JOIN ventas USING (id_venta) WHERE {D30} GROUP BY 1),
nec AS (SELECT id_insumo, CAST(sum(CAST(u AS BIGINT) * cantidad_usada) AS DOUBLE) / (SELECT n FROM dias) * 7 AS necesario
        FROM dem JOIN recetas USING (id_plato) GROUP BY 1),
ped AS (
  SELECT id_insumo, nombre AS insumo, coalesce(nullif(proveedor, ''), 'Sin proveedor') AS proveedor, unidad_medida AS unidad,
         {num('stock_disponible', 3)} AS stock_actual, {num('necesario', 3)} AS necesario,
         {num('necesario - CAST(stock_disponible AS DOUBLE)', 3)} AS cantidad_pedido,
         {num('(necesario - CAST(stock_disponible AS DOUBLE)) * CAST(costo_unitario AS DOUBLE)', 2)} AS costo_estimado
  FROM nec JOIN insumos USING (id_insumo) WHERE estado AND necesario - CAST(stock_disponible AS DOUBLE) > 0)"""

FOOT = f"""
huella AS (
  SELECT nombre, categoria, kg, costo_estimado, kg * {factor('nombre', CO2_BY_WORD, K.CO2_DEFAULT)} AS co2,
         kg * {factor('nombre', WATER_BY_WORD, K.WATER_DEFAULT)} AS agua
  FROM (SELECT coalesce(nullif(i.nombre, ''), nullif(p.nombre, ''), 'Otros') AS nombre,
               coalesce(nullif(i.categoria, ''), nullif(p.categoria, ''), nullif(i.nombre, ''), nullif(p.nombre, ''), 'Otros') AS categoria,
               CASE WHEN lower(trim(d.unidad_medida)) IN ('g','gr','gramo','gramos','ml','mililitro','mililitros')
                    THEN CAST(cantidad AS DOUBLE) / 1000 ELSE CAST(cantidad AS DOUBLE) END AS kg, d.costo_estimado
        FROM desperdicios d LEFT JOIN insumos i ON d.id_insumo = i.id_insumo LEFT JOIN platos p ON d.id_plato = p.id_plato
        WHERE {D30}))"""

NL, ND = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)"


def alert(kind, frm, lvl, risk, plato=NL, insumo=NL, pred=ND, act=ND, ctx="", **slots):
    slots = {"nombre": "nombre", **slots}
    ctx = ctx.replace("'", "''")
    return f"""
  SELECT '{kind}' AS tipo_alerta, {lvl} AS nivel_riesgo, {render(K.ALERT_TITLES[kind], **slots)} AS titulo,
         {render(K.ALERT_DESCRIPTIONS[kind], **slots)} AS descripcion,
         {render(K.ALERT_ADVICE[kind], **slots)} || '{ctx}' AS recomendacion,
         {plato} AS id_plato, {insumo} AS id_insumo, CAST({pred} AS DOUBLE) AS valor_predicho,
         CAST({act} AS DOUBLE) AS valor_actual, CAST({risk} AS DOUBLE) AS porcentaje_riesgo
  FROM {frm}"""


MEASURES = f"""
sobra AS (SELECT *, CAST(sobrante AS DOUBLE) / preparada * 100 AS pct FROM (
  SELECT id_plato, nombre, CAST(sum(sobrante) AS BIGINT) AS sobrante, CAST(sum(preparada) AS BIGINT) AS preparada
  FROM producciones JOIN platos USING (id_plato) WHERE {D30} GROUP BY 1, 2) WHERE preparada > 0),
u AS (SELECT id_plato, sum(cantidad) FILTER ({D30}) AS r, sum(cantidad) FILTER (NOT ({D30})) AS p, count(*) FILTER ({D30}) AS n
      FROM detalle JOIN ventas USING (id_venta) WHERE {D60} GROUP BY 1),
cambio AS (SELECT id_plato, nombre, CAST(coalesce(r, 0) AS BIGINT) AS reciente, CAST(coalesce(p, 0) AS BIGINT) AS previo, coalesce(n, 0) AS n,
      CASE WHEN coalesce(p, 0) > 0 THEN CAST(coalesce(p, 0) - coalesce(r, 0) AS DOUBLE) / CAST(p AS DOUBLE) * 100 END AS caida
      FROM platos LEFT JOIN u USING (id_plato) WHERE estado),
merma AS (SELECT id_plato, nombre, CAST(sum(d.costo_estimado) AS DOUBLE) AS costo, CAST(sum(cantidad) AS DOUBLE) AS cantidad
      FROM desperdicios d JOIN platos USING (id_plato) WHERE {D30} GROUP BY 1, 2),
vence AS (SELECT *, fecha_vencimiento - (SELECT d FROM hoy) AS dias, CAST(stock_disponible AS DOUBLE) AS stock FROM insumos
      WHERE estado AND fecha_vencimiento BETWEEN (SELECT d FROM hoy) AND (SELECT d FROM hoy) + 7),
exceso AS (SELECT *, CAST(stock_disponible AS DOUBLE) / CAST(stock_minimo AS DOUBLE) AS ratio FROM insumos
      WHERE estado AND stock_minimo > 0 AND stock_disponible > stock_minimo * 3),
reciente AS (SELECT tipo_alerta, id_plato, id_insumo FROM alertas
      WHERE estado = 'pendiente' AND fecha_generacion >= (SELECT t FROM ahora) - INTERVAL 24 HOUR)"""


def rules(ctx=""):
    return {
        "r1": alert(K.OVERPRODUCTION, "sobra WHERE pct >= 10", level("pct", K.CUTS[K.OVERPRODUCTION]), num("pct", 2),
                    plato="id_plato", pred="preparada - sobrante", act="sobrante", ctx=ctx, pct=txt("pct", 1),
                    sobrante="sobrante", preparada="preparada", ajuste="CAST(least(floor(pct * 0.8::DOUBLE), 40) AS BIGINT)"),
        "r2": alert(K.EXPIRING, "vence",
                    "(CASE WHEN dias <= 1 THEN 'CRITICO' WHEN dias <= 2 THEN 'ALTO' WHEN dias <= 4 THEN 'MEDIO' ELSE 'BAJO' END)",
                    "greatest(0.0, round(CAST(7 - dias AS DOUBLE) / 7 * 100, 2))", insumo="id_insumo", pred="stock", act="dias",
                    ctx=ctx, dias="dias", fecha="fecha_vencimiento", stock=txt("stock", 2), unidad="unidad_medida"),
        "r3": alert(K.OVERSTOCK, "exceso", level("ratio", K.CUTS[K.OVERSTOCK]), num("least(ratio * 10, 100.0)", 2),
                    insumo="id_insumo", pred="stock_minimo", act="stock_disponible", ctx=ctx, stock=txt("stock_disponible", 2),
                    unidad="unidad_medida", ratio=txt("ratio", 1)),
        "r4": alert(K.LOW_DEMAND, "cambio WHERE caida >= 20", level("caida", K.CUTS[K.LOW_DEMAND]), num("caida", 2),
                    plato="id_plato", pred="previo", act="reciente", ctx=ctx, pct=txt("caida", 1), previo="previo",
                    reciente="reciente"),
        "r5": alert(K.HIGH_WASTE, "merma WHERE costo >= 20", level("costo", K.CUTS[K.HIGH_WASTE]),
                    num("least(costo / 2, 100.0)", 2), plato="id_plato", pred="0", act="costo", ctx=ctx,
                    costo=txt("costo", 2), cantidad=txt("cantidad", 2)),
        "r6": alert(K.MENU, "cambio WHERE n = 0", "'BAJO'", "0", plato="id_plato", act="0", ctx=ctx),
        "r7": alert(K.CRITICAL, """platos WHERE id_plato IN (SELECT id_plato FROM cambio WHERE caida >= 20)
                    AND id_plato IN (SELECT id_plato FROM merma WHERE costo >= 60)""", "'CRITICO'", "100", plato="id_plato", ctx=ctx),
        "r7s": alert(K.CRITICAL, f"""platos WHERE id_plato IN (SELECT id_plato FROM alertas WHERE tipo_alerta = '{K.LOW_DEMAND}' AND estado = 'pendiente')
                    AND id_plato IN (SELECT id_plato FROM merma WHERE costo >= 60 AND id_plato NOT IN
                    (SELECT id_plato FROM reciente WHERE tipo_alerta = '{K.HIGH_WASTE}' AND id_plato IS NOT NULL))""",
                     "'CRITICO'", "100", plato="id_plato", ctx=ctx),
    }


def run(ctx=""):
    every = " UNION ALL ".join(v for k, v in rules(ctx).items() if k != "r7s")
    return MEASURES + f""",
cand AS ({every}),
nuevas AS (SELECT * FROM cand c WHERE NOT EXISTS (
   SELECT 1 FROM reciente r WHERE r.tipo_alerta = c.tipo_alerta AND (r.id_plato = c.id_plato OR r.id_insumo = c.id_insumo)))"""


def advice(kind, sev, module, frm, **slots):
    t, d = K.RECOMMENDATIONS[kind]
    return (f"SELECT '{kind}' AS tipo, {sev} AS severidad, {render(t, **slots)} AS titulo, {render(d, **slots)} AS descripcion, "
            f"'{module}' AS modulo FROM {frm}")


def note(kind, sev, frm, **slots):
    t, d = K.DASHBOARD_ALERTS[kind]
    return f"SELECT '{kind}' AS tipo, '{sev}' AS severidad, {render(t, **slots)} AS titulo, {render(d, **slots)} AS mensaje FROM {frm}"


LOW = "insumos WHERE estado AND stock_disponible <= stock_minimo"
STOCK, MINIMUM = "CAST(stock_disponible AS DOUBLE)", "CAST(stock_minimo AS DOUBLE)"
ADVICE = " UNION ALL ".join([
    advice("stock_bajo", "'alta'", "insumos", LOW, nombre="nombre", stock=STOCK, minimo=MINIMUM, unidad="unidad_medida"),
    advice("vencimiento", "CASE WHEN dias <= 2 THEN 'alta' ELSE 'media' END", "insumos", "vence", nombre="nombre", dias="dias",
           fecha="fecha_vencimiento"),
    advice("sobreproduccion", "'media'", "produccion", "sobra WHERE pct > 15", nombre="nombre", pct=txt("pct", 1)),
    advice("motivo_desperdicio", "'baja'", "desperdicio", f"""(SELECT * FROM (SELECT motivo, count(*) AS frecuencia,
        {tot('costo_estimado')} AS costo FROM desperdicios WHERE {D30} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) WHERE costo > 0)""",
           motivo="motivo", frecuencia="frecuencia", costo=txt("costo", 2)),
])
ALLOWED = sql_list(f"{r}|{m}|{a}" for r, ms in K.PERMISSIONS.items() for m, acts in ms.items() for a in acts)
CONTACTS = """
c AS (SELECT c_custkey AS k, c_name AS nombre,
  CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE replace(lower(c_name), '#', '.') || '@correo.pe' END AS correo,
  CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 11, '2') END AS ruc,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN 'tel ' || c_custkey ELSE '+51 900' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS telefono,
  CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_custkey - 20 AS VARCHAR) END AS credito,
  'pw' || c_custkey AS clave FROM customer)"""
QUALITY = {
    "correo": rf"regexp_matches(correo, '{K.EMAIL_PATTERN}')", "ruc": "regexp_matches(ruc, '^[0-9]{11}$')",
    "telefono": rf"(telefono = '' OR regexp_matches(telefono, '{K.PHONE_PATTERN}'))", "nombre": "length(trim(nombre)) > 0",
    "credito": "coalesce(TRY_CAST(credito AS DOUBLE) >= 0, false)", "clave": "length(clave) >= 6",
}
TICKET10 = "(SELECT * FROM ventas ORDER BY fecha DESC, hora DESC, id_venta DESC LIMIT 200)"
O_TITLE, O_TEXT = K.OUTBOX_WASTE

ORACLES = {
    # listings
    "p01_active_dishes": sql("SELECT id_plato, nombre, categoria, CAST(precio_venta AS DOUBLE) AS precio_venta FROM platos WHERE estado"),
    "p02_recent_waste": sql(f"SELECT fecha, tipo, motivo, cantidad FROM desperdicios WHERE {D30}"),
    "p03_week_tickets": sql("SELECT id_venta, fecha FROM ventas WHERE fecha BETWEEN (SELECT d FROM hoy) - 6 AND (SELECT d FROM hoy)"),
    "p04_previous_production": sql(f"SELECT id_plato, fecha, preparada, sobrante FROM producciones WHERE {D60} AND NOT ({D30})"),
    "p05_to_date_tickets": sql("""SELECT id_venta, fecha, fecha >= date_trunc('month', (SELECT d FROM hoy)) AS del_mes
FROM ventas WHERE fecha >= date_trunc('year', (SELECT d FROM hoy))"""),
    "p06_stock_flags": sql("""SELECT id_insumo, nombre, CAST(coalesce(stock_disponible, 0) AS DOUBLE) AS stock_disponible,
CAST(coalesce(stock_minimo, 0) AS DOUBLE) AS stock_minimo, coalesce(stock_disponible, 0) <= coalesce(stock_minimo, 0) AS stock_critico FROM insumos"""),
    "p07_expiring": sql("SELECT id_insumo, nombre, fecha_vencimiento, dias FROM vence", MEASURES),
    "p08_expiry_status": sql("""SELECT id_insumo, nombre AS insumo, CAST(stock_disponible AS DOUBLE) AS stock, unidad_medida AS unidad, fecha_vencimiento,
fecha_vencimiento - (SELECT d FROM hoy) AS dias, CASE WHEN fecha_vencimiento < (SELECT d FROM hoy) THEN 'VENCIDO' ELSE 'Por vencer' END AS estado_vencimiento
FROM insumos WHERE estado AND fecha_vencimiento <= (SELECT d FROM hoy) + 7"""),
    "p09_filtered_alerts": sql(f"""SELECT id_alerta, tipo_alerta, nivel_riesgo, estado FROM alertas
WHERE tipo_alerta IN ('{K.LOW_DEMAND}', '{K.HIGH_WASTE}') AND estado = 'leida'"""),
    "p10_dish": sql("SELECT id_plato, nombre, categoria, estado FROM platos WHERE id_plato = 7"),
    "p11_ingredient_values": sql(f"""SELECT id_insumo, CAST(stock_disponible AS DOUBLE) AS stock_disponible, CAST(costo_unitario AS DOUBLE) AS costo_unitario,
{num('CAST(stock_disponible AS DOUBLE) * CAST(costo_unitario AS DOUBLE)', 2)} AS valor FROM insumos"""),
    "p13_ticket_lines": sql(f"""SELECT id_venta, fecha, CAST(v.total AS DOUBLE) AS total, id_plato, coalesce(nombre, '') AS plato, cantidad, CAST(subtotal AS DOUBLE) AS subtotal
FROM {TICKET10} v JOIN detalle USING (id_venta) LEFT JOIN platos USING (id_plato)"""),
    "p14_ticket_pricing": sql("""SELECT id_venta, CAST(total AS DOUBLE) AS total, CAST(r AS DOUBLE) AS recalculado, CAST(s AS DOUBLE) AS suma_lineas, total = r AS coincide
FROM ventas JOIN (SELECT id_venta, sum(precio_venta * cantidad) AS r, sum(subtotal) AS s FROM detalle JOIN platos USING (id_plato) GROUP BY 1) USING (id_venta)"""),
    "p15_permission_audit": sql(f"""SELECT rol, modulo, accion, count(*) AS n,
list_contains({ALLOWED}, rol || '|' || CASE WHEN rol = 'Administrador' THEN 'todos' ELSE modulo END || '|' || accion) AS permitido
FROM bitacora GROUP BY 1, 2, 3"""),
    "p16_contact_quality": sql(" UNION ALL ".join(
        f"SELECT '{n}' AS regla, count(*) AS filas, count(*) FILTER (NOT ({e})) AS violaciones FROM c" for n, e in QUALITY.items()), CONTACTS),
    "p17_waste_listing": sql("""SELECT fecha, tipo, coalesce(p.nombre, '') AS plato, coalesce(i.nombre, '') AS insumo, cantidad, d.unidad_medida, motivo,
CAST(d.costo_estimado AS DOUBLE) AS costo_estimado FROM desperdicios d LEFT JOIN platos p USING (id_plato) LEFT JOIN insumos i USING (id_insumo)"""),
    "p17_production_listing": sql("""SELECT fecha, id_plato, coalesce(nombre, '') AS plato, preparada, preparada - sobrante AS vendida, sobrante
FROM producciones LEFT JOIN platos USING (id_plato)"""),
    "p17_recipe_listing": sql("""SELECT id_plato, id_insumo, coalesce(p.nombre, '') AS plato, coalesce(i.nombre, '') AS insumo, CAST(cantidad_usada AS DOUBLE) AS cantidad_usada
FROM recetas LEFT JOIN platos p USING (id_plato) LEFT JOIN insumos i USING (id_insumo)"""),
    "p18_over_limit_dishes": sql(f"SELECT id_plato, nombre, {num('pct', 2)} AS porcentaje FROM sobra WHERE pct > 15", MEASURES),
    "p19_ingredient_in_restaurant": sql("""SELECT d.id_plato, d.id_restaurante, d.insumo, i.id_insumo FROM
(SELECT id_plato, id_restaurante, 'Supplier#' || lpad(CAST(id_plato % 100 AS VARCHAR), 9, '0') AS insumo FROM platos) d
JOIN insumos i ON i.id_restaurante = d.id_restaurante AND i.nombre = d.insumo"""),
    "t04_latest_tickets": sql(f"SELECT id_venta, fecha, hora, CAST(total AS DOUBLE) AS total, metodo_pago FROM {TICKET10}"),
    "t04_audit_report": sql("""SELECT id_evento, fecha, hora, id_usuario, rol, modulo, accion, resultado FROM bitacora
WHERE fecha BETWEEN CAST((SELECT t FROM ahora) AS DATE) - 7 AND CAST((SELECT t FROM ahora) AS DATE) ORDER BY fecha DESC, hora DESC, id_evento DESC LIMIT 500"""),
    "t06_audit_log": sql("""SELECT id_evento, fecha, hora, id_usuario, rol, modulo, accion, resultado FROM bitacora
WHERE modulo = 'ventas' AND resultado = 'exito' ORDER BY id_evento DESC LIMIT 100"""),
    "f08_text_formats": sql(f"""SELECT id_venta, 'S/ ' || format('{{:,.2f}}', CAST(total AS DOUBLE)) AS total_texto, strftime(fecha, '%d/%m/%Y') AS fecha_texto,
({sql_list(K.WEEKDAYS)})[isodow(fecha)] AS dia, ({sql_list(K.MONTHS)})[month(fecha)] AS mes FROM ventas"""),
    # joins
    "s02_sales_lines": sql("""SELECT id_venta, id_plato, fecha, cantidad, categoria, CAST(precio_venta AS DOUBLE) AS precio
FROM detalle JOIN ventas USING (id_venta) JOIN platos USING (id_plato)"""),
    "s03_dish_transactions": sql("""SELECT id_venta, id_plato, fecha, cantidad, categoria, CAST(precio_venta AS DOUBLE) AS precio
FROM detalle JOIN ventas USING (id_venta) JOIN platos USING (id_plato) WHERE id_plato = 7"""),
    "j02_production_by_dish": sql("""SELECT id_plato, nombre, CAST(sum(preparada) AS BIGINT) AS preparada, CAST(sum(sobrante) AS BIGINT) AS sobrante
FROM producciones JOIN platos USING (id_plato) GROUP BY 1, 2"""),
    "j03_waste_by_category": sql("""SELECT coalesce(nullif(i.categoria, ''), nullif(p.categoria, ''), 'Otros') AS categoria, CAST(sum(d.costo_estimado) AS DOUBLE) AS costo,
count(*) AS registros FROM desperdicios d LEFT JOIN insumos i ON i.id_insumo = d.id_insumo LEFT JOIN platos p ON p.id_plato = d.id_plato GROUP BY 1"""),
    "j04_unsold_dishes": sql("SELECT id_plato, nombre FROM cambio WHERE n = 0", MEASURES),
    "j06_low_and_costly": sql("SELECT id_plato FROM cambio WHERE caida >= 20 INTERSECT SELECT id_plato FROM merma WHERE costo >= 60", MEASURES),
    "j07_demand_change": sql("SELECT id_plato, nombre, reciente, previo, n AS ventas_recientes, round(caida, 4) AS caida FROM cambio", MEASURES),
    "j08_ingredient_need": sql(f"SELECT id_insumo, {num('necesario', 4)} AS necesario FROM nec", NEED),
    "j09_item_factors": sql(f"""SELECT id_plato, nombre, {factor('nombre', CO2_BY_WORD, K.CO2_DEFAULT)} AS co2_por_kg,
{factor('nombre', WATER_BY_WORD, K.WATER_DEFAULT)} AS agua_por_kg FROM platos"""),
    "j12_units_by_name": sql("""SELECT nombre, CAST(sum(cantidad) AS BIGINT) AS vendidos, CAST(sum(subtotal) AS DOUBLE) AS ingreso
FROM detalle JOIN ventas USING (id_venta) JOIN platos USING (id_plato) GROUP BY 1"""),
    "u03_active_minus_sold": sql(f"""SELECT id_plato FROM platos WHERE estado EXCEPT
SELECT id_plato FROM detalle JOIN ventas USING (id_venta) WHERE {D30}"""),
    # replenishment and footprint
    "a08_purchase_list": sql("SELECT * FROM ped", NEED),
    "a08_purchase_totals": sql("""SELECT 7 AS dias_proyeccion, (SELECT n FROM dias) AS dias_base_calculo, count(*) AS total_items,
coalesce(CAST(sum(CAST(costo_estimado AS DECIMAL(18,2))) AS DOUBLE), 0) AS total_costo_estimado FROM ped""", NEED),
    "a09_orders_by_supplier": sql("SELECT proveedor, count(*) AS items, CAST(sum(CAST(costo_estimado AS DECIMAL(18,2))) AS DOUBLE) AS subtotal FROM ped GROUP BY 1", NEED),
    "a10_footprint_totals": sql(f"""SELECT 30 AS periodo_dias, {dec('c', 2)} AS total_co2_kg, {dec('a', 0)} AS total_agua_litros, {dec('k', 3)} AS total_kg_desperdiciado,
{dec('s', 2)} AS total_costo_soles, {dec('c / 22', 1)} AS arboles_anuales, {dec('c / 0.21::DOUBLE', 1)} AS km_en_auto, {dec('a / 65', 0)} AS duchas_perdidas
FROM (SELECT {tot('co2')} AS c, {tot('agua')} AS a, {tot('kg')} AS k, {tot('costo_estimado')} AS s FROM huella)""", FOOT),
    "a11_footprint_by_category": sql(f"""SELECT array_to_string(list_transform(string_split(categoria, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS categoria,
{dec(tot('co2'), 2)} AS co2_kg, {dec(tot('agua'), 0)} AS agua_litros, {dec(tot('kg'), 3)} AS kg_desperdiciado, {dec(tot('costo_estimado'), 2)} AS costo FROM huella GROUP BY 1""", FOOT),
    # rules
    "r01_overproduction": sql(rules()["r1"], MEASURES),
    "r02_expiring_soon": sql(rules()["r2"], MEASURES),
    "r03_overstock": sql(rules()["r3"], MEASURES),
    "r04_low_demand": sql(rules()["r4"], MEASURES),
    "r05_high_waste": sql(rules()["r5"], MEASURES),
    "r06_unsold": sql(rules()["r6"], MEASURES),
    "r07_combined_risk": sql(rules()["r7"], MEASURES),
    "r07_combined_risk_history": sql(rules()["r7s"], MEASURES),
    "u01_generate_alerts": sql("SELECT * FROM nuevas", run()),
    "f15_alerts_with_context": sql("SELECT * FROM nuevas", run(advice_context(3, 2))),
    "a32_run_summary": sql("SELECT tipo_alerta, nivel_riesgo, count(*) AS n FROM nuevas GROUP BY GROUPING SETS ((tipo_alerta), (nivel_riesgo), ())", run()),
    "j05_cooled_down": sql("SELECT tipo_alerta, id_plato, id_insumo FROM cand EXCEPT ALL SELECT tipo_alerta, id_plato, id_insumo FROM nuevas", run()),
    "r08_dish_risk": sql(f"""SELECT id_plato, nombre, round(p, 2) AS porcentaje, {level('p', K.CUTS['RIESGO_PLATO'])} AS nivel FROM (
SELECT id_plato, nombre, least((CASE WHEN m > 0 THEN s / m * 100 ELSE 0.0::DOUBLE END) * 0.6::DOUBLE + least(coalesce(c, 0.0::DOUBLE) / 10, 50.0) * 0.4::DOUBLE, 100.0) AS p
FROM platos LEFT JOIN (SELECT id_plato, CAST(sum(sobrante) AS DOUBLE) AS s, CAST(sum(preparada) AS DOUBLE) AS m FROM producciones WHERE {D30} GROUP BY 1) USING (id_plato)
LEFT JOIN (SELECT id_plato, CAST(sum(costo_estimado) AS DOUBLE) AS c FROM desperdicios WHERE {D30} GROUP BY 1) USING (id_plato))"""),
    "r09_active_alerts": sql("""SELECT id_alerta, tipo_alerta, nivel_riesgo, fecha_generacion, a.estado, a.id_plato, a.id_insumo, p.nombre AS plato, i.nombre AS insumo, valor_actual
FROM (SELECT * FROM alertas WHERE estado = 'pendiente' ORDER BY fecha_generacion DESC, id_alerta DESC LIMIT 50) a
LEFT JOIN platos p ON p.id_plato = a.id_plato LEFT JOIN insumos i ON i.id_insumo = a.id_insumo"""),
    "r10_current_states": sql("""SELECT id_alerta, estado, momento, cambios FROM (
SELECT *, count(*) OVER (PARTITION BY id_alerta) AS cambios, row_number() OVER (PARTITION BY id_alerta
  ORDER BY momento DESC, list_position(['pendiente', 'leida', 'resuelta'], estado) DESC) AS r FROM cambios_alerta) WHERE r = 1"""),
    "a38_counts_by_level": sql("""SELECT count(*) AS total, count(*) FILTER (nivel_riesgo = 'CRITICO') AS critico, count(*) FILTER (nivel_riesgo = 'ALTO') AS alto,
count(*) FILTER (nivel_riesgo = 'MEDIO') AS medio, count(*) FILTER (nivel_riesgo = 'BAJO') AS bajo FROM alertas WHERE estado = 'pendiente'"""),
    "r11_recommendations": sql(ADVICE, MEASURES),
    "a39_recommendations_by_severity": sql(f"SELECT severidad, count(*) AS n FROM ({ADVICE}) GROUP BY 1", MEASURES),
    "r12_dashboard_alerts": sql(note("stock_bajo", "advertencia", LOW, nombre="nombre", stock=STOCK, unidad="unidad_medida")
                                + " UNION ALL " + note("vencimiento", "critica", "vence", nombre="nombre", fecha="fecha_vencimiento"), MEASURES),
    "r13_to_notify": sql("""SELECT tipo_alerta, nivel_riesgo, id_plato, id_insumo FROM nuevas UNION ALL
SELECT tipo_alerta, nivel_riesgo, id_plato, id_insumo FROM alertas WHERE estado = 'pendiente' AND (SELECT count(*) FROM nuevas) = 0""", run()),
    "s16_outbox_to_resend": sql(f"""SELECT 'desperdicio' AS tipo, {render(O_TITLE, pct=txt('porcentaje_desperdicio', 2))} AS titulo,
{render(O_TEXT, pct=txt('porcentaje_desperdicio', 2), umbral="'0.05'")} AS mensaje, 'critica' AS severidad, false AS enviado, CAST(NULL AS DATE) AS fecha_envio, fecha
FROM dia WHERE porcentaje_desperdicio > 0.05 AND day(fecha) % 3 = 0""", DAILY),
}
