import datetime as dt

import pytest
from pyspark.sql import functions as F

from wastelens.asof import AsOf
from wastelens.functions import constants as K
from wastelens.functions import scalar as S
from wastelens.operators import bi, footprint, listing, replenish, rules
from wastelens.schemas import TABLES
from wastelens.sources import export
from wastelens.sources.trade_tables import TradeWarehouse
from wastelens.sources.warehouse import ParquetWarehouse, Warehouse, write_warehouse

HOY = dt.date(2026, 6, 30)
NOW = dt.datetime(2026, 6, 30, 12)


def ago(n):
    return HOY - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def wh(spark):
    make = spark.createDataFrame
    frames = {
        "restaurantes": make([(1, "Uno", "Centro", True), (2, "Dos", None, True)], "id_restaurante long, nombre string, distrito string, estado boolean"),
        "platos": make([(1, "Lomo Saltado", "Fondo", 20.0, True), (2, "Ceviche", "Entrada", 15.0, True), (3, "Sopa", "Sopa", 8.0, True),
                        (4, "Viejo", None, 5.0, False)], "id_plato long, nombre string, categoria string, precio_venta double, estado boolean")
        .withColumn("precio_venta", F.col("precio_venta").cast("decimal(10,2)")),
        "insumos": make([(1, "Carne de Res", "carnes", "kg", 1.0, 5.0, 10.0, ago(-1), "Sur", True), (2, "Arroz", "granos", "g", 100.0, 5.0, 2.0, ago(2), "", True),
                         (3, "Aceite vegetal", "", "ml", 1.0, 1.0, 3.0, None, None, True)],
                        "id_insumo long, nombre string, categoria string, unidad_medida string, stock_disponible double, stock_minimo double, "
                        "costo_unitario double, fecha_vencimiento date, proveedor string, estado boolean"),
        "recetas": make([(1, 1, 0.5), (1, 3, 0.1), (2, 1, 0.2)], "id_plato long, id_insumo long, cantidad_usada double"),
        "ventas": make([(1, ago(5), 100.0, 1), (2, ago(5), 50.0, 1), (3, ago(40), 200.0, 1), (4, ago(-3), 10.0, 1)],
                       "id_venta long, fecha date, total double, id_restaurante long"),
        "detalle_ventas": make([(1, 1, 4, 80.0), (2, 2, 10, 150.0), (3, 1, 20, 400.0), (4, 1, 1, 20.0), (1, 99, 7, 7.0)],
                               "id_venta long, id_plato long, cantidad long, subtotal double"),
        "producciones": make([(1, ago(3), 10, 1), (2, ago(3), 10, 0), (3, ago(60), 10, 9)], "id_plato long, fecha date, preparada long, sobrante long"),
        "desperdicios": make([(1, None, ago(3), "plato", 2, "kg", "vencimiento", 130.0, 1), (None, 1, ago(3), "insumo", 500, "g", "baja demanda", 5.0, 1),
                              (2, None, ago(45), "plato", 1, "kg", "vencimiento", 30.0, 2)],
                             "id_plato long, id_insumo long, fecha date, tipo string, cantidad long, unidad_medida string, motivo string, "
                             "costo_estimado double, id_restaurante long"),
        "alertas": make([(1, K.OVERPRODUCTION, "MEDIO", "pendiente", NOW - dt.timedelta(hours=2), 1, None),
                         (2, K.HIGH_WASTE, "CRITICO", "leida", NOW - dt.timedelta(hours=2), 1, None),
                         (3, K.LOW_DEMAND, "ALTO", "pendiente", NOW - dt.timedelta(hours=30), 1, None)],
                        "id_alerta long, tipo_alerta string, nivel_riesgo string, estado string, fecha_generacion timestamp, id_plato long, id_insumo long"),
    }
    return Warehouse(spark, frames, AsOf(HOY), AsOf(NOW))


def test_trailing_window_has_no_upper_bound(wh):
    assert {r["fecha"] for r in bi.daily_sales(wh).collect()} == {ago(5), ago(-3)}


def test_top_dishes_drop_unknown_ids(wh):
    assert [(r["plato"], r["vendidos"]) for r in bi.top_dishes(wh).collect()] == [("Ceviche", 10), ("Lomo Saltado", 5)]


def test_demand_change_and_low_demand(wh):
    r = {x["nombre"]: x for x in rules.demand_change(wh).collect()}
    assert (r["Lomo Saltado"]["previo"], r["Lomo Saltado"]["reciente"]) == (20, 5) and r["Lomo Saltado"]["caida"] == 75.0
    alert = rules.low_demand(wh).collect()
    assert [(a["id_plato"], a["nivel_riesgo"], a["porcentaje_riesgo"]) for a in alert] == [(1, "CRITICO", 75.0)]
    assert "de 20 a 5 unidades" in alert[0]["descripcion"]


def test_drop_of_exactly_twenty_percent_fires(spark):
    make = spark.createDataFrame
    frames = {"platos": make([(1, "A", True)], "id_plato long, nombre string, estado boolean"),
              "ventas": make([(1, ago(1)), (2, ago(40))], "id_venta long, fecha date"),
              "detalle_ventas": make([(1, 1, 80), (2, 1, 100)], "id_venta long, id_plato long, cantidad long")}
    out = rules.low_demand(Warehouse(spark, frames, AsOf(HOY), AsOf(NOW))).collect()
    assert [a["nivel_riesgo"] for a in out] == ["MEDIO"]


def test_every_rule_and_the_cool_down(wh):
    out = [(a["tipo_alerta"], a["id_plato"] or a["id_insumo"], a["nivel_riesgo"]) for a in rules.generate_alerts(wh).collect()]
    assert sorted(out) == sorted([
        (K.LOW_DEMAND, 1, "CRITICO"), (K.HIGH_WASTE, 1, "CRITICO"), (K.MENU, 3, "BAJO"), (K.CRITICAL, 1, "CRITICO"),
        (K.EXPIRING, 1, "CRITICO"), (K.OVERSTOCK, 2, "CRITICO")])
    assert [tuple(r) for r in rules.cooled_down(wh).collect()] == [(K.OVERPRODUCTION, 1, None)]


def test_single_rules_agree_with_the_combined_pass(wh):
    names = [rules.overproduction, rules.low_demand, rules.high_waste, rules.unsold, rules.combined_risk]
    alone = sorted((a["tipo_alerta"], a["id_plato"]) for f in names for a in f(wh).collect())
    assert alone == sorted((a["tipo_alerta"], a["id_plato"]) for a in rules.all_candidates(wh)[0].collect())


def test_lowest_level_cannot_occur_at_the_gate(spark):
    for kind, gate in ((K.OVERPRODUCTION, 10.0), (K.LOW_DEMAND, 20.0), (K.HIGH_WASTE, 20.0)):
        df = spark.range(1).select(S.level_by_cuts(F.lit(gate), K.CUTS[kind]).alias("n"))
        assert df.first()["n"] == "MEDIO"


def test_history_based_critical_rule(wh):
    assert [a["id_plato"] for a in rules.combined_risk_history(wh).collect()] == [1]
    strict = rules.generate_alerts(wh, strict_reference=True).filter(F.col("tipo_alerta") == K.CRITICAL)
    assert strict.count() == 1


def test_context_suffix():
    assert rules.advice_context(2, 0) == ""
    assert rules.advice_context(3, 0).endswith("puede reducir la demanda.")
    assert "feriado nacional" in rules.advice_context(1, 2)


def test_notify_falls_back_to_pending(spark, wh):
    quiet = Warehouse(spark, {"alertas": wh.alertas}, AsOf(HOY), AsOf(NOW))
    assert rules.to_notify(quiet).count() == 2
    assert rules.to_notify(wh).count() == 6


def test_limit_before_severity(spark):
    rows = [(1, "A", "CRITICO", "pendiente", NOW - dt.timedelta(hours=9)), (2, "A", "BAJO", "pendiente", NOW), (3, "A", "ALTO", "pendiente", NOW - dt.timedelta(hours=1))]
    frames = {"alertas": spark.createDataFrame(rows, "id_alerta long, tipo_alerta string, nivel_riesgo string, estado string, fecha_generacion timestamp")}
    out = rules.active_alerts(Warehouse(spark, frames, AsOf(HOY), AsOf(NOW)), limit=2).collect()
    assert [r["id_alerta"] for r in out] == [3, 2]


def test_empty_warehouse_gives_defaults(spark):
    nothing = Warehouse(spark, {}, AsOf(HOY), AsOf(NOW))
    r = bi.efficiency(nothing).first()
    assert (r["puntaje_produccion"], r["puntaje_alertas"], r["puntaje_desperdicio"], r["color"]) == (50.0, 100.0, 100.0, "verde")
    assert bi.kpis(nothing).first()["ventas_mes"] == 0.0
    assert bi.weekly_summary(nothing).first()["top_5_platos"] == "Sin datos"
    assert replenish.purchase_totals(nothing).first()["total_items"] == 0


def test_purchase_need(wh):
    rows = {r["id_insumo"]: r for r in replenish.purchase_list(wh).collect()}
    need = (5 * 0.5 + 10 * 0.2) / 2 * 7
    assert rows[1]["necesario"] == pytest.approx(need) and rows[1]["cantidad_pedido"] == pytest.approx(need - 1)
    assert rows[1]["proveedor"] == "Sur" and rows[3]["proveedor"] == "Sin proveedor"


def test_footprint_units_names_and_priority(wh):
    rows = {r["nombre"]: r for r in footprint.footprint_lines(wh).collect()}
    assert rows["Carne de Res"]["kg"] == 0.5 and rows["Carne de Res"]["co2"] == 12.5
    assert rows["Lomo Saltado"]["co2"] == pytest.approx(2 * K.CO2_FACTORS["sal"])


def test_keyword_order(spark):
    names = ["Aceite vegetal", "Ají Limo", "Salsa", "Camarón", "Otro"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", S.keyword_factor(F.col("n"), K.CO2_FACTORS, K.CO2_DEFAULT).alias("f"), S.keyword_factor(F.col("n"), K.WATER_FACTORS, K.WATER_DEFAULT).alias("w"))
    got = {r["n"]: (r["f"], r["w"]) for r in df.collect()}
    assert got == {"Aceite vegetal": (2.0, 322.0), "Ají Limo": (1.5, 1000.0), "Salsa": (0.1, 1000.0), "Camarón": (3.0, 1000.0), "Otro": (2.5, 1000.0)}


def test_unknown_units_count_as_kg(spark):
    df = spark.createDataFrame([(500, " Gramos "), (3, "atado"), (2, None)], "q long, u string")
    assert [r[0] for r in df.select(S.to_kg(F.col("q"), F.col("u"))).collect()] == [0.5, 3.0, 2.0]


def test_restaurants_without_rows(wh):
    rows = {r["id_restaurante"]: r for r in bi.restaurant_comparison(wh).collect()}
    assert rows[1]["ventas"] == 150.0 and rows[2]["ventas"] == 0.0 and rows[2]["porcentaje"] == 0.0 and rows[2]["distrito"] == ""


def test_permissions(spark):
    cases = [("Administrador", "x", "eliminar", True), ("Gerente", "ventas", "crear", True), ("Trabajador", "platos", "crear", False),
             ("Analista", "usuarios", "ver", False), ("Nadie", "ventas", "ver", False)]
    df = spark.createDataFrame(cases, "r string, m string, a string, ok boolean")
    assert df.filter(listing.has_permission(F.col("r"), F.col("m"), F.col("a")) != F.col("ok")).count() == 0


def test_validations(spark):
    df = spark.createDataFrame([("a@b.pe", "20123456789", "", "x", "0", "secreto"), ("a@b", "123", "12", " ", "-1", "corto"), (None,) * 6],
                               "c string, r string, t string, v string, n string, p string")
    out = df.select(S.valid_email(F.col("c")), S.valid_tax_id(F.col("r")), S.valid_phone(F.col("t")), S.not_blank(F.col("v")),
                    S.not_negative(F.col("n")), S.valid_password(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [(True,) * 6, (False,) * 6, (False, False, True, False, False, False)]


def test_texts(spark):
    df = spark.createDataFrame([(1234.5, HOY, "Ñandú — 5°")], "x double, d date, t string")
    r = df.select(S.money_text(F.col("x")), S.date_text(F.col("d")), S.fold_latin(F.col("t")), S.weekday_name(S.weekday(F.col("d"))),
                  S.month_name(F.month("d")), S.parse_date(F.lit("x")), S.parse_number(F.lit("1.5"))).first()
    assert tuple(r) == ("S/ 1,234.50", "30/06/2026", "Nandu - 5o", "Martes", "Junio", None, 1.5)


def test_month_layout_round_trip(spark, wh, tmp_path):
    names = ["platos", "ventas", "detalle_ventas", "desperdicios", "producciones"]
    write_warehouse(wh, str(tmp_path), names)
    stored = ParquetWarehouse(spark, str(tmp_path), AsOf(HOY), AsOf(NOW), tables=names)
    assert sorted(map(tuple, bi.top_dishes(stored).collect())) == sorted(map(tuple, bi.top_dishes(wh).collect()))
    plan = bi.daily_sales(stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "mes" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "ventas" not in bi.top_dishes(stored)._jdf.queryExecution().optimizedPlan().toString().replace("detalle_ventas", "")


def test_writer_stores_every_row_and_refuses_absent_tables(spark, tmp_path):
    trade = TradeWarehouse(spark, "/root/testdata/sf0.001")
    write_warehouse(trade, str(tmp_path), list(TABLES[:-1]))
    stored = ParquetWarehouse(spark, str(tmp_path), trade.as_of, trade.now, tables=list(TABLES[:-1]))
    for name in TABLES[:-1]:
        assert getattr(stored, name).count() == trade.table(name).count() > 0, name
    assert stored.detalle_ventas.filter("categoria IS NULL OR fecha IS NULL").count() == 0
    assert rules.current_states(stored.cambios_alerta).count() == rules.current_states(trade.cambios_alerta).count()
    with pytest.raises(KeyError):
        write_warehouse(Warehouse(spark, {}), str(tmp_path), ["platos"])
    with pytest.raises(KeyError):
        trade.table("plato")


def test_states_of_the_same_moment_do_not_depend_on_row_order(spark):
    rows = [(1, NOW, "leida"), (1, NOW, "pendiente"), (1, NOW - dt.timedelta(hours=1), "resuelta")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "id_alerta long, momento timestamp, estado string")
        assert rules.current_states(frame).first()["estado"] == "leida"


def test_exports(spark, wh, tmp_path):
    out = export.export_bundle({"Un nombre de hoja con mas de treinta y un letras": bi.daily_sales(wh), "vacio": wh.bitacora}, str(tmp_path))
    assert list(out) == ["Un nombre de hoja con mas de treinta y un letras", "vacio"]
    with pytest.raises(ValueError):
        export.export_bundle({"a/b": wh.bitacora, "a_b": wh.bitacora}, str(tmp_path))
    assert spark.read.option("header", True).csv(out["vacio"]).first()["info"] == "Sin datos"
    assert spark.read.option("header", True).csv(list(out.values())[0]).count() == 2


def test_seed_is_idempotent(spark, wh):
    rows = spark.createDataFrame([(9, "Uno"), (10, "Tres")], "id_restaurante long, nombre string")
    missing = listing.seed_missing(wh.restaurantes, rows, ["nombre"])
    assert [r["nombre"] for r in missing.collect()] == ["Tres"]
    assert listing.seed_missing(wh.restaurantes.select("nombre").unionByName(missing.select("nombre")), rows, ["nombre"]).count() == 0


def test_states_of_one_moment_follow_their_order(spark):
    """Of several changes at one moment the last in the order of states counts, not the last by name."""
    moment = dt.datetime(2026, 1, 1)
    for states in (["pendiente", "leida"], ["leida", "pendiente"], ["resuelta", "leida", "pendiente"]):
        rows = spark.createDataFrame([(1, s, moment) for s in states], "id_alerta long, estado string, momento timestamp")
        assert rules.current_states(rows).first()["estado"] == max(states, key=["pendiente", "leida", "resuelta"].index)
