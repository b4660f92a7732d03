"""Names of the registered queries and the operator each one runs on a warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wastelens.asof import in_period, today
from wastelens.functions import constants as K
from wastelens.operators import bi, cleaning, common, eda, footprint, listing, metrics, naive, plan, replenish, rules, series, tests_stat
from wastelens.plans.model_queries import MODELS
from wastelens.session import cut_lineage
from wastelens.sources.trade_tables import CO2_BY_WORD, WATER_BY_WORD

BI: dict[str, Callable[..., DataFrame]] = {
    "a01_kpis": bi.kpis,
    "a02_summary": bi.summary,
    "a03_daily_sales": bi.daily_sales,
    "a04_monthly_sales": bi.monthly_sales,
    "a05_monthly_waste": bi.monthly_waste,
    "a06_waste_by_reason": bi.waste_by_reason,
    "a07_efficiency": bi.efficiency,
    "a12_savings": bi.savings,
    "a13_daily_summary": bi.daily_summary,
    "a13_daily_summaries": bi.daily_summaries,
    "a14_weekly_summary": bi.weekly_summary,
    "a15_day_tickets": bi.tickets_of_day,
    "a15_day_waste": bi.waste_of_day,
    "a15_day_totals": lambda wh: bi.sales_and_waste(wh, lambda df: in_period(df, wh.as_of, first=today, last=today)),
    "a16_week_days": bi.weekly_sales_days,
    "a16_week_top": bi.weekly_top,
    "a16_week_total": bi.weekly_sales_total,
    "a17_month_waste": bi.monthly_waste_report,
    "a17_month_reasons": bi.monthly_waste_reasons,
    "a18_executive_totals": bi.executive_totals,
    "a18_executive_top": bi.executive_top,
    "a19_top_waste_dishes": bi.top_waste_dishes,
    "a19_week_waste_totals": bi.week_waste_totals,
    "a20_month_context": bi.month_context,
    "j11_restaurant_comparison": bi.restaurant_comparison,
    "t01_top_dishes": bi.top_dishes,
    "t02_top_reasons_with_cost": bi.top_reasons_with_cost,
    "r14_waste_over_limit": lambda wh: bi.waste_over_limit(wh, limit=0.05),
}

LISTING: dict[str, Callable[..., DataFrame]] = {
    "p01_active_dishes": listing.active_dishes,
    "p02_recent_waste": listing.recent_waste,
    "p03_week_tickets": listing.week_tickets,
    "p04_previous_production": listing.previous_production,
    "p05_to_date_tickets": listing.to_date_tickets,
    "p06_stock_flags": replenish.stock_flags,
    "p07_expiring": lambda wh: replenish.expiring(wh).select("id_insumo", "nombre", "fecha_vencimiento", "dias"),
    "p08_expiry_status": replenish.expiry_status,
    "p09_filtered_alerts": lambda wh: listing.filtered_alerts(wh, [K.LOW_DEMAND, K.HIGH_WASTE], "leida"),
    "p10_dish": lambda wh: listing.dish(wh, 7),
    "p11_ingredient_values": listing.ingredient_values,
    "p13_ticket_lines": listing.ticket_lines,
    "p14_ticket_pricing": listing.ticket_pricing,
    "p15_permission_audit": listing.permission_audit,
    "p16_contact_quality": listing.contact_quality,
    "p17_waste_listing": listing.waste_listing,
    "p17_production_listing": listing.production_listing,
    "p17_recipe_listing": listing.recipe_listing,
    "p18_over_limit_dishes": listing.over_limit_dishes,
    "p19_ingredient_in_restaurant": lambda wh: replenish.ingredient_in_restaurant(wh, wh.platos.select(
        "id_plato", "id_restaurante",
        F.concat(F.lit("Supplier#"), F.lpad((F.col("id_plato") % 100).cast("string"), 9, "0")).alias("insumo"))),
    "t04_latest_tickets": listing.latest_tickets,
    "t04_audit_report": listing.audit_report,
    "t06_audit_log": lambda wh: listing.audit_log(wh, module="ventas", result="exito"),
    "f08_text_formats": listing.text_formats,
    "s02_sales_lines": listing.sales_lines,
    "s03_dish_transactions": lambda wh: listing.sales_lines(wh, 7),
    "j02_production_by_dish": listing.production_by_dish,
    "j03_waste_by_category": listing.waste_named,
    "j12_units_by_name": common.units_by_name,
}

OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "j04_unsold_dishes": lambda wh: rules.demand_change(wh).filter("ventas_recientes = 0").select("id_plato", "nombre"),
    "j06_low_and_costly": lambda wh: rules.combined_risk(wh).select("id_plato"),
    "j07_demand_change": lambda wh: rules.demand_change(wh).withColumn("caida", F.round("caida", 4)).drop("estado"),
    "j08_ingredient_need": lambda wh: replenish.ingredient_need(wh).withColumn("necesario", F.round("necesario", 4)),
    "j09_item_factors": lambda wh: footprint.item_factors(wh, CO2_BY_WORD, WATER_BY_WORD),
    "u03_active_minus_sold": lambda wh: wh.platos.filter("estado").select("id_plato").subtract(
        common.dated_lines(wh, lambda v: bi.trailing(v, wh.as_of, 30)).select("id_plato")),
    "a08_purchase_list": replenish.purchase_list,
    "a08_purchase_totals": replenish.purchase_totals,
    "a09_orders_by_supplier": replenish.orders_by_supplier,
    "a10_footprint_totals": lambda wh: footprint.footprint_totals(wh, 30, CO2_BY_WORD, WATER_BY_WORD),
    "a11_footprint_by_category": lambda wh: footprint.footprint_by_category(wh, 30, CO2_BY_WORD, WATER_BY_WORD),
    "r01_overproduction": rules.overproduction,
    "r02_expiring_soon": rules.expiring_soon,
    "r03_overstock": rules.overstock,
    "r04_low_demand": rules.low_demand,
    "r05_high_waste": rules.high_waste,
    "r06_unsold": rules.unsold,
    "r07_combined_risk": rules.combined_risk,
    "r07_combined_risk_history": rules.combined_risk_history,
    "u01_generate_alerts": rules.generate_alerts,
    "f15_alerts_with_context": lambda wh: rules.generate_alerts(wh, weather=3, event=2),
    "a32_run_summary": rules.run_summary,
    "j05_cooled_down": rules.cooled_down,
    "r08_dish_risk": rules.dish_risk,
    "r09_active_alerts": rules.active_alerts,
    "r10_current_states": lambda wh: rules.current_states(wh.cambios_alerta),
    "a38_counts_by_level": lambda wh: rules.counts_by_level(wh.alertas.filter("estado = 'pendiente'")),
    "r11_recommendations": rules.recommendations,
    "a39_recommendations_by_severity": rules.recommendations_by_severity,
    "r12_dashboard_alerts": rules.dashboard_alerts,
    "r13_to_notify": rules.to_notify,
    "s16_outbox_to_resend": lambda wh: rules.to_resend(
        rules.waste_outbox(wh, 0.05, delivered=F.dayofmonth("fecha") % 3 != 0)),
}



def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


PAST = ["cantidad", *[f"lag_{k}" for k in series.LAGS], *[f"media_movil_{w}" for w in series.MEANS]]


def _daily(wh) -> DataFrame:
    """Continuous daily series per dish category."""
    return series.continuous(series.daily_series(wh))


def _lines(wh) -> int:
    """How many ticket lines there are: Parquet files say it in their footers."""
    return wh.detalle_ventas.count()


def _features(wh) -> DataFrame:
    return series.enriched(series.daily_demand(wh), wh.platos)


def _future(wh) -> DataFrame:
    reference = series.last_week_mean(_daily(wh)).join(
        series.category_codes(wh.platos).withColumnRenamed("categoria", "serie"), "serie")
    return series.future_rows(reference, F.col("fin"), 7).drop("fin")


SERIES: dict[str, Callable[..., DataFrame]] = {
    "c01_clean": lambda wh: cleaning.clean(cleaning.raw_transactions(wh), ["linea"], _lines(wh)),
    "c01_cleaning_warnings": lambda wh: cleaning.cleaning_warnings(cleaning.raw_transactions(wh), _lines(wh)),
    "t08_keep_first": lambda wh: wh.detalle_ventas.groupBy("id_venta", "id_plato").agg(F.min("linea").alias("linea")),
    "a21_daily_demand": series.daily_demand,
    "a22_daily_series": series.daily_series,
    "a22_brand_series": lambda wh: series.daily_series(wh, "marca"),
    "a23_descriptive": lambda wh: eda.descriptive(_daily(wh)),
    "a24_null_counts": lambda wh: cleaning.null_counts(wh.desperdicios, ["id_restaurante"]),
    "a24_null_counts_lines": lambda wh: cleaning.null_counts(listing.sales_lines(wh), ["categoria"]),
    "a25_duplicates": lambda wh: cleaning.duplicate_count(listing.sales_lines(wh), ["categoria"], _lines(wh)),
    "a26_histogram": lambda wh: eda.histogram(_daily(wh)),
    "a27_by_weekday": lambda wh: eda.by_weekday(_daily(wh)),
    "a28_by_month": lambda wh: eda.by_month(_daily(wh)),
    "a29_correlations": lambda wh: eda.correlations(_features(wh), "categoria", complete=eda.KNOWN),
    "a30_code_counts": lambda wh: eda.code_counts(_features(wh), "categoria"),
    "a31_coverage": lambda wh: eda.coverage(listing.sales_lines(wh), "categoria"),
    "a34_signature": lambda wh: series.signature(common.dated_lines(wh), ["id_plato"]),
    "a39_box_positions": lambda wh: eda.box_positions(_daily(wh)),
    "c02_continuous": lambda wh: _rounded(_daily(wh), "cantidad"),
    "c03_lags_and_means": lambda wh: _rounded(series.lags_and_means(_daily(wh)), *PAST),
    "c04_scaler_parameters": lambda wh: _rounded(series.scaler_parameters(
        series.chronological_split(series.lags_and_means(_daily(wh))), PAST), "media", "escala"),
    "c05_prepared": lambda wh: series.prepared(wh).select(
        "serie", "fecha", "idx", "bloque", *[F.round(f"{c}_esc", 4).alias(f"{c}_esc") for c in PAST]),
    "c05_warnings": lambda wh: series.preparation_warnings(_daily(wh)),
    "c06_features": lambda wh: _rounded(_features(wh), "ventas_7d"),
    "c07_future_rows": lambda wh: _rounded(_future(wh), "ventas_7d"),
    "c08_eda_bundle": lambda wh: eda.bundle(listing.sales_lines(wh), _daily(wh), "categoria"),
    "c08_eda_complete": lambda wh: eda.complete_bundle(listing.sales_lines(wh), _daily(wh), _features(wh), "categoria", _lines(wh)),
    "c09_outliers": lambda wh: eda.outliers(_daily(wh)),
    "w01_trailing_mean": lambda wh: _rounded(series.trailing_mean(series.daily_demand(wh)), "ventas_7d").select(
        "fecha", "id_plato", "ventas_7d"),
    "w05_split": lambda wh: series.chronological_split(_daily(wh)).select("serie", "fecha", "idx", "bloque"),
    "w06_holdout": lambda wh: series.holdout_split(_daily(wh)).select("serie", "fecha", "n_train", "es_test"),
    "w07_tuning_split": lambda wh: series.tuning_split(_daily(wh)).select(
        "serie", "fecha", (F.col("idx") <= F.col("n_train")).alias("es_train")),
    "w08_folds": lambda wh: series.fold_table(_daily(wh)),
    "w09_last_week_mean": lambda wh: _rounded(series.last_week_mean(_daily(wh)), "ventas_7d"),
}



def _holdout(wh) -> DataFrame:
    return naive.holdout_predictions(_daily(wh))


def _scores(wh) -> DataFrame:
    return metrics.score(_holdout(wh), ["serie", "modelo"])


def _best_of(predictions: DataFrame) -> DataFrame:
    scores = metrics.score(predictions, ["serie", "modelo"])
    return metrics.winners(scores, ["serie"]).select("serie", F.col("modelo").alias("ganador"))


def _pairs(wh) -> DataFrame:
    """The predictions are written once: winner, pairs and ranks all read them."""
    predictions = cut_lineage(_holdout(wh), "pronosticos")
    return tests_stat.pairs_with_best(tests_stat.errors(predictions), _best_of(predictions))


def _tests(wh) -> DataFrame:
    predictions = cut_lineage(_holdout(wh), "pronosticos")
    return tests_stat.all_tests(predictions, _best_of(predictions))


def _fold_scores(wh) -> DataFrame:
    return metrics.score(naive.fold_predictions(_daily(wh)), ["serie", "modelo", "fold"])


def _fold_slices(wh) -> DataFrame:
    """Transactions inside the training range of every fold, per fold. Lines are counted per
    (series, day) before they meet the folds of their own series."""
    days = listing.sales_lines(wh).groupBy(F.col("categoria").alias("serie"), "fecha").agg(
        F.count("*").alias("t"), F.sum("cantidad").alias("q"))
    inside = F.col("fecha").between(F.col("fecha_inicio_train"), F.col("fecha_fin_train"))
    return days.join(series.fold_table(_daily(wh)), "serie").filter(inside).groupBy("serie", "fold").agg(
        F.sum("t").cast("long").alias("transacciones"), F.sum("q").cast("long").alias("unidades"))


def _holm_over_folds(wh) -> DataFrame:
    """Friedman test per fold, adjusted within each series."""
    folds = naive.fold_predictions(_daily(wh))
    key = F.concat_ws("|", "serie", F.col("fold").cast("string"))
    tests = tests_stat.friedman(tests_stat.errors(folds.withColumn("serie", key)))
    parts = F.split("serie", "[|]")
    tests = tests.select(parts[0].alias("serie"), parts[1].cast("int").alias("fold"), parts[1].alias("modelo_b"), "p_valor")
    return tests_stat.holm(tests, ["serie"]).select("serie", "fold", "p_valor", "p_valor_ajustado")


def _window_search(wh) -> DataFrame:
    candidates = naive.window_candidates(series.tuning_split(_daily(wh)), [1, 3, 7, 14, 28])
    scored = metrics.score(candidates, ["serie", "ventana"])
    return scored.groupBy("serie").agg(F.min_by("ventana", F.struct("mae", "ventana")).alias("ventana"), F.min("mae").alias("mae"))


FORECAST: dict[str, Callable[..., DataFrame]] = {
    "j13_aligned_errors": lambda wh: _rounded(_pairs(wh), "ec", "eg"),
    "j14_fold_slices": _fold_slices,
    "e06_holdout_scores": _scores,
    "e06_fold_scores": _fold_scores,
    "a33_across_folds": lambda wh: metrics.across_folds(_fold_scores(wh), ["serie", "modelo"]),
    "m13_holdout_predictions": lambda wh: _rounded(_holdout(wh), "y", "yhat", "previo"),
    "m16_window_search": _window_search,
    "m18_fold_predictions": lambda wh: _rounded(naive.fold_predictions(_daily(wh)), "y", "yhat", "previo"),
    "w10_model_ranking": lambda wh: metrics.ranked(_scores(wh), ["serie"]).select("serie", "modelo", "mae", "posicion"),
    "w11_winners": lambda wh: _best_of(_holdout(wh)),
    "w13_friedman_ranks": lambda wh: tests_stat.friedman_ranks(tests_stat.errors(_holdout(wh))).select(
        "serie", "modelo", "fecha", "rango"),
    "w15_dm_statistic": lambda wh: _rounded(tests_stat.dm_statistic(_pairs(wh)).drop("sin_varianza"), "dm"),
    "w14_wilcoxon_statistic": lambda wh: tests_stat.wilcoxon_statistic(_pairs(wh)),
    "e08_friedman": lambda wh: tests_stat.friedman(tests_stat.errors(_holdout(wh))).select(
        "serie", "n", "estadistico", "p_valor", "significativo"),
    "e07_diebold_mariano": lambda wh: tests_stat.diebold_mariano(_pairs(wh)),
    "e09_wilcoxon": lambda wh: tests_stat.wilcoxon(_pairs(wh)),
    "e10_holm": _holm_over_folds,
    "e11_winner_text": lambda wh: plan.winner_text(metrics.winners(_scores(wh), ["serie"])),
    "u04_all_tests": _tests,
    "f12_naive_plan": lambda wh: plan.production_plan(_holdout(wh), _scores(wh), ["serie", "modelo"]),
}

CATALOG: dict[str, Callable[..., DataFrame]] = {**BI, **LISTING, **OPERATIONS, **SERIES, **FORECAST, **MODELS}
