"""Seconds per headline query. Prints one JSON line.

Every query is built and run to the end into a sink that discards its rows. A small query runs
first, so that the start of the JVM is not charged to the first measurement.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "t01_top_dishes", "a01_kpis", "a03_daily_sales", "a13_daily_summaries", "j11_restaurant_comparison", "p14_ticket_pricing",
    "a08_purchase_list", "a10_footprint_totals", "u01_generate_alerts", "r08_dish_risk", "c01_clean", "c05_prepared",
    "c06_features", "c08_eda_bundle", "a29_correlations", "e06_fold_scores", "e08_friedman", "m03_arima_forecast",
    "m04_trend_forecast", "m05_holt_winters", "x01_stream_daily",
]


def main() -> None:
    from wastelens.plans.catalog import CATALOG
    from wastelens.session import build_session
    from wastelens.sources.trade_tables import TradeWarehouse

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        CATALOG[name](TradeWarehouse(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("p10_dish")
    times = {name: run(name) for name in HEADLINE}
    start = time.perf_counter()
    series = CATALOG["m18_walk_forward"](TradeWarehouse(spark, sf_dir)).select("serie").distinct().count()
    experiment = time.perf_counter() - start
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "walk_forward": {"series": series, "models": 5, "folds": 5, "seconds": round(experiment, 3),
                         "seconds_per_series": round(experiment / max(series, 1), 3)}}))
    spark.stop()


if __name__ == "__main__":
    main()
