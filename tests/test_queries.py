"""Registered queries against their SQL twins on the smallest tables, plans and streams."""

import datetime as dt
import random
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import compare, duck
from wastelens.operators import series
from wastelens.plans.catalog import CATALOG
from wastelens.sources.trade_tables import TradeWarehouse
from wastelens.streaming import jobs

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
SAMPLE = [
    "a02_summary", "a07_efficiency", "a14_weekly_summary", "a08_purchase_list", "a11_footprint_by_category", "p13_ticket_lines",
    "p15_permission_audit", "p16_contact_quality", "u01_generate_alerts", "a32_run_summary", "r11_recommendations", "c01_clean",
    "c02_continuous", "c06_features", "c08_eda_bundle", "a29_correlations", "e06_fold_scores", "w15_dm_statistic", "e08_friedman",
    "e10_holm", "s07_run_rows", "s12_generated_lines", "m04_design_sums", "x01_stream_daily", "x05_stream_sessions",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    verdict = compare(df.columns, df.collect(), con.sql(entry.oracle_sql()[name]))
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CATALOG) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_window_reaches_the_scan(spark):
    plan = plan_of(CATALOG["a03_daily_sales"](TradeWarehouse(spark, SMALL)))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_series_windows_never_use_one_partition(spark):
    wh = TradeWarehouse(spark, SMALL)
    for df in (series.prepared(wh), CATALOG["e06_fold_scores"](wh)):
        assert "SinglePartition" not in plan_of(df)


def test_no_cartesian_products(spark):
    heavy = {"m07_attention_forest", "m08_attention_boosting", "m09_stacked_hybrid", "m10_single_models", "m11_dish_forecast", "m12_three_models",
             "m13_five_models", "m13_future_plan", "m16_tuned_smoothing", "m18_walk_forward", "m19_experiment_tests"}
    written = ("x", "s05", "s06", "s09", "e07", "e09", "u04", "w14", "w15", "j13", "m01", "m02_arima", "m03_arima", "m04_trend", "m05_holt", "m06")
    wh = TradeWarehouse(spark, SMALL)
    for name, operator in CATALOG.items():
        if name in heavy or name.startswith(written):
            continue
        plan = plan_of(operator(wh))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "partes"))
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
        .parquet(str(tmp_path / "partes")).withColumn("ts", F.col("ts").cast("timestamp")))
    got = {(r["dia"], r["event_type"]): r["eventos"] for r in jobs.drain(jobs.daily_totals(stream, "40 days"), "prueba").collect()}
    full = events.groupBy(F.to_date("ts").alias("dia"), "event_type").count().collect()
    assert all(got[k] == n for k, n in (((r[0], r[1]), r[2]) for r in full) if k in got)


def test_hot_series_and_hot_dish_keep_every_row(spark, day):
    """One dish holds most lines: totals stay whole."""
    n = 30000
    lines = spark.range(n).select(
        F.col("id").alias("id_venta"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("id_plato"), F.lit(1).cast("long").alias("cantidad"),
        F.date_add(F.lit(day(0)), (F.col("id") % 40).cast("int")).alias("fecha"))
    from wastelens.asof import AsOf
    from wastelens.sources.warehouse import Warehouse
    wh = Warehouse(spark, {"detalle_ventas": lines}, AsOf(day(40)), AsOf(day(40)))
    daily = series.daily_series(wh, "id_plato")
    assert daily.agg(F.sum("cantidad")).first()[0] == n and daily.filter("serie = '0'").count() == 40


def test_cool_down_does_not_depend_on_files(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    results = []
    for files in (1, 8):
        root = str(tmp_path / f"log{files}")
        events.repartitionByRange(files, "ts").write.parquet(root)
        marks = str(tmp_path / f"marcas{files}")
        spark.createDataFrame([], events.schema).write.parquet(marks)
        read = lambda path: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        stream = read(root).union(read(marks)).withColumn("ts", F.col("ts").cast("timestamp"))
        out = jobs.drain(jobs.cooled_alerts(stream, late="40 days"), "pausa", marks)
        results.append(sorted(tuple(r) for r in out.collect()))
    assert results[0] == results[1]
    assert len(results[0]) > len({r[1:3] for r in results[0]})
    last: dict = {}
    for r in sorted(results[0], key=lambda r: r[3]):
        assert r[1:3] not in last or (r[3] - last[r[1:3]]).total_seconds() >= 24 * 3600
        last[r[1:3]] = r[3]


def by_rule(events, hours):
    last, out = {}, []
    for event_id, kind, user, ts in sorted(events, key=lambda r: (r[3], r[0])):
        key = (kind, user)
        if key not in last or ts - last[key] >= dt.timedelta(hours=hours):
            last[key] = ts
            out.append((event_id, kind, user, ts))
    return sorted(out)


def test_cool_down_agrees_with_the_rule_and_goes_on_from_its_checkpoint(spark, tmp_path):
    """Batches of several days in mixed order, a stop after half of them, a hot key, exact distances, equal times, keys without a user."""
    schema = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "event_type", "user_id", "ts").schema
    start, rng = dt.datetime(2026, 3, 1), random.Random(3)
    rows = [(i, "a" if i % 3 else "b", 1 if i % 2 else rng.randrange(5), start + dt.timedelta(minutes=rng.randrange(9 * 1440))) for i in range(900)]
    rows += [(900 + i, "c", None, start + dt.timedelta(hours=24 * i)) for i in range(8)]  # each exactly at the end of the pause
    rows += [(950 + i, "d", 7, start + dt.timedelta(hours=5)) for i in range(4)]  # equal times: the smallest id
    rng.shuffle(rows)
    root, marks, out = (str(tmp_path / name) for name in ("log", "marcas", "salida"))
    spark.createDataFrame([], schema).write.parquet(marks)

    def add(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(root)

    def run():
        read = lambda path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        stream = jobs.cooled_alerts(read(root).union(read(marks)).withColumn("ts", F.col("ts").cast("timestamp")), late="30 days")
        spark.conf.set(jobs.PROVIDER, jobs.ROCKSDB)
        try:
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-control").trigger(
                availableNow=True).start().awaitTermination()
        finally:
            spark.conf.unset(jobs.PROVIDER)

    for k in range(3):
        add(rows[150 * k:150 * (k + 1)])
    run()  # the query ends; the next one begins from its checkpoint
    for part in (rows[450:600], rows[600:]):
        add(part)
    run()
    spark.createDataFrame([(None, None, None, jobs.END)], schema).write.mode("append").parquet(marks)
    run()
    got = spark.read.parquet(out).select("event_id", "event_type", "user_id", "ts").collect()
    assert sorted(tuple(r) for r in got if r["event_type"] != "c") == by_rule([r for r in rows if r[1] != "c"], 24)
    assert sorted(r["event_id"] for r in got if r["event_type"] == "c") == list(range(900, 908))


def test_raw_lines_are_never_sorted_and_the_waste_scan_is_bounded(spark):
    wh = TradeWarehouse(spark, SMALL)
    for name in ("c01_clean", "t08_keep_first", "a29_correlations"):
        assert "SortAggregate" not in plan_of(CATALOG[name](wh)), name
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # the scan's list of filters is cut off at 100 characters
    try:
        assert "GreaterThanOrEqual(l_shipdate" in plan_of(CATALOG["a12_savings"](wh))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_calls_of_state_follow_the_buckets_not_the_keys():
    """A thousand users in two buckets of one slot: two waiting parts, two timers, and exact large ids beside a closing mark."""
    import types

    import pandas as pd

    class Held(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__
        get = lambda self: self.getValue(0)
        update = lambda self, value: self.updateValue(0, value)

    job, states, timers = jobs.CoolDown(24), {}, []
    job.init(types.SimpleNamespace(getValueState=lambda name, _: states.setdefault(name, Held()),
                                   getMapState=lambda name, *_: states.setdefault(name, Held()), registerTimer=timers.append))
    big = 2**60 + 1
    rows = [(big + 2 * i + k, "a", i, 0, i + k * jobs.BUCKET) for i in range(1000) for k in range(2)] + [(0, "", 0, 3 + jobs.MARK, 10**15)]
    list(job.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["event_id", *jobs.KEYS, "us"])]), None))
    assert len(states["esperan"]) == 2 and len(timers) == 2
    got = [r for at in sorted(timers) for frame in job.handleExpiredTimer((0,), None, types.SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
           for r in frame.itertuples(index=False)]
    assert [(r.event_id, r.usuario, r.us) for r in got] == [(big + 2 * i, i, i) for i in range(1000)]
    assert not states["esperan"] and not states["partes"]
