"""Joins that spare null keys, sized broadcasts and numbering in blocks."""

import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.compare import compare, duck
import __spark_entry__ as entry
from wastelens.operators import common, listing
from wastelens.sources import generate
from wastelens.sources.trade_tables import TradeWarehouse

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_join_known_is_a_left_join(spark, no_broadcast):
    rows = spark.createDataFrame([(1, 1), (2, None), (3, 7), (4, None), (4, None), (5, 1)], "n int, k int")
    other = spark.createDataFrame([(1, "uno"), (2, "dos"), (None, "nada")], "k int, name string")
    got = common.join_known(rows, other, "k")
    want = rows.join(other, "k", "left").select("n", "k", "name")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert common.join_known(rows.limit(0), other, "k").collect() == []


def test_null_keys_are_not_shuffled(spark, tmp_path, no_broadcast):
    rows = spark.createDataFrame([(i, i if i % 3 == 0 else None) for i in range(300)], "n int, k int")
    other = spark.createDataFrame([(i, str(i)) for i in range(300)], "k int, name string")
    rows.write.parquet(str(tmp_path / "rows"))
    df = common.join_known(spark.read.parquet(str(tmp_path / "rows")), other, "k")
    known, passed = plan_of(df).split("\n   +- ", 1)  # the children of the union
    assert "IsNotNull(k)" in known and "Exchange" in known
    assert "IsNull(k)" in passed and "Exchange" not in passed


@tables
@pytest.mark.parametrize("name", ["p17_waste_listing", "s12_generated_waste", "p13_ticket_lines"])
def test_listing_equals_its_sql_without_broadcasts(spark, no_broadcast, name):
    df = entry.queries()[name](spark, SMALL)
    verdict = compare(df.columns, df.collect(), duck(SMALL).sql(entry.oracle_sql()[name]))
    assert verdict.startswith("ok"), verdict


@tables
def test_only_few_tickets_are_broadcast(spark, no_broadcast):
    wh = TradeWarehouse(spark, SMALL)
    few, many = (plan_of(listing.ticket_lines(wh, n)) for n in (200, listing.BROADCAST_TICKETS + 1))
    assert "BroadcastExchange" in few and "BroadcastExchange" not in many


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_numbering_in_blocks_equals_one_window(spark, block):
    ids = [*range(1, 12), 500, 501, 10**12, -5]
    rows = [(1, i, 1.0, 0.5) for i in ids] + [(2, 9, 1.0, 0.5)] + [(3, 2 * i, 1.0, 0.5) for i in range(40)]
    dishes = spark.createDataFrame(rows, "id_restaurante int, id_plato long, precio_venta double, costo_estimado double")
    whole = Window.partitionBy("id_restaurante")
    want = dishes.withColumns({"puesto": F.row_number().over(whole.orderBy("id_plato")) - 1, "platos": F.count("*").over(whole)})
    got = generate.numbered(dishes, block)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert generate.numbered(dishes.limit(0), block).collect() == []


def test_no_window_holds_all_dishes_of_a_restaurant(spark):
    dishes = spark.range(100).select(F.lit(1).alias("id_restaurante"), F.col("id").alias("id_plato"), F.lit(1.0).alias("precio_venta"), F.lit(0.5).alias("costo_estimado"))
    windows = [line for line in plan_of(generate.numbered(dishes)).splitlines() if re.search(r"\bWindow \[", line)]
    assert len(windows) == 2 and all("_n#" in w or "_pieza#" in w.split("windowspec")[1] for w in windows)
