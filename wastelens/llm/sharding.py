"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. On each level every child draws ``-ln(u) / weight`` with u hashed
from the child's name and the key, and the smallest draw wins; a child's weight is the sum of the
shards below it. A change of weights moves keys only into or out of the subtrees whose weights changed.

``tree(n)`` lays shards 0 to ``BASE - 1`` out in racks and regions of fixed size; every later shard is a region
of its own, so growing by one shard leaves the weights of all older subtrees as they are, and rows
move only into the new shard.

The draws of one document depend on its id and the tree alone. Null ids share one shard; repeated rows
share their shard and get a slot each. A null text has size 16 and checksum 0. An empty table gives an
empty result. Fixed expressions, no shuffle; only the slots need one, spread over buckets of the shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import common

SHARDS = 40
BASE = 40
SHARDS_PER_RACK = 2
RACKS_PER_REGION = 4
OVERHEAD = 16


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n: int, weights: dict[int, float] | None = None) -> list[Shard]:
    out = []
    for i in range(n):
        rack = i // SHARDS_PER_RACK
        region = f"r{rack // RACKS_PER_REGION}" if i < BASE else f"x{i}"
        out.append(Shard(region, f"{region}/k{rack if i < BASE else i}", i, (weights or {}).get(i, 1.0)))
    return out


def _children(shards: list[Shard]) -> tuple[Column, Column]:
    """Two constant maps: a subtree's name to its children (name, weight), and a leaf's name to its shard."""
    below: dict[str, dict[str, float]] = {}
    leaves = {}
    for s in (s for s in shards if s.weight > 0):
        leaf = f"{s.rack}/s{s.shard}"
        leaves[leaf] = s.shard
        for parent, child in (("", s.region), (s.region, s.rack), (s.rack, leaf)):
            weights = below.setdefault(parent, {})
            weights[child] = weights.get(child, 0.0) + s.weight
    literal = lambda c: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in c.items()])
    return (F.create_map(*[x for parent, c in below.items() for x in (F.lit(parent), literal(c))]),
            F.create_map(*[F.lit(x) for pair in leaves.items() for x in pair]))


def _pick(key: Column, children: Column, parent: Column) -> Column:
    """The child with the smallest draw; equal draws go to the smaller name."""
    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(child["name"], key), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(F.element_at(children, parent), draw))["name"]


def place(df: DataFrame, key: str, shards: list[Shard], out: str) -> DataFrame:
    """Add ``out``: the shard of each row's key."""
    children, leaves = _children(shards)
    node = F.lit("")
    for level in ("_region", "_rack", "_leaf"):
        df = df.withColumn(level, _pick(F.col(key), children, node))
        node = F.col(level)
    return df.withColumn(out, F.element_at(leaves, node)).drop("_region", "_rack", "_leaf")


def shard(docs: DataFrame, n: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = place(rows, "doc_id", tree(n, weights), "shard")
    rows = place(rows, "doc_id", tree(n + 1, weights), "grown_shard")
    rows = rows.withColumn("_order", F.xxhash64(F.lit("slot"), F.col("doc_id"))).withColumn(
        "_bucket", F.pmod(F.col("_order"), F.lit(common.BUCKETS)).cast("int"))
    rows = common.cut_lineage(rows, "sharding")
    rows = common.running_before(rows, "shard", "_bucket", ["_order", "doc_id", "size", "text_crc32"], F.lit(1).cast("long"), "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
