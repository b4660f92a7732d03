"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

* Words are runs of non-blank characters with A-Z lowered; shingles are ``shingle`` words joined by one blank, repeats
  included, a text with fewer words being one shingle. A bit is 1 if it is set in over half the shingles' XXH64
  (UTF-8, seed 42). A text without words, null included, has fingerprint zero and is linked like any other.
* Distinct fingerprints, in order of their population counts, are cut into tiles of at most ``TILE``. Two tiles meet in one
  task unless their population counts differ beyond the radius; inside, strips of ``STRIP`` fingerprints are compared by exclusive-or and bit
  count, unless the counts of their four 16-bit quarters together differ beyond the radius (each differing bit changes one count by one).
  So every pair within the radius is found, and nothing else is linked.
* Copies share one fingerprint and enter once. A task hands on a spanning forest of its links, never all pairs, so
  a group of any size leaves at most one edge per fingerprint and pair of tiles.
* The number of tile pairs grows with the square of the number of distinct fingerprints; see README.
* Repeated rows share fingerprint and component. ``component_id`` is null only where every id of the component is null.
  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wastelens.llm import common, graph

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 32_768
STRIP = 256
BLOCK = 65_536  # hashes whose bits are counted at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    body = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(body, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - shingle + 1
    return np.fromiter(
        (digest(body[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[shingle - 1:].tolist(), strict=True)), np.uint64, last)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as a signed integer."""
    found = hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for low in range(0, len(found), BLOCK):
        part = found[low:low + BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def fingerprinted(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its column text turned into column ``name``, or kept beside it where ``name`` is new."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _quarter(fp: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))


def _tiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, held = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)

        def tile(part: np.ndarray) -> pa.RecordBatch:
            counts = np.bitwise_count(part.view(np.uint64))
            return pa.RecordBatch.from_arrays([
                pa.array([first + k], pa.int64()), pa.array([int(counts.min())], pa.int64()), pa.array([int(counts.max())], pa.int64()),
                pa.array([part.tobytes()], pa.binary())], names=["tile", "low", "high", "prints"])

        for batch in batches:
            held = np.concatenate((held, batch.column(0).to_numpy(zero_copy_only=False)))
            while len(held) >= size:
                yield tile(held[:size])
                held, k = held[size:], k + 1
        if len(held):
            yield tile(held)

    return run


def _boxes(prints: np.ndarray, strip: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest count of the whole and of each quarter, by strip."""
    quarters = np.stack([np.bitwise_count(prints)] + [np.bitwise_count((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4)], axis=1)
    cuts = np.arange(0, len(prints), strip)
    return np.minimum.reduceat(quarters, cuts).astype(np.int16), np.maximum.reduceat(quarters, cuts).astype(np.int16)


def links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, strip: int = STRIP) -> np.ndarray:
    """Edges (fingerprint, fingerprint) that connect what lies within the radius in ``a`` and ``b``, or in ``a`` alone."""
    own = b is None
    b = a if own else b
    low_a, high_a = _boxes(a, strip)
    low_b, high_b = _boxes(b, strip)
    parent = np.arange(len(a) if own else len(a) + len(b))
    shift = 0 if own else len(a)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for i in range(len(low_a)):
        gaps = np.maximum(np.maximum(low_b - high_a[i], low_a[i] - high_b), 0)
        near = np.flatnonzero((gaps[:, 0] <= radius) & (gaps[:, 1:].sum(axis=1) <= radius))
        rows = slice(i * strip, (i + 1) * strip)
        for j in near.tolist():
            if own and j < i:
                continue
            columns = slice(j * strip, (j + 1) * strip)
            of_a, of_b = parent[rows], parent[shift + columns.start:shift + columns.stop][:len(b[columns])]
            if (of_a == of_a[0]).all() and (of_b == of_a[0]).all():
                continue
            p, q = np.nonzero(np.bitwise_count(a[rows, None] ^ b[None, columns]) <= radius)
            found = np.stack((of_a[p], of_b[q]), axis=1)
            found = found[found[:, 0] != found[:, 1]]
            if not len(found):
                continue
            for x, y in np.unique(found, axis=0).tolist():
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            while (parent[parent] != parent).any():
                parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(parent)))
    every = a if own else np.concatenate((a, b))
    return np.stack((every[child], every[parent[child]]), axis=1).astype(np.uint64)


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a = np.frombuffer(x.as_py(), np.uint64)
                edges = links(a, np.frombuffer(y.as_py(), np.uint64) if y.is_valid else None, radius).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    return run


def linked(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(node, label) for the distinct fingerprints (column ``fp``) that have a neighbour within the radius."""
    fp = F.col("fp")
    ordered = prints.select("fp", F.bit_count(fp).alias("c"), *[_quarter(fp, k).alias(f"q{k}") for k in range(3)])
    ordered = ordered.repartitionByRange("c", "q0", "q1", "q2", "fp").sortWithinPartitions("c", "q0", "q1", "q2", "fp").select("fp")
    tiles = common.cut_lineage(ordered.mapInArrow(_tiles(tile), "tile long, low long, high long, prints binary"), "tiles")
    ranges = tiles.select("tile", "low", "high")
    reach = ranges.select(F.col("tile").alias("x"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("c"))
    spots = ranges.select(F.col("tile").alias("y"), F.explode(F.sequence("low", "high")).alias("c"))
    pairs = reach.join(spots, "c").filter("x <= y").select("x", "y").distinct()
    one = tiles.select(F.col("tile").alias("x"), F.col("prints").alias("a"))
    two = tiles.select(F.col("tile").alias("y"), F.col("prints").alias("b"))
    work = pairs.join(one, "x").join(two, "y").select("a", F.when(F.col("x") != F.col("y"), F.col("b")).alias("b"), "x", "y")
    spread = max(2, 4 * prints.sparkSession.sparkContext.defaultParallelism)
    work = work.repartition(spread, "x", "y").select("a", "b")
    return graph.components(work.mapInArrow(_linker(radius), "u long, v long"))


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """(_fp, label) for every distinct fingerprint of ``rows``."""
    prints = rows.select(F.col("fp")).distinct()
    groups = linked(prints, radius)
    return prints.join(groups, prints["fp"] == groups["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    rows = common.cut_lineage(fingerprinted(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "fingerprints")
    labels = common.cut_lineage(_labelled(rows, radius), "labels")
    lowest = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    components = labels.join(lowest, labels["_fp"] == lowest["fp"]).groupBy("label").agg(F.min("low").alias("component_id"))
    of_print = labels.join(components, "label").select("_fp", "component_id")
    return rows.join(of_print, rows["fp"] == of_print["_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, exactly one each, all columns unchanged.

    Rows are told apart by a number of their own, so repeated ids and null ids (which stand last) count as rows.
    """
    fp, number = common.fresh(docs.columns, "_fp"), common.fresh(docs.columns, "_number")
    whole = common.cut_lineage(fingerprinted(docs, fp, shingle).withColumn(number, F.monotonically_increasing_id()), "fingerprinted")
    rows = whole.select(F.col(fp).alias("fp"), F.struct(F.col("doc_id").isNull(), "doc_id", F.col(number).alias("number")).alias("place"))
    labels = _labelled(rows, radius)
    best = rows.groupBy("fp").agg(F.min("place").alias("place"))
    stay = best.join(labels, best["fp"] == labels["_fp"]).groupBy("label").agg(F.min("place").alias("place"))
    stay = stay.select(F.col("place.number").alias("_stays"))
    return whole.join(stay, whole[number] == stay["_stays"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
