"""Regression trees, forests and boosting for many training sets at once, on binned features.

A training set is a *pool* (a fold, or all series), a *candidate* is a named ``Spec``; all trees of all candidates and pools grow
together. Features are binned once per pool at approximate quantiles. A tree splits where the weighted variance falls
most; bagging weights and feature subsets are hashes of (row, tree) and (tree, node), so a model depends on
its rows alone and not on partitions.

* Wide sets grow level by level: one job sums (weight, weight * label, weight * label ** 2) per (tree, node, feature, bin) inside each task,
  adds the sums up, and takes every node's best split by ``max_by``. A node with at most ``local_rows`` rows goes to one task
  with those rows, which grows the rest of its tree. Sets that are that small begin there: one job, some trees a task.
* Forests over coarse features grow from *cells* (``fit_cells``), rows of equal bins summed per tree: their work follows the cells, which
  the bins bound, and of the rows there is one pass that draws the weights.
* Boosting adds one tree after the other; wide sets carry the label and the fit so far with each row.
* Trees are rows of a table and stay in it. The driver holds the bin edges (features * 31 numbers a pool) and, of wide
  sets, the splits above local nodes: at most trees * rows / local_rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wastelens.operators.common import PART_ROWS, in_parts
from wastelens.session import cut_lineage

BINS = 32
QUANTILES = 4 * BINS
LOCAL_ROWS = 200_000
SPREAD = 16  # tasks that share the trees of one small set
BUCKET_ROWS = 100_000  # rows that are predicted together
LOCAL_CELLS = 8_000_000  # cells of one tree that a task holds, 20 bytes each beside their bins
DEEPEST = 30
SEED = 42
POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])  # unit mean
TREE = "candidate string, pool string, tree int, weight double, feature array<int>, cut array<double>, `left` array<int>, value array<double>, gain array<double>"
TREE_TYPE = pa.schema([("candidate", pa.string()), ("pool", pa.string()), ("tree", pa.int32()), ("weight", pa.float64()),
                       ("feature", pa.list_(pa.int32())), ("cut", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())),
                       ("value", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64()))])
KEYS = ["candidate", "pool", "tree"]


@dataclass(frozen=True)
class Spec:
    kind: str
    trees: int
    depth: int
    min_leaf: int = 1
    subset: str | None = None  # features a node may use: all, sqrt or log2 of their number
    rate: float = 1.0
    share: float = 1.0  # of the rows, per boosting round

    @property
    def boosted(self) -> bool:
        return self.kind == "gradient_boosting"


def spec(kind: str, **hp) -> Spec:
    """From the names of the search spaces. No ``max_depth`` (None) means ``DEEPEST``; ``min_samples_split`` asks half as many rows of each child."""
    depth = min(hp.get("max_depth") or DEEPEST, DEEPEST)
    leaf = max(hp.get("min_samples_leaf", 1), -(-hp.get("min_samples_split", 2) // 2), 1)
    if kind == "random_forest":
        return Spec(kind, hp.get("n_estimators", 150), depth if "max_depth" in hp else 10, leaf, hp.get("max_features"))
    if kind == "gradient_boosting":
        return Spec(kind, hp.get("n_estimators", 100), depth if hp.get("max_depth") else 4, leaf, None, hp.get("learning_rate", 0.08),
                    hp.get("subsample", 1.0))
    if kind == "decision_tree":
        return Spec(kind, 1, depth if hp.get("max_depth") else 8, leaf)
    raise ValueError(f"unknown tree model {kind!r}")


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of (id, salt) in [0, 1)."""
    with np.errstate(over="ignore"):
        z = ids.astype("i8").view("u8") + np.uint64((salt * 0x9E3779B97F4A7C15 + SEED) & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype("f8") * 2.0**-53


def bag(ids: np.ndarray, tree: int, s: Spec) -> np.ndarray:
    """How often each row enters a tree."""
    if s.kind == "random_forest" and s.trees > 1:
        return np.searchsorted(POISSON, _uniform(ids, tree + 1), side="right").astype("f8")
    if s.boosted and s.share < 1:
        return (_uniform(ids, tree + 1) < s.share).astype("f8")
    return np.ones(len(ids))


def allowed(paths: np.ndarray, tree: int, s: Spec, features: int) -> np.ndarray | None:
    """Features each node may split on; None for all. A node is named by its path, 1 at the root, 2p and 2p + 1 below p."""
    if s.subset is None:
        return None
    k = max(1, int(np.ceil({"sqrt": np.sqrt, "log2": np.log2}[s.subset](features))))
    draws = np.array([_uniform(paths * 1009 + f, -1 - tree) for f in range(features)]).T
    return draws <= np.sort(draws, axis=1)[:, k - 1:k]


def best_splits(sums: np.ndarray, s: Spec, may: np.ndarray | None) -> tuple:
    """Best (feature, bin, gain, left weight, left sum) of every node from sums[3, node, feature, bin]; feature -1 where none helps."""
    cw, cs = np.cumsum(sums[0], axis=2), np.cumsum(sums[1], axis=2)
    w, t, q = cw[:, :1, -1:], cs[:, :1, -1:], sums[2][:, 0].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = cs**2 / cw + (t - cs) ** 2 / (w - cw) - t**2 / w
    score[(cw < s.min_leaf) | (w - cw < s.min_leaf)] = -np.inf
    if may is not None:
        score[~may] = -np.inf
    flat = score.reshape(len(score), -1)
    at = flat.argmax(axis=1)
    gain = flat[np.arange(len(at)), at]
    f, b = np.divmod(at, score.shape[2])
    return np.where(gain > 1e-10 * q, f, -1), b, gain, cw[np.arange(len(at)), f, b], cs[np.arange(len(at)), f, b]


class Tree:
    """Arrays of one tree that grows; node 0 is the root."""

    def __init__(self, value: float, width: int = 0):
        self.width = width  # features
        self.feature, self.cut, self.left, self.value, self.gain = [-1], [0], [-1], [value], [0.0]

    def split(self, node: int, feature: int, cut: int, gain: float, left: float, right: float) -> int:
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.value)
        for v in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.value.append(v)
            self.gain.append(0.0)
        return self.left[node]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, s: Spec, tree: int, path: int = 1, depth: int = 0) -> Tree:
    """A tree, or the part of one below a node, over rows that fit into a task."""
    used = np.flatnonzero(w)
    y, w = y[used], w[used]
    return _grown(bins[used], [w, w * y, w * y * y], float(np.average(y, weights=w)) if len(used) else 0.0, s, tree, path, depth)


def _grown(bins: np.ndarray, parts: list[np.ndarray], value: float, s: Spec, tree: int, path: int = 1, depth: int = 0) -> Tree:
    """All nodes of a level at a time. ``parts``: weight, weight * label and weight * label ** 2 of each row; ``value``: of the first node."""
    width, out = bins.shape[1], Tree(value)
    columns, local = np.ascontiguousarray(bins.T), np.zeros(len(bins), "i4")
    nodes, paths = np.zeros(1, "i8"), np.array([path], "i8")
    while depth < s.depth and len(nodes) and len(local):
        sums = np.zeros((3, len(nodes), width, BINS))
        for feature, column in enumerate(columns):
            at = local * np.int32(BINS) + column
            for k, v in enumerate(parts if feature == 0 else parts[:2]):  # the squares are added up over one feature
                sums[k, :, feature] = np.bincount(at, v, len(nodes) * BINS).reshape(-1, BINS)
        f, b, gain, lw, ls = best_splits(sums, s, allowed(paths, tree, s, width))
        tw, ts = sums[0, :, 0].sum(axis=1), sums[1, :, 0].sum(axis=1)
        child = np.full(len(nodes), -1)
        for i in np.flatnonzero(f >= 0).tolist():
            child[i] = out.split(int(nodes[i]), int(f[i]), int(b[i]), float(gain[i]), ls[i] / lw[i], (ts[i] - ls[i]) / (tw[i] - lw[i]))
        stay = child[local] >= 0
        if not stay.all():
            columns, local, parts = columns[:, stay], local[stay], [v[stay] for v in parts]
        right = (columns[f[local], np.arange(len(local))] > b[local]).astype("i4")
        order = np.cumsum(child >= 0) - 1
        local = 2 * order[local].astype("i4") + right
        split = child >= 0
        nodes = np.stack([child[split], child[split] + 1], 1).ravel()
        paths = np.stack([2 * paths[split], 2 * paths[split] + 1], 1).ravel()
        depth += 1
    return out


def route(bins: np.ndarray, feature, cut, left) -> np.ndarray:
    """The node of every row at the end of its way down; cuts are bins or values, as the rows are."""
    feature, cut, left = (np.asarray(a) for a in (feature, cut, left))
    node = np.zeros(len(bins), "i8")
    while True:
        go = np.flatnonzero(left[node] >= 0)
        if not len(go):
            return node
        at = node[go]
        node[go] = left[at] + (bins[go, feature[at]] > cut[at])


def boost(bins: np.ndarray, y: np.ndarray, ids: np.ndarray, s: Spec) -> list[Tree]:
    """The first tree fits the label; every later one fits twice the rest (the slope of the squared error) and counts with the rate."""
    fit, out = np.zeros(len(y)), []
    for t in range(s.trees):
        tree = grow(bins, y if t == 0 else 2 * (y - fit), bag(ids, t, s), s, t)
        fit += (1.0 if t == 0 else s.rate) * np.array(tree.value)[route(bins, tree.feature, tree.cut, tree.left)]
        out.append(tree)
    return out


# ---- tables ----
def edges(rows: DataFrame, at_quantiles: bool = False) -> dict[str, list[np.ndarray]]:
    """Bin edges per pool and feature: between neighbouring values while there are few, else between quantiles, or at those that
    part the rows into ``BINS`` equal shares, as MLlib does."""
    asked = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = rows.select("pool", F.posexplode("x")).groupBy("pool", "pos").agg(
        F.percentile_approx("col", F.array(*[F.lit(a) for a in asked]), 10_000).alias("q")).collect()
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in found:
        values, step = np.unique(np.array(r["q"], "f8")), QUANTILES // BINS
        cuts = (values[1:] + values[:-1]) / 2
        if len(values) > BINS and at_quantiles:
            cuts = np.unique(np.array(r["q"][step:-1:step], "f8"))
        elif len(values) > BINS:
            values = np.unique(np.array(r["q"][::step], "f8"))[-BINS:]
            cuts = (values[1:] + values[:-1]) / 2
        out.setdefault(r["pool"], {})[r["pos"]] = cuts
    return {pool: [cuts[i] for i in sorted(cuts)] for pool, cuts in out.items()}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _bytes(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "u1").reshape(len(raw), -1)


def binned(rows: DataFrame, cuts: dict[str, list[np.ndarray]]) -> DataFrame:
    """Rows (pool, rid, label, x) with the bin of every feature as one byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pools, x = np.array(batch.column("pool").to_pylist()), _matrix(batch.column("x"))
            out = np.zeros(x.shape, "u1")
            for pool in np.unique(pools).tolist():
                own = pools == pool
                for i, c in enumerate(cuts[pool]):
                    out[own, i] = np.searchsorted(c, x[own, i], side="left")
            yield pa.RecordBatch.from_arrays(
                [batch.column("pool"), batch.column("rid"), batch.column("label"), pa.array([r.tobytes() for r in out], pa.binary())],
                names=["pool", "rid", "label", "bins"])

    return rows.select("pool", "rid", "label", "x").mapInArrow(run, "pool string, rid long, label double, bins binary")


def _row(candidate: str, pool: str, tree: int, weight: float, t: Tree, cuts: list[np.ndarray]) -> dict:
    real = [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]
    return {"candidate": candidate, "pool": pool, "tree": tree, "weight": weight, "feature": t.feature, "cut": real, "left": t.left,
            "value": [float(v) for v in t.value], "gain": t.gain}


def _weight(s: Spec, tree: int) -> float:
    if s.boosted:
        return 1.0 if tree == 0 else s.rate
    return 1.0 / s.trees


def _small(rows: DataFrame, specs: dict[str, Spec], cuts: dict, pools: list[str]) -> DataFrame:
    """Sets of at most local_rows rows: each task gets one set and its share of the trees of a candidate."""
    shares = [(name, k) for name, s in specs.items() for k in range(1 if s.boosted else min(s.trees, SPREAD))]
    units = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(k).alias("share")) for n, k in shares]))

    def run(key, table):
        candidate, pool, share = (k.as_py() for k in key)
        s, table = specs[candidate], table.sort_by("rid")
        bins, y, ids = _bytes(table["bins"]), table["label"].to_numpy(), table["rid"].to_numpy()
        if s.boosted:
            trees = list(enumerate(boost(bins, y, ids, s)))
        else:
            trees = [(t, grow(bins, y, bag(ids, t, s), s, t)) for t in range(share, s.trees, SPREAD)]
        return pa.Table.from_pylist([_row(candidate, pool, t, _weight(s, t), tree, cuts[pool]) for t, tree in trees], TREE_TYPE)

    keys = ["candidate", "pool", "share"]
    spread = rows.filter(F.col("pool").isin(pools)).select("pool", "rid", "label", "bins", units.alias("u")).select("u.*", "pool", "rid", "label", "bins")
    return spread.repartition(2 * len(shares) * len(pools), *keys).groupBy(*keys).applyInArrow(run, TREE)


# ---- wide sets ----
@dataclass
class Upper:
    """The splits of one tree above its local nodes, held by the driver, with the nodes still open and those left to a task: node -> (path, depth)."""
    tree: Tree
    open: dict[int, tuple[int, int]]
    local: dict[int, tuple[int, int]]


def _level(rows: DataFrame, upper: dict[tuple, Upper], specs: dict[str, Spec]) -> list:
    """Best split of every open node of every tree, from one pass over the rows."""
    of_pool: dict[str, list[tuple]] = {}
    for key, u in upper.items():
        if u.open:
            of_pool.setdefault(key[1], []).append(key)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # sums of this task, as many as open nodes
        for batch in batches:
            pools = np.array(batch.column("pool").to_pylist())
            for pool in np.unique(pools).tolist() if len(pools) else []:
                own = np.flatnonzero(pools == pool)
                if pool not in of_pool:
                    continue
                bins = _bytes(batch.column("bins").take(pa.array(own)))
                y, ids = (batch.column(c).to_numpy(zero_copy_only=False)[own] for c in ("label", "rid"))
                width = bins.shape[1]
                offset = bins.astype("i4") + np.arange(width, dtype="i4") * BINS
                for key in of_pool[pool]:
                    u = upper[key]
                    names = sorted(u.open)
                    node = route(bins, u.tree.feature, u.tree.cut, u.tree.left)
                    local = np.searchsorted(names, node).clip(max=len(names) - 1)
                    w = bag(ids, key[2], specs[key[0]]) * (np.array(names)[local] == node)
                    r = np.flatnonzero(w)
                    at = (local[r, None] * (width * BINS) + offset[r]).ravel()
                    sums = np.stack([np.bincount(at, np.repeat(v, width), len(names) * width * BINS)
                                     for v in (w[r], w[r] * y[r], w[r] * y[r] ** 2)])
                    held[key] = held[key] + sums if key in held else sums
        for key, sums in held.items():
            names = sorted(upper[key].open)
            width = sums.shape[1] // (len(names) * BINS)
            cell = np.flatnonzero(sums[0])
            node, rest = np.divmod(cell, width * BINS)
            feature, b = np.divmod(rest, BINS)
            n = len(cell)
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array([key[2]] * n, pa.int32()),
                pa.array(np.array(names, "i4")[node]), pa.array(feature.astype("i4")), pa.array(b.astype("i4")),
                *[pa.array(s[cell]) for s in sums]], names=[*KEYS, "node", "feature", "bin", "w", "s", "q"])

    sums = rows.mapInArrow(partial, "candidate string, pool string, tree int, node int, feature int, bin int, w double, s double, q double")
    node = [*KEYS, "node"]
    sums = sums.groupBy(*node, "feature", "bin").agg(*[F.sum(c).alias(c) for c in "wsq"])
    whole = W.partitionBy(*node, "feature")  # at most BINS rows
    running = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = sums.withColumns({"lw": F.sum("w").over(running), "ls": F.sum("s").over(running), "tw": F.sum("w").over(whole),
                              "ts": F.sum("s").over(whole), "tq": F.sum("q").over(whole)})
    rw, rs = F.col("tw") - F.col("lw"), F.col("ts") - F.col("ls")
    cells = cells.withColumn("gain", F.when(rw > 0, F.col("ls") ** 2 / F.col("lw") + rs**2 / F.when(rw > 0, rw) - F.col("ts") ** 2 / F.col("tw")))
    least = F.create_map(*[F.lit(x) for n, s in specs.items() for x in (n, float(s.min_leaf))])
    fits = (F.col("lw") >= least[F.col("candidate")]) & (rw >= least[F.col("candidate")])
    subsets = {n for n, s in specs.items() if s.subset}
    if subsets:  # the nodes' features, one row each; the driver knows the open nodes
        lists = [(*key, n, [int(f) for f in np.flatnonzero(allowed(np.array([path], "i8"), key[2], specs[key[0]], width)[0])])
                 for key, u in upper.items() if key[0] in subsets for n, (path, _) in u.open.items()
                 for width in [upper[key].tree.width]]
        may = rows.sparkSession.createDataFrame(lists, "candidate string, pool string, tree int, node int, may array<int>")
        cells = cells.join(may, node, "left")
        fits = fits & (F.col("may").isNull() | F.array_contains("may", F.col("feature")))
    usable = F.when(fits, F.col("gain"))
    # the larger gain wins; of equal gains the smaller feature, then the smaller bin
    rank = F.struct(F.coalesce(usable, F.lit(float("-inf"))).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    pick = F.struct("feature", "bin", F.coalesce(usable, F.lit(float("-inf"))).alias("gain"), "lw", "ls", "tw", "ts", "tq")
    return cells.groupBy(*node).agg(F.max_by(pick, rank).alias("p")).select(*node, "p.*").collect()


def _wide_trees(rows: DataFrame, keys: list[tuple], specs: dict[str, Spec], cuts: dict, local_rows: int) -> DataFrame:
    """Grow the trees ``keys`` (candidate, pool, number) over sets of any size."""
    upper = {}
    for key in keys:
        upper[key] = Upper(Tree(0.0, len(cuts[key[1]])), {0: (1, 0)}, {})
    while any(u.open for u in upper.values()):
        found = {(r["candidate"], r["pool"], r["tree"], r["node"]): r for r in _level(rows, upper, specs)}
        for key, u in upper.items():
            before, u.open = u.open, {}
            for node, (path, depth) in before.items():
                r, s = found.get((*key, node)), specs[key[0]]
                if r is None:  # no row drew a weight
                    continue
                if node == 0:
                    u.tree.value[0] = r["ts"] / r["tw"]
                if r["gain"] <= 1e-10 * r["tq"]:
                    continue
                left = u.tree.split(node, r["feature"], r["bin"], r["gain"], r["ls"] / r["lw"], (r["ts"] - r["ls"]) / (r["tw"] - r["lw"]))
                for child, p, n in ((left, 2 * path, r["lw"]), (left + 1, 2 * path + 1, r["tw"] - r["lw"])):
                    if depth + 1 < s.depth:
                        (u.open if n > local_rows else u.local)[child] = (p, depth + 1)
    of_pool: dict[str, list[tuple]] = {}
    for key in keys:
        of_pool.setdefault(key[1], []).append(key)

    def to_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pools = np.array(batch.column("pool").to_pylist())
            for pool in np.unique(pools).tolist() if len(pools) else []:
                own = batch.take(pa.array(np.flatnonzero(pools == pool)))
                bins, ids = _bytes(own.column("bins")), own.column("rid").to_numpy(zero_copy_only=False)
                for key in of_pool.get(pool, []):
                    u = upper[key]
                    node = route(bins, u.tree.feature, u.tree.cut, u.tree.left)
                    for n in u.local:
                        r = np.flatnonzero((node == n) & (bag(ids, key[2], specs[key[0]]) > 0))
                        if len(r):
                            part = own.take(pa.array(r))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([key[0]] * len(r)), part.column("pool"), pa.array([key[2]] * len(r), pa.int32()),
                                 pa.array([n] * len(r), pa.int32()), *[part.column(c) for c in ("rid", "label", "bins")]],
                                names=[*KEYS, "node", "rid", "label", "bins"])

    def below(key, table):
        candidate, pool, tree, node = (k.as_py() for k in key)
        s, table = specs[candidate], table.sort_by("rid")
        path, depth = upper[candidate, pool, tree].local[node]
        ids = table["rid"].to_numpy()
        part = grow(_bytes(table["bins"]), table["label"].to_numpy(), bag(ids, tree, s), s, tree, path, depth)
        row = _row(candidate, pool, tree, float(node), part, cuts[pool])
        return pa.Table.from_pylist([row], TREE_TYPE)

    def joined(key, table):
        """The upper part with every part grown below one of its nodes."""
        (candidate, pool, tree), parts = (k.as_py() for k in key), sorted(table.to_pylist(), key=lambda p: p["weight"])
        out = parts[0]
        for p in parts[1:]:
            at, shift = int(p["weight"]), len(out["value"]) - 1
            place = lambda i: at if i == 0 else i + shift  # noqa: B023, E731
            p["left"] = [place(i) if i >= 0 else -1 for i in p["left"]]
            for c in ("feature", "cut", "left", "value", "gain"):
                out[c][at] = p[c][0]
                out[c].extend(p[c][1:])
        return pa.Table.from_pylist([out | {"weight": _weight(specs[candidate], tree)}], TREE_TYPE)

    tops = rows.sparkSession.createDataFrame(
        [tuple(_row(*key, -1.0, u.tree, cuts[key[1]]).values()) for key, u in upper.items()], TREE)
    node = [*KEYS, "node"]
    parts = rows.mapInArrow(to_local, "candidate string, pool string, tree int, node int, rid long, label double, bins binary")
    parts = parts.groupBy(*node).applyInArrow(below, TREE)
    return cut_lineage(tops.unionByName(parts).groupBy(*KEYS).applyInArrow(joined, TREE), "arboles")


def _wide_boost(rows: DataFrame, name: str, s: Spec, pools: list[str], cuts: dict, local_rows: int) -> DataFrame:
    state, out = rows.select("pool", "rid", "bins", F.col("label").alias("goal"), F.lit(0.0).alias("fit"), "label"), None
    for t in range(s.trees):
        grown = _wide_trees(state, [(name, p, t) for p in pools], {name: s}, cuts, local_rows)
        trees = {r["pool"]: r for r in grown.collect()}  # one tree a pool, bounded by its depth
        plan = {p: (r["feature"], [int(np.searchsorted(cuts[p][f], c)) if f >= 0 else 0 for f, c in zip(r["feature"], r["cut"])],
                    r["left"], np.array(r["value"]) * r["weight"]) for p, r in trees.items()}
        state = cut_lineage(state.mapInArrow(_advance(plan), state.schema), "residuos")
        out = grown if out is None else out.unionByName(grown)
    return out


def _advance(plan: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goal, fit = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("goal", "fit"))
            pools, fit = np.array(batch.column("pool").to_pylist()), fit.copy()
            for pool in np.unique(pools).tolist() if len(pools) else []:
                own = np.flatnonzero(pools == pool)
                feature, cut, left, value = plan[pool]
                fit[own] += value[route(_bytes(batch.column("bins").take(pa.array(own))), feature, cut, left)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("pool"), batch.column("rid"), batch.column("bins"), batch.column("goal"), pa.array(fit), pa.array(2 * (goal - fit))],
                names=["pool", "rid", "bins", "goal", "fit", "label"])

    return run


def fit(rows: DataFrame, specs: dict[str, Spec], local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Trees of every candidate for every pool of the rows (pool, rid, label, x), written. ``rid`` names a row in its pool."""
    cuts = edges(rows)
    rows = cut_lineage(binned(rows, cuts), "cubetas")
    sizes = {r["pool"]: r["count"] for r in rows.groupBy("pool").count().collect()}
    small = sorted(p for p, n in sizes.items() if n <= local_rows)
    wide = sorted(p for p, n in sizes.items() if n > local_rows)
    parts = [_small(rows, specs, cuts, small)] if small else []
    if wide:
        own = rows.filter(F.col("pool").isin(wide))
        plain = {n: s for n, s in specs.items() if not s.boosted}
        if plain:
            parts.append(_wide_trees(own, [(n, p, t) for n, s in plain.items() for p in wide for t in range(s.trees)], plain, cuts, local_rows))
        parts += [_wide_boost(own, n, s, wide, cuts, local_rows) for n, s in specs.items() if s.boosted]
    if not parts:
        return rows.sparkSession.createDataFrame([], TREE)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out, "bosque")


# ---- cells ----
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches gathered to at least ``PART_ROWS`` rows; the last may be shorter."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= PART_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fit_cells(rows: DataFrame, s: Spec, local_cells: int | None = None) -> DataFrame | None:
    """The trees of a forest over one pool, as ``fit`` grows them, written; None where the rows have more than ``local_cells`` (``LOCAL_CELLS``) cells.

    Rows of equal bins are a cell. Every row draws its weights for all trees, next to the other rows of its cell, and every tree is grown
    by a task from the weights and weighted labels of its cells. Rows of equal ``rid`` share their draws. Labels must not be null.
    """
    if s.boosted:
        raise ValueError("a boosted tree needs the rows' fit so far")
    cuts = edges(rows, at_quantiles=True)
    rows = cut_lineage(binned(rows, cuts), "cubetas")
    cells = rows.groupBy("bins").count()
    size = cells.agg(F.count("*").alias("cells"), F.sum("count").alias("rows"), F.first("bins").alias("b")).first()
    if size["cells"] > (LOCAL_CELLS if local_cells is None else local_cells):
        return None
    if not size["cells"]:
        return rows.sparkSession.createDataFrame([], TREE)
    (pool,), width, parts = cuts, len(size["b"]), -(-size["rows"] // PART_ROWS)
    often = [r["bins"] for r in cells.filter(F.col("count") > PART_ROWS).collect()]  # fewer than parts; their rows are spread
    salt = F.when(F.col("bins").isin(often), F.pmod("rid", F.lit(parts))) if often else F.lit(None).cast("long")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            if table["label"].null_count:
                raise ValueError("labels must not be null")
            bins, y, ids = _bytes(table["bins"]), table["label"].to_numpy(), table["rid"].to_numpy()
            first = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]).any(axis=1)])
            names = bins[first]
            for t in range(s.trees):
                w = bag(ids, t, s)
                of_cell, label = np.add.reduceat(w, first), np.add.reduceat(w * y, first)
                in_bag = of_cell > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), *[pa.array([v[in_bag].tobytes()], pa.binary()) for v in (names, of_cell.astype("<u4"), label)]],
                    names=["tree", "bins", "w", "s"])

    def grown(key, table):
        (t,), pieces = (k.as_py() for k in key), sorted(table.to_pylist(), key=lambda p: (p["bins"], p["s"]))
        bins, w, label = (np.frombuffer(b"".join(p[c] for p in pieces), kind) for c, kind in (("bins", "u1"), ("w", "<u4"), ("s", "f8")))
        w = w.astype("f8")
        value = float(label.sum() / w.sum()) if len(w) else 0.0
        # the squares only tell a gain from rounding noise; those of the cells' means are at most those of the labels
        tree = _grown(bins.reshape(-1, width), [w, label, label * label / w], value, s, t)
        return pa.Table.from_pylist([_row("", pool, t, _weight(s, t), tree, cuts[pool])], TREE_TYPE)

    laid = in_parts(rows.select("bins", "rid", "label", salt.alias("salt")), ["bins", "salt"], size["rows"]).sortWithinPartitions("bins", "rid", "label")
    blocks = laid.drop("salt").mapInArrow(drawn, "tree int, bins binary, w binary, s binary")
    return cut_lineage(blocks.repartition(2 * s.trees, "tree").groupBy("tree").applyInArrow(grown, TREE), "bosque")


def scorer(trees: list) -> Callable[[Column], Column]:
    """A column function, features (array<double>) to prediction, from the rows of the trees of one candidate and pool."""
    ready = []
    for t in sorted(trees, key=lambda t: t["tree"]):
        feature, cut, left = (np.array(t[c]) for c in ("feature", "cut", "left"))
        leaf = left < 0  # leads to itself
        ready.append((np.where(leaf, 0, feature), np.where(leaf, np.inf, cut), np.where(leaf, np.arange(len(left)), left), np.array(t["value"]) * t["weight"]))

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        x = _matrix(x)
        flat, at, out = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for feature, cut, left, value in ready:
            node, before = np.zeros(len(x), "i8"), None
            while before is None or (node != before).any():
                before, node = node, left[node] + (flat[at + feature[node]] > cut[node])
            out += value[node]
        return pa.array(out)

    return run


def predict(rows: DataFrame, trees: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns of the rows (pool, x, ...), once per candidate, with ``candidate`` and ``prediction``.

    Rows are dealt to buckets of about ``BUCKET_ROWS``; every bucket gets the trees of its pool.
    """
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*carried), F.lit(buckets)).cast("int"))
    dealt = trees.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", candidate string, prediction double"

    def run(left, right):
        x = _matrix(left["x"])
        sums: dict[str, np.ndarray] = {}
        if len(left):
            for t in sorted(right.to_pylist(), key=lambda t: (t["candidate"], t["tree"])):
                value = np.array(t["value"])[route(x, t["feature"], t["cut"], t["left"])] * t["weight"]
                sums[t["candidate"]] = sums.get(t["candidate"], 0.0) + value
        own = left.select(carried)
        parts = [own.append_column("candidate", pa.array([c] * len(own), pa.string())).append_column("prediction", pa.array(v)) for c, v in sums.items()]
        return pa.concat_tables(parts) if parts else own.slice(0, 0).append_column("candidate", pa.array([], pa.string())).append_column(
            "prediction", pa.array([], pa.float64()))

    return rows.groupBy("pool", "bucket").cogroup(dealt.groupBy("pool", "bucket")).applyInArrow(run, schema)


def importances(trees: DataFrame) -> DataFrame:
    """Share of each feature in the gains of a candidate's trees, as (candidate, pool, feature, importance); a tree's shares add up to one first."""
    cells = trees.select("candidate", "pool", "tree", F.explode(F.arrays_zip("feature", "gain")).alias("g")).filter("g.feature >= 0")
    by_tree = cells.groupBy("candidate", "pool", "tree", F.col("g.feature").alias("feature")).agg(F.sum("g.gain").alias("gain"))
    share = F.col("gain") / F.sum("gain").over(W.partitionBy("candidate", "pool", "tree"))
    sums = by_tree.withColumn("gain", share).groupBy("candidate", "pool", "feature").agg(F.sum("gain").alias("gain"))
    return sums.select("candidate", "pool", "feature", (F.col("gain") / F.sum("gain").over(W.partitionBy("candidate", "pool"))).alias("importance"))
