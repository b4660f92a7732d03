"""Fixed (untrained) multi-head self-attention as a feature expansion of daily rows.

One group is the daily rows of one series (and fold): at most the days of the calendar, because
transactions were summed per day before. Inside a group the score matrix is formed in row
blocks, so memory grows with the length of the series and not with its square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wastelens.operators.series import FEATURES

CONTEXT, BLOCK, SEED = 200, 512, 42


def size_for(n: int) -> tuple[int, int]:
    """(heads, width) by the number of training rows."""
    for least, size in ((200, (4, 16)), (100, (4, 8)), (50, (2, 8))):
        if n >= least:
            return size
    return 2, 4


def projections(features: int, heads: int, width: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """Seeded normal matrices, drawn in the order queries, keys, values, output, feed-forward."""
    rng, scale = np.random.default_rng(seed), np.sqrt(2.0 / (features + width))
    shapes = {"q": (heads, features, width), "k": (heads, features, width), "v": (heads, features, width),
              "o": (heads * width, features), "f1": (features, 2 * features), "f2": (2 * features, features)}
    return {name: rng.normal(0, scale, shape) for name, shape in shapes.items()}


def _normalise(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + 1e-9)


def encode(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Every row attends to all rows of ``x``; residual, layer norm and feed-forward follow."""
    keys, vals = x @ w["k"], x @ w["v"]
    width = keys.shape[2]
    blocks = []
    for start in range(0, len(x), BLOCK):
        scores = (x[start:start + BLOCK] @ w["q"]) @ keys.transpose(0, 2, 1) / np.sqrt(width)
        weight = np.exp(np.maximum(scores - scores.max(axis=2, keepdims=True), -100))
        mixed = weight @ vals / (weight.sum(axis=2, keepdims=True) + 1e-9)
        blocks.append(np.concatenate(list(mixed), axis=1))
    out = _normalise(np.concatenate(blocks) @ w["o"] + x)
    return _normalise(np.maximum(out @ w["f1"], 0) @ w["f2"] + out)


def _expand(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scale on the training rows, attend, and append the attended columns as the array ``x``."""
    pdf = pdf.sort_values(["futuro", "fecha"])
    past = ~pdf["futuro"].to_numpy(dtype=bool)
    raw = pdf[FEATURES].fillna(0).to_numpy(dtype=float)
    if not past.any():
        return pdf.head(0).assign(x=None, media=None)[[*pdf.columns.difference(FEATURES, sort=False), "x", "media"]]
    spread = raw[past].std(axis=0)
    scaled = (raw - raw[past].mean(axis=0)) / np.where(spread == 0, 1.0, spread)
    heads, width = size_for(int(past.sum()))
    w = projections(len(FEATURES), heads, width)
    seen, ahead = scaled[past], scaled[~past]
    parts = [encode(seen, w)]
    if len(ahead):
        parts.append(encode(np.concatenate([seen[-CONTEXT:], ahead]), w)[-len(ahead):])
    out = pdf.drop(columns=FEATURES)
    out["x"] = np.concatenate([scaled, np.concatenate(parts)], axis=1).tolist()
    out["media"] = float(pdf["y"][past].mean())
    return out


def expanded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows(keys..., fecha, futuro, y, FEATURES)`` to ``keys..., fecha, futuro, y, x, media``."""
    kept = [f for f in rows.schema.fields if f.name not in FEATURES]
    schema = T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("media", T.DoubleType())])
    return rows.groupBy(*keys).applyInPandas(_expand, schema)
