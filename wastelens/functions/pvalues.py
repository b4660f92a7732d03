"""Tail probabilities Spark SQL has no function for, as Arrow-batched scalar functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|N(0,1)| >= |z|)."""
    out = pd.Series(np.nan, index=z.index)
    ok = z.notna()
    out[ok] = _erfc(z[ok].abs().to_numpy() / math.sqrt(2)) if ok.any() else []
    return out.where(ok, None)


def _chi2_tail(x: float, dof: int) -> float:
    half = x / 2
    if dof % 2 == 0:
        term = total = 1.0
        for j in range(1, dof // 2):
            term *= half / j
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) * 2 / math.sqrt(math.pi)
    for j in range(dof // 2):
        total += math.exp(-half) * term
        term *= half / (j + 1.5)
    return total


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else _chi2_tail(a, int(d)) for a, d in zip(x, dof)], dtype="float64")


def _signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p of the smaller signed-rank sum, from the counts of subset sums of 1..n."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    return min(1.0, 2 * float(ways[: int(w) + 1].sum() / ways.sum()))


@F.pandas_udf(T.DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    """Exact up to 50 differences without ties or zeros, else normal with tie correction.

    ``ties`` is the sum of t^3 - t over the groups of equal absolute differences.
    """
    out = []
    for stat, count, tie, zero in zip(w, n, ties, zeros):
        if pd.isna(stat):
            out.append(None)
        elif count == 0:
            out.append(1.0)
        elif count <= 50 and tie == 0 and zero == 0:
            out.append(_signed_rank_exact(stat, int(count)))
        else:
            spread = math.sqrt((count * (count + 1) * (2 * count + 1) - tie / 2) / 24)
            z = (stat - count * (count + 1) / 4) / spread
            out.append(math.erfc(abs(z) / math.sqrt(2)))
    return pd.Series(out, dtype="float64")
