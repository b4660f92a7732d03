"""The block recursion of the smoothing fit against the fold in SQL and a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wastelens.models import holt_winters as hw

KEY = ["serie"]


def block(lengths, seed=4):
    rng = np.random.default_rng(seed)
    return {f"s{i}": (20 + 5 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(0, 2, n)).tolist() for i, n in enumerate(lengths)}


def test_fitted_state_equals_the_fold(make_series):
    """Series of many lengths in one block: the state that the fit returns is that of the SQL recursion with its parameters."""
    rows = make_series(**block([1, 2, 6, 13, 14, 15, 29, 30, 31, 60, 61, 62, 90]))
    fitted = hw.fit(rows, KEY)
    again = hw.smoothed(hw.values(rows, KEY).join(fitted.select("serie", "alpha", "beta", "gamma", "phi").withColumnsRenamed(
        {c: f"p_{c}" for c in ("alpha", "beta", "gamma", "phi")}), "serie"), *[F.col(f"p_{c}") for c in ("alpha", "beta", "gamma", "phi")])
    want = {r["serie"]: r["f"] for r in again.collect()}
    for r in fitted.collect():
        f = want[r["serie"]]
        assert (r["l"], r["b"], r["sse"]) == pytest.approx((f["l"], f["b"], f["sse"])) and r["s"] == pytest.approx(f["s"])
    assert fitted.count() == 13


def test_the_coarse_grid_picks_the_smallest_error(make_series):
    rows = make_series(**block([20, 45]))
    for r in hw.fit(rows, KEY, refine=0).collect():
        phis = hw.PHIS if r["n"] >= hw.DAMPED_FROM else (1.0,)
        grid = [(a, b, g, p) for a in hw.ALPHAS for b in hw.BETAS for g in hw.GAMMAS for p in phis]
        own = hw.values(rows.filter(F.col("serie") == r["serie"]), KEY)
        errors = {c: hw.smoothed(own, *[F.lit(v) for v in c]).select("f.sse").first()[0] for c in grid[::5] + [(r["alpha"], r["beta"], r["gamma"], r["phi"])]}
        assert r["sse"] == pytest.approx(min(errors.values())) and (r["alpha"], r["beta"], r["gamma"], r["phi"]) in grid


def test_blocks_do_not_change_results(make_series, monkeypatch):
    rows = make_series(**block([40, 33, 50, 28, 41]))
    whole = {r["serie"]: r for r in hw.fit(rows, KEY).collect()}
    monkeypatch.setattr(hw, "BLOCK", 2)
    assert {r["serie"]: r for r in hw.fit(rows.repartition(1), KEY).collect()} == whole
    assert hw.fit(rows.limit(0), KEY).count() == 0
