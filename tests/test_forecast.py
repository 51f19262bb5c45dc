"""Forecasters on series whose future is known."""

from __future__ import annotations

import numpy as np
import pytest

from sparkpanel.operators import forecast as O

SEASONS = np.tile([1.0, -2.0, 0.5, 0.5], 10)


@pytest.mark.parametrize("name", sorted(O.FORECASTERS))
def test_pure_season_goes_on(name):
    got = O.FORECASTERS[name](10 + SEASONS, 4, {"alpha": 1e-6} if "ridge" in name else {})
    assert np.allclose(got, 10 + SEASONS[:4], atol=1e-3)


def test_trend_goes_on():
    y = np.arange(40) * 0.5
    assert np.allclose(O.ets(y, 4, {"trend": "add", "seasonal": "none"}), 20 + np.arange(4) * 0.5, atol=0.5)
    assert np.allclose(O.loess(y, 7), y)


def test_stl_splits_trend_and_season():
    y = np.arange(40) * 0.1 + SEASONS
    trend, seasonal, rest = O.stl(y)
    assert np.allclose(trend + seasonal + rest, y)
    assert np.abs(rest).max() < 0.2 and np.abs(seasonal - SEASONS).max() < 0.2


def test_walk_forward_rows_and_errors(spark):
    rows = [("a", k, float(10 + SEASONS[k])) for k in range(24)] + [("b", k, 1.0) for k in range(6)]
    got = O.walk_forward(spark.createDataFrame(rows, "sector string, t int, y double"), [("m", "seasonal_naive", {})], "sector", "t", "y").collect()
    a = [r for r in got if r["sector"] == "a"]
    assert len(a) == 16 and {r["fold_set"] for r in a} == {"inner", "outer"} and all(abs(r["y_pred"] - r["y_true"]) < 1e-9 and r["target_date"] > r["origin_date"] for r in a)
    assert [r["error"] for r in got if r["sector"] == "b"] == ["history too short"]
