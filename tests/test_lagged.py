"""Lagged regressions by sums of products against least squares, series with holes, and known orders of differencing."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import lagged as G


def residual(x, y):
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())


def adf(y):
    """statistic, lags and critical value by least squares."""
    dy, n = np.diff(y), len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), max(0, n // 2 - 2))

    def design(lags, start):
        rows = np.arange(start, len(dy))
        return np.column_stack([y[rows], np.ones(len(rows)), *[dy[rows - k] for k in range(1, lags + 1)]]), dy[rows]

    def criterion(lags):
        x, t = design(lags, most)
        return len(t) * math.log(residual(x, t) / len(t)) + 2 * x.shape[1]

    lags = min(range(most + 1), key=criterion)
    x, t = design(lags, lags)
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    var = residual(x, t) / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]
    return b[0] / math.sqrt(var), lags, sum(c / len(t) ** k for k, c in enumerate(G.ADF_5))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    series = {"noise": rng.normal(size=200), "walk": rng.normal(size=200).cumsum() + 500, "short": rng.normal(size=14).cumsum(), "tiny": rng.normal(size=7), "twice": np.arange(200.0) ** 2 + rng.normal(size=200).cumsum().cumsum(), "season": rng.normal(size=200).cumsum() + np.tile([9.0, -9.0, 5.0, -5.0], 50), "ar": np.zeros(120)}
    for k in range(2, 120):
        series["ar"][k] = 0.5 * series["ar"][k - 1] + 0.3 * series["ar"][k - 2] + rng.normal()
    rows = [(s, k, float(v)) for s, y in series.items() for k, v in enumerate(y)]
    rows += [("hole", k, None if k == 20 else float(v)) for k, v in enumerate(rng.normal(size=60))] + [("ends", k, None if k in (0, 1, 59) else float(v)) for k, v in enumerate(rng.normal(size=60).cumsum())]
    return rows, spark.createDataFrame(rows, "sector string, t int, y double")


def test_adf_equals_least_squares(panel):
    rows, df = panel
    got = {r["sector"]: r for r in G.adf_test(df, "sector", "t", "y").collect()}
    assert set(got) == {"noise", "walk", "short", "twice", "season", "ar", "ends"}
    for s, r in got.items():
        stat, lags, critical = adf(np.array([y for k, _, y in rows if k == s and y is not None]))
        assert r["lags"] == lags and r["statistic"] == pytest.approx(stat, rel=1e-6, abs=1e-6) and r["critical"] == pytest.approx(critical)
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]


def test_orders(spark, panel):
    _, df = panel
    got = {r["sector"]: (r["d"], r["seasonal_d"]) for r in G.differencing_order(df, "sector", "t", "y").collect()}
    assert got["noise"] == (0, 0) and got["walk"][0] == 1 and got["twice"][0] == 2 and got["season"] == (1, 1) and "hole" not in got
    periods = spark.createDataFrame([("season", 4), ("walk", 1), ("twice", 7)], "sector string, period int")
    again = {r["sector"]: (r["d"], r["seasonal_d"]) for r in G.differencing_order(df, "sector", "t", "y", periods).collect()}
    assert again["season"] == (1, 1) and again["walk"] == (1, 0) and again["ends"][1] == 0


def test_granger_equals_least_squares(spark):
    rng, rows = np.random.default_rng(5), []
    data = {}
    for s in "abc":
        x = rng.normal(size=40).cumsum()
        y = np.concatenate([[0.0, 0.0], x[:-2]]) + rng.normal(size=40)
        data[s] = x, y
        rows += [(s, k, float(y[k]), float(x[k]), 2.0, None if s == "b" and k == 17 else float(x[k])) for k in range(40)]
    df = spark.createDataFrame(rows, "sector string, t int, y double, lead double, flat double, gap double")
    got = {(r["feature"], r["sector"], r["lag"]): r["p"] for r in G.granger_tests(df, ["lead", "flat", "gap"], "y", "sector", "t", 3).collect()}
    assert {k[0] for k in got} == {"lead", "gap"} and {k[1] for k in got if k[0] == "gap"} == {"a", "c"}
    for (f, s, lag), p in got.items():
        dx, dy = np.diff(data[s][0]), np.diff(data[s][1])
        n = len(dy) - lag
        own = np.column_stack([np.ones(n), *[dy[lag - k : len(dy) - k] for k in range(1, lag + 1)]])
        more = np.column_stack([own, *[dx[lag - k : len(dx) - k] for k in range(1, lag + 1)]])
        less, full, bottom = residual(own, dy[lag:]), residual(more, dy[lag:]), n - 2 * lag - 1
        stat = (less - full) / lag / (full / bottom)
        # chance by integration of the beta density over an angle
        u = (np.arange(200_000) + 0.5) / 200_000 * math.asin(math.sqrt(bottom / (bottom + lag * stat)))
        area = (2 * np.sin(u) ** (bottom - 1) * np.cos(u) ** (lag - 1)).mean() * math.asin(math.sqrt(bottom / (bottom + lag * stat)))
        want = area / math.exp(math.lgamma(bottom / 2) + math.lgamma(lag / 2) - math.lgamma((bottom + lag) / 2))
        assert p == pytest.approx(want, rel=1e-5, abs=1e-12)
    short = df.where("t < 9")
    assert G.granger(short, ["lead"], "y", "sector", "t").count() == 0


def test_sums_as_columns_and_as_rows_agree(spark, monkeypatch):
    df = spark.createDataFrame([(k % 2, float(k), float(k * k % 7)) for k in range(30)], "g int, a double, b double")
    columns = [F.lit(1.0), F.col("a"), F.col("b")]
    one = sorted(map(tuple, G.grams(df, ["g"], columns).collect()))
    monkeypatch.setattr(G, "COLUMNS", 1)
    assert sorted(map(tuple, G.grams(df, ["g"], columns).collect())) == one
    plan = G.granger(df.selectExpr("g AS sector", "a AS t", "b AS y", "a AS x"), ["x"], "y", "sector", "t")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
