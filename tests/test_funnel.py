"""The feature funnel and stationarity tests on data whose answer is known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import funnel as N
from sparkpanel.operators import lagged as G
from sparkpanel.operators import selection as K


def frame(spark, n=60):
    rng, rows = np.random.default_rng(5), []
    for s in "abc":
        x, noise = rng.normal(size=n).cumsum(), rng.normal(size=n)
        y = np.concatenate([[0.0], x[:-1]]) + rng.normal(size=n) * 0.1  # x leads y
        rows += [(s, k, float(y[k]), float(x[k]), float(noise[k]), 1.0, float(x[k] * 2), float(x[k])) for k in range(n)]
    return spark.createDataFrame(rows, "sector string, t int, y double, q_lead double, q_noise double, q_flat double, q_copy double, y_lead double")


def test_granger_finds_the_leader(spark):
    got = {r["feature"]: r for r in G.granger(frame(spark), ["q_lead", "q_noise"], "y", "sector", "t").collect()}
    assert got["q_lead"]["share"] == 1.0 and got["q_lead"]["retained"] and got["q_lead"]["n"] == 3


def test_lasso_meets_least_squares_without_penalty_and_selects(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, 0.0, -1.0] + rng.normal(size=200) * 0.01
    m = np.column_stack([np.ones(200), x, y])
    q, c, scale = N.standard(m.T @ m)
    assert np.allclose(N.lasso(q, c, 0.0) / scale, [2, 0, -1], atol=0.01)
    assert (N.lasso(q, c, 0.5)[[1]] == 0).all()
    got = {r["feature"]: r["share"] for r in N.lasso_stability(frame(spark), ["q_lead", "q_noise"], "y", "sector", "t", boots=10).collect()}
    assert got["q_lead"] == 1.0


def test_tree_importance_ranks(spark):
    d = frame(spark).withColumnRenamed("q_copy", "z").selectExpr("sector", "t", "q_lead * 3 AS y", "q_lead", "q_noise")
    got = {r["feature"]: r["importance"] for r in N.tree_importance(d, ["q_lead", "q_noise"], "y", "sector", "t", repeats=2, trees=10).collect()}
    assert got["q_lead"] > 0.5 > got["q_noise"]


def test_select_features_end_to_end(spark):
    d = frame(spark)
    got = {r["feature"]: r for r in N.select_features(d, ["sector", "t"], "y", "sector", "t", holdout=4, corr=0.0, boots=10).collect()}
    assert set(got) == {"q_lead", "q_noise", "q_flat", "q_copy"}
    assert got["q_flat"]["last_stage"] == "none" and not got["q_flat"]["selected"]
    assert got["q_lead"]["selected"] != got["q_copy"]["selected"]  # one of a redundant pair
    with pytest.raises(ValueError, match="nothing"):
        N.select_features(d.limit(0), ["sector", "t"], "y", "sector", "t", holdout=0)


def test_lagged_ols(spark):
    rows = [("a", k, float(k % 7), 2.0 + 3.0 * ((k - 3) % 7)) for k in range(30)]
    got = N.lagged_ols(spark.createDataFrame(rows, "s string, t int, x double, y double"), "x", "y", "s", "t").collect()
    assert len(got) == 4 and all(abs(r["y"] - r["y_pred"]) < 1e-9 for r in got)


def counted(spark):
    """The frame, its number of rows and an accumulator of how many rows of it were read."""
    d, read = frame(spark), spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    return d.withColumn("y", F.udf(seen, "double").asNondeterministic()("y")), d.count(), read


def test_select_features_reads_its_panel_once(spark):
    d, n, read = counted(spark)
    rows = N.select_features(d, ["sector", "t"], "y", "sector", "t", holdout=4, corr=0.0, boots=10).collect()
    assert any(r["selected"] for r in rows) and read.value == n


def test_funnel_reads_its_panel_once(spark):
    d, n, read = counted(spark)
    stages = N.funnel(d, ["q_lead", "q_noise"], "y", "sector", "t", corr=0.0, boots=10)
    assert len(stages) == 6 and stages[-1][1] and read.value == n


def test_redundancy_and_lasso_read_their_panel_once(spark):
    d, n, read = counted(spark)
    got = K.redundancy(d, ["y", "q_copy", "q_noise"], "q_lead")  # the column that counts is a feature, which both kinds of pairs read
    assert {f for f, _, keep in got if keep} >= {"q_copy", "q_noise"} and read.value == n
    assert N.lasso_stability(d, ["q_lead", "q_noise"], "y", "sector", "t", boots=10).count() == 2 and read.value == 2 * n
