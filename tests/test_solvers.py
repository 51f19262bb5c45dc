"""Denton by blocks against the dense system, and clusters by chains against the best pair at each step."""

from __future__ import annotations

import time

import numpy as np
import pytest

from sparkpanel.operators.disaggregation import denton_series
from sparkpanel.operators.selection import complete_linkage, redundancy


def dense(annual, indicator, how):
    n = len(annual)
    d = np.diff(np.eye(4 * n), axis=0)
    a = np.kron(np.eye(n), np.full(4, 0.25 if how == "mean" else 1.0))
    kkt = np.block([[d.T @ d, a.T], [a, np.zeros((n, n))]])
    return np.linalg.solve(kkt, np.concatenate([d.T @ d @ indicator, annual]))[: 4 * n]


@pytest.mark.parametrize("how", ["mean", "sum"])
def test_denton_equals_the_dense_solution(spark, how):
    rng, rows, want = np.random.default_rng(3), [], {}
    for years in (1, 2, 3, 25):
        annual, indicator = rng.normal(100, 20, years), rng.normal(50, 9, 4 * years)
        rows += [(f"s{years}", 2000 + k // 4, k % 4 + 1, float(annual[k // 4]), float(indicator[k])) for k in range(4 * years)]
        want |= {(f"s{years}", 2000 + k // 4, k % 4 + 1): x for k, x in enumerate(dense(annual, indicator, how))}
    rows += [("part", 2000, q, 5.0, 1.0) for q in (1, 2, 3)]  # no whole year
    df = spark.createDataFrame(rows, "k string, year int, quarter int, v double, p double").repartition(5)
    d = denton_series(df, "k", "year", "quarter", "v", "p", how)
    got = {(r["k"], r["year"], r["quarter"]): r["v"] for r in d.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())
    assert "Python" not in d._jdf.queryExecution().toString()


def test_denton_of_400_years(spark):
    rng = np.random.default_rng(0)
    annual, indicator = rng.normal(100, 20, 400), rng.normal(50, 9, 1600)
    rows = [("s", k // 4, k % 4 + 1, float(annual[k // 4]), float(indicator[k])) for k in range(1600)]
    t = time.perf_counter()
    got = denton_series(spark.createDataFrame(rows, "k string, year int, quarter int, v double, p double"), "k", "year", "quarter", "v", "p").orderBy("year", "quarter").collect()
    assert time.perf_counter() - t < 60
    x = np.array([r["v"] for r in got])
    assert np.allclose(x, dense(annual, indicator, "mean"), atol=1e-6)


def greedy(near, most):
    groups = [[i] for i in range(len(near))]
    while len(groups) > 1:
        link = [(min(near[a][b] for a in g for b in h), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        best = max(link)
        if best[0] < most:
            break
        groups[-best[1]] += groups.pop(-best[2])
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("seed", range(6))
def test_clusters_equal_those_of_the_best_pair(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 60))
    for i in range(0, 60, 3):
        x[:, i + 1] = x[:, i] + rng.normal(size=40) * rng.uniform(0.05, 0.8)
    near = np.abs(np.corrcoef(x.T))
    for most in (0.3, 0.6, 0.9):
        assert complete_linkage(near, most) == greedy(near, most)


def test_clusters_of_300_columns():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(100, 60))
    x = np.repeat(base, 5, axis=1) + rng.normal(size=(100, 300)) * 0.1
    got = complete_linkage(np.abs(np.corrcoef(x.T)), 0.9)
    assert got == [list(range(k, k + 5)) for k in range(0, 300, 5)]
    assert complete_linkage(np.zeros((0, 0)), 0.9) == []


def test_redundancy_keeps_the_best(spark):
    rows = [(float(k), float(2 * k), float((-1) ** k), float(k + 5 * (k % 3))) for k in range(30)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    got = {f: (k, keep) for f, k, keep in redundancy(df, ["a", "b", "c"], "y", 0.8)}
    assert got["a"][1] and got["b"][1] and not got["c"][1] and got["a"][0] == got["c"][0] != got["b"][0]
