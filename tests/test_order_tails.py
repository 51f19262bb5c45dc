"""Exact order without one task, and tail probabilities in columns."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.functions import tails
from sparkpanel.operators import order as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 1), None]), float(rng.randrange(9)), k) for k in range(2000)]
    return out, spark.createDataFrame(out, "g string, x double, z double, id int").repartition(5)


def test_quantiles(rows):
    data, df = rows
    got = {(r["g"], r["column"], r["share"]): r["value"] for r in O.quantiles(df, ["x", "z"], [0.0, 0.1, 0.5, 0.75, 1.0], ["g"]).collect()}
    assert len(got) == 3 * 2 * 5
    for (g, c, p), v in got.items():
        own = [r[1 if c == "x" else 2] for r in data if r[0] == g and r[1 if c == "x" else 2] is not None]
        assert v == pytest.approx(np.quantile(own, p), abs=1e-12)
    assert [r["value"] for r in O.quantiles(df, ["z"], [0.5]).collect()] == [np.median([r[2] for r in data])]
    assert O.quantiles(df.limit(0), ["x"], [0.5]).count() == 0
    wide = O.wide_quantiles(df, {"low": ("x", 0.25), "mid": ("z", 0.5)}).first()
    assert wide["low"] == pytest.approx(np.quantile([r[1] for r in data if r[1] is not None], 0.25))


def test_quantiles_plan_has_no_percentile_and_no_single_group(rows):
    _, df = rows
    plan = O.quantiles(df, ["x"], [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan


def test_placed_and_neighbours(rows):
    data, df = rows
    d = O.placed(df.where("g IS NOT NULL"), ["g"], ["z", "id"])
    got = {r["id"]: r["place"] for r in d.collect()}
    for g in "ab":
        own = sorted((r[2], r[3]) for r in data if r[0] == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    back = {r["id"]: r["id_back2"] for r in O.neighbours(d, ["g"], "place", ["id"], 2).collect()}
    for g in "ab":
        own = [i for _, i in sorted((r[2], r[3]) for r in data if r[0] == g)]
        assert [back[i] for i in own] == [None, None, *own[:-2]]
    assert sorted(r["place"] for r in O.placed(df, [], ["id"]).collect()) == list(range(1, 2001))


#: Upper tail values of tables. Fixed values: (statistic, degrees of freedom, chance).
CHI2 = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (23.209251158954356, 10, 0.01), (124.3421134287216, 100, 0.05)]
F_TABLE = [(4.964602743730711, 1, 10, 0.05), (2.978237016203438, 10, 10, 0.05), (161.44763879758855, 1, 1, 0.05), (5.994338661627068, 4, 10, 0.01)]
T_TABLE = [(2.2281388519649385, 10, 0.05), (12.706204736432095, 1, 0.05)]


def test_tails_against_tables(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    lit = lambda x: F.lit(float(x))
    for s, k, p in CHI2:
        assert value(tails.chi2_tail(lit(s), lit(k))) == pytest.approx(p, abs=1e-8)
    for s, a, b, p in F_TABLE:
        assert value(tails.f_tail(lit(s), lit(a), lit(b))) == pytest.approx(p, abs=1e-8)
    for s, k, p in T_TABLE:
        assert value(tails.t_two_sided(lit(s), lit(k))) == pytest.approx(p, abs=1e-8)


def test_tails_against_closed_forms(spark):
    data = [(x, b) for x in (1e-6, 0.1, 0.7, 1.5, 3.0, 8.0, 20.0) for b in (3.0, 10.0, 41.0, 500.0)]
    d = spark.createDataFrame(data, "x double, b double")
    got = d.select("x", "b", tails.f_tail(F.col("x"), F.lit(2.0), F.col("b")).alias("f"), tails.normal_two_sided(F.col("x")).alias("z"), tails.chi2_tail(F.col("x"), F.lit(2.0)).alias("c"), tails.log_gamma(F.col("b")).alias("g"), tails.normal_upper(-F.col("x")).alias("u"), tails.t_two_sided(F.col("x"), F.lit(1.0)).alias("t")).collect()
    for r in got:
        x, b = r["x"], r["b"]
        assert r["f"] == pytest.approx((1 + 2 * x / b) ** (-b / 2), rel=1e-9)
        assert r["z"] == pytest.approx(math.erfc(x / math.sqrt(2)), rel=1e-9)
        assert r["c"] == pytest.approx(math.exp(-x / 2), rel=1e-9)
        assert r["g"] == pytest.approx(math.lgamma(b), rel=1e-12)
        assert r["u"] == pytest.approx(1 - math.erfc(x / math.sqrt(2)) / 2, rel=1e-9)
        assert r["t"] == pytest.approx(1 - 2 / math.pi * math.atan(x), rel=1e-8)


def test_loss_test_p_values_are_those_of_the_unrounded_statistic(spark):
    from sparkpanel.plans import scores  # noqa: F401
    from sparkpanel.plans.registry import QUERIES

    got = QUERIES["diebold_mariano"](spark, "/root/testdata/sf0.001").collect()
    t = {(r["model_a"], r["model_b"]): r["stat"] for r in scores.dm(spark, "/root/testdata/sf0.001", ["model_a", "model_b"]).collect()}
    assert got and all(r["p"] == pytest.approx(math.erfc(abs(t[r["model_a"], r["model_b"]]) / math.sqrt(2)), abs=6e-9) for r in got)
