"""Operators on small frames of our own: sources, sinks, gates, hierarchies, disaggregation."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.functions.period import period_to_date, regime_ramps
from sparkpanel.functions.text import json_value, tier
from sparkpanel.operators import champion, disaggregation, hierarchy, profile, reshape, selection, windows
from sparkpanel.functions.tails import normal_two_sided as normal_p
from sparkpanel.operators.compare import diebold_mariano
from sparkpanel.sources import io
from sparkpanel.streaming.landing import stream_new_files


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_star_scan_reads_fact_and_dimensions(spark, tmp_path):
    (tmp_path / "TypedDataSet.json").write_text(json.dumps([{"ID": 1, "Perioden": " 2020KW01 ", "v_1": 2.5}, {"ID": 2, "Perioden": "2020KW02", "v_1": None}]))
    (tmp_path / "Branche.json").write_text(json.dumps([{"Key": "A  ", "Title": "A farming"}]))
    t = io.star_scan(spark, f"file://{tmp_path}", "t1")
    assert sorted(t) == ["t1_dim_Branche", "t1_fact"]
    fact = io.trim_and_stamp(t["t1_fact"], "t1_fact")
    assert rows(fact, "bronze_pk", "Perioden") == [("t1_fact_1", "2020KW01"), ("t1_fact_2", "2020KW02")]
    assert io.column_types(t["t1_fact"]) == {"ID": "int", "Perioden": "string", "v_1": "float"}
    assert io.trim_and_stamp(spark.createDataFrame([(1,)], "x int"), "n") is None


def test_full_refresh_turns_nan_to_null(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    io.full_refresh(spark.createDataFrame([(1, float("nan"), "x")], "a int, b double, more string"), path, T.StructType.fromDDL("a int, b double, c string"))
    assert rows(spark.read.parquet(path), "a", "b", "c") == [(1, None, None)]


def test_catalog_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    steps = spark.createDataFrame([(1, "near_constant", "x", True), (1, "near_constant", "y", False)], "step int, filter string, feature string, retained boolean")
    io.write_catalog(steps, spark.createDataFrame([("g", ["x"])], "group string, columns array<string>"), path)
    assert io.read_catalog(spark, path) == {"g": ["x"], "all_survivors": ["x"], "structural_only": []}


def test_canonical_needs_its_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        io.to_canonical(spark.createDataFrame([(1,)], "horizon int"))


def test_landing_takes_each_file_once(spark, tmp_path):
    schema = T.StructType.fromDDL("x int")
    for k in range(3):
        spark.createDataFrame([(k,)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for _ in range(2):
            stream_new_files(spark, f"file://{tmp_path}/in", schema, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert rows(spark.read.parquet(f"file://{tmp_path}/out"), "x") == [(0,), (1,), (2,)]


def test_period_codes(spark):
    codes = ["2020KW01", "2020MM12", "2020JJ00", "2020KW05", "2020XX01", "", None]
    got = [str(r[0]) for r in spark.createDataFrame([(c,) for c in codes], "c string").select(period_to_date(F.col("c"))).collect()]
    assert got == ["2020-03-31", "2020-12-31", "2020-12-31", "None", "None", "None", "None"]


def test_yearly_rows_fill_four_quarters(spark):
    d = reshape.yearly_to_quarterly(spark.createDataFrame([(2020, 10)], "year int, v int"))
    assert [(r["period_enddate"].month, r["v"]) for r in d.orderBy("quarter").collect()] == [(3, 10), (6, 10), (9, 10), (12, 10)]


def test_totals_stay_if_alone(spark):
    d = spark.createDataFrame([("T001", 1), ("A", 2)], "dim string, v int")
    assert rows(reshape.drop_totals(d, ["dim"]), "dim") == [("A",)]
    assert rows(reshape.drop_totals(d.where("dim = 'T001'"), ["dim"]), "dim") == [("T001",)]


def test_ramp_of_first_quarter(spark):
    d = spark.createDataFrame([("2022-12-31",)], "d string").select(F.col("d").cast("date").alias("d"))
    r = d.select(regime_ramps(F.col("d"), "2022-10-02", "2023-01-01")["depth"].alias("x")).first()
    assert r["x"] == pytest.approx(90 / 91.3125)


def test_validate_panel(spark):
    d = spark.createDataFrame([("a", "2020-03-31", 1.0), ("a", "2020-06-30", None)], "sector string, d string, y double").withColumn("d", F.col("d").cast("date"))
    assert profile.validate_panel(d, "y", "d", ["sector", "d"], strict=False)["nulls"] == {"y": 1}
    for bad in (lambda: profile.validate_panel(d, "y", "d", ["sector", "d"], strict=True), lambda: profile.validate_panel(d.unionByName(d), "y", "d", ["sector", "d"], strict=False)):
        with pytest.raises(ValueError, match="not valid"):
            bad()


def test_tiers_and_kinds(spark):
    d = spark.createDataFrame([(0.9,), (0.95,), (1.0,), (None,), (float("nan"),)], "m double")
    assert [r[0] for r in d.select(tier(F.col("m"))).collect()] == ["Good", "Medium", "Poor", "Poor", "Poor"]
    d = spark.createDataFrame([("8",), ("1.0",), ("True",), ("None",), ("add",)], "c string")
    assert [r[0] for r in d.select(json_value(F.col("c"))).collect()] == ["integer", "number", "boolean", "null", "text"]


def test_champion_gate(spark):
    new = spark.createDataFrame([("a", "m", 0.8), ("b", "m", 0.8), ("c", "m", 0.8), ("d", "m", float("nan")), ("e", "m", 0.8)], "sector string, model_name string, mase double")
    old = spark.createDataFrame([("b", 0.9), ("c", 0.8), ("e", 0.7)], "sector string, mase double")
    assert rows(champion.champion_gate(new, old, "sector"), "sector", "verdict") == [("a", "seed"), ("b", "promote"), ("c", "keep"), ("e", "keep")]
    assert champion.champion_gate(new, old, "sector", mase_ceiling=0.5).count() == 0


def test_denton_keeps_annual_means(spark):
    rng = np.random.default_rng(0)
    annual, indicator = rng.normal(size=5), rng.normal(size=20)

    def quarters(annual):
        rows = [("a", k // 4, k % 4 + 1, float(annual[k // 4]), float(indicator[k])) for k in range(20)]
        d = disaggregation.denton_series(spark.createDataFrame(rows, "k string, year int, quarter int, v double, p double"), "k", "year", "quarter", "v", "p")
        return np.array([r["v"] for r in d.orderBy("year", "quarter").collect()])

    assert np.allclose(quarters(annual).reshape(5, 4).mean(axis=1), annual)
    assert np.allclose(quarters(indicator.reshape(5, 4).mean(axis=1)), indicator)


def test_linear_interpolation_keeps_annual_means(spark):
    d = disaggregation.interpolate_linear(spark.createDataFrame([("a", 2000 + k, float(v)) for k, v in enumerate([1, 5, 2])], "k string, year int, v double"), "k", "year", "v")
    assert rows(d.groupBy("year").agg(F.round(F.avg("v"), 9).alias("m"), F.count("*").alias("n")), "m", "n") == [(1.0, 4), (2.0, 4), (5.0, 4)]


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("T", "A-U All", "total"), ("S", "B-F Industry", "sector"), ("C", "C Making", "section"), ("10", "10-12 Food", "subdivision"), ("90", "90 Art", "subdivision")], "code string, title string, level string")
    edges = hierarchy.tree_parent(nodes)
    assert rows(edges, "code", "parent") == [("10", "C"), ("90", "T"), ("C", "S"), ("S", "T"), ("T", None)]
    tree = json.loads(hierarchy.tree_json(edges).first()["node"])
    assert tree["code"] == "T" and {c["code"] for c in tree["children"]} == {"90", "S"}
    assert hierarchy.code_is_numeric(spark.createDataFrame([("10 ",), ("11",), ("A",)], "c string"), "c")


def test_windows_on_gaps(spark):
    d = spark.createDataFrame([("a", "2020-03-31", 1.0), ("a", "2020-09-30", 3.0), ("a", "2020-12-31", 4.0)], "sector string, d string, y double").select("sector", F.col("d").cast("date").alias("period_enddate"), "y")
    assert windows.contiguous_tail(d).count() == 2 and windows.calendar_fill(d).count() == 4
    assert windows.gap_report(d).first()["n_gaps"] == 1 and not windows.contiguous(d).first()["is_contiguous"]


def test_redundancy_keeps_the_better_of_a_pair(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    a = y + rng.normal(size=200) * 0.5
    d = spark.createDataFrame([(float(v), float(w), float(w + e), float(z)) for v, w, e, z in zip(y, a, rng.normal(size=200) * 0.05, rng.normal(size=200), strict=True)], "y double, a double, b double, c double")
    kept = {f: k for f, _, k in selection.redundancy(d, ["a", "b", "c"], "y")}
    assert kept["c"] and kept["a"] != kept["b"]


def test_normal_tail(spark):
    got = spark.range(1).select(normal_p(F.lit(1.959964)).alias("a"), normal_p(F.lit(0.0)).alias("b")).first()
    assert got["a"] == pytest.approx(0.05, abs=1e-6) and got["b"] == pytest.approx(1.0, abs=1e-6)


def test_impute_target_over_all_series(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("b", 1, None), ("a", 2, None), ("b", 2, 7.0), ("a", 3, None), ("b", 3, None), ("a", 0, None)], "sector string, period_enddate int, y double")
    got = rows(profile.impute_target(d, scope="global"), "sector", "period_enddate", "y")
    assert got == sorted([("a", 0, 6.0), ("a", 1, 5.0), ("b", 1, 5.0), ("a", 2, 5.0), ("b", 2, 7.0), ("a", 3, 7.0), ("b", 3, 7.0)], key=str)


def test_diebold_mariano_lags_by_hand(spark):
    e = np.array([0.3, -0.1, 0.4, 0.6, -0.2, 0.5, 0.1, 0.7, 0.2, -0.3])
    d = spark.createDataFrame([("a", "b", k, float(v)) for k, v in enumerate(e)], "model_a string, model_b string, t int, d double")
    c, n = e - e.mean(), len(e)
    for h, bartlett in ((1, False), (2, False), (3, False), (3, True)):
        g = [(c[k:] * c[: n - k]).sum() for k in range(h)]
        var = g[0] / n + 2 * sum((1 - k / h) * g[k] / n if bartlett else g[k] / (n - k) for k in range(1, h))
        got = diebold_mariano(d, ["model_a", "model_b"], ["t"], h, bartlett=bartlett).first()["stat"]
        assert got == (pytest.approx(e.mean() / np.sqrt(var / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)) if var > 0 else None)
