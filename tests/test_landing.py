"""Raw folders, yearly smoothing and tree models on data whose answer is known."""

from __future__ import annotations

import json

import pandas as pd
import pytest

from sparkpanel.operators import disaggregation as D
from sparkpanel.operators import funnel as N
from sparkpanel.operators import hierarchy, joins, reshape
from sparkpanel.sources import io


def test_star_scan_reads_folders_of_lines_and_files(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "ID int, t string").repartition(2).write.json(f"file://{tmp_path}/TypedDataSet.json")
    spark.createDataFrame([("x",)], "Key string").write.json(f"file://{tmp_path}/Branche.json")
    t = io.star_scan(spark, f"file://{tmp_path}", "t", lines=True)
    assert sorted(t) == ["t_dim_Branche", "t_fact"] and t["t_fact"].count() == 2
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "TypedDataSet.json").write_text(json.dumps([{"ID": 1}, {"ID": 2}]))
    assert io.star_scan(spark, f"{tmp_path}/one/", "t")["t_fact"].count() == 2


def test_list_tables_needs_suffix_and_active_name(spark):
    for name in ("aa_gold", "bb_gold", "cc_silver"):
        spark.range(1).createOrReplaceTempView(name)
    assert io.list_tables(spark, "_gold", {"aa", "cc"}) == ["aa_gold"]


def test_classes_origins_formats_and_graphs(spark):
    d = spark.createDataFrame([("1", "2", "a", 3)], "v_1 string, `Branche x` string, size string, n int")
    assert reshape.classify_columns(d) == {"metric": ["v_1"], "key": ["Branche x"], "pivot": ["size"], "other": ["n"]}
    assert sorted(tuple(r) for r in joins.column_origin({"a": ["x"], "b": ["y", "z"]}, spark).collect()) == [("x", "a"), ("y", "b"), ("z", "b")]
    codes = spark.createDataFrame([(k, str(k) if k < 6 else "A") for k in range(40)] + [(-1, None)], "k int, c string")
    assert hierarchy.code_is_numeric(codes, "c", "k") and not hierarchy.code_is_numeric(codes.where("k > 1"), "c", "k")
    assert not hierarchy.code_is_numeric(codes.where("k < 0"), "c")
    g = '{"@graph": [{"schema:identifier": "01", "schema:nace": "A", "rdfs:label": [{"@language": "en", "@value": "e"}, {"@language": "nl", "@value": "n"}]}, {"schema:identifier": "02", "schema:nace": null, "rdfs:label": []}]}'
    graph = spark.createDataFrame([(g,)], "j string").selectExpr("from_json(j, '`@graph` array<struct<`schema:identifier`:string,`schema:nace`:string,`rdfs:label`:array<struct<`@language`:string,`@value`:string>>>>') AS s").select("s.*")
    assert [tuple(r) for r in hierarchy.jsonld_extract(graph).orderBy("code").collect()] == [("01", "n", "A"), ("02", None, None)]


def smoothing_panel(spark):
    """Two series of seven years and one quarter; y_a goes with x, y_b is known for one year, y_c ends with the whole years."""
    rows = []
    for s in ("a", "b"):
        for t in range(29):
            year, quarter = 2000 + t // 4, t % 4 + 1
            rows.append((s, year, quarter, float(year**2 % 17 + quarter), float(year**2 % 17 * 3), 5.0 if year == 2001 else None, float(year**2 % 17 * 2) if year < 2007 else None))
    return spark.createDataFrame(rows, "s string, year int, quarter int, x double, y_a double, y_b double, y_c double")


def test_smooth_yearly_keeps_annual_means_and_says_how(spark):
    p = smoothing_panel(spark)
    out, report = D.smooth_yearly(p, "year", "quarter", ["y_a", "y_b", "y_c"], ["x"])
    how = {r["column"]: (r["method"], r["indicator"], r["is_broadcast"]) for r in report.collect()}
    assert how == {"y_a": ("linear (incomplete quarters)", "x", True), "y_b": ("skip", None, True), "y_c": ("denton", "x", True)}
    old, new = p.toPandas(), out.toPandas()
    assert len(new) == len(old) and list(new.columns) == list(old.columns)
    whole = lambda d: d[d.year < 2007].groupby(["s", "year"])[["y_a", "y_c"]].mean()
    pd.testing.assert_frame_equal(whole(new), whole(old))
    assert new.y_c.dropna().groupby([new.s, new.year]).nunique().min() == 4
    assert new.y_b.dropna().eq(5).all() and new.y_b.count() == old.y_b.count()


def test_smooth_yearly_without_features_or_rows(spark):
    p = smoothing_panel(spark)
    _, report = D.smooth_yearly(p, "year", "quarter", ["y_a"])
    assert [tuple(r) for r in report.collect()] == [("y_a", True, "linear", None, None)]
    out, _ = D.smooth_yearly(p.where("year < 0"), "year", "quarter", ["y_a"], ["x"])
    assert out.count() == 0


def test_forest_learns_a_season_and_gives_weights(spark):
    import datetime

    day = lambda t: datetime.date(1990 + t // 4, t % 4 * 3 + 1, 1)
    rows = [(s, day(t), float([10, 20, 30, 40][t % 4] + k)) for k, s in enumerate("abc") for t in range(60)] + [("short", day(0), 1.0), ("null", day(0), None)]
    d = spark.createDataFrame(rows, "s string, t date, y double")
    out, weights = N.random_forest(d, "s", "t", "y", window=8, trees=20)
    got = out.toPandas()
    assert len(got) == 12 and (got.y - got.y_pred).abs().max() < 3
    assert len(weights) == 8 and sum(weights) == pytest.approx(1)
    champions = spark.createDataFrame([("a", "random_forest"), ("b", "ridge"), ("c", "mean"), ("short", "ridge")], "s string, model string")
    top = N.champion_importance(d, champions, "s", "t", "y", weights, n=3).toPandas()
    assert sorted(zip(top.s, top.model, strict=True)) == [("a", "random_forest")] * 3 + [("b", "ridge")] * 3
    empty, none = N.random_forest(d.where("s = 'short'"), "s", "t", "y")
    assert empty.count() == 0 and none == []
    assert N.champion_importance(d, champions, "s", "t", "y", none).where("s = 'a'").count() == 0


def test_sliding_backtest_counts_windows_and_is_exact_on_seasons(spark):
    from sparkpanel.operators.forecast import sliding_backtest

    rows = [("a", t, float(t % 4)) for t in range(60)] + [("b", t, 1.0) for t in range(10)]
    d = spark.createDataFrame(rows, "s string, t int, y double")
    got = [tuple(r) for r in sliding_backtest(d, "s", "t", "y").orderBy("step").collect()]
    assert got == [("a", 1, 12, 0.0), ("a", 2, 11, 0.0), ("a", 3, 10, 0.0), ("a", 4, 9, 0.0)]
    trend = spark.createDataFrame([("a", t, float(t)) for t in range(20)], "s string, t int, y double")
    assert {r["rmse"] for r in sliding_backtest(trend, "s", "t", "y", window=8).collect()} == {6.0}  # mates lie 4 and 8 rows before


def test_feature_prefixes(spark):
    d = spark.createDataFrame([("a_1",), ("b_1",), ("c",)], "f string")
    assert sorted(r["f"] for r in reshape.keep_prefixes(d, "f", ["a_", "c"]).collect()) == ["a_1", "c"] and reshape.keep_prefixes(d, "f", []).count() == 0
