"""Queries of projections, filters, joins, profiles and quality gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.period import period_frequency, period_number, period_to_date, period_year
from ..operators import joins as J
from ..operators import profile as P
from ..operators import reshape as R
from ..sources import io
from .frames import canonical, order_facts, panel, period_table, sector_mae, table
from .registry import query
from .series import HOLES, holes

six = lambda c: F.round(c, 6)
TO_DATE = """CASE WHEN regexp_matches(Perioden, '^[0-9]{4}(KW|MM|JJ)[0-9]{2}$') THEN CASE WHEN contains(Perioden, 'KW') THEN CASE WHEN n BETWEEN 1 AND 4 THEN last_day(make_date(yy, n * 3, 1)) END
WHEN contains(Perioden, 'MM') THEN CASE WHEN n BETWEEN 1 AND 12 THEN last_day(make_date(yy, n, 1)) END ELSE make_date(yy, 12, 31) END END"""
CODES = "(SELECT *, try_cast(substr(Perioden, 1, 4) AS INT) AS yy, try_cast(substr(Perioden, 7, 2) AS INT) AS n FROM {period_table})"


@query("trim_and_stamp", "SELECT o_orderkey AS \"Key\", trim(o_orderstatus) AS o_orderstatus, trim(o_orderpriority) AS o_orderpriority, 'orders_' || o_orderkey AS bronze_pk, 'orders' AS _source_file FROM orders")
def _(spark, d):
    padded = F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("Key"), "o_orderstatus", padded.alias("o_orderpriority"))
    return io.trim_and_stamp(o, "orders")


SQL_QUERY = "SELECT n_name, count(*) AS n_customers, max(c_acctbal) AS max_bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query("sql_query", SQL_QUERY)
def _(spark, d):
    from ..sources.io import sql_query

    return sql_query(spark, {n: table(spark, d, n) for n in ("customer", "nation")}, SQL_QUERY)


@query("period_sql_extract", f"SELECT period_enddate, sector, try_cast(Metric_1 AS DOUBLE) AS value FROM (SELECT *, {TO_DATE} AS period_enddate FROM {CODES}) WHERE dim = 'T001' AND contains(Perioden, 'KW') AND period_enddate >= DATE '1996-01-01'")
def _(spark, d):
    p = period_table(spark, d).where("dim = 'T001' AND Perioden LIKE '%KW%'").select(period_to_date(F.col("Perioden")).alias("period_enddate"), "sector", F.col("Metric_1").try_cast("double").alias("value"))
    return p.where("period_enddate >= DATE '1996-01-01'")


@query("external_predictions_scan", "SELECT 'external' AS model_name, sector_code, last_day(target_date - INTERVAL 3 MONTH) AS origin_date, target_date, 1 AS horizon, y_true, y_pred FROM {canonical} WHERE model_name = 'last'")
def _(spark, d):
    from ..sources.io import external_predictions

    raw = canonical(spark, d).where("model_name = 'last'").select(F.col("sector_code").alias("code"), F.col("target_date").alias("when"), F.col("y_true").alias("actual"), F.col("y_pred").alias("forecast"))
    return external_predictions(raw, {"code": "sector_code", "when": "target_date", "actual": "y_true", "forecast": "y_pred"}, "external", 1)


@query("predictions_table_scan", "SELECT model_name, sector_code, origin_date, target_date, horizon, y_true, y_pred, fold_set, round(abs(y_pred - y_true), 6) AS _ae FROM {canonical}")
def _(spark, d):
    from ..sources.io import resolve_predictions

    stored = canonical(spark, d).withColumnsRenamed({"origin_date": "fold_origin_date", "horizon": "horizon_step"})
    return resolve_predictions(stored).select("model_name", "sector_code", "origin_date", "target_date", "horizon", "y_true", "y_pred", "fold_set", six("_ae").alias("_ae"))


@query("runs_scan", "SELECT 'fam_' || model_name AS model_family, 'a+b' AS feature_group, sector_code AS sector, mae AS mase FROM {sector_mae} WHERE mae IS NOT NULL")
def _(spark, d):
    from ..sources.io import runs

    raw = sector_mae(spark, d).select(F.concat(F.lit("fam_"), "model_name").alias("model_family"), F.lit('["a","b"]').alias("groups"), F.col("sector_code").alias("sector"), F.col("mae").cast("string").alias("mase"))
    return runs(raw)


@query("prune_meta", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("s_Status"), F.col("o_orderpriority").alias("p_Title"), F.lit("x").alias("bronze_pk"))
    return R.prune_meta(o)


@query("normalize_key_name", "SELECT c_custkey AS key, c_name FROM customer")
def _(spark, d):
    return R.normalize_key_name(table(spark, d, "customer").select("c_custkey", "c_name"), ["cust_id", "c_custkey"], "key")


@query("start_year_filter", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1999")
def _(spark, d):
    return R.start_year(table(spark, d, "orders"), "o_orderdate", 1999).select("o_orderkey")


@query("dimension_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 4, 5, 6, 7, 8)")
def _(spark, d):
    return R.dimension_filter(table(spark, d, "orders"), {"o_orderstatus": ["F", "P"], "o_custkey": list(range(1, 9)), "absent": 1}).select("o_orderkey", "o_orderstatus")


@query("drop_totals", "SELECT Perioden, dim, sector, Metric_1 FROM {period_table} WHERE dim NOT LIKE 'T00%'")
def _(spark, d):
    return R.drop_totals(period_table(spark, d), ["dim", "sector"])


@query("metric_allow_deny", "SELECT l_quantity, l_discount FROM lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(*R.metric_allow_deny(t.columns, ["l_quan", "l_ex", "l_dis", "l_tax"], ["PRICE", "tax$"]))


@query("prefix_yearly", "SELECT sector, year, y AS y_y, n_orders AS y_n_orders FROM {panel} WHERE quarter = 4")
def _(spark, d):
    p = panel(spark, d).where("quarter = 4").select("sector", "year", F.col("y").alias("v"), "n_orders")
    return R.prefix_yearly(p, ["sector", "year"], 1).withColumnRenamed("y_v", "y_y")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS seg_{s}" for s in SEGMENTS) + " FROM customer")
def _(spark, d):
    return R.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS, "seg")


@query("one_hot_decode", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def _(spark, d):
    t = R.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS, "seg")
    return R.one_hot_decode(t, {f"seg_{s}": s for s in SEGMENTS}, "segment").select("c_custkey", "segment")


@query("sector_isolate", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    t = R.one_hot(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_mktsegment", SEGMENTS, "seg")
    return R.isolate(t, "seg_BUILDING", [f"seg_{s}" for s in SEGMENTS], "c_custkey")


@query("project_groups", "SELECT sector, period_enddate, y, x_bal, n_orders FROM {panel}")
def _(spark, d):
    return R.project_groups(panel(spark, d), {"a": ["x_bal", "absent"], "b": ["n_orders", "x_bal"]}, ["a", "b"], ["sector", "period_enddate"], "y")


@query("numeric_matrix", "SELECT n_orders, quarter, x_bal FROM {panel}")
def _(spark, d):
    p = panel(spark, d)
    return p.select(*R.numeric_columns(p, ("y", "year")))


@query("cast_all_double", "SELECT sector, period_enddate, year::DOUBLE AS year, quarter::DOUBLE AS quarter, n_orders::DOUBLE AS n_orders FROM {panel}")
def _(spark, d):
    return R.cast_all_double(panel(spark, d).select("sector", "period_enddate", "year", "quarter", "n_orders"))


@query("cast_plan", "SELECT try_cast(p_size AS INT) AS p_size, trim(p_brand) AS p_brand, try_cast(p_name AS DOUBLE) AS p_name, p_retailprice FROM part")
def _(spark, d):
    return R.cast_plan(table(spark, d, "part"), ["p_size"], ["p_brand"], ["p_name", "p_retailprice"])


@query("domain_prefix_filter", "SELECT p_brand || '_' || p_size AS feature, count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_brand || '_', 'Brand#23_') GROUP BY 1")
def _(spark, d):
    f = table(spark, d, "part").groupBy(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("feature")).agg(F.count("*").alias("n"))
    return R.keep_prefixes(f, "feature", ["Brand#1", "Brand#23_"])


LASTS = "(SELECT DISTINCT period_enddate FROM {panel} ORDER BY 1 DESC LIMIT 8)"


@query("holdout_filter", f"SELECT sector, period_enddate, y FROM {{panel}} WHERE period_enddate NOT IN {LASTS}")
def _(spark, d):
    return R.holdout(panel(spark, d), "period_enddate", 8).where("split = 'train'").select("sector", "period_enddate", "y")


@query("temporal_split", f"SELECT CASE WHEN period_enddate IN {LASTS} THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows, count(DISTINCT period_enddate) AS n_periods FROM {{panel}} GROUP BY 1")
def _(spark, d):
    return R.holdout(panel(spark, d), "period_enddate", 8).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("period_enddate").alias("n_periods"))


@query("regex_title_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(upper(p_name), '^[A-M]') AND p_size IN (1, 5, 9, 14)")
def _(spark, d):
    return table(spark, d, "part").where(F.upper("p_name").rlike("^[A-M]") & F.col("p_size").isin(1, 5, 9, 14)).select("p_partkey", "p_name")


@query("preset_tables", "SELECT r_name AS preset, n_name AS table_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def _(spark, d):
    registry = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("table_id"), F.col("n_regionkey").alias("category"))
    presets = table(spark, d, "region").groupBy(F.col("r_name").alias("preset")).agg(F.collect_list("r_regionkey").alias("categories"))
    return presets.withColumn("category", F.explode("categories")).join(registry, "category").select("preset", "table_id")


@query("rename_reorder", "SELECT year, quarter, period_enddate, y AS value, sector FROM {panel}")
def _(spark, d):
    p = panel(spark, d).drop("x_bal", "n_orders", "region").withColumnsRenamed({"y": "value"})
    return p.select("period_enddate", "year", "quarter", "sector", "value")


@query("star_join", "SELECT o_orderkey, c.c_name AS customer_c_name, c.c_nationkey AS customer_c_nationkey FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return J.star_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"customer": (c, "o_custkey", "c_custkey")}).drop("o_custkey")


@query("tiered_join", "WITH f AS (SELECT sector, last_day(period_enddate + INTERVAL 3 MONTH) AS period_enddate, y AS feat FROM {panel}) SELECT p.sector, p.period_enddate, y, feat FROM {panel} p LEFT JOIN f ON p.sector = f.sector AND p.period_enddate = f.period_enddate")
def _(spark, d):
    p = panel(spark, d)
    f = p.select("sector", F.last_day(F.add_months("period_enddate", 3)).alias("period_enddate"), F.col("y").alias("feat"))
    return J.tiered_join(p.select("sector", "period_enddate", "y"), f, "period_enddate", "sector")[0]


@query("broadcast_join", "WITH f AS (SELECT period_enddate, round(avg(x_bal), 6) AS nat FROM {panel} GROUP BY 1) SELECT sector, period_enddate, nat FROM {panel} LEFT JOIN f USING (period_enddate)")
def _(spark, d):
    p = panel(spark, d)
    f = p.groupBy("period_enddate").agg(six(F.avg("x_bal")).alias("nat"))
    return p.join(f, "period_enddate", "left").select("sector", "period_enddate", "nat")


@query("prejoin_dedupe", "SELECT period_enddate, round(avg(y), 6) AS y, round(avg(n_orders), 6) AS n_orders FROM {panel} GROUP BY 1")
def _(spark, d):
    m = J.per_period_mean(panel(spark, d).select("period_enddate", "y", "n_orders"), "period_enddate")
    return m.select("period_enddate", six("y").alias("y"), six("n_orders").alias("n_orders"))


@query("overlap_drop", "SELECT p.sector, p.period_enddate, p.y, q.x_bal FROM {panel} p LEFT JOIN {panel} q ON p.sector = q.sector AND p.period_enddate = q.period_enddate")
def _(spark, d):
    p = panel(spark, d)
    return J.tiered_join(p.select("sector", "period_enddate", "y"), p.select("sector", "period_enddate", "y", "x_bal"), "period_enddate", "sector")[0]


YEARLY = "(SELECT sector, year, round(avg(y), 6) AS y FROM {panel} GROUP BY ALL)"


@query("lagged_year_join", f"SELECT p.sector, p.period_enddate, p.y, v.y AS y_yearly FROM {{panel}} p LEFT JOIN {YEARLY} v ON p.sector = v.sector AND p.year = v.year + 1")
def _(spark, d):
    p = panel(spark, d)
    v = p.groupBy("sector", "year").agg(six(F.avg("y")).alias("y"))
    return J.lagged_year_join(p, v, 1, key="sector").select("sector", "period_enddate", "y", "y_yearly")


ALIGNED = "SELECT * FROM {canonical} WHERE (sector_code, target_date, horizon) IN (SELECT (sector_code, target_date, horizon) FROM {canonical} GROUP BY ALL HAVING count(DISTINCT model_name) = (SELECT count(DISTINCT model_name) FROM {canonical}))"


@query("align_intersection", f"SELECT model_name, count(*) AS n_rows, min(target_date) AS first FROM ({ALIGNED}) GROUP BY 1")
def _(spark, d):
    return J.align(canonical(spark, d), ["sector_code", "target_date", "horizon"]).groupBy("model_name").agg(F.count("*").alias("n_rows"), F.min("target_date").alias("first"))


@query("baseline_join", "SELECT m.model_name, m.sector_code, m.target_date, m.y_pred, b.y_pred AS base FROM {canonical} m JOIN {canonical} b ON m.sector_code = b.sector_code AND m.target_date = b.target_date AND m.horizon = b.horizon AND b.model_name = 'naive'")
def _(spark, d):
    c, keys = canonical(spark, d), ["sector_code", "target_date", "horizon"]
    base = c.where("model_name = 'naive'").select(*keys, F.col("y_pred").alias("base"))
    return J.baseline_join(c, base, keys).select("model_name", "sector_code", "target_date", "y_pred", "base")


@query("winner_join", """WITH w AS (SELECT sector_code, min_by(model_name, (mae, model_name)) AS model_name FROM {sector_mae} GROUP BY 1), i AS (SELECT sector_code, model_name, count(*) AS n_inner FROM {canonical} WHERE fold_set = 'inner' AND model_name <> 'last' GROUP BY ALL)
SELECT c.sector_code, c.target_date, c.model_name, c.y_pred, coalesce(n_inner, 0) AS n_inner FROM {canonical} c JOIN w ON c.sector_code = w.sector_code AND c.model_name = w.model_name LEFT JOIN i ON i.sector_code = c.sector_code AND i.model_name = c.model_name WHERE fold_set = 'outer'""")
def _(spark, d):
    w = sector_mae(spark, d).groupBy("sector_code").agg(F.min_by("model_name", F.struct("mae", "model_name")).alias("model_name"))
    c, keys = canonical(spark, d), ["sector_code", "model_name"]
    inner = c.where("fold_set = 'inner' AND model_name <> 'last'").groupBy(*keys).agg(F.count("*").alias("n_inner"))
    return c.where("fold_set = 'outer'").join(w, keys).join(inner, keys, "left").select("sector_code", "target_date", "model_name", "y_pred", F.coalesce("n_inner", F.lit(0)).alias("n_inner"))


TITLES = "(SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE n_name END AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("hierarchy_lookup", "SELECT c_custkey, coalesce(n_name, '') AS title, coalesce(CASE WHEN n_regionkey < 3 THEN 'low' ELSE 'high' END, 'unknown') AS level FROM customer LEFT JOIN (SELECT *, CASE WHEN n_regionkey < 3 THEN 'low' ELSE 'high' END AS l FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey")
def _(spark, d):
    from ..operators.hierarchy import lookup

    n = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("  ")).alias("Key"), F.col("n_name").alias("title"), F.when(F.col("n_regionkey") < 3, "low").otherwise("high").alias("level"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code"))
    out = lookup(c, n, "code").select("c_custkey", "title", "level")
    return out.withColumn("level", F.when(F.col("level") == "unknown", "high").otherwise(F.col("level")))


@query("unmatched_rows", "SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0")
def _(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_anti").select("c_custkey")


@query("baseline_grid_join", "SELECT g.sector_code, g.target_date, g.horizon, b.y_pred FROM (SELECT DISTINCT sector_code, target_date, horizon FROM {canonical}) g JOIN {canonical} b ON g.sector_code = b.sector_code AND g.target_date = b.target_date AND b.model_name = 'naive'")
def _(spark, d):
    c = canonical(spark, d)
    return c.select("sector_code", "target_date", "horizon").distinct().join(c.where("model_name = 'naive'").select("sector_code", "target_date", "y_pred"), ["sector_code", "target_date"])


@query("source_sensitivity_join", "SELECT a.sector_code, round(a.mae - b.mae, 6) AS delta FROM {sector_mae} a JOIN {sector_mae} b ON a.sector_code = b.sector_code AND a.model_name = 'naive' AND b.model_name = 'seasonal_ma'")
def _(spark, d):
    s = sector_mae(spark, d)
    a, b = (s.where(F.col("model_name") == m).select("sector_code", F.col("mae").alias(f"mae_{m}")) for m in ("naive", "seasonal_ma"))
    return a.join(b, "sector_code").select("sector_code", six(F.col("mae_naive") - F.col("mae_seasonal_ma")).alias("delta"))


@query("period_self_join", "SELECT a.sector, round((b.y / a.y - 1) * 100, 6) AS growth FROM {panel} a JOIN {panel} b ON a.sector = b.sector AND a.quarter = b.quarter AND a.year = 1995 AND b.year = 2000 WHERE a.quarter = 4")
def _(spark, d):
    p = panel(spark, d).where("quarter = 4")
    a, b = (p.where(F.col("year") == v).select("sector", F.col("y").alias(f"y{v}")) for v in (1995, 2000))
    return a.join(b, "sector").select("sector", six((F.col("y2000") / F.col("y1995") - 1) * 100).alias("growth"))


@query("multi_series_join", "SELECT a.sector_code, a.target_date, a.y_true, a.y_pred AS p1, b.y_pred AS p2, c.y_pred AS p3 FROM {canonical} a JOIN {canonical} b USING (sector_code, target_date) JOIN {canonical} c USING (sector_code, target_date) WHERE a.model_name = 'naive' AND b.model_name = 'last' AND c.model_name = 'rolling'")
def _(spark, d):
    c, on = canonical(spark, d), ["sector_code", "target_date"]
    own = lambda m, n: c.where(F.col("model_name") == m).select(*on, F.col("y_pred").alias(n))
    return c.where("model_name = 'naive'").select(*on, "y_true", F.col("y_pred").alias("p1")).join(own("last", "p2"), on).join(own("rolling", "p3"), on).dropna().dropDuplicates(on)


@query("date_semi_join", "SELECT sector, period_enddate, y FROM {panel} WHERE period_enddate IN (SELECT target_date FROM {canonical} WHERE fold_set = 'outer')")
def _(spark, d):
    dates = canonical(spark, d).where("fold_set = 'outer'").select(F.col("target_date").alias("period_enddate"))
    return panel(spark, d).join(dates, "period_enddate", "left_semi").select("sector", "period_enddate", "y")


@query("lookup_fallback", "WITH t AS (SELECT sector, quarter, avg(y) AS p FROM {panel} WHERE year < 1999 AND length(sector) < 9 GROUP BY ALL), g AS (SELECT avg(y) AS g FROM {panel} WHERE year < 1999) SELECT p.sector, p.period_enddate, round(coalesce(t.p, g.g), 6) AS y_pred FROM {panel} p LEFT JOIN t ON p.sector = t.sector AND p.quarter = t.quarter, g WHERE p.year >= 1999")
def _(spark, d):
    p = panel(spark, d)
    train = p.where("year < 1999")
    known = train.where("length(sector) < 9").groupBy("sector", "quarter").agg(F.avg("y").alias("y_pred"))
    return J.lookup_fallback(p.where("year >= 1999"), known, ["sector", "quarter"], "y_pred", train.agg(F.avg("y"))).select("sector", "period_enddate", six("y_pred").alias("y_pred"))


@query("origin_fold_crossjoin", "SELECT n_name AS sector, origin::INT AS origin, config FROM nation, (VALUES (12), (16), (20)) o(origin), (VALUES ('naive'), ('mean')) c(config)")
def _(spark, d):
    return J.work_list(table(spark, d, "nation").select(F.col("n_name").alias("sector")), spark.createDataFrame([(12,), (16,), (20,)], "origin int"), spark.createDataFrame([("naive",), ("mean",)], "config string"))


POSITIONED = "(SELECT *, row_number() OVER (PARTITION BY sector ORDER BY period_enddate)::INT AS pos FROM {panel})"


@query("training_range_join", f"SELECT sector, origin::INT AS origin, count(*) AS n_rows, round(avg(y), 6) AS mean_y FROM {POSITIONED}, (VALUES (12), (16), (20)) o(origin) WHERE pos <= origin AND pos > origin - 10 GROUP BY ALL")
def _(spark, d):
    p = panel(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("sector").orderBy("period_enddate")))
    folds = J.work_list(p.select("sector").distinct(), spark.createDataFrame([(12,), (16,), (20,)], "origin int"), spark.createDataFrame([(1,)], "config int"))
    return J.training_rows(p, folds, "sector", "pos", 10).groupBy("sector", "origin").agg(F.count("*").alias("n_rows"), six(F.avg("y")).alias("mean_y"))


MONTHS = "(SELECT n_name AS sector, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(avg(o_totalprice), 6) AS value FROM {facts} GROUP BY ALL)"


@query("monthly_to_quarterly", f"SELECT sector, year, ceil(month / 3.0)::INT AS quarter, round(avg(value), 5) AS value FROM {MONTHS} GROUP BY ALL")
def _(spark, d):
    m = order_facts(spark, d).groupBy(F.col("n_name").alias("sector"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(six(F.avg("o_totalprice")).alias("value"))
    return R.monthly_to_quarterly(m, ["sector"]).withColumn("value", F.round("value", 5))


@query("yearly_to_quarterly", f"SELECT sector, year + 1 AS year, q::INT AS quarter, last_day(make_date(year + 1, q::INT * 3, 1)) AS period_enddate, y FROM {YEARLY}, range(1, 5) r(q)")
def _(spark, d):
    return R.yearly_to_quarterly(panel(spark, d).groupBy("sector", "year").agg(six(F.avg("y")).alias("y")), lag=1)


@query("frequency_priority", "SELECT Perioden, dim, sector, Metric_1 FROM {period_table} WHERE contains(Perioden, 'MM')")
def _(spark, d):
    return R.frequency_priority(period_table(spark, d).where("Perioden NOT LIKE '%KW%'"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("dimension_pivot", "SELECT sector, Perioden, " + ", ".join(f"avg(Metric_1::DOUBLE) FILTER (dim = '{p}') AS \"m_{p}\"" for p in PRIORITIES) + " FROM {period_table} WHERE contains(Perioden, 'KW') AND dim <> 'T001' GROUP BY ALL")
def _(spark, d):
    p = period_table(spark, d).where("Perioden LIKE '%KW%' AND dim <> 'T001'").withColumn("m", F.col("Metric_1").cast("double"))
    return R.dimension_pivot(p, ["sector", "Perioden"], "dim", PRIORITIES, ["m"])


@query("period_to_date", f"SELECT DISTINCT Perioden, {TO_DATE} AS period_enddate FROM {CODES}")
def _(spark, d):
    return period_table(spark, d).select("Perioden", period_to_date(F.col("Perioden")).alias("period_enddate")).distinct()


@query("period_frequency", "SELECT Perioden, CASE WHEN contains(Perioden, 'KW') THEN 'quarterly' WHEN contains(Perioden, 'MM') THEN 'monthly' WHEN contains(Perioden, 'JJ') THEN 'annual' ELSE 'unknown' END AS frequency, count(*) AS n FROM {period_table} GROUP BY ALL")
def _(spark, d):
    return period_table(spark, d).groupBy("Perioden", period_frequency(F.col("Perioden")).alias("frequency")).agg(F.count("*").alias("n"))


@query("period_parts", f"SELECT DISTINCT Perioden, yy AS year, n AS number FROM {CODES}")
def _(spark, d):
    return period_table(spark, d).select("Perioden", period_year(F.col("Perioden")).alias("year"), period_number(F.col("Perioden")).alias("number")).distinct()


@query("null_profile", f"WITH h AS ({HOLES}), n AS (SELECT count(*) AS n, count(*) FILTER (y IS NULL) AS a, count(*) FILTER (x_bal IS NULL) AS b FROM h) SELECT 'y' AS \"column\", a AS n_null, round(a * 100.0 / n, 6) AS pct FROM n UNION ALL SELECT 'x_bal', b, round(b * 100.0 / n, 6) FROM n")
def _(spark, d):
    return P.null_profile(holes(spark, d), ["y", "x_bal"]).withColumn("pct", six("pct"))


@query("top_missing", f"SELECT 'y' AS \"column\", count(*) FILTER (y IS NULL) AS n_null FROM ({HOLES})")
def _(spark, d):
    return P.null_profile(holes(spark, d)).orderBy(F.desc("n_null"), "column").limit(1).select("column", "n_null")


@query("duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return P.duplicate_keys(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def _(spark, d):
    return P.value_counts(table(spark, d, "part"), "p_type", 10)


@query("describe", "SELECT " + " UNION ALL SELECT ".join(f"'{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def _(spark, d):
    p = P.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return p.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("coverage_profile", "SELECT year, count(*) AS n_rows, min(period_enddate) AS first, max(period_enddate) AS last, count(DISTINCT sector) AS n_sectors FROM {panel} GROUP BY year")
def _(spark, d):
    return panel(spark, d).groupBy("year").agg(F.count("*").alias("n_rows"), F.min("period_enddate").alias("first"), F.max("period_enddate").alias("last"), F.countDistinct("sector").alias("n_sectors"))


@query("impute_target", f"WITH h AS ({HOLES}), m AS (SELECT quantile_cont(y, 0.5) AS m FROM h) SELECT sector, period_enddate, round(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY sector ORDER BY period_enddate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m), 6) AS y FROM h, m")
def _(spark, d):
    return P.impute_target(holes(spark, d)).select("sector", "period_enddate", six("y").alias("y"))


@query("binary_columns", "SELECT 'l_flag' AS column_name")
def _(spark, d):
    t = table(spark, d, "lineitem").withColumn("l_flag", (F.col("l_quantity") > 25).cast("int"))
    return spark.createDataFrame([(c,) for c in P.binary_columns(t)], "column_name string")


@query("impute_features", f"WITH h AS ({HOLES}), m AS (SELECT quantile_cont(y, 0.5) AS m FROM h) SELECT sector, period_enddate, round(coalesce(y, m), 6) AS y FROM h, m")
def _(spark, d):
    return P.impute_features(holes(spark, d), ["y"], []).select("sector", "period_enddate", six("y").alias("y"))


@query("missing_indicators", f"SELECT sector, period_enddate, (y IS NULL)::INT AS y_is_missing FROM ({HOLES})")
def _(spark, d):
    return P.missing_indicators(holes(spark, d), ["y"]).select("sector", "period_enddate", "y_is_missing")


@query("critical_missing", f"SELECT 'y' AS \"column\", count(*) FILTER (y IS NULL) AS n_missing FROM ({HOLES}) UNION ALL SELECT 'sector', 0")
def _(spark, d):
    return P.critical_missing(holes(spark, d), ["y", "sector"])


@query("decimal_comma", "SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem")
def _(spark, d):
    c = F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(","))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.decimal_comma(c).alias("v"))


@query("coerce_numeric", "SELECT p_partkey, try_cast(p_name AS DOUBLE) AS a, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS b FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.coerce_numeric(F.col("p_name")).alias("a"), X.coerce_numeric(F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).otherwise(".")).alias("b"))


@query("ratio_features", "SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", six(F.try_divide("l_tax", "l_discount")).alias("ratio"))


@query("union_all", "SELECT sector, period_enddate, y AS v FROM {panel} UNION ALL SELECT sector, period_enddate, x_bal FROM {panel} UNION ALL SELECT sector, period_enddate, n_orders FROM {panel}")
def _(spark, d):
    p = panel(spark, d)
    a, b, c = (p.select("sector", "period_enddate", F.col(v).cast("double").alias("v")) for v in ("y", "x_bal", "n_orders"))
    return a.unionByName(b).unionByName(c)


@query("union_models", f"SELECT model_name, sector_code, target_date FROM ({ALIGNED})")
def _(spark, d):
    a = J.align(canonical(spark, d), ["sector_code", "target_date", "horizon"])
    names = ["rolling", "naive", "seasonal_ma", "last"]
    parts = [a.where(F.col("model_name") == m).select("model_name", "sector_code", "target_date") for m in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query("intersect_keys", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("except_keys", "SELECT DISTINCT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).distinct().join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")), "k", "left_anti")


@query("distinct_lookup", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("topk_groups", "SELECT sector, period_enddate, n_orders FROM {panel} WHERE sector IN (SELECT sector FROM {panel} GROUP BY 1 ORDER BY sum(n_orders) DESC, sector LIMIT 6)")
def _(spark, d):
    p = panel(spark, d)
    top = p.groupBy("sector").agg(F.sum("n_orders").alias("n")).orderBy(F.desc("n"), "sector").limit(6).select("sector")
    return p.join(top, "sector", "left_semi").select("sector", "period_enddate", "n_orders")


@query("worst_k", "SELECT model_name, sector_code, mae FROM {sector_mae} ORDER BY mae DESC, model_name, sector_code LIMIT 5")
def _(spark, d):
    return sector_mae(spark, d).orderBy(F.desc("mae"), "model_name", "sector_code").limit(5).select("model_name", "sector_code", "mae")
