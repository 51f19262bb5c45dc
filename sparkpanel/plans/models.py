"""Queries of selection, champions, hierarchies, disaggregation and diagnostics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import champion as H
from ..operators import disaggregation as D
from ..operators import hierarchy as T
from ..operators import selection as K
from ..operators.order import wide_quantiles
from ..operators.windows import lagged
from ..sources.scratch import shared_path
from ..streaming import landing as L
from .frames import canonical, panel, sector_mae, table
from .registry import query
from .scores import MASE, TIER, mase

six = lambda c: F.round(c, 6)
FEATURES = ["n_orders", "x_bal", "quarter"]


@query("near_constant", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(max(n) / sum(n)::DOUBLE, 6) AS share, max(n) / sum(n)::DOUBLE <= 0.95 AS retained FROM (SELECT {f}, count(*) AS n FROM {{panel}} GROUP BY 1)" for f in FEATURES))
def _(spark, d):
    return K.near_constant(panel(spark, d), ["sector", "period_enddate"], FEATURES).withColumn("share", six("share"))


@query("corr_pooled", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f}, y), 5) AS r FROM {{panel}}" for f in FEATURES))
def _(spark, d):
    return K.target_correlation(panel(spark, d), ["sector", "period_enddate"], FEATURES, "y").withColumn("r", F.round("r", 5))


_S = "PARTITION BY sector ORDER BY period_enddate"


@query("corr_within_diff", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f} , y), 5) AS r FROM (SELECT y - lag(y) OVER ({_S}) AS y, {f} - lag({f}) OVER ({_S}) AS {f} FROM {{panel}})" for f in FEATURES[:2]))
def _(spark, d):
    from ..operators.windows import differences

    p = differences(panel(spark, d), ["y", *FEATURES[:2]])
    return K.target_correlation(p, ["sector"], FEATURES[:2], "y").withColumn("r", F.round("r", 5))


@query("lagged_corr", " UNION ALL ".join(f"SELECT '{f}' AS feature, {h} AS horizon, round(median(abs(r)), 5) AS r FROM (SELECT sector, corr({f}, a) AS r FROM (SELECT sector, {f}, lead(y, {h}) OVER ({_S}) AS a FROM {{panel}}) WHERE a IS NOT NULL GROUP BY 1 HAVING count(*) > 10)" for f in FEATURES[:2] for h in range(1, 5)))
def _(spark, d):
    return K.lagged_correlation(panel(spark, d), FEATURES[:2], "y", "sector", "period_enddate").withColumn("r", F.round("r", 5))


@query("redundancy")
def _(spark, d):
    return spark.createDataFrame(K.redundancy(panel(spark, d), FEATURES, "y"), "feature string, cluster long, retained boolean")


@query("yearly_evaluation", f"""WITH o AS (SELECT sector, year, avg(y) AS t, avg(x_bal) AS v FROM {{panel}} GROUP BY ALL), d AS (SELECT *, v - lag(v) OVER w AS dv, t - lag(t) OVER w AS dt, lead(t) OVER w AS a FROM o WINDOW w AS (PARTITION BY sector ORDER BY year)),
r AS (SELECT sector, abs(corr(dv, dt)) AS r1, abs(corr(v, a) FILTER (a IS NOT NULL)) AS r2 FROM d GROUP BY 1) SELECT 'x_bal' AS feature, round(median(r1), 5) AS r_diff, round(median(r2), 5) AS r_ahead FROM r""")
def _(spark, d):
    e = K.yearly_evaluation(panel(spark, d), ["x_bal"], "y", "sector", "year")
    return e.withColumns({"r_diff": F.round("r_diff", 5), "r_ahead": F.round("r_ahead", 5)})


BRANDS = "(SELECT p_brand AS name, list_sort(list(DISTINCT p_size % 3)) AS columns FROM part GROUP BY 1)"


@query("dedupe_presets", f"SELECT array_to_string(columns, ',') AS columns, min(name) AS name, count(*) AS n_same FROM {BRANDS} GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set(F.col("p_size") % 3).alias("columns"))
    return K.dedupe_presets(p).select(F.array_join(F.col("columns").cast("array<string>"), ",").alias("columns"), "name", "n_same")


@query("group_by_category", "SELECT coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN r_name END, 'ungrouped') AS \"group\", string_agg(n_name, ',' ORDER BY n_name) AS columns FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "nation")
    origin = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("column"), F.col("n_regionkey").cast("string").alias("table_id"))
    registry = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("table_id"), F.col("r_name").alias("category"))
    g = K.group_by_category(n.select(F.col("n_name").alias("feature")), origin, registry)
    return g.select("group", F.array_join("columns", ",").alias("columns"))


INNER = "(SELECT sector_code, model_name, avg(abs(y_pred - y_true)) AS m FROM {canonical} WHERE fold_set = 'inner' GROUP BY ALL)"


@query("variant_select_honest", f"SELECT c.model_name, c.sector_code, c.target_date, c.y_pred FROM {{canonical}} c JOIN (SELECT sector_code, min_by(model_name, (round(m, 9), model_name)) AS model_name FROM {INNER} GROUP BY 1) b ON c.sector_code = b.sector_code AND c.model_name = b.model_name WHERE fold_set = 'outer'")
def _(spark, d):
    return H.select_honest(canonical(spark, d)).select("model_name", "sector_code", "target_date", "y_pred")


@query("variant_select_global", "SELECT model_name, sector_code, target_date, y_pred FROM {canonical} WHERE fold_set = 'outer' AND model_name = (SELECT min_by(model_name, (round(m, 9), model_name)) FROM (SELECT model_name, avg(abs(y_pred - y_true)) AS m FROM {canonical} WHERE fold_set = 'inner' GROUP BY 1))")
def _(spark, d):
    return H.select_global(canonical(spark, d)).select("model_name", "sector_code", "target_date", "y_pred")


@query("variant_select_legacy", "SELECT sector_code, min_by(model_name, (round(m, 9), model_name)) AS model_name FROM (SELECT sector_code, model_name, avg(abs(y_pred - y_true)) AS m FROM {canonical} WHERE fold_set = 'outer' GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return H.select_by_outer(canonical(spark, d)).select("sector_code", "model_name")


CHAMPIONS = f"(SELECT * FROM {MASE} WHERE model_name <> 'naive' QUALIFY row_number() OVER (PARTITION BY sector_code ORDER BY mase, model_name) = 1)"


def champions(spark, d):
    m = mase(spark, d)
    return H.champion_gate(m.where("model_name <> 'naive'"), m.where("model_name = 'naive' AND length(sector_code) > 8"), "sector_code")


@query("champion_gate", f"SELECT c.sector_code, c.model_name, c.mase, CASE WHEN i.mase IS NULL THEN 'seed' WHEN c.mase < i.mase THEN 'promote' ELSE 'keep' END AS verdict FROM {CHAMPIONS} c LEFT JOIN (SELECT * FROM {MASE} WHERE model_name = 'naive' AND length(sector_code) > 8) i ON c.sector_code = i.sector_code")
def _(spark, d):
    return champions(spark, d).select("sector_code", "model_name", "mase", "verdict")


@query("quality_table", f"SELECT c.sector_code, c.model_name, c.mase, b.mase AS baseline_mase, {TIER.replace('mase', 'c.mase')} AS tier FROM {CHAMPIONS} c LEFT JOIN (SELECT * FROM {MASE} WHERE model_name = 'naive') b ON c.sector_code = b.sector_code")
def _(spark, d):
    return H.quality_table(champions(spark, d).select("sector_code", "model_name", "mase"), mase(spark, d).where("model_name = 'naive'"), "sector_code")


@query("sound_sectors", f"SELECT sector_code FROM {CHAMPIONS} WHERE mase <= 0.9 + 1e-9")
def _(spark, d):
    return champions(spark, d).where(X.tier(F.col("mase")) == "Good").select("sector_code")


@query("win_counts", f"SELECT model_name, count(*) AS n_won, count(*) FILTER (mase < 1) AS n_beat_naive FROM {CHAMPIONS} GROUP BY 1")
def _(spark, d):
    return H.win_counts(champions(spark, d))


@query("forecast_overlay", "SELECT sector AS sector_code, period_enddate AS at, y AS value, 'observed' AS kind FROM {panel} UNION ALL SELECT sector_code, target_date, y_pred, model_name FROM {canonical}")
def _(spark, d):
    seen = panel(spark, d).select(F.col("sector").alias("sector_code"), F.col("period_enddate").alias("at"), F.col("y").alias("value"), F.lit("observed").alias("kind"))
    return seen.unionByName(canonical(spark, d).select("sector_code", F.col("target_date").alias("at"), F.col("y_pred").alias("value"), F.col("model_name").alias("kind")))


@query("reduce_lags", "SELECT sector, period_enddate, y, " + ", ".join(f"lag(y, {k}) OVER (PARTITION BY sector ORDER BY period_enddate) AS y_lag{k}" for k in range(1, 5)) + " FROM {panel} QUALIFY lag(y, 4) OVER (PARTITION BY sector ORDER BY period_enddate) IS NOT NULL")
def _(spark, d):
    p = panel(spark, d).select("sector", "period_enddate", "y")
    for k in range(1, 5):
        p = lagged(p, ["y"], k)
    return p.where("y_lag4 IS NOT NULL")


@query("quantile_bands", "SELECT model_name, horizon, round(quantile_cont(e, 0.1), 6) AS low_80, round(quantile_cont(e, 0.9), 6) AS high_80 FROM (SELECT model_name, horizon, y_true - y_pred AS e FROM {canonical}) GROUP BY 1, 2")
def _(spark, d):
    e = canonical(spark, d).select("model_name", "horizon", (F.col("y_true") - F.col("y_pred")).alias("e"))
    q = wide_quantiles(e, {"low_80": ("e", 0.1), "high_80": ("e", 0.9)}, ["model_name", "horizon"])
    return q.select("model_name", "horizon", six("low_80").alias("low_80"), six("high_80").alias("high_80"))


YEARS = "(SELECT sector, year, round(avg(y), 6) AS v FROM {panel} GROUP BY ALL)"


@query("interpolate_linear", f"""WITH w AS (SELECT *, coalesce(lag(v) OVER o, v) AS b, coalesce(lead(v) OVER o, v) AS a FROM {YEARS} WINDOW o AS (PARTITION BY sector ORDER BY year)),
r AS (SELECT sector, year, q::INT AS quarter, v, CASE q WHEN 1 THEN v - (v - b) * 0.375::DOUBLE WHEN 2 THEN v - (v - b) * 0.125::DOUBLE WHEN 3 THEN v + (a - v) * 0.125::DOUBLE ELSE v + (a - v) * 0.375::DOUBLE END AS raw FROM w, range(1, 5) t(q))
SELECT sector, year, quarter, round(raw + v - avg(raw) OVER (PARTITION BY sector, year), 5) AS v FROM r""")
def _(spark, d):
    y = panel(spark, d).groupBy("sector", "year").agg(six(F.avg("y")).alias("v"))
    return D.interpolate_linear(y, "sector", "year", "v").withColumn("v", F.round("v", 5))


#: The changes of a year's quarters, as in the operator: forward over the years for the unknown next quarter, then backward.
_LAST = lambda t: f"(SELECT (3 * s - 2) * ((10 * ({t} - c4) - b4 * c5) / det) + 6 * ((a4 * c5 - a5 * ({t} - c4)) / det) - 3 * h FROM (SELECT *, 10 * a4 - b4 * a5 AS det FROM (SELECT f.s AS s, f.h AS h, f.e * (3 * f.s - 2) - (2 * f.s - 1) AS a4, 6 * f.e - 2 AS b4, f.h * (2 - 3 * f.e) AS c4, 6 * f.s - 2 AS a5, f.total + 6 * f.h AS c5)))"
DENTON = f"""WITH RECURSIVE a AS MATERIALIZED (SELECT *, avg(y) OVER (PARTITION BY sector, year) AS annual, count(*) OVER (PARTITION BY sector, year) AS n FROM {{panel}}),
ys AS MATERIALIZED (SELECT sector, year, 4 * max(annual) - sum(x_bal) AS total, row_number() OVER (PARTITION BY sector ORDER BY year) AS k, count(*) OVER (PARTITION BY sector) AS ks FROM a WHERE n = 4 GROUP BY sector, year),
f AS (SELECT sector, k, ks, total, 1.0::DOUBLE AS s, 0.0::DOUBLE AS h, CASE WHEN k = ks THEN 1.0 ELSE 2.0 END::DOUBLE AS e FROM ys WHERE k = 1
UNION ALL SELECT y.sector, y.k, y.ks, y.total, 2 - ({_LAST(1)} - {_LAST(0)}), {_LAST(0)}, CASE WHEN y.k = y.ks THEN 1.0 ELSE 2.0 END::DOUBLE FROM f JOIN ys y ON y.sector = f.sector AND y.k = f.k + 1),
g AS MATERIALIZED (SELECT *, e * (3 * s - 2) - (2 * s - 1) AS a4, 6 * e - 2 AS b4, h * (2 - 3 * e) AS c4, 6 * s - 2 AS a5, total + 6 * h AS c5, 10 * (e * (3 * s - 2) - (2 * s - 1)) - (6 * e - 2) * (6 * s - 2) AS det FROM f),
b AS (SELECT *, (10 * (0 - c4) - b4 * c5) / det AS x1, (a4 * c5 - a5 * (0 - c4)) / det AS m FROM g WHERE k = ks
UNION ALL SELECT g.*, (10 * (b.x1 - g.c4) - g.b4 * g.c5) / g.det, (g.a4 * g.c5 - g.a5 * (b.x1 - g.c4)) / g.det FROM b JOIN g ON g.sector = b.sector AND g.k = b.k - 1)
SELECT a.sector, a.year, quarter, round(x_bal + CASE quarter WHEN 1 THEN x1 WHEN 2 THEN s * x1 + m - h WHEN 3 THEN (2 * s - 1) * x1 + 3 * m - 2 * h ELSE (3 * s - 2) * x1 + 6 * m - 3 * h END, 5) AS annual
FROM a JOIN ys USING (sector, year) JOIN b ON b.sector = a.sector AND b.k = ys.k WHERE n = 4"""


@query("denton_cholette", DENTON)
def _(spark, d):
    p = panel(spark, d).withColumn("annual", F.avg("y").over(Window.partitionBy("sector", "year")))
    return D.denton_series(p, "sector", "year", "quarter", "annual", "x_bal").withColumn("annual", F.round("annual", 5))


@query("broadcast_series_test", "SELECT bool_and(s < 1e-10) AS is_broadcast FROM (SELECT stddev_pop(y) AS s FROM {panel} GROUP BY period_enddate)")
def _(spark, d):
    return D.constant_over_series(panel(spark, d), "period_enddate", "y")


@query("best_indicator", f"""WITH o AS (SELECT sector, year, avg(y) AS a, avg(n_orders) AS n_orders, avg(x_bal) AS x_bal FROM {{panel}} GROUP BY ALL), r AS (SELECT sector, 'n_orders' AS feature, corr(n_orders, a) AS r FROM o GROUP BY 1 UNION ALL SELECT sector, 'x_bal', corr(x_bal, a) FROM o GROUP BY 1)
SELECT sector, max_by(feature, (round(abs(r), 9), feature)) AS feature, round(max_by(r, (round(abs(r), 9), feature)), 5) AS r FROM r WHERE abs(r) >= 0.3 GROUP BY 1""")
def _(spark, d):
    return D.best_indicator(panel(spark, d), "sector", "year", "y", ["n_orders", "x_bal"]).withColumn("r", F.round("r", 5))


#: Codes and titles of all kinds, made of the columns of part.
CODES = """(SELECT *, lpad(p_size::VARCHAR, 2, '0') || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.' || (p_partkey % 10) WHEN 2 THEN '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') WHEN 3 THEN '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '.' || (p_partkey % 7) ELSE p_brand END AS code,
CASE p_partkey % 6 WHEN 0 THEN 'A-U ' WHEN 1 THEN chr(65 + p_size % 10) || '-' || chr(75 + p_size % 10) || ' ' WHEN 2 THEN chr(65 + p_size % 21) || ' ' WHEN 3 THEN p_size || '-' || (p_size + 2) || ' ' WHEN 4 THEN 'WP' || p_size ELSE '' END || p_name AS title FROM part)"""
LEVEL_OF_CODE = "CASE len(string_split(code, '.')) WHEN 1 THEN 'division' WHEN 2 THEN CASE WHEN length(string_split(code, '.')[2]) = 1 THEN 'group' ELSE 'class' END ELSE 'subclass' END"
LEVEL_OF_TITLE = "CASE WHEN starts_with(title, 'WP') THEN 'size' WHEN starts_with(title, 'A-U ') THEN 'total' WHEN regexp_matches(title, '^[A-Z]-[A-Z] ') THEN 'sector' WHEN regexp_matches(title, '^[A-Z] ') THEN 'section' WHEN left(title, 1) BETWEEN '0' AND '9' THEN 'subdivision' ELSE 'other' END"
SECTION_OF_CODE = "CASE " + " ".join(f"WHEN left(code, 2)::INT BETWEEN {a} AND {b} THEN '{s}'" for s, a, b in X.SECTIONS) + " END"


def coded_parts(spark, d):
    """part with code and title."""
    text = lambda c: c.cast("string")
    two = lambda c: F.lpad(text(c), 2, "0")
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda k, *values: F.element_at(F.array(*values), (key % k + 1).cast("int"))
    dot, tens = F.lit("."), two(key % 100)
    code = F.concat(two(size), pick(5, F.lit(""), F.concat(dot, text(key % 10)), F.concat(dot, tens), F.concat(dot, tens, dot, text(key % 7)), F.col("p_brand")))
    letter = lambda first, n: F.char(first + size % n)
    head = pick(6, F.lit("A-U "), F.concat(letter(65, 10), F.lit("-"), letter(75, 10), F.lit(" ")), F.concat(letter(65, 21), F.lit(" ")), F.concat(text(size), F.lit("-"), text(size + 2), F.lit(" ")), F.concat(F.lit("WP"), text(size)), F.lit(""))
    return table(spark, d, "part").withColumns({"code": code, "title": F.concat(head, "p_name")})


@query("hierarchy_level_code", f"SELECT p_partkey, code, {LEVEL_OF_CODE} AS level FROM {CODES} WHERE p_partkey % 5 < 4")
def _(spark, d):
    return coded_parts(spark, d).where("p_partkey % 5 < 4").select("p_partkey", "code", X.level_by_code(F.col("code")).alias("level"))


@query("hierarchy_level_title", f"SELECT p_partkey, title, {LEVEL_OF_TITLE} AS level FROM {CODES}")
def _(spark, d):
    return coded_parts(spark, d).select("p_partkey", "title", X.level_by_title(F.col("title")).alias("level"))


@query("split_by_level", f"""WITH t AS (SELECT DISTINCT code, {LEVEL_OF_CODE} AS level, {SECTION_OF_CODE} AS section FROM {CODES} WHERE p_partkey % 5 < 4 AND p_size % 9 <> 0),
m AS (SELECT p.*, level, section FROM {CODES} p LEFT JOIN t USING (code))
SELECT frame, section, count(*) AS n, min(p_partkey) AS first FROM (SELECT coalesce(level, '_unmatched') AS frame, NULL AS section, p_partkey FROM m UNION ALL SELECT 'section', section, p_partkey FROM m WHERE level = 'division' AND section IS NOT NULL) GROUP BY ALL""")
def _(spark, d):
    p = coded_parts(spark, d)
    known = p.where("p_partkey % 5 < 4 AND p_size % 9 <> 0").select(F.concat("code", F.lit(" ")).alias("Key"), X.level_by_code(F.col("code")).alias("level"), X.section_of_division(F.substring("code", 1, 2).cast("int")).alias("section"))
    s = T.split_by_level(p, "code", known)
    return s.groupBy("frame", "section").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("tree_paths", "WITH RECURSIVE t AS (SELECT c_custkey AS code, 0 AS depth, c_custkey::VARCHAR AS path FROM customer WHERE c_custkey <= 3 UNION ALL SELECT c_custkey, depth + 1, path || '/' || c_custkey FROM customer JOIN t ON c_custkey // 4 = code AND c_custkey > 3) SELECT code, depth, path FROM t")
def _(spark, d):
    """Customers as a tree in which each has four below it: as deep as the table is large."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") > 3, F.floor(F.col("c_custkey") / 4)).alias("parent"))
    return T.tree_paths(c)


@query("division_to_section", "SELECT p_partkey, p_size, CASE " + " ".join(f"WHEN p_size BETWEEN {a} AND {b} THEN '{s}'" for s, a, b in X.SECTIONS) + " END AS section FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", X.section_of_division(F.col("p_size")).alias("section"))


@query("range_letters", "SELECT n_nationkey, CASE WHEN n_nationkey % 7 <> 0 THEN array_to_string(list_transform(range(65 + n_regionkey, 66 + n_regionkey + n_nationkey % 5), lambda x: chr(x::INT)), '') END AS letters FROM nation")
def _(spark, d):
    first = F.ascii(F.lit("A")) + F.col("n_regionkey")
    ends = F.when(F.col("n_nationkey") % 7 != 0, F.concat(F.lit("-"), F.char(first + F.col("n_nationkey") % 5))).otherwise("")
    title = F.concat(F.char(first), ends, F.lit(" "), "n_name")
    return table(spark, d, "nation").select("n_nationkey", F.array_join(X.range_letters(title), "").alias("letters"))


@query("metric_prefix", "SELECT s_suppkey, regexp_extract(s_name || '_x_' || s_suppkey || '_y', '^(.+?)_[0-9]', 1) AS prefix FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.metric_prefix(F.concat("s_name", F.lit("_x_"), F.col("s_suppkey").cast("string"), F.lit("_y"))).alias("prefix"))


@query("family_name", "SELECT DISTINCT model_name || '_x' AS model, model_name AS family FROM {sector_mae}")
def _(spark, d):
    m = sector_mae(spark, d).select(F.concat("model_name", F.lit("_x")).alias("model")).distinct()
    return m.select("model", X.family_name(F.col("model")).alias("family"))


@query("group_label", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'discovery' ELSE 'a+' || n_name END AS label FROM nation")
def _(spark, d):
    g = F.when(F.col("n_nationkey") % 3 != 0, F.to_json(F.array(F.lit("a"), "n_name")))
    return table(spark, d, "nation").select("n_nationkey", X.group_label(g).alias("label"))


@query("params_json_coerce", "SELECT event_id, CASE WHEN value IS NULL THEN 'null' WHEN value = floor(value) AND value::VARCHAR NOT LIKE '%.%' THEN 'integer' ELSE 'number' END AS kind FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.json_value(F.col("value").cast("string")).alias("kind"))


@query("feature_set_hash", "SELECT p_brand, substr(sha1(string_agg(p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR)), 1, 12) AS h FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("c"))
    return p.select("p_brand", X.feature_set_hash(F.col("c")).alias("h"))


@query("paradigm_quadrant", "SELECT DISTINCT model_name, CASE model_name WHEN 'naive' THEN 'uni/explainable' WHEN 'rolling' THEN 'uni/explainable' ELSE CASE WHEN contains(model_name, 'season') THEN 'uni/seasonal' ELSE 'unknown' END END AS quadrant FROM {sector_mae}")
def _(spark, d):
    m = sector_mae(spark, d).select("model_name").distinct()
    known = X.mapped(F.col("model_name"), {"naive": "uni/explainable", "rolling": "uni/explainable"})
    return m.select("model_name", F.coalesce(known, F.when(F.col("model_name").rlike("season"), "uni/seasonal").otherwise("unknown")).alias("quadrant"))


LABELS = "(SELECT p_partkey, replace(lower(p_type), ' ', '_') || '|b' || p_size || '_a' || (p_partkey % 3) || CASE WHEN starts_with(p_brand, 'Brand#1') THEN '|winsorized' ELSE '' END AS label FROM part)"


@query("correction_label_parse", f"SELECT p_partkey, split_part(label, '|', 1) AS method, regexp_extract(label, '[|]b([0-9]+)', 1)::INT AS before, regexp_extract(label, '_a([0-9]+)', 1)::INT AS after, contains(label, '|winsorized') AS winsorized FROM {LABELS}")
def _(spark, d):
    text = F.concat(F.translate(F.lower("p_type"), " ", "_"), F.lit("|b"), F.col("p_size").cast("string"), F.lit("_a"), (F.col("p_partkey") % 3).cast("string"), F.when(F.col("p_brand").startswith("Brand#1"), "|winsorized").otherwise(""))
    p = table(spark, d, "part").select("p_partkey", text.alias("label"))
    return p.select("p_partkey", *[c.alias(n) for n, c in X.correction_parts(F.col("label")).items()])


@query("normalize_group_code", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size::VARCHAR ELSE p_brand END AS code FROM part")
def _(spark, d):
    k, s = F.col("p_size") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, "  ").when(k == 1, s).when(k == 2, F.concat(s, F.lit(".0"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.normal_group_code(raw).alias("code"))


@query("strip_letter_prefix", f"SELECT p_partkey, regexp_replace(title, '^[A-Z] +', '') AS title FROM {CODES}")
def _(spark, d):
    return coded_parts(spark, d).select("p_partkey", X.strip_letter_prefix(F.col("title")).alias("title"))


@query("tree_parent", "SELECT 'N' || n_nationkey AS code, 'S' || n_regionkey AS parent FROM nation UNION ALL SELECT 'S' || r_regionkey, 'ALL' FROM region UNION ALL SELECT 'ALL', NULL")
def _(spark, d):
    letter = lambda c: F.char(F.ascii(F.lit("A")) + F.col(c) * 5)
    nations = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.concat(letter("n_regionkey"), F.lit(" "), "n_name").alias("title"), F.lit("section").alias("level"))
    ends = F.concat(letter("r_regionkey"), F.lit("-"), F.char(F.ascii(F.lit("A")) + F.col("r_regionkey") * 5 + 1), F.lit(" "), "r_name")
    regions = table(spark, d, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("code"), ends.alias("title"), F.lit("sector").alias("level"))
    total = spark.createDataFrame([("ALL", "A-U All", "total")], "code string, title string, level string")
    return T.tree_parent(nations.unionByName(regions).unionByName(total)).select("code", "parent")


@query("acf", " UNION ALL ".join(f"SELECT sector, {k} AS lag, round(sum((y - m) * (l - m)) / max(s), 5) AS r FROM (SELECT *, avg(y) OVER (PARTITION BY sector) AS m, lag(y, {k}) OVER (PARTITION BY sector ORDER BY period_enddate) AS l FROM {{panel}}) JOIN (SELECT sector, var_pop(y) * count(*) AS s FROM {{panel}} GROUP BY 1) USING (sector) GROUP BY 1" for k in (1, 2, 4)))
def _(spark, d):
    from ..operators.diagnostics import acf

    return acf(panel(spark, d), "sector", "period_enddate", "y", [1, 2, 4]).withColumn("r", F.round("r", 5))


@query("ljung_box", "SELECT sector, round(n * (n + 2) * sum(r * r / (n - k)), 4) AS q FROM (" + " UNION ALL ".join(f"SELECT sector, {k} AS k, count(*) AS n, sum((y - m) * (l - m)) / (var_pop(y) * count(*)) AS r FROM (SELECT *, avg(y) OVER (PARTITION BY sector) AS m, lag(y, {k}) OVER (PARTITION BY sector ORDER BY period_enddate) AS l FROM {{panel}}) GROUP BY 1" for k in (1, 2, 3, 4)) + ") GROUP BY sector, n")
def _(spark, d):
    from ..operators.diagnostics import ljung_box

    return ljung_box(panel(spark, d), "sector", "period_enddate", "y", 4).withColumn("q", F.round("q", 4))


@query("component_strength", """WITH c AS (SELECT sector, y, avg(y) OVER (PARTITION BY sector, quarter) - avg(y) OVER (PARTITION BY sector) AS seasonal FROM {panel})
SELECT sector, round(greatest(0, 1 - var_pop(y - seasonal) / var_pop(y)), 6) AS strength FROM c GROUP BY 1""")
def _(spark, d):
    from ..operators.diagnostics import component_strength

    p = panel(spark, d).withColumn("seasonal", F.avg("y").over(Window.partitionBy("sector", "quarter")) - F.avg("y").over(Window.partitionBy("sector")))
    return component_strength(p.withColumn("remainder", F.col("y") - F.col("seasonal")), "sector", "seasonal", "remainder").withColumn("strength", six("strength"))


@query("seasonal_period", """WITH f AS (SELECT sector, y - lag(y) OVER (PARTITION BY sector ORDER BY period_enddate) AS d, row_number() OVER (PARTITION BY sector ORDER BY period_enddate) - 2 AS t FROM {panel}),
p AS (SELECT sector, k, sum(d * cos(2 * pi() * k * t / n)) ** 2 + sum(d * sin(2 * pi() * k * t / n)) ** 2 AS power, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY sector) AS n FROM f WHERE d IS NOT NULL), range(1, 13) r(k) WHERE k <= n / 2 GROUP BY ALL)
SELECT sector, max_by(round(n / k::DOUBLE)::BIGINT, (round(power, 4), -k)) AS period FROM p GROUP BY 1""")
def _(spark, d):
    from ..operators.diagnostics import seasonal_period

    return seasonal_period(panel(spark, d), "sector", "period_enddate", "y")


LANDED = "SELECT event_type, 1 AS n_files, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1"


def event_files(spark, d, name: str):
    """A folder with the events, one file for each type."""
    top = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    src = table(spark, d, "events")
    src.repartition("event_type").write.partitionBy("event_type").parquet(f"{top}/in")
    return top, src.drop("event_type")


def by_file(rows):
    """Files and rows of each type, by the names of the files that they came from."""
    kind = F.regexp_extract("_source_file", "event_type=([^/]+)/", 1)
    return rows.groupBy(kind.alias("event_type")).agg(F.countDistinct("_source_file").cast("int").alias("n_files"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("incremental_landing", LANDED)
def _(spark, d):
    """A file that is written again takes the place of its rows, and a last run finds nothing new."""
    top, src = event_files(spark, d, "landing")
    L.land_files(spark, f"{top}/in", src.schema, f"{top}/out", pattern="*.parquet")
    again = table(spark, d, "events")
    one = again.agg(F.min("event_type")).scalar()
    again.where(F.col("event_type") == one).repartition("event_type").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type").parquet(f"{top}/in")
    # Spark gives the new file a name of its own, so its old rows are those of a file that is gone
    L.land_files(spark, f"{top}/in", src.schema, f"{top}/out", pattern="*.parquet")
    L.land_files(spark, f"{top}/in", src.schema, f"{top}/out", pattern="*.parquet")
    there = L.source_files(spark, f"{top}/in", "*.parquet").select("_source_file")
    return by_file(L.landed(spark, f"{top}/out").join(there, "_source_file", "left_semi"))


@query("stream_landing", LANDED)
def _(spark, d):
    top, src = event_files(spark, d, "stream")
    for _ in range(2):  # the second run finds nothing new
        L.stream_new_files(spark, f"{top}/in", src.schema, f"{top}/out", f"{top}/state")
    return by_file(spark.read.parquet(f"{top}/out"))


@query("skip_loaded", "SELECT DISTINCT event_type, false AS changed FROM events WHERE event_type <> (SELECT min(event_type) FROM events)")
def _(spark, d):
    """The files of all types but the one that was landed before."""
    top, src = event_files(spark, d, "skip")
    first = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    L.land_files(spark, f"{top}/in/event_type={first}", src.schema, f"{top}/out", pattern="*.parquet")
    left = L.new_files(L.source_files(spark, f"{top}/in", "*.parquet"), L.manifest(spark, f"{top}/out"))
    return left.select(F.regexp_extract("_source_file", "event_type=([^/]+)/", 1).alias("event_type"), "changed")
