"""Queries of sinks, catalogues, groupings and composed reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import metric_prefix, tier
from ..operators import champion as H
from ..operators import scorecard as B
from ..operators import selection as K
from ..operators.forecast import sliding_backtest, walk_forward
from ..operators.hierarchy import lookup
from ..sources import io
from ..sources.keyed import KeyedTable
from ..sources.scratch import shared_path
from . import integrals as S
from .frames import canonical, order_facts, panel, table
from .models import CHAMPIONS, champions
from .registry import query
from .scores import CRPS_SQL, KNOTS, METRICS, TIER

six = lambda c: F.round(c, 6)


def place(spark, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("table_sink", "SELECT sector, period_enddate, y FROM {panel} UNION ALL SELECT sector, period_enddate, y FROM {panel}")
def _(spark, d):
    path, p = place(spark, "table"), panel(spark, d).select("sector", "period_enddate", "y")
    io.write_table(p, path)
    io.write_table(p, path, "append", {"y": "double"})
    return spark.read.parquet(path)


@query("parquet_predictions_scan", "SELECT model_name, sector_code, origin_date, target_date, horizon, y_true, y_pred, y_lower_80, y_upper_80, y_lower_95, y_upper_95 FROM {canonical}")
def _(spark, d):
    path = place(spark, "predictions")
    canonical(spark, d).write.parquet(path)
    return io.canonical_scan(spark, path)


@query("replace_by_key_sink", "SELECT sector, period_enddate, CASE WHEN sector IN ('NATION_1', 'NATION_2') THEN round(y * 2, 6) ELSE y END AS y FROM {panel}")
def _(spark, d):
    t, p = KeyedTable(spark, place(spark, "by-key"), "sector"), panel(spark, d).select("sector", "period_enddate", "y")
    t.replace(p)
    t.replace(p.where("sector IN ('NATION_1', 'NATION_2')").withColumn("y", six(F.col("y") * 2)))
    return t.read()


@query("keyed_versions", "SELECT v AS version, count(*) AS n, count(DISTINCT o_custkey) AS n_keys, min(o_orderkey) AS first FROM orders, range(1, 4) t(v) WHERE NOT (v >= 2 AND o_custkey % 3 = 0 AND o_orderkey % 2 = 0) AND NOT (v = 3 AND o_custkey % 5 = 0) GROUP BY 1")
def _(spark, d):
    """Orders by customer: keys that are replaced by fewer rows, then keys that lose all; each version can still be read."""
    t, o = KeyedTable(spark, place(spark, "versions"), "o_custkey"), table(spark, d, "orders")
    t.replace(o)
    t.replace(o.where("o_custkey % 3 = 0 AND o_orderkey % 2 = 1"), o.where("o_custkey % 3 = 0").select("o_custkey"))
    t.replace(o.limit(0), o.where("o_custkey % 5 = 0").select("o_custkey"))
    parts = [t.read(v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_keys"), F.min("o_orderkey").alias("first")) for v in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("full_refresh_sink", "SELECT sector, period_enddate, CASE WHEN quarter <> 2 THEN y END AS y FROM {panel}")
def _(spark, d):
    path, p = place(spark, "refresh"), panel(spark, d)
    nan = p.withColumn("y", F.when(F.col("quarter") == 2, float("nan")).otherwise(F.col("y")))
    io.full_refresh(nan, path, p.select("sector", "period_enddate", "y").schema)
    return spark.read.parquet(path)


@query("report_sinks", f"SELECT sector_code, model_name, mase FROM {CHAMPIONS}")
def _(spark, d):
    path = place(spark, "report")
    io.write_report({"champions": champions(spark, d).select("sector_code", "model_name", "mase")}, path)
    return spark.read.parquet(f"{path}/champions.parquet")


@query("champion_table", f"SELECT sector_code, model_name, mase FROM {CHAMPIONS}")
def _(spark, d):
    t, c = KeyedTable(spark, place(spark, "champions"), "sector_code"), champions(spark, d).select("sector_code", "model_name", "mase")
    t.replace(c.withColumn("model_name", F.lit("incumbent")))
    t.replace(c)
    return t.read()


@query("sector_performance", f"SELECT c.sector_code, c.model_name, c.mase, {TIER.replace('mase', 'c.mase')} AS tier, coalesce(r_name, '') AS title FROM {CHAMPIONS} c LEFT JOIN nation ON n_name = sector_code LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    titles = n.select(F.col("n_name").alias("Key"), F.col("r_name").alias("title"), F.lit("section").alias("level"))
    c = champions(spark, d).select("sector_code", "model_name", "mase", tier(F.col("mase")).alias("tier"))
    return lookup(c, titles, "sector_code").drop("level")


@query("load_families", "SELECT model_name AS family, sector_code, target_date, y_pred FROM {canonical} WHERE fold_set = 'outer' AND model_name IN ('last', 'naive') UNION ALL SELECT 'seasonal', sector_code, target_date, y_pred FROM {canonical} WHERE fold_set = 'outer' AND model_name = 'seasonal_ma'")
def _(spark, d):
    c = canonical(spark, d).where("model_name <> 'rolling'")
    c = c.withColumn("family", F.when(F.col("model_name").startswith("seasonal"), "seasonal").otherwise(F.col("model_name")))
    return H.select_honest(c, ["sector_code", "family"]).select("family", "sector_code", "target_date", "y_pred")


@query("cross_fold_selection", "WITH b AS (SELECT sector_code, min_by(model_name, (round(m, 9), model_name)) AS model_name FROM (SELECT sector_code, model_name, avg(abs(y_pred - y_true)) AS m FROM {canonical} WHERE fold_set = 'inner' GROUP BY ALL) GROUP BY 1) SELECT c.sector_code, c.model_name, round(avg(abs(y_pred - y_true)), 6) AS outer_mae FROM {canonical} c JOIN b ON b.sector_code = c.sector_code AND b.model_name = c.model_name WHERE fold_set = 'outer' GROUP BY ALL")
def _(spark, d):
    s = H.select_honest(canonical(spark, d))
    return s.groupBy("sector_code", "model_name").agg(six(F.avg(F.abs(F.col("y_pred") - F.col("y_true")))).alias("outer_mae"))


@query("sliding_backtest", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY period_enddate) AS pos FROM {panel}),
e AS (SELECT a.sector, s AS step, a.pos, a.y - avg(b.y) AS e FROM p a, range(1, 5) t(s), p b WHERE a.sector = b.sector AND b.pos BETWEEN a.pos - s - 11 AND a.pos - s AND b.pos % 4 = a.pos % 4 AND a.pos - s >= 12 GROUP BY a.sector, s, a.pos, a.y)
SELECT sector, step::INT AS step, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY ALL""")
def _(spark, d):
    """Windows of 12 quarters: the panel has 26."""
    return sliding_backtest(panel(spark, d), "sector", "period_enddate", "y", window=12).withColumn("rmse", six("rmse"))


@query("sliding_backtest_weeks", """WITH w AS (SELECT n_name AS sector, date_trunc('week', o_orderdate)::DATE AS week, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 100 AS y FROM {facts} GROUP BY ALL),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY week) AS pos FROM w),
e AS (SELECT a.sector, s AS step, a.pos, a.y - avg(b.y) AS e FROM p a, range(1, 5) t(s), p b WHERE a.sector = b.sector AND b.pos BETWEEN a.pos - s - 47 AND a.pos - s AND b.pos % 4 = a.pos % 4 AND a.pos - s >= 48 GROUP BY a.sector, s, a.pos, a.y)
SELECT sector, step::INT AS step, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse FROM e GROUP BY ALL""")
def _(spark, d):
    """Windows of 48, the operator's own length, on weekly means of orders."""
    f = order_facts(spark, d).groupBy(F.col("n_name").alias("sector"), F.date_trunc("week", "o_orderdate").alias("week"))
    w = f.agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count("*") / 100).alias("y"))
    return sliding_backtest(w, "sector", "week", "y").withColumn("rmse", F.round("rmse", 4))


@query("sector_sweep")
def _(spark, d):
    b = walk_forward(panel(spark, d), [("ridge", "ridge", {})], "sector", "period_enddate", "y")
    return b.groupBy("sector").agg(F.count("error").alias("n_failed"), six(F.avg(F.abs(F.col("y_pred") - F.col("y_true")))).alias("mae"))


NAMES = "(SELECT DISTINCT p_brand || '_' || p_size AS feature FROM part)"


def names(spark, d):
    return table(spark, d, "part").select(F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("feature")).distinct()


@query("propose_groups", f"SELECT CASE WHEN regexp_extract(feature, '^(.+?)_[0-9]', 1) = 'Brand#11' THEN 'first' ELSE regexp_extract(feature, '^(.+?)_[0-9]', 1) END AS \"group\", string_agg(feature, ',' ORDER BY feature) AS columns FROM {NAMES} GROUP BY 1")
def _(spark, d):
    g = K.propose_groups(names(spark, d), metric_prefix(F.col("feature")), {"Brand#11": "first"})
    return g.select("group", F.array_join("columns", ",").alias("columns"))


@query("validate_groups", f"SELECT CASE WHEN regexp_extract(feature, '^(.+?)_[0-9]', 1) < 'Brand#3' THEN regexp_extract(feature, '^(.+?)_[0-9]', 1) ELSE 'ungrouped' END AS \"group\", string_agg(feature, ',' ORDER BY feature) AS columns FROM {NAMES} WHERE length(feature) > 10 GROUP BY 1")
def _(spark, d):
    n = names(spark, d)
    groups = K.propose_groups(n, metric_prefix(F.col("feature")), {}).where("group < 'Brand#3'")
    return K.validate_groups(groups, n.where("length(feature) > 10")).select("group", F.array_join("columns", ",").alias("columns"))


@query("partition_candidates", "SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'yearly_prefix' WHEN n_nationkey % 5 = 1 THEN 'unknown_origin' WHEN n_regionkey = 0 THEN 'yearly_origin' ELSE 'candidate' END AS reason, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "nation").withColumn("feature", F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("y_"), "n_name")).otherwise(F.col("n_name")))
    origin = n.where("n_nationkey % 5 <> 1").select(F.col("feature").alias("column"), F.col("n_regionkey").cast("string").alias("table_id"))
    return K.partition_candidates(n.select("feature"), origin, ["0"]).groupBy("reason").agg(F.count("*").alias("n"))


_UNPIVOT = lambda metrics, source: f"SELECT part, model_name, other, u.metric, u.value FROM ({source}) CROSS JOIN LATERAL (VALUES " + ", ".join(f"('{m}', {m}::DOUBLE)" for m in metrics) + ") u(metric, value)"
_ERRORS = METRICS.replace("round(", "(").replace(", 6)", ")").replace(", 5)", ")")
_SCORES = [("naive", 3, 3, 3, 3), ("seasonal*", 2, 2, 2, 3), ("*", 1, 1, 1, 1)]
SCORECARD = f"""WITH given AS MATERIALIZED (SELECT * FROM {{canonical}}),
al AS MATERIALIZED (SELECT given.* FROM given JOIN (SELECT sector_code, target_date, horizon FROM given GROUP BY ALL HAVING count(DISTINCT model_name) = (SELECT count(DISTINCT model_name) FROM given)) USING (sector_code, target_date, horizon)),
regimes AS (SELECT *, CASE WHEN year(target_date) < (SELECT min(year(target_date)) FROM given) + 2 THEN 'pre' ELSE 'post' END AS regime FROM al),
points AS MATERIALIZED (SELECT CASE WHEN grouping(horizon) = 0 THEN 'horizon' WHEN grouping(sector_code) = 0 THEN 'sector' WHEN grouping(regime) = 0 THEN 'regime' ELSE 'point' END AS part, model_name, coalesce(horizon::VARCHAR, sector_code, regime) AS other, {_ERRORS} FROM regimes GROUP BY GROUPING SETS ((model_name), (model_name, horizon), (model_name, sector_code), (model_name, regime))),
maes AS MATERIALIZED (SELECT model_name, other AS sector_code, round(mae, 9) AS mae FROM points WHERE part = 'sector'),
ranked AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY sector_code ORDER BY mae) + (count(*) OVER (PARTITION BY sector_code, mae) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY sector_code, mae) AS ties FROM maes WHERE sector_code IN (SELECT sector_code FROM maes GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT model_name) FROM maes))),
pairs AS MATERIALIZED (SELECT a.sector_code, a.model_name AS model_a, b.model_name AS model_b, (a.y_true - a.y_pred) ** 2 - (b.y_true - b.y_pred) ** 2 AS d FROM al a JOIN al b USING (sector_code, target_date, horizon) WHERE a.model_name <> b.model_name),
pooled AS (SELECT model_a, model_b, count(*)::DOUBLE AS n, avg(d) AS m, var_pop(d) AS g0 FROM pairs GROUP BY 1, 2),
own AS (SELECT model_a, model_b, sector_code, count(*)::DOUBLE AS n, avg(d) AS m, var_pop(d) AS g0 FROM pairs GROUP BY 1, 2, 3),
stats AS (SELECT model_a, model_b, CASE WHEN n >= 8 AND g0 > 0 THEN m / sqrt(g0 / n) * sqrt((n - 1) / n) END AS stat FROM pooled),
own_p AS (SELECT model_a, model_b, m, {S.normal_two_sided('stat')} AS p FROM (SELECT *, m / sqrt(g0 / n) * sqrt((n - 1) / n) AS stat FROM own WHERE n >= 8 AND g0 > 0)),
sums AS (SELECT model_name, count(*) AS n, sum(r) AS s, sum(ties * ties - 1) AS t FROM ranked GROUP BY 1),
fried AS (SELECT n, k, (12.0::DOUBLE / (n * k * (k + 1)) * r2 - 3 * n * (k + 1)) / (1 - t / (n * (k * k * k - k))::DOUBLE) AS stat FROM (SELECT max(n) AS n, count(*) AS k, sum(s * s)::DOUBLE AS r2, sum(t) AS t FROM sums)),
ops AS (SELECT model_name, (CASE WHEN model_name = 'naive' THEN 12 WHEN starts_with(model_name, 'seasonal') THEN 9 ELSE 4 END)::DOUBLE AS total FROM (SELECT DISTINCT model_name FROM al)),
best AS (SELECT model_name, round(mae, 9) AS a, round(abs(bias), 9) AS u, round(rmse, 9) AS l, total AS e FROM points JOIN ops USING (model_name) WHERE part = 'point')
SELECT part, model_name, other, metric, round(value, 5) AS value FROM (
{_UNPIVOT(("n", "mae", "rmse", "mape", "r2", "bias"), "SELECT * FROM points")}
UNION ALL {_UNPIVOT(("n_given", "n_aligned"), "SELECT 'alignment' AS part, model_name, NULL::VARCHAR AS other, count(*) AS n_given, max(n) AS n_aligned FROM given JOIN (SELECT model_name, count(*) AS n FROM al GROUP BY 1) USING (model_name) GROUP BY 2")}
UNION ALL SELECT 'skill', m.model_name, NULL, 'skill', 1 - avg(abs(m.y_pred - m.y_true)) / avg(abs(b.y_pred - b.y_true)) FROM al m JOIN al b USING (sector_code, target_date, horizon) WHERE b.model_name = 'naive' AND m.model_name <> 'naive' GROUP BY 2
UNION ALL {_UNPIVOT(("n", "observed", "width", "miscalibration"), "SELECT 'calibration' AS part, model_name, level::VARCHAR AS other, count(*) AS n, avg((y_true BETWEEN low AND high)::INT) AS observed, avg(high - low) AS width, avg((y_true BETWEEN low AND high)::INT) - level / 100.0::DOUBLE AS miscalibration FROM (SELECT model_name, y_true, 80 AS level, y_lower_80 AS low, y_upper_80 AS high FROM al UNION ALL SELECT model_name, y_true, 95, y_lower_95, y_upper_95 FROM al) GROUP BY model_name, level")}
UNION ALL SELECT 'crps', model_name, NULL, 'crps', avg({CRPS_SQL}) FROM al GROUP BY 2
UNION ALL {_UNPIVOT(("stat", "p"), f"SELECT 'dm' AS part, model_a AS model_name, model_b AS other, stat, {S.normal_two_sided('stat')} AS p FROM stats")}
UNION ALL {_UNPIVOT(("win", "loss", "tie"), "SELECT 'dm_sectors' AS part, model_a AS model_name, model_b AS other, count(*) FILTER (p < 0.05 AND m < 0) AS win, count(*) FILTER (p < 0.05 AND m >= 0) AS loss, count(*) FILTER (p >= 0.05) AS tie FROM own_p GROUP BY 2, 3")}
UNION ALL {_UNPIVOT(("n", "k", "stat", "p", "cd"), f"SELECT 'friedman' AS part, NULL::VARCHAR AS model_name, NULL::VARCHAR AS other, n, k, stat, {S.chi2_upper('stat', '(k - 1)')} AS p, 2.569 * sqrt(k * (k + 1) / (6.0 * n)) AS cd FROM fried")}
UNION ALL SELECT 'rank', model_name, NULL, 'mean_rank', avg(r) FROM ranked GROUP BY 2
UNION ALL SELECT 'operational', model_name, NULL, 'total', total FROM ops
UNION ALL SELECT 'decision', min_by(model_name, (a, model_name)), 'accuracy', 'best', min(a) FROM best
UNION ALL SELECT 'decision', min_by(model_name, (u, model_name)), 'unbiased', 'best', min(u) FROM best
UNION ALL SELECT 'decision', min_by(model_name, (l, model_name)), 'no large errors', 'best', min(l) FROM best
UNION ALL SELECT 'decision', min_by(model_name, (-e, model_name)), 'explainable', 'best', max(e) FROM best)"""


@query("scorecard", SCORECARD)
def _(spark, d):
    c = canonical(spark, d)
    border = c.agg(F.min(F.year("target_date")) + 2).scalar()
    scores = spark.createDataFrame(_SCORES, "pattern string, explains int, needs int, robust int, cheap int")
    s = B.scorecard(c, "naive", F.when(F.year("target_date") < border, "pre").otherwise("post"), KNOTS, scores)
    return s.withColumn("value", F.round("value", 5))
