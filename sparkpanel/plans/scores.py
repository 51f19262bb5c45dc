"""Queries of metrics, rankings and comparisons of forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..functions.tails import normal_two_sided
from ..operators import compare as C
from ..operators.order import placed, wide_quantiles
from ..operators.scorecard import operational
from ..operators.windows import first_rows
from . import integrals as S
from .frames import canonical, panel, sector_mae, table
from .registry import query

six = lambda c: F.round(c, 6)
METRICS = """count(*) AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse, round(avg(abs(y_pred - y_true) / greatest(abs(y_true), 2.220446049250313e-16)), 6) AS mape,
round(CASE WHEN count(*) > 1 THEN 1 - sum((y_pred - y_true) ** 2) / (sum(y_true * y_true) - sum(y_true) * sum(y_true) / count(*)) END, 5) AS r2, round(avg(y_pred - y_true), 6) AS bias"""


def rounded(df):
    return df.withColumns({c: F.round(c, 5 if c == "r2" else 6) for c in ("mae", "rmse", "mape", "r2", "bias")})


@query("point_metrics", f"SELECT model_name, fold_set, {METRICS} FROM {{canonical}} GROUP BY ALL")
def _(spark, d):
    return rounded(C.metrics_by(canonical(spark, d), ["model_name", "fold_set"]))


for _name, _sql, _agg in (
    ("metric_mae", "round(avg(abs(y_pred - y_true)), 6)", M.mae),
    ("metric_rmse", "round(sqrt(avg((y_pred - y_true) ** 2)), 6)", M.rmse),
    ("metric_mape", "round(avg(abs(y_pred - y_true) / abs(y_true)), 6)", M.mape),
    ("metric_bias", "round(avg(y_pred - y_true), 6)", M.bias),
    ("metric_r2", "round(1 - sum((y_pred - y_true) ** 2) / (sum(y_true * y_true) - sum(y_true) * sum(y_true) / count(*)), 6)", M.r2),
):

    @query(_name, f"SELECT model_name, sector_code, {_sql} AS value FROM {{canonical}} GROUP BY 1, 2")
    def _(spark, d, agg=_agg):
        return canonical(spark, d).groupBy("model_name", "sector_code").agg(six(agg(F.col("y_true"), F.col("y_pred"))).alias("value"))


@query("directional_accuracy", """SELECT model_name, round(avg((sign(y_true - a) = sign(y_pred - b))::INT), 6) AS dir_acc FROM (SELECT *, lag(y_true) OVER w AS a, lag(y_pred) OVER w AS b FROM {canonical} WINDOW w AS (PARTITION BY model_name, sector_code ORDER BY target_date)) WHERE a IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return C.directional_accuracy(canonical(spark, d), ["model_name"], ["sector_code"], "target_date").withColumn("dir_acc", six("dir_acc"))


SCALE = "(SELECT sector, CASE WHEN count(y) > 4 THEN avg(ae) END AS scale FROM (SELECT *, abs(y - lag(y, 4) OVER (PARTITION BY sector ORDER BY period_enddate)) AS ae FROM {panel} WHERE year < 2000) GROUP BY sector)"


@query("seasonal_naive_mae", f"SELECT sector, round(scale, 6) AS scale FROM {SCALE}")
def _(spark, d):
    return C.seasonal_naive_mae(panel(spark, d).where("year < 2000"), "sector", "period_enddate", "y").withColumn("scale", six("scale"))


def mase(spark, d):
    scale = C.seasonal_naive_mae(panel(spark, d).where("year < 2000"), "sector", "period_enddate", "y").withColumnRenamed("sector", "sector_code")
    s = sector_mae(spark, d).join(scale, "sector_code", "left")
    return s.select("model_name", "sector_code", "mae", six(F.try_divide("mae", F.when(F.col("scale") > 0, F.col("scale")))).alias("mase"))


MASE = f"(SELECT model_name, sector_code, mae, round(mae / nullif(scale, 0), 6) AS mase FROM {{sector_mae}} LEFT JOIN {SCALE} ON sector = sector_code)"


@query("mase", f"SELECT * FROM {MASE}")
def _(spark, d):
    return mase(spark, d)


TIER = "CASE WHEN mase <= 0.9 + 1e-9 THEN 'Good' WHEN mase < 1 - 1e-9 THEN 'Medium' ELSE 'Poor' END"


@query("mase_leaderboard", f"SELECT model_name, sector_code, mase, {TIER} AS tier, row_number() OVER (PARTITION BY model_name ORDER BY mase, sector_code) AS place FROM {MASE}")
def _(spark, d):
    m = mase(spark, d).select("model_name", "sector_code", "mase", X.tier(F.col("mase")).alias("tier"))
    return placed(m, ["model_name"], ["mase", "sector_code"])


@query("assign_tier", f"SELECT model_name, sector_code, mase, {TIER} AS tier FROM {MASE}")
def _(spark, d):
    return mase(spark, d).select("model_name", "sector_code", "mase", X.tier(F.col("mase")).alias("tier"))


@query("tier_sort", f"SELECT model_name, sector_code, {TIER} AS tier, mase FROM {MASE} ORDER BY CASE WHEN mase <= 0.9 + 1e-9 THEN 0 WHEN mase < 1 - 1e-9 THEN 1 ELSE 2 END, mase, model_name, sector_code")
def _(spark, d):
    t = mase(spark, d).select("model_name", "sector_code", X.tier(F.col("mase")).alias("tier"), "mase")
    return t.orderBy(X.tier_order(F.col("tier")), "mase", "model_name", "sector_code")


@query("mae_tier", "SELECT model_name, sector_code, CASE WHEN mae / 100 < 0.2 THEN 'good' WHEN mae / 100 < 0.3 THEN 'acceptable' ELSE 'poor' END AS tier FROM {sector_mae}")
def _(spark, d):
    return sector_mae(spark, d).select("model_name", "sector_code", X.mae_tier(F.col("mae") / 100).alias("tier"))


REGIME = "CASE WHEN target_date < DATE '1999-07-01' THEN 'early' WHEN target_date < DATE '2000-01-01' THEN 'turn' WHEN target_date < DATE '2001-01-01' THEN 'late' ELSE 'last' END"


def regime(date):
    return F.when(date < F.lit("1999-07-01").cast("date"), "early").when(date < F.lit("2000-01-01").cast("date"), "turn").when(date < F.lit("2001-01-01").cast("date"), "late").otherwise("last")


@query("regime_label", f"SELECT DISTINCT target_date, {REGIME} AS regime FROM {{canonical}}")
def _(spark, d):
    return canonical(spark, d).select("target_date", regime(F.col("target_date")).alias("regime")).distinct()


@query("regime_metrics", f"SELECT model_name, CASE WHEN target_date < DATE '2000-01-01' THEN 'pre' ELSE 'post' END AS regime, {METRICS} FROM {{canonical}} GROUP BY ALL")
def _(spark, d):
    c = canonical(spark, d).withColumn("regime", F.when(F.col("target_date") < F.lit("2000-01-01").cast("date"), "pre").otherwise("post"))
    return rounded(C.metrics_by(c, ["model_name", "regime"]))


@query("per_sector_metrics", f"SELECT model_name, sector_code, {METRICS} FROM {{canonical}} GROUP BY ALL")
def _(spark, d):
    return rounded(C.metrics_by(canonical(spark, d), ["model_name", "sector_code"]))


@query("per_horizon_metrics", f"SELECT model_name, horizon, {METRICS} FROM {{canonical}} GROUP BY ALL")
def _(spark, d):
    return rounded(C.metrics_by(canonical(spark, d), ["model_name", "horizon"]))


@query("multi_grouping_summary", f"SELECT CASE WHEN grouping(sector_code) = 0 THEN 'model_name+sector_code' WHEN grouping(horizon) = 0 THEN 'model_name+horizon' ELSE 'model_name' END AS \"grouping\", model_name, sector_code, horizon, {METRICS} FROM {{canonical}} GROUP BY GROUPING SETS ((model_name), (model_name, sector_code), (model_name, horizon))")
def _(spark, d):
    return rounded(C.grouping_metrics(canonical(spark, d), [["model_name"], ["model_name", "sector_code"], ["model_name", "horizon"]]))


BASED = "{canonical} m JOIN {canonical} b ON m.sector_code = b.sector_code AND m.target_date = b.target_date AND m.horizon = b.horizon AND b.model_name = 'naive' AND m.model_name <> 'naive'"


@query("skill_score", f"SELECT m.model_name, round(1 - avg(abs(m.y_pred - m.y_true)) / avg(abs(b.y_pred - b.y_true)), 6) AS skill FROM {BASED} GROUP BY 1")
def _(spark, d):
    return C.skill_score(canonical(spark, d), "naive").withColumn("skill", six("skill"))


LEVELS = "(SELECT model_name, y_true, 80 AS level, y_lower_80 AS low, y_upper_80 AS high FROM {canonical} UNION ALL SELECT model_name, y_true, 95, y_lower_95, y_upper_95 FROM {canonical})"


@query("pi_coverage", f"SELECT model_name, level, count(*) AS n, round(avg((y_true BETWEEN low AND high)::INT), 6) AS observed, round(avg(high - low), 5) AS width, round(avg((y_true BETWEEN low AND high)::INT) - level / 100.0::DOUBLE, 6) AS miscalibration FROM {LEVELS} GROUP BY model_name, level")
def _(spark, d):
    c = C.interval_coverage(canonical(spark, d))
    return c.withColumns({"observed": six("observed"), "width": F.round("width", 5), "miscalibration": six("miscalibration")})


@query("calibration_table", f"SELECT level, round(avg((y_true BETWEEN low AND high)::INT), 6) AS observed FROM {LEVELS} GROUP BY 1")
def _(spark, d):
    c = canonical(spark, d)
    parts = F.array(*[F.struct(F.lit(v).alias("level"), c[f"y_lower_{v}"].alias("low"), c[f"y_upper_{v}"].alias("high")) for v in (80, 95)])
    return c.select("y_true", F.inline(parts)).groupBy("level").agg(six(M.coverage(F.col("y_true"), F.col("low"), F.col("high"))).alias("observed"))


KNOTS = {0.025: "y_lower_95", 0.1: "y_lower_80", 0.5: "y_pred", 0.9: "y_upper_80", 0.975: "y_upper_95"}
_own = sorted(KNOTS.items())
CRPS_SQL = " + ".join(f"(({p} + {q}) / 2.0::DOUBLE - (y_true <= ({a} + {b}) / 2)::INT) ** 2 * abs({b} - {a})" for (p, a), (q, b) in zip(_own, _own[1:], strict=False))


@query("crps_quantile", f"SELECT model_name, round(avg({CRPS_SQL}), 5) AS crps FROM {{canonical}} GROUP BY 1")
def _(spark, d):
    return C.crps(canonical(spark, d), KNOTS).withColumn("crps", F.round("crps", 5))


@query("coverage_label", "SELECT model_name, sector_code, target_date, CASE WHEN y_true BETWEEN y_lower_80 AND y_upper_80 THEN '80' WHEN y_true BETWEEN y_lower_95 AND y_upper_95 THEN '95' ELSE 'outside' END AS label FROM {canonical}")
def _(spark, d):
    inside = lambda v: F.col("y_true").between(F.col(f"y_lower_{v}"), F.col(f"y_upper_{v}"))
    return canonical(spark, d).select("model_name", "sector_code", "target_date", F.when(inside(80), "80").when(inside(95), "95").otherwise("outside").alias("label"))


@query("horizon_mape", "SELECT model_name, horizon, round(avg(abs(y_pred - y_true) / abs(y_true)), 6) AS mape FROM {canonical} WHERE fold_set = 'outer' AND y_true <> 0 GROUP BY ALL")
def _(spark, d):
    e = F.abs(F.col("y_pred") - F.col("y_true")) / F.abs("y_true")
    return canonical(spark, d).where("fold_set = 'outer' AND y_true <> 0").groupBy("model_name", "horizon").agg(six(F.avg(e)).alias("mape"))


@query("abs_pct_error", "SELECT model_name, sector_code, target_date, round(abs(y_pred - y_true) / nullif(abs(y_true), 0), 6) AS ape FROM {canonical}")
def _(spark, d):
    return canonical(spark, d).select("model_name", "sector_code", "target_date", six(F.try_divide(F.abs(F.col("y_pred") - F.col("y_true")), F.abs("y_true"))).alias("ape"))


SUMMARY = "(SELECT model_name, count(*)::DOUBLE AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(avg(y_pred - y_true), 6) AS bias FROM {canonical} WHERE fold_set = 'outer' GROUP BY 1)"


@query("eval_summary_table", f"SELECT model_name AS scope, metric, value FROM (UNPIVOT {SUMMARY} ON n, mae, bias INTO NAME metric VALUE value) UNION ALL SELECT model_name || ':' || horizon, 'mape', round(avg(abs(y_pred - y_true) / abs(y_true)), 6) FROM {{canonical}} WHERE fold_set = 'outer' GROUP BY model_name, horizon")
def _(spark, d):
    c = canonical(spark, d).where("fold_set = 'outer'")
    m = C.metrics_by(c, ["model_name"]).select(F.col("model_name").alias("scope"), F.col("n").cast("double").alias("n"), six("mae").alias("mae"), six("bias").alias("bias"))
    h = c.groupBy(F.format_string("%s:%d", "model_name", "horizon").alias("scope")).agg(six(M.mape(F.col("y_true"), F.col("y_pred"))).alias("value"))
    return m.unpivot(["scope"], ["n", "mae", "bias"], "metric", "value").unionByName(h.withColumn("metric", F.lit("mape")))


RUNS = f"(SELECT *, CASE WHEN length(sector_code) > 8 THEN 'a' ELSE 'b' END AS feature_group FROM {MASE})"
MODELS = ["last", "naive", "rolling", "seasonal_ma"]


def runs(spark, d):
    return mase(spark, d).withColumn("feature_group", F.when(F.length("sector_code") > 8, "a").otherwise("b"))


@query("experiment_matrix", f"SELECT model_name, round(median(mase) FILTER (feature_group = 'a'), 6) AS a, round(median(mase) FILTER (feature_group = 'b'), 6) AS b FROM {RUNS} GROUP BY 1")
def _(spark, d):
    return runs(spark, d).groupBy("model_name").pivot("feature_group", ["a", "b"]).agg(six(F.median("mase")))


@query("win_matrix", f"SELECT model_name, count(*) FILTER (feature_group = 'a') AS a, count(*) FILTER (feature_group = 'b') AS b FROM (SELECT * FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY sector_code ORDER BY mase, model_name) = 1) GROUP BY 1")
def _(spark, d):
    best = first_rows(runs(spark, d), "sector_code", [F.col("mase"), F.col("model_name")])
    return best.groupBy("model_name").agg(F.count_if(F.col("feature_group") == "a").alias("a"), F.count_if(F.col("feature_group") == "b").alias("b"))


@query("family_inner_mae", "SELECT model_name, round(avg(abs(y_pred - y_true)), 6) AS mae, count(*) AS n FROM {canonical} WHERE fold_set = 'inner' GROUP BY 1 ORDER BY mae, model_name")
def _(spark, d):
    return canonical(spark, d).where("fold_set = 'inner'").groupBy("model_name").agg(six(M.mae(F.col("y_true"), F.col("y_pred"))).alias("mae"), F.count("*").alias("n")).orderBy("mae", "model_name")


@query("mase_summary", f"SELECT model_name, round(avg(mase), 6) AS mean, round(median(mase), 6) AS median, count(*) FILTER (mase < 1) AS n_below, round(100.0 * count(*) FILTER (mase < 1) / count(*), 6) AS pct FROM {MASE} GROUP BY 1")
def _(spark, d):
    below = F.count_if(F.col("mase") < 1)
    return mase(spark, d).groupBy("model_name").agg(six(F.avg("mase")).alias("mean"), six(F.median("mase")).alias("median"), below.alias("n_below"), six(100 * below / F.count("*")).alias("pct"))


@query("sensitivity_agg", "SELECT count(*) AS n, round(avg(x), 6) AS mean_delta, round(median(x), 6) AS median_delta, count(*) FILTER (x < 0) AS improved, count(*) FILTER (x > 0) AS worsened FROM (SELECT a.mae - b.mae AS x FROM {sector_mae} a JOIN {sector_mae} b ON a.sector_code = b.sector_code AND a.model_name = 'naive' AND b.model_name = 'seasonal_ma')")
def _(spark, d):
    s = sector_mae(spark, d).groupBy("sector_code").agg((F.max(F.when(F.col("model_name") == "naive", F.col("mae"))) - F.max(F.when(F.col("model_name") == "seasonal_ma", F.col("mae")))).alias("x"))
    return s.agg(F.count("*").alias("n"), six(F.avg("x")).alias("mean_delta"), six(F.median("x")).alias("median_delta"), F.count_if(F.col("x") < 0).alias("improved"), F.count_if(F.col("x") > 0).alias("worsened"))


@query("horizon_quantiles", "SELECT horizon, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 6) AS iqr, round(max(e), 6) AS max FROM (SELECT horizon, abs(y_true - y_pred) AS e FROM {canonical}) GROUP BY 1")
def _(spark, d):
    e = canonical(spark, d).select("horizon", F.abs(F.col("y_true") - F.col("y_pred")).alias("e"))
    q = wide_quantiles(e, {"low": ("e", 0.25), "mid": ("e", 0.5), "high": ("e", 0.75), "top": ("e", 1.0)}, ["horizon"])
    return q.select("horizon", six("mid").alias("median"), six(F.col("high") - F.col("low")).alias("iqr"), six("top").alias("max"))


@query("cv_summary", "SELECT model_name, count(DISTINCT origin_date) AS n_folds, count(*) FILTER (y_pred IS NULL) AS n_null, round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse FROM {canonical} GROUP BY 1")
def _(spark, d):
    y, p = F.col("y_true"), F.col("y_pred")
    return canonical(spark, d).groupBy("model_name").agg(F.countDistinct("origin_date").alias("n_folds"), F.count_if(p.isNull()).alias("n_null"), six(M.mae(y, p)).alias("mae"), six(M.rmse(y, p)).alias("rmse"))


@query("modal_config", "SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS config, max(n) AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return g.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("config"), F.max("n").alias("n"))


@query("config_modal_share", "WITH l AS (SELECT c_nationkey, max_by(c_mktsegment, c_custkey) AS last FROM customer GROUP BY 1) SELECT c_nationkey, last AS config, round(avg((c_mktsegment = last)::INT), 6) AS share FROM customer JOIN l USING (c_nationkey) GROUP BY ALL")
def _(spark, d):
    c = table(spark, d, "customer")
    last = c.groupBy("c_nationkey").agg(F.max_by("c_mktsegment", "c_custkey").alias("config"))
    return c.join(last, "c_nationkey").groupBy("c_nationkey", "config").agg(six(F.avg((F.col("c_mktsegment") == F.col("config")).cast("int"))).alias("share"))


@query("wide_pivot", "SELECT period_enddate, " + ", ".join(f"max(y) FILTER (sector = 'NATION_{k}') AS \"NATION_{k}\"" for k in range(25)) + " FROM {panel} GROUP BY 1")
def _(spark, d):
    return panel(spark, d).groupBy("period_enddate").pivot("sector", [f"NATION_{k}" for k in range(25)]).agg(F.max("y"))


@query("year_quarter_matrix", "SELECT sector, year, " + ", ".join(f"max(y) FILTER (quarter = {q}) AS \"{q}\"" for q in range(1, 5)) + " FROM {panel} GROUP BY ALL")
def _(spark, d):
    return panel(spark, d).groupBy("sector", "year").pivot("quarter", [1, 2, 3, 4]).agg(F.max("y"))


@query("seasonality_strength", "SELECT sector, round(stddev_samp(m) / avg(m), 6) AS strength FROM (SELECT sector, quarter, avg(y) AS m FROM {panel} GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    q = panel(spark, d).groupBy("sector", "quarter").agg(F.avg("y").alias("m"))
    return q.groupBy("sector").agg(six(F.stddev_samp("m") / F.avg("m")).alias("strength"))


@query("relative_volatility", "SELECT sector, round(stddev_samp(y) / avg(y), 6) AS cv FROM {panel} GROUP BY 1")
def _(spark, d):
    return panel(spark, d).groupBy("sector").agg(six(F.stddev_samp("y") / F.avg("y")).alias("cv"))


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r FROM {{panel}}" for a, b in (("y", "n_orders"), ("y", "x_bal"), ("n_orders", "x_bal"))))
def _(spark, d):
    from ..operators.selection import correlation_pairs

    return correlation_pairs(panel(spark, d), ["y", "n_orders", "x_bal"]).withColumn("r", F.round("r", 5))


@query("latest_period_level", "SELECT sector, round(avg(y), 6) AS level FROM {panel} WHERE year = (SELECT max(year) FROM {panel}) GROUP BY 1")
def _(spark, d):
    p = panel(spark, d)
    return p.join(F.broadcast(p.agg(F.max("year").alias("year"))), "year").groupBy("sector").agg(six(F.avg("y")).alias("level"))


@query("latest_valid_period", "SELECT sector, period_enddate, y FROM {panel} WHERE period_enddate = (SELECT max(period_enddate) FROM {panel} WHERE y IS NOT NULL) ORDER BY sector")
def _(spark, d):
    p = panel(spark, d)
    return p.join(F.broadcast(p.where("y IS NOT NULL").agg(F.max("period_enddate").alias("period_enddate"))), "period_enddate").select("sector", "period_enddate", "y").orderBy("sector")


@query("run_floor_best", "SELECT sector_code, min(mae) FILTER (model_name = 'naive') AS floor, min(mae) FILTER (model_name <> 'naive') AS best, round((min(mae) FILTER (model_name = 'naive') - min(mae) FILTER (model_name <> 'naive')) / min(mae) FILTER (model_name = 'naive'), 6) AS uplift FROM {sector_mae} GROUP BY 1")
def _(spark, d):
    floor, best = F.min(F.when(F.col("model_name") == "naive", F.col("mae"))), F.min(F.when(F.col("model_name") != "naive", F.col("mae")))
    return sector_mae(spark, d).groupBy("sector_code").agg(floor.alias("floor"), best.alias("best"), six((floor - best) / floor).alias("uplift"))


@query("best_by_sector_model", "SELECT sector_code, " + ", ".join(f"max(mae) FILTER (model_name = '{m}') AS \"{m}\"" for m in MODELS) + " FROM {sector_mae} GROUP BY 1")
def _(spark, d):
    return sector_mae(spark, d).groupBy("sector_code").pivot("model_name", MODELS).agg(F.max("mae"))


@query("best_median_worst", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY mae, sector_code) AS k, count(*) OVER (PARTITION BY model_name) AS n_all FROM {sector_mae}) SELECT model_name, CASE WHEN k = 1 THEN 'best' WHEN k = n_all THEN 'worst' ELSE 'median' END AS place, sector_code, mae FROM r WHERE k IN (1, n_all // 2 + 1, n_all)")
def _(spark, d):
    r = placed(sector_mae(spark, d), ["model_name"], ["mae", "sector_code"], "k")
    r = r.join(r.groupBy("model_name").agg(F.count("*").alias("n_all")), "model_name").where("k IN (1, n_all div 2 + 1, n_all)")
    return r.select("model_name", F.when(F.col("k") == 1, "best").when(F.col("k") == F.col("n_all"), "worst").otherwise("median").alias("place"), "sector_code", "mae")


@query("validate_canonical", "SELECT model_name, sector_code, origin_date, target_date, horizon, y_true, y_pred, y_lower_80, y_upper_80, y_lower_95, y_upper_95 FROM {canonical}")
def _(spark, d):
    from ..sources.io import to_canonical

    return first_rows(to_canonical(canonical(spark, d)), ["model_name", "sector_code", "target_date", "horizon"], [F.col("origin_date")])


DIFF = "(SELECT a.sector_code, a.target_date, a.horizon, a.model_name AS model_a, b.model_name AS model_b, (a.y_true - a.y_pred) ** 2 - (b.y_true - b.y_pred) ** 2 AS d FROM {canonical} a JOIN {canonical} b ON a.sector_code = b.sector_code AND a.target_date = b.target_date AND a.horizon = b.horizon AND a.model_name <> b.model_name)"
CENTRED = f"(SELECT *, d - avg(d) OVER (PARTITION BY model_a, model_b) AS c FROM {DIFF})"


def dm(spark, d, keys, **more):
    return C.diebold_mariano(C.loss_differences(canonical(spark, d)), keys, ["sector_code", "target_date"], **more)


DM = f"(SELECT model_a, model_b, n, m AS mean_d, CASE WHEN n >= 8 AND g0 > 0 THEN m / sqrt(g0 / n) * sqrt((n - 1) / n) END AS stat FROM (SELECT model_a, model_b, count(*)::DOUBLE AS n, avg(d) AS m, avg(c * c) AS g0 FROM {CENTRED} GROUP BY ALL))"


@query("diebold_mariano", f"SELECT model_a, model_b, n, round(stat, 5) AS stat, round({S.normal_two_sided('stat')}, 8) AS p FROM {DM}")
def _(spark, d):
    t = dm(spark, d, ["model_a", "model_b"]).withColumn("p", normal_two_sided(F.col("stat")))
    return t.select("model_a", "model_b", F.col("n").cast("double").alias("n"), F.round("stat", 5).alias("stat"), F.round("p", 8).alias("p"))


@query("dm_one_sided", f"""SELECT model_a, model_b, round(stat, 5) AS stat, round({S.t_upper('-stat', '(n - 1)')}, 8) AS p FROM (SELECT model_a, model_b, n, CASE WHEN v > 0 THEN m / sqrt(v / n) * sqrt((n + 1 - 4 + 2.0 / n) / n) END AS stat FROM (
SELECT model_a, model_b, count(*)::DOUBLE AS n, avg(d) AS m, avg(c * c) + sum(c * l) / count(*) AS v FROM (SELECT *, lag(c) OVER (PARTITION BY model_a, model_b ORDER BY sector_code, target_date) AS l FROM {CENTRED}) GROUP BY ALL))""")
def _(spark, d):
    t = dm(spark, d, ["model_a", "model_b"], h=2, bartlett=True, spread=True)
    t = t.withColumn("p", C.student_lower(F.col("stat"), (F.col("n") - 1).cast("double")))
    return t.select("model_a", "model_b", F.round("stat", 5).alias("stat"), F.round("p", 8).alias("p"))


@query("dm_two_steps", f"""SELECT model_a, model_b, sector_code, round(CASE WHEN n >= 8 AND v > 0 THEN m / sqrt(v / n) * sqrt((n + 1 - 4 + 2.0 / n) / n) END, 5) AS stat FROM (
SELECT model_a, model_b, sector_code, count(*)::DOUBLE AS n, avg(d) AS m, avg(c * c) + 2 * coalesce(avg(c * l), 0) AS v FROM (SELECT *, lag(c) OVER (PARTITION BY model_a, model_b, sector_code ORDER BY target_date) AS l FROM (SELECT *, d - avg(d) OVER (PARTITION BY model_a, model_b, sector_code) AS c FROM {DIFF})) GROUP BY ALL)""")
def _(spark, d):
    keys = ["model_a", "model_b", "sector_code"]
    return C.diebold_mariano(C.loss_differences(canonical(spark, d)), keys, ["target_date"], h=2).select(*keys, F.round("stat", 5).alias("stat"))


@query("pairwise_dm", f"SELECT model_a, model_b, round(mean_d, 4) AS mean_d, n::BIGINT AS n, round({S.normal_two_sided('stat')}, 8) AS p FROM {DM}")
def _(spark, d):
    t = dm(spark, d, ["model_a", "model_b"]).withColumn("p", normal_two_sided(F.col("stat")))
    return t.select("model_a", "model_b", F.round("mean_d", 4).alias("mean_d"), "n", F.round("p", 8).alias("p"))


SECTOR_DM = f"""(SELECT model_a, model_b, sector_code, m AS mean_d, CASE WHEN n >= 8 AND g0 > 0 THEN m / sqrt(g0 / n) * sqrt((n - 1) / n) END AS stat FROM (
SELECT model_a, model_b, sector_code, count(*)::DOUBLE AS n, avg(d) AS m, var_pop(d) AS g0 FROM {DIFF} GROUP BY ALL))"""


@query("dm_win_loss_tie", f"SELECT model_a, model_b, count(*) FILTER (p < 0.05 AND mean_d < 0) AS win, count(*) FILTER (p < 0.05 AND mean_d >= 0) AS loss, count(*) FILTER (p >= 0.05) AS tie FROM (SELECT *, {S.normal_two_sided('stat')} AS p FROM {SECTOR_DM} WHERE stat IS NOT NULL) GROUP BY 1, 2")
def _(spark, d):
    t = dm(spark, d, ["model_a", "model_b", "sector_code"]).withColumn("p", normal_two_sided(F.col("stat")))
    return C.win_loss_tie(t)


RANKS = "(SELECT *, rank() OVER (PARTITION BY sector_code ORDER BY mae) + (count(*) OVER (PARTITION BY sector_code, mae) - 1) / 2.0 AS r FROM {sector_mae})"


FRIEDMAN = f"(SELECT n, k, (12.0 / (n * k * (k + 1)) * r2 - 3 * n * (k + 1)) / (1 - t / (n * (k * k * k - k))) AS stat FROM (SELECT max(n) AS n, count(*) AS k, sum(s * s) AS r2, sum(t) AS t FROM (SELECT model_name, count(*) AS n, sum(r) AS s, sum(t * t - 1) AS t FROM (SELECT *, count(*) OVER (PARTITION BY sector_code, mae) AS t FROM {RANKS}) GROUP BY 1)))"


@query("friedman", f"SELECT n, k, round(stat, 5) AS stat, round({S.chi2_upper('stat', '(k - 1)')}, 8) AS p FROM {FRIEDMAN}")
def _(spark, d):
    return C.friedman(sector_mae(spark, d), "sector_code", "model_name", "mae").withColumns({"stat": F.round("stat", 5), "p": F.round("p", 8)})


@query("nemenyi_cd", "SELECT round(2.569 * sqrt(4 * 5 / (6.0 * count(DISTINCT sector_code))), 6) AS cd FROM {sector_mae}")
def _(spark, d):
    return sector_mae(spark, d).agg(six(C.nemenyi(F.countDistinct("model_name"), F.countDistinct("sector_code"))).alias("cd"))


@query("cd_groups", f"WITH m AS (SELECT model_name, avg(r) AS r FROM {RANKS} GROUP BY 1), cd AS (SELECT 2.569 * sqrt(4 * 5 / (6.0 * count(DISTINCT sector_code))) AS cd FROM {{sector_mae}}) SELECT a.model_name, count(*) AS n_close FROM m a JOIN m b ON true JOIN cd ON abs(a.r - b.r) < cd GROUP BY 1")
def _(spark, d):
    from ..operators.windows import average_rank

    s = sector_mae(spark, d)
    m = average_rank(s, "mae", "sector_code").groupBy("model_name").agg(F.avg("rank").alias("r"))
    cd = s.agg(C.nemenyi(F.countDistinct("model_name"), F.countDistinct("sector_code")).alias("cd"))
    # ranks of models in order: a window of values around each, no pairs
    ranked = m.crossJoin(F.broadcast(cd)).withColumn("all", F.collect_list("r").over(Window.partitionBy("cd")))
    return ranked.select("model_name", F.size(F.filter("all", lambda x: F.abs(x - F.col("r")) < F.col("cd"))).cast("long").alias("n_close"))


@query("operational_table", "SELECT model_name, CASE WHEN model_name = 'naive' THEN 12 WHEN starts_with(model_name, 'seasonal') THEN 9 ELSE 4 END::INT AS total FROM (SELECT DISTINCT model_name FROM {canonical})")
def _(spark, d):
    scores = spark.createDataFrame([("naive", 3, 3, 3, 3), ("seasonal*", 2, 2, 2, 3), ("*", 1, 1, 1, 1)], "pattern string, a int, b int, c int, e int")
    return operational(canonical(spark, d).select("model_name").distinct(), scores).withColumn("total", F.col("total").cast("int"))


@query("decision_matrix", "WITH m AS (SELECT model_name, round(avg(abs(y_pred - y_true)), 6) AS mae, round(abs(avg(y_pred - y_true)), 6) AS bias FROM {canonical} GROUP BY 1) SELECT 'accuracy' AS priority, min_by(model_name, (mae, model_name)) AS model_name FROM m UNION ALL SELECT 'unbiased', min_by(model_name, (bias, model_name)) FROM m")
def _(spark, d):
    m = C.metrics_by(canonical(spark, d), ["model_name"]).select("model_name", six("mae").alias("mae"), six(F.abs("bias")).alias("bias"))
    return C.decision_matrix(m, {"accuracy": ("mae", True), "unbiased": ("bias", True)})


WIN = "(SELECT sector_code, min_by(model_name, (mae, model_name)) FILTER (model_name <> 'naive') AS best, min(mae) FILTER (model_name <> 'naive') AS m, max(mae) FILTER (model_name = 'naive') AS b FROM {sector_mae} GROUP BY 1)"


@query("winners_final", f"SELECT sector_code, CASE WHEN m < b THEN best ELSE 'Baseline' END AS winner, round(CASE WHEN m < b THEN (1 - m / b) * 100 ELSE 0 END, 6) AS improvement FROM {WIN}")
def _(spark, d):
    other = F.col("model_name") != "naive"
    w = sector_mae(spark, d).groupBy("sector_code").agg(F.min_by(F.when(other, F.col("model_name")), F.when(other, F.struct("mae", "model_name"))).alias("best"), F.min(F.when(other, F.col("mae"))).alias("m"), F.max(F.when(~other, F.col("mae"))).alias("b"))
    better = F.col("m") < F.col("b")
    return w.select("sector_code", F.when(better, F.col("best")).otherwise("Baseline").alias("winner"), six(F.when(better, (1 - F.col("m") / F.col("b")) * 100).otherwise(0.0)).alias("improvement"))


@query("baseline_reconcile", "WITH s AS (SELECT sector_code, mae * (1 + length(sector_code) / 1000.0::DOUBLE) AS stored, mae FROM {sector_mae} WHERE model_name = 'naive') SELECT sector_code, abs(stored - mae) / stored <= 0.0085 AS agrees FROM s")
def _(spark, d):
    s = sector_mae(spark, d).where("model_name = 'naive'")
    stored = s.select("sector_code", (F.col("mae") * (1 + F.length("sector_code") / 1000)).alias("stored"))
    return s.join(stored, "sector_code").select("sector_code", (F.abs(F.col("stored") - F.col("mae")) / F.col("stored") <= 0.0085).alias("agrees"))


@query("mase_vs_baseline", "SELECT a.model_name, round(avg(a.mae / b.mae), 6) AS mase FROM {sector_mae} a JOIN {sector_mae} b ON a.sector_code = b.sector_code AND b.model_name = 'naive' GROUP BY 1")
def _(spark, d):
    s = sector_mae(spark, d)
    return s.join(s.where("model_name = 'naive'").select("sector_code", F.col("mae").alias("base")), "sector_code").groupBy("model_name").agg(six(F.avg(F.try_divide("mae", "base"))).alias("mase"))


@query("regime_metrics4", f"SELECT m.model_name, {REGIME.replace('target_date', 'm.target_date')} AS regime, round(avg(abs(m.y_pred - m.y_true)) / avg(abs(b.y_pred - b.y_true)), 6) AS mase, count(*) AS n FROM {BASED} GROUP BY ALL HAVING count(*) >= 5")
def _(spark, d):
    c = canonical(spark, d)
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    base = c.where("model_name = 'naive'").select(*C.KEYS, e.alias("base"))
    g = c.where("model_name <> 'naive'").join(base, C.KEYS).groupBy("model_name", regime(F.col("target_date")).alias("regime"))
    return g.agg(six(F.avg(e) / F.avg("base")).alias("mase"), F.count("*").alias("n")).where("n >= 5")


@query("error_diagnostics", f"SELECT m.model_name, m.sector_code, round(avg(abs(m.y_pred - m.y_true)), 6) AS mae, round(max(abs(m.y_pred - m.y_true)), 6) AS max_error, round(avg(m.y_pred - m.y_true), 6) AS bias, round((1 - avg(abs(m.y_pred - m.y_true)) / avg(abs(b.y_pred - b.y_true))) * 100, 4) AS improvement FROM {BASED} GROUP BY ALL")
def _(spark, d):
    c = canonical(spark, d)
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    j = c.where("model_name <> 'naive'").join(c.where("model_name = 'naive'").select(*C.KEYS, e.alias("base")), C.KEYS)
    return j.groupBy("model_name", "sector_code").agg(six(F.avg(e)).alias("mae"), six(F.max(e)).alias("max_error"), six(F.avg(F.col("y_pred") - F.col("y_true"))).alias("bias"), F.round((1 - F.avg(e) / F.avg("base")) * 100, 4).alias("improvement"))


@query("structural_labels", f"SELECT model_name, sector_code, array_to_string(list_filter([CASE WHEN mase < 0.9 THEN 'improves' END, CASE WHEN mase > 1.1 THEN 'degrades' END, CASE WHEN mae > 20 THEN 'large_error' END], lambda x: x IS NOT NULL), ',') AS labels FROM {MASE}")
def _(spark, d):
    flag = lambda c, name: F.when(c, F.lit(name))
    labels = F.array_compact(F.array(flag(F.col("mase") < 0.9, "improves"), flag(F.col("mase") > 1.1, "degrades"), flag(F.col("mae") > 20, "large_error")))
    return mase(spark, d).select("model_name", "sector_code", F.array_join(labels, ",").alias("labels"))


@query("health_status", f"SELECT model_name, sector_code, CASE WHEN mase IS NULL THEN 'no data' WHEN mase > 1.2 THEN 'failing' WHEN mase > 1 THEN 'weak' ELSE 'healthy' END AS status FROM {MASE}")
def _(spark, d):
    m = F.col("mase")
    return mase(spark, d).select("model_name", "sector_code", F.when(m.isNull(), "no data").when(m > 1.2, "failing").when(m > 1, "weak").otherwise("healthy").alias("status"))
