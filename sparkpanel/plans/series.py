"""Queries of the window operators on the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.period import next_quarter_ends, quarter_label, regime_flags, regime_ramps
from ..operators import windows as W
from .frames import canonical, order_facts, panel, sector_mae, table
from .registry import query

ID = "sector, period_enddate"
S = "PARTITION BY sector ORDER BY period_enddate"
six = lambda c: F.round(c, 6)


@query("rolling_same_quarter_mean", f"SELECT {ID}, y, round(y_pred, 6) AS y_pred FROM {{models}} WHERE model_name = 'rolling'")
def _(spark, d):
    return W.rolling_same_quarter_mean(panel(spark, d)).select("sector", "period_enddate", "y", six("y_pred").alias("y_pred"))


@query("baseline_residuals", f"SELECT {ID}, round(y - y_pred, 6) AS residual, round(abs(y - y_pred), 6) AS abs_error FROM {{models}} WHERE model_name = 'rolling' AND y_pred IS NOT NULL")
def _(spark, d):
    e = F.col("y") - F.col("y_pred")
    return W.rolling_same_quarter_mean(panel(spark, d)).where("y_pred IS NOT NULL").select("sector", "period_enddate", six(e).alias("residual"), six(F.abs(e)).alias("abs_error"))


@query("seasonal_naive", f"SELECT {ID}, y, lag(y, 4) OVER ({S}) AS y_lag4 FROM {{panel}}")
def _(spark, d):
    return W.lagged(panel(spark, d), ["y"], 4).select("sector", "period_enddate", "y", "y_lag4")


@query("seasonal_ma_lags", f"SELECT {ID}, round(y_pred, 6) AS y_pred FROM {{models}} WHERE model_name = 'seasonal_ma'")
def _(spark, d):
    return W.seasonal_ma(panel(spark, d)).select("sector", "period_enddate", six("y_pred").alias("y_pred"))


@query("diff_within_group", f"SELECT {ID}, round(y - lag(y) OVER ({S}), 6) AS y, round(x_bal - lag(x_bal) OVER ({S}), 6) AS x_bal FROM {{panel}}")
def _(spark, d):
    return W.differences(panel(spark, d), ["y", "x_bal"]).select("sector", "period_enddate", six("y").alias("y"), six("x_bal").alias("x_bal"))


@query("lead_target", f"SELECT {ID}, " + ", ".join(f"lead(y, {h}) OVER ({S}) AS y_h{h}" for h in range(1, 5)) + " FROM {panel}")
def _(spark, d):
    return W.leads(panel(spark, d)).select("sector", "period_enddate", *[f"y_h{h}" for h in range(1, 5)])


@query("lag_features", f"SELECT {ID}, lag(n_orders, 3) OVER ({S}) AS n_orders_lag3, lag(x_bal, 3) OVER ({S}) AS x_bal_lag3 FROM {{panel}}")
def _(spark, d):
    return W.lagged(panel(spark, d), ["n_orders", "x_bal"], 3).select("sector", "period_enddate", "n_orders_lag3", "x_bal_lag3")


#: A third of the values taken out, for the operators on gaps.
HOLES = "SELECT * REPLACE (CASE WHEN (year * 4 + quarter + length(sector)) % 3 <> 0 THEN y END AS y) FROM {panel}"
GAPS = "SELECT * FROM {panel} WHERE NOT (year = 1997 AND quarter = 2 AND length(sector) % 2 = 0)"


def holes(spark, d):
    return panel(spark, d).withColumn("y", F.when((F.col("year") * 4 + F.col("quarter") + F.length("sector")) % 3 != 0, F.col("y")))


def gaps(spark, d):
    return panel(spark, d).where("NOT (year = 1997 AND quarter = 2 AND length(sector) % 2 = 0)")


@query("grouped_ffill", f"SELECT {ID}, last_value(y IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM ({HOLES})")
def _(spark, d):
    return W.forward_fill(holes(spark, d), ["y"]).select("sector", "period_enddate", "y")


@query("carry_forward_future", """SELECT sector, last_day(z + to_months(3 * step::INT))::DATE AS period_enddate, y, n_orders, step::INT AS step
FROM (SELECT sector, max(period_enddate) AS z, max_by(y, period_enddate) AS y, max_by(n_orders, period_enddate) AS n_orders FROM {panel} GROUP BY sector), range(1, 5) r(step)""")
def _(spark, d):
    return W.carry_forward(panel(spark, d).select("sector", "period_enddate", "y", "n_orders"), 4)


@query("trend_index", f"SELECT {ID}, (year * 4 + quarter - (SELECT min(year * 4 + quarter) FROM {{panel}}) + 1)::BIGINT AS trend_index FROM {{panel}}")
def _(spark, d):
    return W.with_trend(panel(spark, d)).select("sector", "period_enddate", "trend_index")


@query("leaderboard", "SELECT *, row_number() OVER (PARTITION BY sector_code ORDER BY mae, model_name)::INT AS place FROM {sector_mae}")
def _(spark, d):
    return sector_mae(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("sector_code").orderBy("mae", "model_name")))


@query("average_rank", """SELECT model_name, round(avg(r), 6) AS mean_rank FROM (SELECT *, rank() OVER (PARTITION BY sector_code ORDER BY mae) + (count(*) OVER (PARTITION BY sector_code, mae) - 1) / 2.0 AS r FROM {sector_mae}) GROUP BY model_name""")
def _(spark, d):
    return W.average_rank(sector_mae(spark, d), "mae", "sector_code").groupBy("model_name").agg(six(F.avg("rank")).alias("mean_rank"))


BEST = "SELECT * FROM {sector_mae} QUALIFY row_number() OVER (PARTITION BY sector_code ORDER BY mae, model_name) = 1"


@query("best_per_group", BEST)
def _(spark, d):
    return W.first_rows(sector_mae(spark, d), "sector_code", [F.col("mae"), F.col("model_name")])


@query("runner_up_margin", "SELECT sector_code, round(max(mae) FILTER (k = 2) - max(mae) FILTER (k = 1), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY sector_code ORDER BY mae, model_name) AS k FROM {sector_mae}) GROUP BY sector_code")
def _(spark, d):
    r = sector_mae(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("sector_code").orderBy("mae", "model_name")))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("mae")))
    return r.groupBy("sector_code").agg(six(pick(2) - pick(1)).alias("margin"))


@query("dedupe_keep_last", "SELECT sector_code, target_date, model_name, origin_date FROM {canonical} QUALIFY row_number() OVER (PARTITION BY sector_code, target_date ORDER BY origin_date DESC, model_name) = 1")
def _(spark, d):
    return W.first_rows(canonical(spark, d), ["sector_code", "target_date"], [F.desc("origin_date"), F.col("model_name")]).select("sector_code", "target_date", "model_name", "origin_date")


@query("dedupe_keep_first", "SELECT c_nationkey, c_mktsegment, c_custkey, n_same FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n_same FROM customer) QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("n_same", F.count("*").over(Window.partitionBy("c_nationkey", "c_mktsegment")))
    return W.first_rows(c, ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")]).select("c_nationkey", "c_mktsegment", "c_custkey", "n_same")


@query("contiguous_tail", f"""WITH g AS ({GAPS}), f AS (SELECT *, coalesce(lag(period_enddate) OVER ({S}) <> last_day(period_enddate - INTERVAL 3 MONTH), true) AS gap FROM g),
t AS (SELECT *, max(period_enddate) FILTER (gap) OVER (PARTITION BY sector) AS tail FROM f)
SELECT sector, period_enddate, y FROM t WHERE period_enddate >= tail QUALIFY count(*) OVER (PARTITION BY sector) >= 8""")
def _(spark, d):
    return W.contiguous_tail(gaps(spark, d), least=8).select("sector", "period_enddate", "y")


REPORT = """SELECT sector, count(*) AS n_obs, min(period_enddate) AS first, max(period_enddate) AS last, count(*) FILTER (y IS NULL) AS n_null,
(max(year * 4 + quarter) - min(year * 4 + quarter) + 1 - count(*))::BIGINT AS n_gaps FROM ({}) GROUP BY sector"""


@query("gap_report", REPORT.replace("{}", GAPS))
def _(spark, d):
    return W.gap_report(gaps(spark, d))


@query("eligible_series", f"SELECT sector, n_obs FROM ({REPORT.replace('{}', GAPS)}) WHERE n_gaps = 0 AND n_obs >= 20")
def _(spark, d):
    return W.gap_report(gaps(spark, d)).where("n_gaps = 0 AND n_obs >= 20").select("sector", "n_obs")


@query("calendar_fill", f"""WITH g AS ({GAPS}), s AS (SELECT sector, unnest(generate_series(min(year * 4 + quarter), max(year * 4 + quarter))) AS k FROM g GROUP BY sector)
SELECT s.sector, last_day(make_date((k - 1) // 4, ((k - 1) % 4 + 1) * 3, 1)) AS period_enddate, y FROM s LEFT JOIN g ON s.sector = g.sector AND k = year * 4 + quarter""")
def _(spark, d):
    return W.calendar_fill(gaps(spark, d)).select("sector", "period_enddate", "y")


@query("resample_last", "SELECT n_name AS sector, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS period_enddate, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS y FROM {facts} GROUP BY ALL")
def _(spark, d):
    from ..functions.period import quarter_end_of

    f = order_facts(spark, d)
    return f.groupBy(F.col("n_name").alias("sector"), quarter_end_of(F.col("o_orderdate")).alias("period_enddate")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("y"))


@query("winsorize_window", f"""WITH b AS (SELECT sector, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM {{panel}} WHERE year <= 1999 GROUP BY sector)
SELECT p.sector, period_enddate, round(least(greatest(y, lo), hi), 6) AS y FROM {{panel}} p JOIN b ON p.sector = b.sector WHERE year <= 1999""")
def _(spark, d):
    train = panel(spark, d).where("year <= 1999")
    bounds = train.groupBy("sector").agg(F.percentile("y", F.lit(0.05)).alias("lo"), F.percentile("y", F.lit(0.95)).alias("hi"))
    return train.join(bounds, "sector").select("sector", "period_enddate", six(F.least(F.greatest("y", "lo"), "hi")).alias("y"))


@query("regime_seasonal_correction", """WITH s AS (SELECT *, CASE WHEN period_enddate < DATE '1998-01-01' THEN 0 WHEN period_enddate > DATE '1998-12-31' THEN 1 END AS side FROM {panel}),
k AS (SELECT *, row_number() OVER (PARTITION BY sector, quarter, side ORDER BY CASE WHEN side = 0 THEN -datediff('day', DATE '1990-01-01', period_enddate) ELSE datediff('day', DATE '1990-01-01', period_enddate) END) AS k FROM s WHERE side IS NOT NULL),
m AS (SELECT sector, quarter, avg(y) AS normal FROM k WHERE (side = 0 AND k <= 2) OR (side = 1 AND k <= 1) GROUP BY ALL)
SELECT s.sector, period_enddate, round(CASE WHEN side IS NULL THEN coalesce(normal, y) ELSE y END, 6) AS y_corrected FROM s LEFT JOIN m ON s.sector = m.sector AND s.quarter = m.quarter""")
def _(spark, d):
    return W.regime_correction(panel(spark, d), "1998-01-01", "1998-12-31", 2, 1).select("sector", "period_enddate", six("y_corrected").alias("y_corrected"))


INDEX = "SELECT sector, {side} quarter, avg(y) / avg(avg(y)) OVER (PARTITION BY sector{over}) AS idx FROM {panel} GROUP BY sector, {side} quarter"


@query("seasonal_index", f"SELECT sector, quarter, round(idx, 6) AS idx FROM ({INDEX.replace('{side}', '').replace('{over}', '')})")
def _(spark, d):
    q = panel(spark, d).groupBy("sector", "quarter").agg(F.avg("y").alias("m"))
    return q.select("sector", "quarter", six(F.col("m") / F.avg("m").over(Window.partitionBy("sector"))).alias("idx"))


@query("seasonal_stability", """WITH i AS (SELECT sector, year <= 1998 AS pre, quarter, avg(y) / avg(avg(y)) OVER (PARTITION BY sector, year <= 1998) AS idx FROM {panel} GROUP BY sector, year <= 1998, quarter)
SELECT a.sector, round(max(abs(a.idx - b.idx)), 6) AS max_shift, max(abs(a.idx - b.idx)) > 0.3 AS warn FROM i a JOIN i b ON a.sector = b.sector AND a.quarter = b.quarter AND a.pre AND NOT b.pre GROUP BY a.sector""")
def _(spark, d):
    q = panel(spark, d).groupBy("sector", (F.col("year") <= 1998).alias("pre"), "quarter").agg(F.avg("y").alias("m"))
    q = q.withColumn("idx", F.col("m") / F.avg("m").over(Window.partitionBy("sector", "pre")))
    side = lambda pre: F.max(F.when(F.col("pre") == pre, F.col("idx")))
    q = q.groupBy("sector", "quarter").agg(F.abs(side(True) - side(False)).alias("shift"))
    return q.groupBy("sector").agg(six(F.max("shift")).alias("max_shift"), (F.max("shift") > 0.3).alias("warn"))


@query("fold_labels", """WITH o AS (SELECT DISTINCT sector_code, origin_date FROM {canonical}), k AS (SELECT *, row_number() OVER (PARTITION BY sector_code ORDER BY origin_date) AS k, count(*) OVER (PARTITION BY sector_code) AS n FROM o)
SELECT sector_code, origin_date, CASE WHEN k <= least(ceil(0.4 * n), n - 1) THEN 'inner' ELSE 'outer' END AS fold_label FROM k""")
def _(spark, d):
    o = canonical(spark, d).select("sector_code", "origin_date").distinct()
    return W.inner_outer(o, "sector_code", out="fold_label").select("sector_code", "origin_date", "fold_label")


@query("cv_origins", """WITH n AS (SELECT sector, count(*) AS n FROM {panel} GROUP BY sector), o AS (SELECT sector, n, unnest(generate_series(greatest(12, floor(0.45 * n))::BIGINT, n - 5)) AS origin FROM n)
SELECT sector, origin::INT AS origin, CASE WHEN row_number() OVER (PARTITION BY sector ORDER BY origin) <= floor(0.6 * count(*) OVER (PARTITION BY sector)) THEN 'inner' ELSE 'outer' END AS fold_set FROM o QUALIFY count(*) OVER (PARTITION BY sector) >= 5""")
def _(spark, d):
    n = panel(spark, d).groupBy("sector").agg(F.count("*").cast("int").alias("n"))
    first = F.greatest(F.lit(12), F.floor(0.45 * F.col("n")).cast("int"))
    o = n.where(F.col("n") - 5 >= first).select("sector", F.explode(F.sequence(first, F.col("n") - 5)).alias("origin"))
    all_ = F.count("*").over(Window.partitionBy("sector"))
    o = o.withColumn("all", all_).where("all >= 5").withColumn("k", F.row_number().over(Window.partitionBy("sector").orderBy("origin")))
    return o.select("sector", "origin", F.when(F.col("k") <= F.floor(0.6 * F.col("all")), "inner").otherwise("outer").alias("fold_set"))


@query("growth_first_last", "SELECT sector, round((max_by(y, period_enddate) / min_by(y, period_enddate) - 1) * 100, 6) AS growth_pct FROM {panel} GROUP BY sector")
def _(spark, d):
    return panel(spark, d).groupBy("sector").agg(six((F.max_by("y", "period_enddate") / F.min_by("y", "period_enddate") - 1) * 100).alias("growth_pct"))


@query("last_per_group_year", "SELECT sector, year, period_enddate, y FROM {panel} QUALIFY row_number() OVER (PARTITION BY sector, year ORDER BY period_enddate DESC) = 1")
def _(spark, d):
    return W.first_rows(panel(spark, d), ["sector", "year"], [F.desc("period_enddate")]).select("sector", "year", "period_enddate", "y")


@query("share_of_total", f"SELECT {ID}, round(n_orders / sum(n_orders) OVER (PARTITION BY period_enddate), 6) AS share FROM {{panel}}")
def _(spark, d):
    return W.share_of_total(panel(spark, d), "n_orders", "period_enddate").select("sector", "period_enddate", six("share").alias("share"))


@query("share_change_pp", """WITH s AS (SELECT sector, year, sum(n_orders) / sum(sum(n_orders)) OVER (PARTITION BY year) AS share FROM {panel} GROUP BY sector, year)
SELECT sector, round(100 * (max_by(share, year) - min_by(share, year)), 6) AS change_pp FROM s GROUP BY sector""")
def _(spark, d):
    s = W.share_of_total(panel(spark, d).groupBy("sector", "year").agg(F.sum("n_orders").alias("n")), "n", "year")
    return s.groupBy("sector").agg(six(100 * (F.max_by("share", "year") - F.min_by("share", "year"))).alias("change_pp"))


@query("horizon_decay", """WITH h AS (SELECT model_name, horizon, avg(abs(y_pred - y_true)) AS mae FROM {canonical} GROUP BY ALL)
SELECT model_name, horizon, round(mae / first_value(mae) OVER (PARTITION BY model_name ORDER BY horizon), 6) AS decay FROM h""")
def _(spark, d):
    h = canonical(spark, d).groupBy("model_name", "horizon").agg(M.mae(F.col("y_true"), F.col("y_pred")).alias("mae"))
    return h.select("model_name", "horizon", six(F.col("mae") / F.first("mae").over(Window.partitionBy("model_name").orderBy("horizon"))).alias("decay"))


@query("holm_adjust", """WITH p AS (SELECT model_name, sector_code, round(mae / (1 + mae), 6) AS p FROM {sector_mae}), s AS (SELECT *, p * (count(*) OVER (PARTITION BY model_name) - row_number() OVER (PARTITION BY model_name ORDER BY p, sector_code) + 1) AS z FROM p)
SELECT model_name, sector_code, p, round(least(1.0, max(z) OVER (PARTITION BY model_name ORDER BY p, sector_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_holm FROM s""")
def _(spark, d):
    p = sector_mae(spark, d).select("model_name", "sector_code", six(F.col("mae") / (1 + F.col("mae"))).alias("p"))
    return W.holm(p, "p", ["sector_code"], group="model_name").withColumn("p_holm", six("p_holm"))


@query("lag1_autocorr", """WITH e AS (SELECT model_name, sector_code, target_date, y_true - y_pred AS e FROM {canonical}), l AS (SELECT *, lag(e) OVER (PARTITION BY model_name, sector_code ORDER BY target_date) AS b FROM e)
SELECT model_name, sector_code, round(corr(e, b), 5) AS r, abs(corr(e, b)) > 0.3 AS flag FROM l WHERE b IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    e = canonical(spark, d).select("model_name", "sector_code", "target_date", (F.col("y_true") - F.col("y_pred")).alias("e"))
    e = e.withColumn("e_lag1", F.lag("e").over(Window.partitionBy("model_name", "sector_code").orderBy("target_date")))
    r = e.groupBy("model_name", "sector_code").agg(M.corr(F.col("e"), F.col("e_lag1")).alias("r"))
    return r.select("model_name", "sector_code", F.round("r", 5).alias("r"), (F.abs("r") > 0.3).alias("flag"))


@query("per_period_best", "SELECT sector_code, target_date, min_by(model_name, (round(abs(y_pred - y_true), 6), model_name)) AS best FROM {canonical} GROUP BY ALL")
def _(spark, d):
    key = F.struct(six(F.abs(F.col("y_pred") - F.col("y_true"))), "model_name")
    return canonical(spark, d).groupBy("sector_code", "target_date").agg(F.min_by("model_name", key).alias("best"))


@query("contiguity_check", f"SELECT sector, max(year * 4 + quarter) - min(year * 4 + quarter) + 1 = count(*) AS is_contiguous FROM ({GAPS}) GROUP BY sector")
def _(spark, d):
    return W.contiguous(gaps(spark, d))


@query("year_ago_by_date", f"WITH g AS ({GAPS}) SELECT a.sector, a.period_enddate, a.y, b.y AS y_year_ago, round(abs(a.y - b.y), 6) AS ae FROM g a LEFT JOIN g b ON a.sector = b.sector AND a.period_enddate = last_day(b.period_enddate + INTERVAL 12 MONTH)")
def _(spark, d):
    return W.year_ago(gaps(spark, d)).select("sector", "period_enddate", "y", "y_year_ago", six(F.abs(F.col("y") - F.col("y_year_ago"))).alias("ae"))


@query("target_series", """WITH f AS (SELECT n_name AS sector, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS period_enddate, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS y FROM {facts} GROUP BY ALL)
SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY sector) >= 20""")
def _(spark, d):
    from ..functions.period import quarter_end_of

    f = order_facts(spark, d).withColumn("period_enddate", quarter_end_of(F.col("o_orderdate")))
    s = f.groupBy(F.col("n_name").alias("sector"), "period_enddate").agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("y"))
    return s.withColumn("n", F.count("*").over(Window.partitionBy("sector"))).where("n >= 20").drop("n")


@query("latest_value_wins", f"SELECT sector, max_by(y, period_enddate) FILTER (y IS NOT NULL) AS y, max(period_enddate) FILTER (y IS NOT NULL) AS at FROM ({HOLES}) GROUP BY sector")
def _(spark, d):
    h = holes(spark, d).where("y IS NOT NULL")
    return h.groupBy("sector").agg(F.max_by("y", "period_enddate").alias("y"), F.max("period_enddate").alias("at"))


@query("collapse_variants", "SELECT sector_code, least(max(mae) FILTER (model_name = 'naive'), max(mae) FILTER (model_name = 'seasonal_ma')) AS seasonal, max(mae) FILTER (model_name = 'last') AS last FROM {sector_mae} GROUP BY sector_code")
def _(spark, d):
    own = lambda m: F.max(F.when(F.col("model_name") == m, F.col("mae")))
    return sector_mae(spark, d).groupBy("sector_code").agg(F.least(own("naive"), own("seasonal_ma")).alias("seasonal"), own("last").alias("last"))


@query("date_parts", "SELECT o_orderkey, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))


@query("period_flags", f"SELECT {ID}, (period_enddate BETWEEN DATE '1998-01-01' AND DATE '1999-06-30')::INT AS in_regime, (period_enddate > DATE '1999-06-30')::INT AS after_regime FROM {{panel}}")
def _(spark, d):
    return panel(spark, d).withColumns(regime_flags(F.col("period_enddate"), "1998-01-01", "1999-06-30")).select("sector", "period_enddate", "in_regime", "after_regime")


RAMPS = "round(least(12, greatest(0, datediff('day', DATE '1998-01-01', period_enddate) / 91.3125)), 6) AS depth, round(greatest(0, datediff('day', DATE '1999-06-30', period_enddate) / 91.3125), 6) AS recovery"


@query("regime_ramps", f"SELECT {ID}, {RAMPS} FROM {{panel}}")
def _(spark, d):
    r = regime_ramps(F.col("period_enddate"), "1998-01-01", "1999-06-30")
    return panel(spark, d).select("sector", "period_enddate", *[six(c).alias(k) for k, c in r.items()])


@query("regime_interactions", f"SELECT {ID}, CASE WHEN period_enddate BETWEEN DATE '1998-01-01' AND DATE '1999-06-30' THEN quarter ELSE 0 END AS quarter_regime, (CASE WHEN period_enddate BETWEEN DATE '1998-01-01' AND DATE '1999-06-30' THEN year * 4 + quarter - (SELECT min(year * 4 + quarter) FROM {{panel}}) + 1 ELSE 0 END)::BIGINT AS trend_regime FROM {{panel}}")
def _(spark, d):
    p = W.with_trend(panel(spark, d)).withColumns(regime_flags(F.col("period_enddate"), "1998-01-01", "1999-06-30"))
    return p.select("sector", "period_enddate", (F.col("quarter") * F.col("in_regime")).alias("quarter_regime"), (F.col("trend_index") * F.col("in_regime")).alias("trend_regime"))


@query("next_quarter_ends", "SELECT sector, last_day(z + to_months(3 * k::INT))::DATE AS period_enddate FROM (SELECT sector, max(period_enddate) AS z FROM {panel} GROUP BY sector), range(1, 5) r(k)")
def _(spark, d):
    return panel(spark, d).groupBy("sector").agg(F.max("period_enddate").alias("z")).select("sector", F.explode(next_quarter_ends(F.col("z"), 4)).alias("period_enddate"))


@query("quarter_label", "SELECT DISTINCT printf('%d-Q%d', year, quarter) AS label FROM {panel}")
def _(spark, d):
    return panel(spark, d).select(quarter_label(F.col("period_enddate")).alias("label")).distinct()
