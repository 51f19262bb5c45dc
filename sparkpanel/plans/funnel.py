"""Queries of the feature funnel, importances and stationarity tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import corr
from ..operators import funnel as N
from ..operators import lagged as G
from ..operators import selection as K
from ..operators.diagnostics import seasonal_period
from .elimination import adf_sql, granger_sql
from .frames import panel
from .integrals import f_upper
from .registry import query

six = lambda c: F.round(c, 6)
STRUCTURAL = ["sector", "region", "period_enddate", "year", "quarter"]


def wide(spark, d):
    """The panel with a feature that moves with the target, a yearly one and flags of two regions."""
    p = panel(spark, d)
    return p.withColumns({"x_mix": F.col("y") * 0.5 + F.col("x_bal") / 1000, "y_bal": F.col("x_bal"), "r_ASIA": (F.col("region") == "ASIA").cast("int"), "r_EUROPE": (F.col("region") == "EUROPE").cast("int")})


@query("derive_features", " UNION ALL ".join(f"SELECT '{f}' AS feature, {y} AS yearly, count({c}) AS n FROM {{panel}}" for f, c, y in (("n_orders", "n_orders", "false"), ("x_bal", "x_bal", "false"), ("x_mix", "x_bal", "false"), ("y_bal", "x_bal", "true"))))
def _(spark, d):
    w = wide(spark, d)
    own = N.derive_features(w.columns, STRUCTURAL, "y", ("r_",))
    names = spark.createDataFrame(own, "feature string, yearly boolean")
    n = K.long(w, ["sector"], [f for f, _ in own]).groupBy("feature").agg(F.count("value").alias("n"))
    return names.join(n, "feature")


FEATURES = ["n_orders", "x_bal", "x_mix"]


LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, sector, period_enddate AS t, {c} AS value, y FROM {{panel}}" for f, c in (("n_orders", "n_orders::DOUBLE"), ("x_bal", "x_bal"), ("x_mix", "y * 0.5 + x_bal / 1000")))


@query("granger", f"WITH {granger_sql(LONG)} SELECT feature, round(avg((p < 0.05)::INT), 6) AS share, count(*) AS n, avg((p < 0.05)::INT) >= 0.2 AS retained FROM (SELECT feature, sector, min({f_upper('stat', 'lag', 'bottom')}) AS p FROM granger_p GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return G.granger(wide(spark, d), FEATURES, "y", "sector", "period_enddate").withColumn("share", six("share"))


@query("granger_tests", f"WITH {granger_sql(LONG, 2)} SELECT feature, sector, lag::INT AS lag, round({f_upper('stat', 'lag', 'bottom')}, 6) AS p FROM granger_p")
def _(spark, d):
    """Each test by itself, for one and two lags."""
    return G.granger_tests(wide(spark, d), FEATURES, "y", "sector", "period_enddate", 2).select("feature", "sector", "lag", six("p").alias("p"))


@query("lasso_stability")
def _(spark, d):
    return N.lasso_stability(wide(spark, d), FEATURES, "y", "sector", "period_enddate").withColumn("share", six("share"))


@query("tree_importance")
def _(spark, d):
    return N.tree_importance(wide(spark, d), FEATURES, "y", "sector", "period_enddate").withColumn("importance", six("importance"))


@query("funnel")
def _(spark, d):
    stages = N.funnel(wide(spark, d), FEATURES, "y", "sector", "period_enddate")
    return spark.createDataFrame([(k, name, f) for k, (name, own) in enumerate(stages) for f in own or [None]], "position int, stage string, feature string")


@query("select_features")
def _(spark, d):
    return N.select_features(wide(spark, d), STRUCTURAL, "y", "sector", "period_enddate", ("r_",), holdout=4)


@query("topn_importance", """WITH r AS (SELECT sector, 'n_orders' AS feature, corr(n_orders, y) AS w FROM {panel} GROUP BY 1 UNION ALL SELECT sector, 'x_bal', corr(x_bal, y) FROM {panel} GROUP BY 1)
SELECT sector, feature, round(w, 5) AS weight FROM r QUALIFY row_number() OVER (PARTITION BY sector ORDER BY abs(w) DESC, feature) = 1""")
def _(spark, d):
    r = K.long(panel(spark, d), ["sector", "y"], FEATURES[:2]).groupBy("sector", "feature").agg(corr(F.col("value"), F.col("y")).alias("w"))
    return N.top_importance(r, "sector", "w", 1).select("sector", "feature", F.round("w", 5).alias("weight"))


@query("forecast_lagged_ols", """WITH d AS (SELECT sector, period_enddate, y, lag(x_bal, 3) OVER w AS x, row_number() OVER (PARTITION BY sector ORDER BY period_enddate DESC) AS back FROM {panel} WINDOW w AS (PARTITION BY sector ORDER BY period_enddate)),
f AS (SELECT sector, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM d WHERE back > 4 AND x IS NOT NULL GROUP BY 1) SELECT d.sector, period_enddate, y, round(base + slope * x, 5) AS y_pred FROM d JOIN f USING (sector) WHERE back <= 4""")
def _(spark, d):
    return N.lagged_ols(panel(spark, d), "x_bal", "y", "sector", "period_enddate").withColumn("y_pred", F.round("y_pred", 5))


SERIES = "SELECT sector, period_enddate AS t, y FROM {panel}"


@query("adf_test", f"WITH {adf_sql(SERIES)} SELECT sector, round(statistic, 4) AS statistic, lags::INT AS lags, round(critical, 6) AS critical, statistic < critical AS stationary FROM adf")
def _(spark, d):
    return G.adf_test(panel(spark, d), "sector", "period_enddate", "y").withColumns({"statistic": F.round("statistic", 4), "critical": six("critical")})


ORDERS = """od AS (SELECT sector, t, y - lag(y) OVER o AS once, y - 2 * lag(y) OVER o + lag(y, 2) OVER o AS twice FROM (SERIES) WINDOW o AS (PARTITION BY sector ORDER BY t)),
oo AS (SELECT sector, t, 1 AS d, once AS v FROM od WHERE once IS NOT NULL UNION ALL SELECT sector, t, 2, twice FROM od WHERE twice IS NOT NULL),
oc AS (SELECT *, v - avg(v) OVER (PARTITION BY sector, d) AS c, v - lag(v, 4) OVER (PARTITION BY sector, d ORDER BY t) AS a FROM oo),
oe AS (SELECT *, a - avg(a) OVER (PARTITION BY sector, d) AS e, lag(c) OVER w AS c1, lag(c, 4) OVER w AS c4 FROM oc WINDOW w AS (PARTITION BY sector, d ORDER BY t)),
og AS (SELECT *, lag(e) OVER (PARTITION BY sector, d ORDER BY t) AS e1 FROM oe),
os AS (SELECT sector, d, count(*) AS n, var_samp(v) AS var, sum(c * c1) / sum(c * c) AS r1, sum(c * c4) / sum(c * c) AS rs, var_samp(a) AS var_s, sum(e * e1) / sum(e * e) AS r1_s FROM og GROUP BY ALL),
ot AS (SELECT *, coalesce(n > 6 AND abs(rs) > 1.96 / sqrt(n) AND var_s < var AND r1_s >= -0.5, false)::INT AS seasonal FROM os),
ou AS (SELECT a.sector, CASE WHEN b.var < a.var AND b.r1 >= -0.5 THEN 2 ELSE 1 END AS d, CASE WHEN b.var < a.var AND b.r1 >= -0.5 THEN b.seasonal ELSE a.seasonal END AS seasonal_d FROM ot a JOIN ot b ON a.sector = b.sector AND a.d = 1 AND b.d = 2)""".replace("SERIES", SERIES)


@query("differencing_order", f"WITH {adf_sql(SERIES)}, {ORDERS} SELECT sector, CASE WHEN statistic < critical THEN 0 ELSE d END AS d, CASE WHEN statistic < critical THEN 0 ELSE seasonal_d END AS seasonal_d FROM adf JOIN ou USING (sector)")
def _(spark, d):
    return G.differencing_order(panel(spark, d), "sector", "period_enddate", "y")


@query("seasonal_differencing")
def _(spark, d):
    """Orders with the season that each series shows itself."""
    p = panel(spark, d)
    return G.differencing_order(p, "sector", "period_enddate", "y", seasonal_period(p, "sector", "period_enddate", "y"))
