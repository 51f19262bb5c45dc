"""Queries that fit models per series; numeric fits have no SQL, their tests are closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as O
from ..operators.windows import first_rows
from .frames import panel
from .registry import query

six = lambda c: F.round(c, 6)
GRID = [("ets_none", "ets", {}), ("ets_damped", "ets", {"trend": "damped"}), ("ridge", "ridge", {}), ("mean", "seasonal_mean", {}), ("naive", "seasonal_naive", {}), ("stl_ets", "stl_ets", {}), ("ridge_deseason", "ridge_deseason", {"window": 4})]


def backtest(spark, d, configs):
    return O.walk_forward(panel(spark, d), configs, "sector", "period_enddate", "y")


def one(name: str, configs):
    @query(name)
    def _(spark, d):
        return backtest(spark, d, configs).select("sector", "target_date", "horizon", six("y_true").alias("y_true"), six("y_pred").alias("y_pred"), "error")


one("forecast_ets", [("m", "ets", {"trend": "damped"})])
one("forecast_stl_ets", [("m", "stl_ets", {})])
one("forecast_ridge", [("m", "ridge", {"window": 8})])
one("forecast_ridge_deseason", [("m", "ridge_deseason", {"window": 4})])


_PART = "PARTITION BY sector, quarter ORDER BY year DESC"


@query("forecast_seasonal_mean", f"SELECT sector, quarter, round(avg(y), 6) AS y_pred FROM (SELECT *, row_number() OVER ({_PART}) AS k FROM {{panel}}) WHERE k <= 3 GROUP BY ALL")
def _(spark, d):
    last = first_rows(panel(spark, d), ["sector", "quarter"], [F.desc("year")], 3)
    return last.groupBy("sector", "quarter").agg(six(F.avg("y")).alias("y_pred"))


@query("forecast_seasonal_naive", f"SELECT sector, quarter, y AS y_pred FROM (SELECT *, row_number() OVER ({_PART}) AS k FROM {{panel}}) WHERE k = 1")
def _(spark, d):
    return first_rows(panel(spark, d), ["sector", "quarter"], [F.desc("year")]).select("sector", "quarter", F.col("y").alias("y_pred"))


@query("walk_forward")
def _(spark, d):
    return backtest(spark, d, GRID).select("sector", "config", "origin_date", "target_date", "horizon", six("y_pred").alias("y_pred"), "fold_set", "error")


@query("grid_search_cv")
def _(spark, d):
    b = backtest(spark, d, GRID).where("fold_set = 'inner'").groupBy("sector", "config").agg(six(F.avg((F.col("y_pred") - F.col("y_true")) ** 2)).alias("mse"))
    return first_rows(b, "sector", [F.col("mse"), F.col("config")])


@query("full_sweep")
def _(spark, d):
    b = backtest(spark, d, GRID)
    return b.groupBy("config").agg(F.countDistinct("sector").alias("n_sectors"), F.count("error").alias("n_failed"), six(F.avg(F.abs(F.col("y_pred") - F.col("y_true")))).alias("mae"))


@query("forward_forecast")
def _(spark, d):
    b = backtest(spark, d, GRID).where("fold_set = 'inner'").groupBy("sector", "config").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    best = first_rows(b, "sector", [F.col("mae"), F.col("config")])
    return O.forward(panel(spark, d), best, GRID, "sector", "period_enddate", "y").withColumn("y_pred", six("y_pred"))


@query("stl_decompose")
def _(spark, d):
    return O.decompose(panel(spark, d), "sector", "period_enddate", "y").select("sector", "period_enddate", six("trend").alias("trend"), six("seasonal").alias("seasonal"), six("remainder").alias("remainder"))
