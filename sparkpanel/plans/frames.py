"""Frames that the queries share, as DataFrames and as SQL: a panel of nations by quarter and forecasts of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.period import add_quarters, quarter_end
from ..operators.windows import by, rolling_same_quarter_mean, seasonal_ma


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their nation and region, up to the last whole quarter."""
    t = lambda n: table(spark, sf_dir, n)
    end = t("orders").agg(F.date_trunc("quarter", F.max("o_orderdate") + F.expr("INTERVAL 1 DAY"))).scalar()
    d = t("orders").where(F.col("o_orderdate") < end)
    d = d.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector, period_enddate, year, quarter, y (mean order value in thousands), n_orders, x_total, region."""
    d = order_facts(spark, sf_dir).groupBy(F.col("n_name").alias("sector"), F.col("r_name").alias("region"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    # sums of whole hundredths, rounded in whole numbers: the order of the rows can't change a digit
    whole = lambda c: F.sum(F.round(F.col(c) * 100).cast("decimal(20,0)"))
    d = d.agg(whole("o_totalprice").alias("cents"), whole("c_acctbal").alias("bal"), F.count("*").alias("n_orders"))
    mean = lambda c, scale: F.expr(f"sign({c}) * ((abs({c}) * {2 * scale} + n_orders) div (2 * n_orders)) / 1e6D")
    d = d.withColumns({"y": mean("cents", 10), "x_bal": mean("bal", 10_000)})
    return d.withColumn("period_enddate", quarter_end(F.col("year"), F.col("quarter"))).select("sector", "region", "period_enddate", "year", "quarter", "y", "n_orders", "x_bal")


MODELS = ("rolling", "naive", "seasonal_ma", "last")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the panel by four models in the canonical columns and fold_set, horizons 1 to 4 by quarter of the year; from the fourth year on, two years are inner."""
    p = panel(spark, sf_dir)
    w = by("sector", "period_enddate")
    d = seasonal_ma(rolling_same_quarter_mean(p, out="rolling"), out="seasonal_ma").withColumns({"naive": F.lag("y", 4).over(w), "last": F.lag("y", 1).over(w)})
    first = p.agg(F.min("year")).scalar()
    d = d.withColumn("own_models", F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("y_pred")) for m in MODELS]))
    d = d.select(*p.columns, F.inline("own_models")).withColumn("first_year", first).where("y_pred IS NOT NULL AND year >= first_year + 3")
    d = d.withColumn("horizon", F.col("quarter")).withColumn("y_pred", F.round("y_pred", 6))
    band = lambda z, sign: F.round(F.col("y_pred") + sign * z * 0.1 * F.col("y_pred"), 6)
    return d.select(
        "model_name", F.col("sector").alias("sector_code"), add_quarters(F.col("period_enddate"), -F.col("horizon")).alias("origin_date"), F.col("period_enddate").alias("target_date"), "horizon",
        F.col("y").alias("y_true"), "y_pred", band(1.28, -1).alias("y_lower_80"), band(1.28, 1).alias("y_upper_80"), band(1.96, -1).alias("y_lower_95"), band(1.96, 1).alias("y_upper_95"),
        F.when(F.col("year") <= F.col("first_year") + 4, "inner").otherwise("outer").alias("fold_set"),
    )


def sector_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_name, sector_code, mae and n of the outer folds."""
    return canonical(spark, sf_dir).where("fold_set = 'outer'").groupBy("model_name", "sector_code").agg(F.round(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))), 6).alias("mae"), F.count("*").alias("n"))


def period_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perioden (codes of quarters, months and years), dim (order priority, with totals), sector and Metric_1 as text."""
    d = order_facts(spark, sf_dir).groupBy(F.col("n_name").alias("sector"), F.year("o_orderdate").alias("yy"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"), F.col("o_orderpriority").alias("dim")).agg(F.count("*").alias("v"))
    # each count of a month goes to its quarter, month and year, and to the totals
    codes = F.array(*[F.format_string(f"%d{mark}%02d", "yy", n) for mark, n in (("KW", F.col("q")), ("MM", F.col("m")), ("JJ", F.lit(0)))])
    d = d.select("sector", "v", "dim", F.explode(codes).alias("Perioden")).select("sector", "v", "Perioden", F.explode(F.array("dim", F.lit("T001"))).alias("dim"))
    return d.groupBy("Perioden", "dim", "sector").agg(F.sum("v").cast("string").alias("Metric_1"))


CTES = {
    "facts": """SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderdate < (SELECT date_trunc('quarter', max(o_orderdate) + INTERVAL 1 DAY) FROM orders)""",
    "panel": """SELECT n_name AS sector, r_name AS region, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS period_enddate, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter,
  sign(sum(round(o_totalprice * 100)::BIGINT)) * ((abs(sum(round(o_totalprice * 100)::BIGINT)) * 20 + count(*)) // (2 * count(*))) / 1e6 AS y, count(*) AS n_orders,
  sign(sum(round(c_acctbal * 100)::BIGINT)) * ((abs(sum(round(c_acctbal * 100)::BIGINT)) * 20000 + count(*)) // (2 * count(*))) / 1e6 AS x_bal FROM {facts} GROUP BY n_name, r_name, period_enddate, year(o_orderdate), quarter(o_orderdate)""",
    "models": """SELECT 'rolling' AS model_name, *, CASE WHEN count(y) OVER w = 3 THEN avg(y) OVER w END AS y_pred FROM {panel} WINDOW w AS (PARTITION BY sector, quarter ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT 'naive', *, lag(y, 4) OVER (PARTITION BY sector ORDER BY period_enddate) FROM {panel}
  UNION ALL SELECT 'seasonal_ma', * EXCLUDE (a, b, c), (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0)
  FROM (SELECT *, lag(y, 4) OVER v AS a, lag(y, 8) OVER v AS b, lag(y, 12) OVER v AS c FROM {panel} WINDOW v AS (PARTITION BY sector ORDER BY period_enddate))
  UNION ALL SELECT 'last', *, lag(y, 1) OVER (PARTITION BY sector ORDER BY period_enddate) FROM {panel}""",
    "canonical": """SELECT model_name, sector AS sector_code, last_day(period_enddate - to_months(3 * quarter))::DATE AS origin_date, period_enddate AS target_date, quarter AS horizon, y AS y_true, round(y_pred, 6) AS y_pred,
  round(round(y_pred, 6) - 1.28 * 0.1 * round(y_pred, 6), 6) AS y_lower_80, round(round(y_pred, 6) + 1.28 * 0.1 * round(y_pred, 6), 6) AS y_upper_80,
  round(round(y_pred, 6) - 1.96 * 0.1 * round(y_pred, 6), 6) AS y_lower_95, round(round(y_pred, 6) + 1.96 * 0.1 * round(y_pred, 6), 6) AS y_upper_95,
  CASE WHEN year <= (SELECT min(year) FROM {panel}) + 4 THEN 'inner' ELSE 'outer' END AS fold_set FROM {models} WHERE y_pred IS NOT NULL AND year >= (SELECT min(year) FROM {panel}) + 3""",
    "sector_mae": "SELECT model_name, sector_code, round(avg(abs(y_pred - y_true)), 6) AS mae, count(*) AS n FROM {canonical} WHERE fold_set = 'outer' GROUP BY ALL",
    "period_table": """SELECT Perioden, dim, sector, count(*)::VARCHAR AS Metric_1 FROM (
  SELECT unnest([printf('%dKW%02d', year(o_orderdate), quarter(o_orderdate)), printf('%dMM%02d', year(o_orderdate), month(o_orderdate)), printf('%dJJ00', year(o_orderdate))]) AS Perioden, dim, n_name AS sector
  FROM (SELECT *, unnest([o_orderpriority, 'T001']) AS dim FROM {facts})) GROUP BY ALL""",
}
