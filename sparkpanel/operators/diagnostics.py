"""Diagnostics of series from sums over lags and frequencies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def acf(df: DataFrame, key: str, time: str, y: str, lags: list[int]) -> DataFrame:
    """key, lag, r: autocorrelations about the series' mean."""
    w, part = Window.partitionBy(key).orderBy(time), Window.partitionBy(key)
    d = df.select(key, time, (F.col(y) - F.avg(y).over(part)).alias("c"))
    d = d.withColumns({f"p{k}": F.col("c") * F.lag("c", k).over(w) for k in lags})
    g = d.groupBy(key).agg(F.sum(F.col("c") * F.col("c")).alias("s"), *[F.sum(f"p{k}").alias(f"s{k}") for k in lags])
    return g.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(f"s{k}", "s").alias("r")) for k in lags])))


def ljung_box(df: DataFrame, key: str, time: str, y: str, lags: int) -> DataFrame:
    """key, q: n (n + 2) times the sum of squared autocorrelations over n - lag."""
    n = df.groupBy(key).agg(F.count(y).alias("n"))
    r = acf(df, key, time, y, list(range(1, lags + 1))).join(n, key)
    return r.groupBy(key).agg((F.max("n") * (F.max("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("q"))


def component_strength(df: DataFrame, key: str, component: str, remainder: str) -> DataFrame:
    """max(0, 1 - var(remainder) / var(component + remainder))."""
    share = F.try_divide(F.var_pop(remainder), F.var_pop(F.col(component) + F.col(remainder)))
    return df.groupBy(key).agg(F.greatest(F.lit(0.0), 1 - share).alias("strength"))


def seasonal_period(df: DataFrame, key: str, time: str, y: str) -> DataFrame:
    """key, period: rows per cycle of the frequency with the most power in the differences, over all frequencies up to half the rows; 1 if it is 1 or more than half the rows."""
    w = Window.partitionBy(key).orderBy(time)
    d = df.select(key, (F.col(y) - F.lag(y).over(w)).alias("d"), (F.row_number().over(w) - 2).alias("t")).where("d IS NOT NULL")
    d = d.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n >= 2").withColumn("k", F.explode(F.expr("sequence(1L, n div 2)")))
    angle = F.lit(2 * math.pi) * F.col("k") * F.col("t") / F.col("n")
    c, s = F.sum(F.col("d") * F.cos(angle)), F.sum(F.col("d") * F.sin(angle))
    # one-sided: all frequencies but the highest of an even number of rows stand for two
    p = d.groupBy(key, "k", "n").agg(((c * c + s * s) * F.when(F.col("k") * 2 == F.col("n"), 0.5).otherwise(1.0)).alias("power"))
    best = p.groupBy(key).agg(F.max_by(F.struct(F.round(F.col("n") / F.col("k")).cast("long").alias("period"), "n"), F.struct(F.round("power", 4), -F.col("k"))).alias("b"))
    return best.select(key, F.when((F.col("b.period") > 1) & (F.col("b.period") * 2 <= F.col("b.n") + 1), F.col("b.period")).otherwise(1).alias("period"))
