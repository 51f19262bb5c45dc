"""Yearly series on quarters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import corr


def interpolate_linear(yearly: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """key, year, quarter, value: linear between the middles of years, flat beyond the ends, moved so that a year's quarters average to it."""
    w = Window.partitionBy(key).orderBy(year)
    v = F.col(value)
    d = yearly.withColumns({"before": F.coalesce(F.lag(value).over(w), v), "after": F.coalesce(F.lead(value).over(w), v)})
    d = d.withColumn("quarter", F.explode(F.array(*[F.lit(q) for q in range(1, 5)])))
    # quarter middles lie 3/8 and 1/8 of a year before and after the year's middle
    raw = F.when(F.col("quarter") == 1, v - (v - F.col("before")) * 0.375).when(F.col("quarter") == 2, v - (v - F.col("before")) * 0.125).when(F.col("quarter") == 3, v + (F.col("after") - v) * 0.125).otherwise(v + (F.col("after") - v) * 0.375)
    d = d.withColumn("raw", raw)
    return d.select(key, year, "quarter", (F.col("raw") + v - F.avg("raw").over(Window.partitionBy(key, year))).alias(value))


def _year(s: Column, h: Column, e: Column, total: Column, t: Column) -> list[Column]:
    """The four quarters' changes x of a year: s x1 - x2 + m = h, -x3 + e x4 + m = t, even second differences between, sum = total.

    m is the year's multiplier. All follow from x1 and m, which two equations give.
    """
    a4, b4, c4 = e * (3 * s - 2) - (2 * s - 1), 6 * e - 2, h * (2 - 3 * e)
    a5, c5 = 6 * s - 2, total + 6 * h
    det = 10 * a4 - b4 * a5
    x1, m = (10 * (t - c4) - b4 * c5) / det, (a4 * c5 - a5 * (t - c4)) / det
    return [x1, s * x1 + m - h, (2 * s - 1) * x1 + 3 * m - 2 * h, (3 * s - 2) * x1 + 6 * m - 3 * h]


def denton_series(df: DataFrame, key: str, year: str, quarter: str, value: str, indicator: str, how: str = "mean") -> DataFrame:
    """Each series of whole years (a row per quarter, the annual value on each) made quarterly: the smallest squared changes of value - indicator that keep each year's mean (or sum).

    The conditions of a minimum link a year only to the next one's first quarter. A fold over the years solves each for
    that quarter as an unknown, a second one backwards puts the values in: time is linear in the years but for the copying
    of the folds' lists, and all is in columns.
    """
    weight = 0.25 if how == "mean" else 1.0
    q = F.array_sort(F.collect_list(F.struct(F.col(quarter).alias("q"), F.col(indicator).cast("double").alias("p"))))
    y = df.groupBy(key, year).agg(F.first(value).cast("double").alias("annual"), q.alias("quarters")).where(F.size("quarters") == 4)
    total = F.col("annual") / weight - F.aggregate("quarters", F.lit(0.0), lambda a, x: a + x["p"])
    d = y.select(key, F.struct(F.col(year).alias("year"), total.alias("total"), "quarters").alias("y")).groupBy(key).agg(F.array_sort(F.collect_list("y")).alias("years"))
    end = lambda i: F.when(i == F.size("years") - 1, 1.0).otherwise(2.0)
    rows = F.transform("years", lambda x, i: F.struct(x["total"].alias("total"), end(i).alias("e")))
    state = lambda s, h, out: F.struct(s.alias("s"), h.alias("h"), out.alias("out"))

    def forward(a, x):
        now = F.struct(a["s"].alias("s"), a["h"].alias("h"), x["e"].alias("e"), x["total"].alias("total"))
        last = lambda t: _year(a["s"], a["h"], x["e"], x["total"], F.lit(t))[3]
        none, one = last(0.0), last(1.0)  # the last quarter is linear in the next year's first
        return state(2 - (one - none), none, F.concat(a["out"], F.array(now)))

    kind = "array<struct<s:double,h:double,e:double,total:double>>"
    d = d.withColumn("steps", F.aggregate(rows, state(F.lit(1.0), F.lit(0.0), F.array().cast(kind)), forward, lambda a: a["out"]))
    begin = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<array<double>>").alias("out"))

    def backward(a, x):
        new = F.array(*_year(x["s"], x["h"], x["e"], x["total"], a["t"]))
        return F.struct(F.get(new, F.lit(0)).alias("t"), F.concat(a["out"], F.array(new)).alias("out"))

    d = d.withColumn("changes", F.reverse(F.aggregate(F.reverse("steps"), begin, backward, lambda a: a["out"])))
    one = d.select(key, F.explode(F.arrays_zip("years", "changes")).alias("z"))
    four = F.zip_with("z.years.quarters", "z.changes", lambda q, x: F.struct(q["q"].alias(quarter), (q["p"] + x).alias(value)))
    return one.select(key, F.col("z.years.year").alias(year), F.inline(four))


def constant_over_series(df: DataFrame, time: str, column: str, eps: float = 1e-10) -> DataFrame:
    """is_broadcast: whether the column is the same for all series in each period."""
    return df.groupBy(time).agg(F.stddev_pop(column).alias("s")).agg(F.bool_and(F.coalesce(F.col("s") < eps, F.lit(True))).alias("is_broadcast"))


def best_indicator(df: DataFrame, key: str, year: str, value: str, features: list[str], least_years: int = 5, least_r: float = 0.30) -> DataFrame:
    """key, feature, r: the quarterly feature whose yearly mean goes with the annual value best, of enough years and |r|."""
    own = df.groupBy(key, year).agg(F.avg(value).alias("annual"), *[F.avg(f).alias(f) for f in features])
    d = own.select(key, "annual", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])))
    r = d.groupBy(key, "feature").agg(corr(F.col("x"), F.col("annual")).alias("r"), F.count_if(F.col("x").isNotNull() & F.col("annual").isNotNull()).alias("n"))
    ok = r.where((F.col("n") >= least_years) & (F.abs("r") >= least_r))
    return ok.groupBy(key).agg(F.max_by(F.struct("feature", "r"), F.struct(F.round(F.abs("r"), 9), "feature")).alias("b")).select(key, "b.feature", "b.r")


def smooth_yearly(df: DataFrame, year: str, quarter: str, columns: list[str], features: list[str] = (), least_r: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """df with its yearly columns (one value on all rows of a year) made quarterly, and a report: column, is_broadcast, method, indicator, r.

    A column's annual series is its mean over a year's rows. With features, the one that goes with it best gives the shape
    (denton), unless a year lacks a quarter of it; else the values are interpolated. Fewer than two annual values, and
    periods without a new value, leave the column as it is. What is solved in Python is a row per period and column.
    """
    means = [F.avg(f).alias(f) for f in features]
    periods = df.groupBy(year, quarter).agg(*means, *[F.stddev_pop(c).alias(c) for c in columns])
    own = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    annual = df.groupBy(year).agg(*means, *[F.avg(c).alias(c) for c in columns]).select(year, *features, own).where("value IS NOT NULL")
    report = periods.select(own).groupBy("column").agg(F.coalesce(F.max("value") < 1e-10, F.lit(True)).alias("is_broadcast"))
    report = report.join(annual.groupBy("column").agg(F.count("*").alias("n")), "column", "left")
    if features:
        report = report.join(best_indicator(annual, "column", year, "value", list(features), least_r=least_r).withColumnRenamed("feature", "indicator"), "column", "left")
    else:
        report = report.withColumns({"indicator": F.lit(None).cast("string"), "r": F.lit(None).cast("double")})
    shape = F.inline(F.array(*[F.struct(F.lit(f).alias("indicator"), F.col(f).cast("double").alias("x")) for f in features])) if features else F.inline(F.array(F.struct(F.lit("").alias("indicator"), F.lit(0.0).alias("x"))))
    quarters = annual.select(year, "column", "value").join(report.where("n >= 2").select("column", "indicator"), "column").join(periods.select(year, quarter, shape).where("x IS NOT NULL"), [year, "indicator"], "left")
    whole = quarters.groupBy("column", year).agg(F.count("x").alias("n")).groupBy("column").agg((F.min("n") == 4).alias("whole"))
    report = report.join(whole, "column", "left").withColumn("method", F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, "skip").when(F.col("indicator").isNull(), "linear").when(F.col("whole"), "denton").otherwise("linear (incomplete quarters)"))
    report = report.select("column", "is_broadcast", "method", "indicator", "r")
    of = lambda rule: report.where(rule).select("column")
    new = interpolate_linear(annual.join(of(F.col("method").startswith("linear")), "column", "left_semi"), "column", year, "value")
    if features:
        new = new.unionByName(denton_series(quarters.join(of("method = 'denton'"), "column", "left_semi"), "column", year, quarter, "value", "x"))
    new = new.groupBy(year, "quarter").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"new_{c}") for c in columns]).withColumnRenamed("quarter", quarter)
    out = df.join(new, [year, quarter], "left")
    return out.select(*[F.coalesce(f"new_{c}", F.col(c).cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns]), report
