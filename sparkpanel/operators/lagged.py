"""Regressions on lags by sums of products: causality, unit roots and orders of differencing without a Python worker.

Lags come from windows over each series, the products of all pairs of regressors and of the target are summed by partial
aggregates, and the small symmetric matrix of sums is reduced by Gaussian elimination as a fold over an array. After the
elimination of some regressors, the last diagonal element is the sum of squared residuals on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_tail
from .selection import long

#: Finite-sample 5 % critical value of the unit-root t statistic with a constant, by powers of 1 / n. Fixed values.
ADF_5 = (-2.86154, -2.8903, -4.234, -40.04)
#: A pivot below this share of its own first value counts as collinear and is passed over.
COLLINEAR = 1e-10
#: Regressors up to which each product has an aggregate of its own; more are summed as rows.
COLUMNS = 20


def grams(df: DataFrame, keys: list[str], columns: list[Column], out: str = "gram") -> DataFrame:
    """keys, n (rows) and gram: the sums of products of all pairs of columns, row by row in one array."""
    size = len(columns)
    at = lambda i, j: min(i, j) * size + max(i, j)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    d = df.select(*keys, *[c.cast("double").alias(f"own_{i}") for i, c in enumerate(columns)])
    product = lambda i, j: F.col(f"own_{i}") * F.col(f"own_{j}")
    if size <= COLUMNS:
        d = d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(product(i, j)).alias(f"s_{at(i, j)}") for i, j in pairs])
        return d.select(*keys, "n", F.array(*[F.col(f"s_{at(i, j)}") for i in range(size) for j in range(size)]).alias(out))
    rows = d.select(*keys, F.inline(F.array(*[F.struct(F.lit(at(i, j)).alias("at"), product(i, j).alias("x")) for i, j in pairs])))
    sums = rows.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    d = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    return d.select(*keys, "n", F.array(*[F.col("m")[at(i, j)] for i in range(size) for j in range(size)]).alias(out))


def _pivot(m: Column, first: Column, size: int, k: Column) -> Column:
    """m with regressor k eliminated; first: the matrix before any elimination."""
    whole = F.sequence(F.lit(0), F.lit(size * size - 1))
    top = F.get(m, k * size + k)
    off = lambda t: F.get(m, F.floor(t / size).cast("int") * size + k) * F.get(m, k * size + t % size) / top
    return F.transform(whole, lambda t: F.when(top > COLLINEAR * F.get(first, k * size + k), F.get(m, t) - off(t)).otherwise(F.get(m, t)))


def eliminate(m: Column, first: Column, size: int, start: int, stop: int) -> Column:
    """m with the regressors from start to before stop eliminated one after another."""
    if stop <= start:
        return m
    return F.aggregate(F.sequence(F.lit(start), F.lit(stop - 1)), m, lambda a, k: _pivot(a, first, size, k))


def residuals(m: Column, size: int, start: int, stop: int) -> Column:
    """Sums of squared residuals after the elimination of each regressor from start to before stop."""
    begin = F.struct(m.alias("m"), F.array().cast("array<double>").alias("s"))

    def step(a, k):
        new = _pivot(a["m"], m, size, k)
        return F.struct(new.alias("m"), F.concat(a["s"], F.array(F.get(new, F.lit(size * size - 1)))).alias("s"))

    return F.aggregate(F.sequence(F.lit(start), F.lit(stop - 1)), begin, step, lambda a: a["s"])


def complete_series(df: DataFrame, keys: list[str], time: str, complete: Column) -> DataFrame:
    """The complete rows of the series that have none but complete rows between their first and last one."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("own_line", F.row_number().over(w.orderBy(time))).where(complete)
    return d.withColumn("own_span", F.max("own_line").over(w) - F.min("own_line").over(w) + 1 - F.count("*").over(w)).where("own_span = 0").drop("own_line", "own_span")


def granger_tests(df: DataFrame, features: list[str], y: str, key: str, time: str, most: int = 4) -> DataFrame:
    """key, feature, lag and p: the F test of `lag` lags of the feature added to as many of y, both differenced.

    Left out: series with holes, with fewer than 3 * most differences, and constant features.
    """
    keys = ["feature", key]
    d = complete_series(long(df, [key, time, y], features), keys, time, F.col("value").isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*keys)
    o = w.orderBy(time)
    d = d.select(*keys, time, (F.col(y) - F.lag(y).over(o)).alias("dy"), (F.col("value") - F.lag("value").over(o)).alias("dx")).where("dy IS NOT NULL")
    lags = {f"{c}{k}": F.lag(c, k).over(o) for c in ("dy", "dx") for k in range(1, most + 1)}
    d = d.select("*", *[v.alias(c) for c, v in lags.items()], F.count("*").over(w).alias("n_all"), F.row_number().over(o).alias("line"), (F.max("dx").over(w) - F.min("dx").over(w)).alias("width"))
    d = d.where((F.col("n_all") >= 3 * most) & (F.col("width") > 0)).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(most)))).where("line > lag")
    own = [F.when(F.col("lag") >= k, F.col(f"{c}{k}")).otherwise(0.0) for c in ("dy", "dx") for k in range(1, most + 1)]
    size, half = 2 * most + 2, most + 1
    g = grams(d, [*keys, "lag"], [F.lit(1.0), *own, F.col("dy")])
    last = F.lit(size * size - 1)
    g = g.withColumn("less", eliminate(F.col("gram"), F.col("gram"), size, 0, half)).withColumn("full", eliminate(F.col("less"), F.col("gram"), size, half, size - 1))
    g = g.select(*keys, "lag", (F.col("n") - 2 * F.col("lag") - 1).cast("double").alias("bottom"), F.get("gram", last).alias("all"), F.get("less", last).alias("less"), F.get("full", last).alias("full"))
    stat = F.greatest(F.lit(0.0), F.col("less") - F.col("full")) / F.col("lag") / (F.col("full") / F.col("bottom"))
    exact = F.col("full") <= 1e-14 * F.col("all")
    return g.where("bottom > 0").select(*keys, "lag", F.when(exact, 0.0).otherwise(f_tail(stat, F.col("lag").cast("double"), F.col("bottom"))).alias("p"))


def granger(df: DataFrame, features: list[str], y: str, key: str, time: str, most: int = 4, p: float = 0.05, least: float = 0.2) -> DataFrame:
    """feature, share of series whose smallest p over 1 to most lags is below the level, n series tested, retained."""
    tested = granger_tests(df, features, y, key, time, most).groupBy("feature", key).agg(F.min("p").alias("p"))
    share = F.avg((F.col("p") < p).cast("double"))
    return tested.groupBy("feature").agg(share.alias("share"), F.count("*").alias("n"), (share >= least).alias("retained"))


def adf_test(df: DataFrame, key: str, time: str, y: str, least: int = 10) -> DataFrame:
    """key, statistic, lags, critical, stationary: the unit-root regression with a constant, its lags by Akaike's criterion on one sample.

    Left out: series with holes and of fewer than `least` values.
    """
    w = Window.partitionBy(key)
    o = w.orderBy(time)
    d = complete_series(df.select(key, time, F.col(y).cast("double").alias("y")), [key], time, F.col("y").isNotNull())
    d = d.withColumn("n_all", F.count("*").over(w)).where(F.col("n_all") >= least)
    limit = F.least(F.ceil(12 * F.pow(F.col("n_all") / 100, 0.25)), F.greatest(F.lit(0), F.floor(F.col("n_all") / 2) - 2)).cast("int")
    d = d.withColumns({"most": limit, "level": F.lag("y").over(o)}).withColumn("dy", F.col("y") - F.col("level"))
    top = d.agg(F.coalesce(F.max("most"), F.lit(0)).alias("m")).first()["m"]  # the longest series says how many lags there are
    d = d.select(key, "n_all", "most", "level", "dy", (F.row_number().over(o) - 2).alias("line"), *[F.lag("dy", k).over(o).alias(f"l{k}") for k in range(1, top + 1)]).where("dy IS NOT NULL")
    lag = lambda k, most: F.when(most >= k, F.col(f"l{k}")).otherwise(0.0)
    size = top + 3
    g = grams(d.where("line >= most"), [key, "n_all", "most"], [F.lit(1.0), F.col("level"), *[lag(k, F.col("most")) for k in range(1, top + 1)], F.col("dy")])
    g = g.withColumn("s", residuals(F.col("gram"), size, 0, size - 1))
    criterion = F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: F.col("n") * F.log(F.greatest(F.get("s", k + 1), F.lit(1e-300)) / F.col("n")) + 2 * (k + 2))
    chosen = g.withColumn("c", criterion).select(F.col(key).alias("own_key"), (F.array_position("c", F.array_min("c")) - 1).cast("int").alias("lags"))
    d = d.join(chosen, d[key].eqNullSafe(chosen["own_key"])).where("line >= lags")
    g = grams(d, [key, "lags"], [F.lit(1.0), *[lag(k, F.col("lags")) for k in range(1, top + 1)], F.col("level"), F.col("dy")])
    g = g.withColumn("m", eliminate(F.col("gram"), F.col("gram"), size, 0, size - 2))
    at = lambda i, j: F.get("m", F.lit(i * size + j))
    spread, shared, whole = at(size - 2, size - 2), at(size - 2, size - 1), at(size - 1, size - 1)
    error = F.greatest(F.lit(0.0), whole - shared * shared / spread) / F.greatest(F.lit(1), F.col("n") - F.col("lags") - 2)
    stat = F.when(spread > 0, F.when(error > 0, shared / spread / F.sqrt(error / spread)).otherwise(F.lit(float("-inf"))))
    critical = sum((F.lit(c) / F.pow(F.col("n").cast("double"), F.lit(k)) for k, c in enumerate(ADF_5)), F.lit(0.0))
    out = g.select(key, stat.alias("statistic"), "lags", critical.alias("critical"))
    return out.where("statistic IS NOT NULL").withColumn("stationary", F.col("statistic") < F.col("critical"))


def differencing_order(df: DataFrame, key: str, time: str, y: str, season: int | DataFrame = 4, least: int = 10) -> DataFrame:
    """key, d, seasonal_d of each series without holes of at least `least` values.

    d: 0 if stationary, else 1, or 2 where that lowers the variance and the lag-1 autocorrelation stays at -0.5 or above.
    seasonal_d: 1 if the differenced series goes with itself a season before and a seasonal difference lowers its variance
    without overdoing. season: a number, or a table (key, period); series without a period, or with one of 1, have none.
    """
    test = adf_test(df, key, time, y, least).select(F.col(key).alias("own_key"), "stationary")
    d = complete_series(df.select(F.col(key).alias("own_key"), time, F.col(y).cast("double").alias("y")), ["own_key"], time, F.col("y").isNotNull())
    o = Window.partitionBy("own_key").orderBy(time)
    once = F.col("y") - F.lag("y").over(o)
    d = d.withColumn("once", once).withColumn("twice", F.col("once") - F.lag("once").over(o))
    both = F.array(F.struct(F.lit(1).alias("d"), F.col("once").alias("v")), F.struct(F.lit(2).alias("d"), F.col("twice").alias("v")))
    d = d.select("own_key", time, F.inline(both)).where("v IS NOT NULL")
    w = Window.partitionBy("own_key", "d")
    d = d.withColumns({"line": F.row_number().over(w.orderBy(time)), "c": F.col("v") - F.avg("v").over(w)})
    period = d.select("own_key").distinct().withColumn("period", F.lit(season)) if isinstance(season, int) else season.select(F.col(key).alias("own_key"), "period")
    d = d.join(period, "own_key", "left").withColumn("period", F.coalesce("period", F.lit(1)))
    past = d.select("own_key", "d", (F.col("line") + F.col("period")).alias("line"), F.col("c").alias("c_back"), F.col("v").alias("v_back"))
    d = d.join(past, ["own_key", "d", "line"], "left").withColumn("after", F.when(F.col("period") > 1, F.col("v") - F.col("v_back")))
    o = w.orderBy("line")
    d = d.withColumns({"c_one": F.lag("c").over(o), "e": F.col("after") - F.avg("after").over(w)}).withColumn("e_one", F.lag("e").over(o))
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) * F.col(a))), F.lit(0.0))
    s = d.groupBy("own_key", "d").agg(F.count("*").alias("n"), F.max("period").alias("period"), F.var_samp("v").alias("var"), share("c", "c_one").alias("r1"), share("c", "c_back").alias("rs"), F.var_samp("after").alias("var_s"), share("e", "e_one").alias("r1_s"))
    tried = (F.col("period") > 1) & (F.col("n") > F.col("period") + 2) & (F.abs("rs") > 1.96 / F.sqrt("n"))
    s = s.withColumn("seasonal", F.coalesce((tried & (F.col("var_s") < F.col("var")) & (F.col("r1_s") >= -0.5)).cast("int"), F.lit(0)))
    pick = lambda k, c: F.max(F.when(F.col("d") == k, F.col(c)))
    two = F.coalesce((pick(2, "var") < pick(1, "var")) & (pick(2, "r1") >= -0.5), F.lit(False))
    s = s.groupBy("own_key").agg(F.when(two, 2).otherwise(1).alias("d"), F.when(two, pick(2, "seasonal")).otherwise(pick(1, "seasonal")).alias("seasonal_d"))
    out = test.join(s, "own_key")
    zero = lambda c: F.when(F.col("stationary"), 0).otherwise(F.col(c)).alias(c)
    return out.select(F.col("own_key").alias(key), zero("d"), zero("seasonal_d"))
