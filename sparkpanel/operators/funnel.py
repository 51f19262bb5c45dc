"""The chain of feature selection on a panel (key, time, y and feature columns).

Sums of squares and products over rows are Spark aggregates; what is solved in Python is as large as the number of
features. Rows with a null in what a step needs are left out of that step; an empty panel selects nothing. What is read
more than once is saved first, so that the joins behind a panel, and what they broadcast, run once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection as K
from .forecast import ridge_fit
from .lagged import granger
from .order import saved
from .windows import differences

#: Cumulative Poisson(1) probabilities. Fixed values.
POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)


def derive_features(columns: list[str], structural: list[str], target: str, flags: tuple[str, ...] = (), yearly: str = "y_") -> list[tuple[str, bool]]:
    """(feature, whether yearly) of the columns that are neither structural nor the target nor begin with a flag prefix."""
    own = [c for c in columns if c not in structural and c != target and not c.startswith(flags or ("\0",))]
    return [(c, c.startswith(yearly)) for c in own]


def gram(df: DataFrame, by: list[str], columns: list[str], weight: Column) -> DataFrame:
    """by, and the weighted sums s_i_j of products of the columns, of which the first is 1."""
    c = [F.lit(1.0), *[F.col(x).cast("double") for x in columns]]
    return df.groupBy(*by).agg(*[F.sum(weight * c[i] * c[j]).alias(f"s_{i}_{j}") for i in range(len(c)) for j in range(i, len(c))])


def matrix(row, size: int) -> np.ndarray:
    m = np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
    return m


def standard(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlations of the features, covariances of scaled features with the target (last), and the scales, from sums of products."""
    n = max(m[0, 0], 1e-12)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(cov)[:-1], 0, None))
    inverse = np.where(scale > 1e-12, 1 / np.maximum(scale, 1e-12), 0.0)
    return cov[:-1, :-1] * np.outer(inverse, inverse), cov[:-1, -1] * inverse, scale


def lasso(q: np.ndarray, c: np.ndarray, alpha: float, rounds: int = 500) -> np.ndarray:
    """Coordinate descent on half the quadratic form less the linear one, plus alpha times the absolute sum."""
    b = np.zeros(len(c))
    for _ in range(rounds):
        old = b.copy()
        for j in range(len(c)):
            if q[j, j] > 1e-12:
                r = c[j] - q[j] @ b + q[j, j] * b[j]
                b[j] = np.sign(r) * max(abs(r) - alpha, 0) / q[j, j]
        if np.abs(b - old).max(initial=0) < 1e-9:
            break
    return b


def choose_alpha(folds: list[np.ndarray], steps: int = 30) -> float:
    """The penalty of least squared error over the folds, from their sums of products."""
    whole = sum(folds)
    top = np.abs(standard(whole)[1]).max(initial=0.0) or 1.0
    best = (math.inf, top)
    for alpha in top * np.logspace(0, -3, steps):
        error = 0.0
        for f in folds:
            m = whole - f
            q, c, scale = standard(m)
            b = np.where(scale > 1e-12, lasso(q, c, alpha) / np.maximum(scale, 1e-12), 0.0)
            mean = m[0, 1:] / m[0, 0]
            v = np.concatenate([[-(mean[-1] - mean[:-1] @ b)], -b, [1.0]])  # error of a row: v . (1, x, y)
            error += float(v @ f @ v)
        best = min(best, (error, float(alpha)))
    return best[1]


def lasso_stability(df: DataFrame, features: list[str], y: str, key: str, time: str, boots: int = 50, horizons=(1, 2, 3, 4), least: float = 0.6, folds: int = 5) -> DataFrame:
    """feature, share of bootstraps that select it (the largest over horizons), retained. One penalty, chosen by folds, serves all."""
    w = Window.partitionBy(key).orderBy(time)
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.lead(y, h).over(w).alias("ahead")) for h in horizons])
    d = saved(df.withColumn("a", ahead).select(key, time, *features, F.inline("a")).dropna(subset=[*features, "ahead"]), "lasso")
    columns, size = [*features, "ahead"], len(features) + 2
    rows = gram(d.withColumn("fold", F.pmod(F.xxhash64(key, time), F.lit(folds))), ["fold"], columns, F.lit(1.0)).collect()
    if not rows:
        return df.sparkSession.createDataFrame([], "feature string, share double, retained boolean")
    alpha = choose_alpha([matrix(r, size) for r in rows])
    u = (F.shiftrightunsigned(F.xxhash64(key, time, "h", "boot"), 11) / float(1 << 53)).alias("u")
    d = d.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(boots)))).withColumn("u", u)
    sums = gram(d, ["h", "boot"], columns, sum(((F.col("u") >= p).cast("double") for p in POISSON), F.lit(0.0)))

    def solve(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                q, c, _ = standard(matrix(row, size))
                out += [(row["h"], f, float(abs(b) > 1e-10)) for f, b in zip(features, lasso(q, c, alpha), strict=True)]
            yield pd.DataFrame(out, columns=["h", "feature", "hit"])

    share = sums.mapInPandas(solve, "h int, feature string, hit double").groupBy("h", "feature").agg(F.avg("hit").alias("share"))
    return share.groupBy("feature").agg(F.max("share").alias("share"), (F.max("share") >= least).alias("retained"))


def tree_importance(df: DataFrame, features: list[str], y: str, key: str, time: str, repeats: int = 10, trees: int = 50, seed: int = 7) -> DataFrame:
    """feature and the mean loss of R2 of a random forest on differences when the feature's values change places within their series."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    d = differences(df.select(key, time, y, *features), [y, *features], key, time).dropna()
    d = d.select(key, time, *[F.col(c).cast("double").alias(c) for c in [y, *features]])
    assembler = VectorAssembler(inputCols=features, outputCol="vector")
    model = RandomForestRegressor(featuresCol="vector", labelCol=y, numTrees=trees, maxDepth=6, seed=seed).fit(assembler.transform(d))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(time)))
    tries = F.array(F.struct(F.lit("").alias("moved"), F.lit(0).alias("turn")), *[F.struct(F.lit(f).alias("moved"), F.lit(k).alias("turn")) for f in features for k in range(repeats)])
    e = d.select("*", F.inline(tries)).withColumn("other", F.row_number().over(Window.partitionBy(key, "moved", "turn").orderBy(F.xxhash64("moved", "turn", "place"))))
    o = d.select(F.col(key).alias("o_key"), F.col("place").alias("other"), *[F.col(f).alias(f"o_{f}") for f in features])
    e = e.join(o.withColumnRenamed("o_key", key), [key, "other"])
    e = e.select("moved", "turn", y, *[F.when(F.col("moved") == f, F.col(f"o_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    r = model.transform(assembler.transform(e)).groupBy("moved", "turn").agg((1 - F.try_divide(F.sum((F.col(y) - F.col("prediction")) ** 2), F.count("*") * F.var_pop(y))).alias("r2"))
    base = r.where("moved = ''").select(F.col("r2").alias("base"))
    return r.where("moved <> ''").crossJoin(F.broadcast(base)).groupBy(F.col("moved").alias("feature")).agg(F.avg(F.col("base") - F.col("r2")).alias("importance"))


def funnel(df: DataFrame, features: list[str], y: str, key: str, time: str, corr: float = 0.21, lagged: float = 0.12, redundant: float = 0.9, boots: int = 50) -> list[tuple[str, list[str]]]:
    """(stage, surviving features) of each stage on the survivors of the one before; ends where none are left. Each stage is a Spark job on the saved panel, its result a row for each feature."""
    return _stages(saved(df.select(*dict.fromkeys([key, time, y, *features])), "funnel"), features, y, key, time, corr, lagged, redundant, boots)


def _stages(df: DataFrame, features: list[str], y: str, key: str, time: str, corr: float = 0.21, lagged: float = 0.12, redundant: float = 0.9, boots: int = 50) -> list[tuple[str, list[str]]]:
    """`funnel` on a panel that is cheap to read again."""
    kept, out = list(features), []

    def step(name: str, good: set[str]) -> bool:
        kept[:] = [f for f in kept if f in good]
        out.append((name, list(kept)))
        return bool(kept)

    names = lambda d, rule: {r["feature"] for r in d.where(rule).collect()}
    stages = [
        ("near_constant", lambda: names(K.near_constant(df, [key, time], kept), "retained")),
        ("corr_within_diff", lambda: names(K.target_correlation(differences(df, [y, *kept], key, time), [key], kept, y), F.abs("r") >= corr)),
        ("lagged_corr", lambda: names(K.lagged_correlation(df, kept, y, key, time).groupBy("feature").agg(F.max("r").alias("r")), F.col("r") >= lagged)),
        ("granger", lambda: names(granger(df, kept, y, key, time), "retained")),
        ("lasso_stability", lambda: names(lasso_stability(df, kept, y, key, time, boots), "retained")),
        ("redundancy", lambda: {f for f, _, keep in K.redundancy(df, kept, y, redundant) if keep}),
    ]
    for name, run in stages:
        if not kept or not step(name, run()):
            break
    return out


def select_features(df: DataFrame, structural: list[str], y: str, key: str, time: str, flags: tuple[str, ...] = (), holdout: int = 20, category=lambda f: f.split("_")[0], **limits) -> DataFrame:
    """feature, category, last_stage and selected of every candidate, chosen without the last `holdout` periods; raises ValueError if there are no rows or candidates."""
    spark = df.sparkSession
    candidates = [f for f, yearly in derive_features(df.columns, structural, y, flags) if not yearly]
    if not candidates:
        raise ValueError("nothing to select from")
    df = saved(df.select(*dict.fromkeys([key, time, y, *candidates])), "funnel")
    if holdout:
        last = df.select(time).distinct().orderBy(F.desc(time)).limit(holdout).agg(F.min(time).alias("m"))
        df = df.join(F.broadcast(last), F.col(time) < F.col("m")).drop("m")
    if df.isEmpty():
        raise ValueError("nothing to select from")
    stages = _stages(df, candidates, y, key, time, **limits)
    selected = set(stages[-1][1]) if len(stages) == 6 else set()
    passed = lambda f: max((name for k, (name, own) in enumerate(stages) if f in own), key=[n for n, _ in stages].index, default="none")
    return spark.createDataFrame([(f, category(f), passed(f), f in selected) for f in candidates], "feature string, category string, last_stage string, selected boolean")


def top_importance(df: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """The n rows of each key with the largest absolute weight; ties by feature."""
    w = Window.partitionBy(key).orderBy(F.abs(weight).desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def lagged_ols(df: DataFrame, x: str, y: str, key: str, time: str, lag: int = 3, h: int = 4) -> DataFrame:
    """key, time, y and y_pred of the last h rows of each series: least squares of y on x lag rows before, fitted on the rows before them."""
    w = Window.partitionBy(key)
    d = df.select(key, time, y, F.lag(x, lag).over(w.orderBy(time)).alias("x"), F.row_number().over(w.orderBy(F.desc(time))).alias("back"))
    past = (F.col("back") > h) & F.col("x").isNotNull() & F.col(y).isNotNull()
    fit = d.where(past).groupBy(key).agg(F.regr_slope(y, "x").alias("slope"), F.regr_intercept(y, "x").alias("base"))
    return d.where(F.col("back") <= h).join(fit, key).select(key, time, y, (F.col("base") + F.col("slope") * F.col("x")).alias("y_pred"))


def lag_vectors(df: DataFrame, key: str, time: str, y: str, window: int) -> DataFrame:
    """key, time, label and vector (the values before, latest first) of each row with `window` non-null values before it."""
    from pyspark.ml.functions import array_to_vector

    w = Window.partitionBy(key).orderBy(time)
    d = df.where(F.col(y).isNotNull()).select(key, time, F.col(y).cast("double").alias("label"), *[F.lag(y, k).over(w).cast("double").alias(f"lag_{k}") for k in range(1, window + 1)]).dropna()
    return d.select(key, time, "label", array_to_vector(F.array(*[f"lag_{k}" for k in range(1, window + 1)])).alias("vector"))


def random_forest(df: DataFrame, key: str, time: str, y: str, window: int = 12, h: int = 4, trees: int = 50, least: int = 3, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """key, time, y and y_pred of the last h rows of each series, and the weights of the lags.

    One forest over the lags of all series, fitted without those rows and applied step by step; series with fewer than
    `window` earlier values have no forecast, and a table without any such series has no rows and no weights.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    d = df.where(F.col(y).isNotNull()).select(key, time, F.col(y).cast("double").alias(y)).withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time))))
    past = d.where(F.col("back") > h)
    train = lag_vectors(past, key, time, y, window)
    if train.isEmpty():
        return d.select(key, time, y, F.lit(None).cast("double").alias("y_pred")).limit(0), []
    model = RandomForestRegressor(featuresCol="vector", labelCol="label", numTrees=trees, minInstancesPerNode=least, seed=seed).fit(train)
    state = past.where(F.col("back") <= h + window).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("back", y))).getField(y).alias("lags")).where(F.size("lags") == window)
    steps = [f"p{k}" for k in range(1, h + 1)]
    for p in steps:
        state = model.transform(state.withColumn("vector", array_to_vector("lags"))).withColumnRenamed("prediction", p)
        state = state.withColumn("lags", F.slice(F.concat(F.array(p), "lags"), 1, window)).drop("vector")
    ahead = state.select(key, F.inline(F.array(*[F.struct(F.lit(h - k).cast("int").alias("back"), F.col(p).alias("y_pred")) for k, p in enumerate(steps)])))
    return d.join(ahead, [key, "back"]).select(key, time, y, "y_pred"), [float(v) for v in model.featureImportances.toArray()]


def champion_importance(df: DataFrame, champions: DataFrame, key: str, time: str, y: str, forest: list[float], window: int = 8, alpha: float = 1.0, n: int = 15) -> DataFrame:
    """key, model, feature, weight, rank: the n largest weights of each champion (key, model) that has any.

    A ridge is refitted on its whole series, one series in a task; a forest has the weights of the one that all series
    share; other models, and series too short to refit, have no rows.
    """
    types = dict(df.dtypes)

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = ridge_fit(pdf.dropna(subset=[y]).sort_values(time)[y].to_numpy(float), window, alpha)
        out = [] if fit is None else [(pdf[key].iloc[0], "ridge", f"lag_{window - k}", float(b)) for k, b in enumerate(fit[0])]
        return pd.DataFrame(out, columns=[key, "model", "feature", "weight"])

    linear = df.select(key, time, y).join(champions.where("model = 'ridge'").select(key), key, "left_semi").groupBy(key).applyInPandas(refit, f"{key} {types[key]}, model string, feature string, weight double")
    shared = F.array(*[F.struct(F.lit(f"lag_{k}").alias("feature"), F.lit(v).alias("weight")) for k, v in enumerate(forest, 1)]) if forest else F.expr("CAST(array() AS array<struct<feature:string,weight:double>>)")
    trees = champions.where("model = 'random_forest'").select(key, "model", F.inline(shared))
    return top_importance(linear.unionByName(trees), key, "weight", n)
