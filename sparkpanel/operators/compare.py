"""Comparison of forecasts: metrics by group, skill, coverage, tests, ranks, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.tails import chi2_tail, t_two_sided
from .order import neighbours, placed
from .windows import average_rank

KEYS = ["sector_code", "target_date", "horizon"]


def metrics_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in M.point_metrics(F.col("y_true"), F.col("y_pred")).items()])


def grouping_metrics(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Metrics of several groupings in one aggregation; a column that a grouping lacks is null there, and `grouping` names the grouping."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    name = F.element_at(F.create_map(*[x for s in sets for x in (F.lit(sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s)).cast("long"), F.lit("+".join(s) or "all"))]), F.grouping_id())
    metrics = [c.alias(k) for k, c in M.point_metrics(F.col("y_true"), F.col("y_pred")).items()]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(name.alias("grouping"), *metrics).select("grouping", *columns, *M.point_metrics(F.col("y_true"), F.col("y_pred")))


def directional_accuracy(df: DataFrame, keys: list[str], series: list[str], time: str) -> DataFrame:
    """Share of equal signs of successive differences inside each series."""
    w = Window.partitionBy(*keys, *[s for s in series if s not in keys]).orderBy(time)
    sign = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    d = df.select(*keys, (sign("y_true") == sign("y_pred")).alias("same"))
    return d.groupBy(*keys).agg(F.avg(F.col("same").cast("int")).alias("dir_acc"))


def seasonal_naive_mae(train: DataFrame, key: str, time: str, y: str, m: int = 4) -> DataFrame:
    """Mean absolute seasonal difference; null for m or fewer values."""
    w = Window.partitionBy(key).orderBy(time)
    d = train.withColumn("ae", F.abs(F.col(y) - F.lag(y, m).over(w)))
    return d.groupBy(key).agg(F.when(F.count(y) > m, F.avg("ae")).alias("scale"))


def skill_score(df: DataFrame, baseline: str) -> DataFrame:
    """1 - MAE / MAE of the baseline over the keys that both have."""
    base = df.where(F.col("model_name") == baseline).select(*KEYS, F.abs(F.col("y_pred") - F.col("y_true")).alias("base_ae"))
    d = df.where(F.col("model_name") != baseline).join(base, KEYS)
    return d.groupBy("model_name").agg((1 - F.try_divide(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))), F.avg("base_ae"))).alias("skill"))


def interval_coverage(df: DataFrame, levels=(80, 95)) -> DataFrame:
    """Observed coverage, mean width and miscalibration per model and level."""
    parts = F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"y_lower_{v}").alias("low"), F.col(f"y_upper_{v}").alias("high")) for v in levels])
    d = df.select("model_name", "y_true", F.inline(parts)).where("low IS NOT NULL AND high IS NOT NULL AND y_true IS NOT NULL")
    d = d.groupBy("model_name", "level").agg(F.count("*").alias("n"), M.coverage(F.col("y_true"), F.col("low"), F.col("high")).alias("observed"), F.avg(F.col("high") - F.col("low")).alias("width"))
    return d.withColumn("miscalibration", F.col("observed") - F.col("level") / 100)


def crps(df: DataFrame, knots: dict[float, str]) -> DataFrame:
    """Sum over neighbouring quantile knots of (mid level - 1{y <= mid value})^2 * |step|, mean per model."""
    own, total = sorted(knots.items()), F.lit(0.0)
    for (p, a), (q, b) in zip(own, own[1:], strict=False):
        below = (F.col("y_true") <= (F.col(a) + F.col(b)) / 2).cast("int")
        total = total + (F.lit((p + q) / 2) - below) * (F.lit((p + q) / 2) - below) * F.abs(F.col(b) - F.col(a))
    return df.dropna(subset=["y_true", *knots.values()]).groupBy("model_name").agg(F.avg(total).alias("crps"))


def loss_differences(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """model_a, model_b, keys and d = squared error of a less that of b, for all ordered pairs of models on equal keys. The pairs are few; the join is by key."""
    e = df.select(*KEYS, *(extra or []), "model_name", ((F.col("y_true") - F.col("y_pred")) * (F.col("y_true") - F.col("y_pred"))).alias("e2"))
    a, b = e.withColumnsRenamed({"model_name": "model_a", "e2": "ea"}), e.select(*KEYS, F.col("model_name").alias("model_b"), F.col("e2").alias("eb"))
    return a.join(b, KEYS).where("model_a <> model_b").withColumn("d", F.col("ea") - F.col("eb"))


def diebold_mariano(diff: DataFrame, keys: list[str], order: list[str], h: int = 1, least: int = 8, bartlett: bool = False, spread: bool = False) -> DataFrame:
    """n, mean loss difference and statistic with the small-sample correction; null for too few rows or no variance.

    The long-run variance takes h - 1 lags: each the mean over its own products, or with bartlett their sum over n times 1 - k / h.
    spread: keys are few and hold many rows each, so lags are joined by place instead of a window over all rows of a key; order must be total.
    """
    lags = range(1, h)
    g = diff.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.var_pop("d").alias("g0"))
    if lags:
        d = diff.join(g.select(*keys, "mean_d"), keys).withColumn("c", F.col("d") - F.col("mean_d"))
        if spread:
            d = placed(d.select(*keys, *order, "c"), keys, order)
            for k in lags:
                d = neighbours(d, keys, "place", ["c"], k)
            d = d.select(*keys, *[(F.col("c") * F.col(f"c_back{k}")).alias(f"s{k}") for k in lags])
        else:
            w = Window.partitionBy(*keys).orderBy(*order)
            d = d.select(*keys, *[(F.col("c") * F.lag("c", k).over(w)).alias(f"s{k}") for k in lags])
        g = g.join(d.groupBy(*keys).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in lags]), keys)
    var: Column = F.col("g0")
    for k in lags:
        var = var + 2 * F.coalesce((1 - k / h) * F.col(f"s{k}") / F.col("n") if bartlett else F.try_divide(F.col(f"s{k}"), F.col("n") - k), F.lit(0.0))
    n = F.col("n")
    correct = F.sqrt((n + 1 - 2 * h + F.lit(h * (h - 1)) / n) / n)
    stat = F.when((n >= least) & (var > 0), F.try_divide(F.col("mean_d"), F.sqrt(F.when(var > 0, var) / n)) * correct)
    return g.select(*keys, "n", "mean_d", stat.alias("stat"))


def student_lower(stat: Column, freedom: Column) -> Column:
    """Chance of a smaller t value: small where model a has the smaller loss."""
    half = t_two_sided(stat, freedom) / 2
    return F.when(stat <= 0, half).otherwise(1 - half)


def win_loss_tie(tests: DataFrame, p: str = "p", level: float = 0.05) -> DataFrame:
    """win, loss and tie of model_a over tests (model_a, model_b, mean_d, p), one for each sector; tests without a p-value don't count."""
    sure = F.col(p) < level
    d = tests.where(F.col(p).isNotNull())
    return d.groupBy("model_a", "model_b").agg(F.count_if(sure & (F.col("mean_d") < 0)).alias("win"), F.count_if(sure & (F.col("mean_d") >= 0)).alias("loss"), F.count_if(~sure).alias("tie"))


def friedman(scores: DataFrame, group: str, model: str, value: str) -> DataFrame:
    """n groups, k models, the tie-corrected statistic over groups that have all models and its p-value; null below 3 x 3."""
    k = scores.agg(F.countDistinct(model).alias("k"))
    full = scores.groupBy(group).agg(F.countDistinct(model).alias("own")).crossJoin(F.broadcast(k)).where("own = k").select(group, "k")
    ranked = average_rank(scores.join(full, group), value, group).withColumn("ties", F.count("*").over(Window.partitionBy(group, value)))
    sums = ranked.groupBy(model).agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.max("k").alias("k"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    s = sums.agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum(F.col("r") * F.col("r")).alias("r2"), F.sum("t").alias("t"))
    n, kk = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * kk * (kk + 1)) * F.col("r2") - 3 * n * (kk + 1)
    s = s.select("n", "k", F.when((F.col("n") >= 3) & (F.col("k") >= 3), F.try_divide(raw, 1 - F.col("t") / (n * (kk * kk * kk - kk)))).alias("stat"))
    return s.withColumn("p", F.when(F.col("stat").isNotNull(), chi2_tail(F.col("stat"), (F.col("k") - 1).cast("double"))))


#: Studentised range quantiles at 0.05 divided by sqrt(2), for 2 to 10 models. Fixed values.
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def nemenyi(k: Column, n: Column) -> Column:
    """Critical distance of mean ranks of k models on n groups; null beyond the table."""
    q = F.lit(None).cast("double")
    for m, v in NEMENYI_Q.items():
        q = F.when(k == m, v).otherwise(q)
    return q * F.sqrt(k * (k + 1) / (6.0 * n))


def decision_matrix(df: DataFrame, priorities: dict[str, tuple[str, bool]]) -> DataFrame:
    """Best model per priority; priorities: name -> (column, smaller is better)."""
    picks = [F.struct(F.lit(p).alias("priority"), (F.min_by if low else F.max_by)("model_name", F.struct(F.col(c), F.col("model_name"))).alias("model_name")) for p, (c, low) in priorities.items()]
    return df.agg(F.array(*picks).alias("p")).select(F.inline("p"))
