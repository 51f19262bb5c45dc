"""The comparison report: every table of it from one aligned frame that is saved once, as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_two_sided
from . import compare as C
from .order import saved
from .windows import average_rank, first_rows

METRICS = ("n", "mae", "rmse", "mape", "r2", "bias")


def align(df: DataFrame) -> DataFrame:
    """Rows of canonical predictions on the keys (sector, target date, horizon) that all models have, one for each model and key, saved."""
    one = first_rows(df, ["model_name", *C.KEYS], [F.col("origin_date")])
    n = df.agg(F.countDistinct("model_name").alias("n_models"))
    full = one.groupBy(*C.KEYS).agg(F.count("*").alias("own")).join(n, F.col("own") == F.col("n_models"), "left_semi")
    return saved(one.join(full.select(*C.KEYS), C.KEYS, "left_semi"), "aligned")


def operational(models: DataFrame, scores: DataFrame) -> DataFrame:
    """model_name and total: the sum of the scores (pattern, then numbers) of the model's own name, else of the longest pattern with * that it begins with."""
    total = sum((F.col(c) for c in scores.columns[2:]), F.col(scores.columns[1]))
    s = scores.select("pattern", total.cast("double").alias("total"))
    exact = s.where("NOT endswith(pattern, '*')").withColumnRenamed("pattern", "model_name")
    like = models.join(s.where("endswith(pattern, '*')"), F.col("model_name").startswith(F.regexp_replace("pattern", "\\*$", "")))
    like = like.groupBy("model_name").agg(F.max_by("total", F.length("pattern")).alias("general"))
    return models.join(exact, "model_name", "left").join(like, "model_name", "left").select("model_name", F.coalesce("total", "general").alias("total"))


def _long(df: DataFrame, part: str | Column, other: Column | None, metrics: tuple[str, ...]) -> DataFrame:
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    model = F.col("model_name") if "model_name" in df.columns else F.lit(None).cast("string")
    return df.select((F.lit(part) if isinstance(part, str) else part).alias("part"), model.alias("model_name"), (F.lit(None) if other is None else other).cast("string").alias("other"), rows)


def scorecard(df: DataFrame, baseline: str, regime: Column, knots: dict[float, str], scores: DataFrame | None = None, levels=(80, 95)) -> DataFrame:
    """part, model_name, other, metric and value of all tables of the report.

    alignment (rows given and aligned), point (errors), horizon, sector and regime (errors by these), skill (against the
    baseline model), calibration (by level), crps, dm (p of each pair of models), dm_sectors (wins, losses and ties of
    tests by sector), friedman, rank (mean rank over sectors), operational, decision (the best model for each priority).
    """
    a = align(df)
    d = a.withColumn("regime", regime)
    sets = [["model_name"], ["model_name", "horizon"], ["model_name", "sector_code"], ["model_name", "regime"]]
    points = saved(C.grouping_metrics(d, sets), "points")
    name = F.element_at(F.create_map(*[F.lit(x) for s, p in zip(sets, ("point", "horizon", "sector", "regime"), strict=True) for x in ("+".join(s), p)]), F.col("grouping"))
    other = F.coalesce(F.col("horizon").cast("string"), F.col("sector_code"), F.col("regime"))
    parts = [_long(points, name, other, METRICS)]
    given = df.groupBy("model_name").agg(F.count("*").alias("n_given")).join(a.groupBy("model_name").agg(F.count("*").alias("n_aligned")), "model_name", "left")
    parts.append(_long(given.fillna(0, ["n_aligned"]), "alignment", None, ("n_given", "n_aligned")))
    parts.append(_long(C.skill_score(a, baseline), "skill", None, ("skill",)))
    parts.append(_long(C.interval_coverage(a, levels), "calibration", F.col("level"), ("n", "observed", "width", "miscalibration")))
    parts.append(_long(C.crps(a, knots), "crps", None, ("crps",)))
    diff = C.loss_differences(a)
    pooled = C.diebold_mariano(diff, ["model_a", "model_b"], C.KEYS).withColumn("p", normal_two_sided(F.col("stat")))
    parts.append(_long(pooled.withColumnRenamed("model_a", "model_name"), "dm", F.col("model_b"), ("stat", "p")))
    tests = C.diebold_mariano(diff, ["model_a", "model_b", "sector_code"], C.KEYS).withColumn("p", normal_two_sided(F.col("stat")))
    parts.append(_long(C.win_loss_tie(tests).withColumnRenamed("model_a", "model_name"), "dm_sectors", F.col("model_b"), ("win", "loss", "tie")))
    mae = points.where("sector_code IS NOT NULL").select("model_name", "sector_code", F.round("mae", 9).alias("mae"))
    friedman = C.friedman(mae, "sector_code", "model_name", "mae").withColumn("cd", C.nemenyi(F.col("k"), F.col("n")))
    parts.append(_long(friedman, "friedman", None, ("n", "k", "stat", "p", "cd")))
    models = F.countDistinct("model_name")
    full = mae.groupBy("sector_code").agg(models.alias("own")).join(mae.agg(models.alias("k")), F.col("own") == F.col("k"), "left_semi")
    ranks = average_rank(mae.join(full.select("sector_code"), "sector_code", "left_semi"), "mae", "sector_code")
    parts.append(_long(ranks.groupBy("model_name").agg(F.avg("rank").alias("mean_rank")), "rank", None, ("mean_rank",)))
    best = points.where("grouping = 'model_name'").select("model_name", F.round("mae", 9).alias("accuracy"), F.round(F.abs("bias"), 9).alias("unbiased"), F.round("rmse", 9).alias("no large errors"))
    if scores is not None:
        own = operational(a.select("model_name").distinct(), scores)
        parts.append(_long(own, "operational", None, ("total",)))
        best = best.join(own.select("model_name", (-F.col("total")).alias("explainable")), "model_name", "left")
    priorities = best.columns[1:]
    picked = best.agg(*[F.min(F.when(F.col(p).isNotNull(), F.struct(F.col(p).alias("value"), F.col("model_name")))).alias(p) for p in priorities])
    picked = picked.select(F.inline(F.array(*[F.struct(F.lit(p).alias("priority"), F.col(p)["model_name"].alias("model_name"), F.abs(F.col(p)["value"]).alias("value")) for p in priorities])))
    parts.append(picked.select(F.lit("decision").alias("part"), "model_name", F.col("priority").alias("other"), F.lit("best").alias("metric"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
