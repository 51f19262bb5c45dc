"""Choice of variants and champions from scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tier
from .windows import first_rows


def inner_mae(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where("fold_set = 'inner'").groupBy(*keys).agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("inner_mae"))


def select_honest(df: DataFrame, key: str | list[str] = "sector_code", model: str = "model_name") -> DataFrame:
    """Outer rows of each key's model with the lowest inner error; with several key columns, all families in one pass."""
    keys = [key] if isinstance(key, str) else key
    best = first_rows(inner_mae(df, [*keys, model]), keys, [F.round("inner_mae", 9), F.col(model)])
    return df.where("fold_set = 'outer'").join(best.select(*keys, model), [*keys, model], "left_semi")


def select_global(df: DataFrame, model: str = "model_name") -> DataFrame:
    """Outer rows of the one model with the lowest inner error over all keys."""
    best = inner_mae(df, [model]).agg(F.min_by(model, F.struct(F.round("inner_mae", 9), model)).alias(model))
    return df.where("fold_set = 'outer'").join(F.broadcast(best), model, "left_semi")


def select_by_outer(df: DataFrame, key: str = "sector_code", model: str = "model_name") -> DataFrame:
    """key, model with the lowest outer error; a diagnostic, as it looks at what it reports."""
    own = df.where("fold_set = 'outer'").groupBy(key, model).agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("outer_mae"))
    return first_rows(own, key, [F.round("outer_mae", 9), F.col(model)])


def champion_gate(candidates: DataFrame, incumbents: DataFrame, key: str, r2_floor: float | None = None, mase_ceiling: float | None = None) -> DataFrame:
    """Best candidate of each key by finite MASE within the floors, and whether it takes the place: seed without an incumbent, strictly lower than it otherwise."""
    m: Column = F.col("mase")
    ok = m.isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf"))
    if r2_floor is not None:
        ok = ok & (F.col("r2") >= r2_floor)
    if mase_ceiling is not None:
        ok = ok & (m <= mase_ceiling)
    best = first_rows(candidates.where(ok), key, [m, F.col("model_name")])
    d = best.join(incumbents.select(key, F.col("mase").alias("incumbent")), key, "left")
    verdict = F.when(F.col("incumbent").isNull(), "seed").when(m < F.col("incumbent"), "promote").otherwise("keep")
    return d.withColumn("verdict", verdict)


def quality_table(champions: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Champions (key, model_name, mase) with the baseline's MASE and their tier."""
    return champions.join(baselines.select(key, F.col("mase").alias("baseline_mase")), key, "left").withColumn("tier", tier(F.col("mase")))


def win_counts(champions: DataFrame) -> DataFrame:
    return champions.groupBy("model_name").agg(F.count("*").alias("n_won"), F.count_if(F.col("mase") < 1).alias("n_beat_naive"))
