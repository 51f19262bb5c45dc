"""Joins of facts, features and forecasts. Sides are broadcast by Spark's own size check, not by a hint, where they can grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import numeric_columns


def star_join(fact: DataFrame, dims: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """fact LEFT JOIN each dimension; dims: name -> (table, fact column, key). Dimension columns get the name as prefix."""
    for name, (dim, column, key) in dims.items():
        renamed = dim.select(*[F.col(c).alias(f"{name}_{c}") for c in dim.columns])
        fact = fact.join(renamed, fact[column] == renamed[f"{name}_{key}"], "left").drop(f"{name}_{key}")
    return fact


def dimension_key(columns: list[str], candidates=("Key", "DimensionKey", "ID", "Code")) -> str | None:
    return next((c for c in candidates if c in columns), None)


def tiered_join(target: DataFrame, features: DataFrame, time: str, key: str) -> tuple[DataFrame, list[str]]:
    """LEFT JOIN by time and key if the features have the key, else by time after averaging; columns the target has are left out."""
    on = [time, key] if key in features.columns else [time]
    new = [c for c in features.columns if c not in target.columns]
    side = features.select(*on, *new) if len(on) == 2 else per_period_mean(features.select(time, *new), time)
    return target.join(side, on, "left"), [c for c in side.columns if c not in on]


def per_period_mean(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(time).agg(*[F.avg(c).alias(c) for c in numeric_columns(df, (time,))])


def column_origin(parts: dict[str, list[str]], spark) -> DataFrame:
    return spark.createDataFrame([(c, t) for t, columns in parts.items() for c in columns], "column string, table_id string")


def lagged_year_join(df: DataFrame, yearly: DataFrame, lag: int, year: str = "year", key: str | None = None) -> DataFrame:
    """Yearly values on the quarters `lag` years later; columns that exist already get the ending _yearly."""
    on = [year, key] if key else [year]
    side = yearly.withColumn(year, F.col(year) + lag).dropDuplicates(on)
    return df.join(side.withColumnsRenamed({c: f"{c}_yearly" for c in side.columns if c in df.columns and c not in on}), on, "left")


def align(df: DataFrame, keys: list[str], model: str = "model_name") -> DataFrame:
    """Rows whose keys all models have."""
    n = df.agg(F.countDistinct(model).alias("n_models"))
    common = df.groupBy(*keys).agg(F.countDistinct(model).alias("own")).crossJoin(F.broadcast(n)).where("own = n_models").select(*keys)
    return df.join(common, keys, "left_semi")


def lookup_fallback(df: DataFrame, table: DataFrame, on: list[str], value: str, fallback: DataFrame) -> DataFrame:
    """value from the table by key, else the one value of the fallback row."""
    return df.join(table, on, "left").crossJoin(F.broadcast(fallback.select(F.col(fallback.columns[0]).alias("fallback")))).withColumn(value, F.coalesce(value, "fallback")).drop("fallback")


def work_list(series: DataFrame, origins: DataFrame, configs: DataFrame) -> DataFrame:
    """series x origin x config; origins and configs are parameters of fixed number."""
    return series.crossJoin(origins.crossJoin(configs))


def training_rows(df: DataFrame, folds: DataFrame, key: str, position: str, window: int | None = None) -> DataFrame:
    """Rows each fold (key, origin) may see: positions up to the origin, or the last `window` of them. Joined by key, compared by position."""
    low: Column = F.lit(True) if window is None else F.col(position) > F.col("origin") - window
    return df.join(folds, key).where((F.col(position) <= F.col("origin")) & low)


def last_of_each(df: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.max_by(v, time).alias(v) for v in values])


def baseline_join(model: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    return model.join(baseline, keys, "inner")
