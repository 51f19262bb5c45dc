"""Profiles, quality gates and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import quantiles, wide_quantiles
from .reshape import numeric_columns
from .windows import forward_fill


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_null, pct of every column, from one pass."""
    columns = columns or df.columns
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null"), F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")).alias("pct")) for i, c in enumerate(columns)])
    return row.select(F.inline(parts))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    d = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return d.limit(top) if top else d


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, standard deviation, extremes and exact quartiles of each column; quartiles by ranges of values, not in one task."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    d = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    quarter = lambda p: F.max(F.when(F.col("share") == p, F.col("value")))
    q = quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(quarter(0.25).alias("q25"), quarter(0.5).alias("q50"), quarter(0.75).alias("q75"))
    return d.join(q, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def binary_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose values are 0, 1 or null."""
    columns = numeric_columns(df)
    row = df.agg(*[F.bool_and(F.coalesce(F.col(c).isin(0, 1), F.lit(True))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})


def impute_features(df: DataFrame, columns: list[str], binary: list[str], how: str = "median") -> DataFrame:
    """Null binaries become 0; other nulls the column's median or mean (one row, sent to all)."""
    rest = [c for c in columns if c not in binary]
    fill = None
    if rest:
        fill = wide_quantiles(df, {f"fill_{c}": (c, 0.5) for c in rest}) if how == "median" else df.agg(*[F.avg(c).alias(f"fill_{c}") for c in rest])
    d = df.crossJoin(F.broadcast(fill)) if rest else df
    return d.withColumns({c: F.coalesce(c, F.lit(0)) for c in binary} | {c: F.coalesce(F.col(c).cast("double"), f"fill_{c}") for c in rest}).drop(*[f"fill_{c}" for c in rest])


def impute_target(df: DataFrame, y="y", key="sector", time="period_enddate", scope: str = "key") -> DataFrame:
    """Forward fill inside each series or, with scope="global", over all rows by date and key; then the global median."""
    median = wide_quantiles(df, {"fill": (y, 0.5)})
    if scope == "key":
        d = forward_fill(df, [y], key, time)
    else:  # from the rows of the date, else from the last date before that has a value
        past = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
        dates = df.groupBy(time).agg(F.max_by(y, F.when(F.col(y).isNotNull(), F.col(key))).alias("last_y"))
        dates = dates.select(F.col(time).alias("own_time"), F.last("last_y", ignorenulls=True).over(Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)).alias("before_y"))
        own = df.withColumn(y, F.last(y, ignorenulls=True).over(past(Window.partitionBy(time).orderBy(key))))
        d = own.join(dates, own[time] == dates["own_time"], "left").withColumn(y, F.coalesce(y, "before_y")).drop("own_time", "before_y")
    return d.crossJoin(F.broadcast(median)).withColumn(y, F.coalesce(F.col(y).cast("double"), "fill")).drop("fill")


def validate_panel(df: DataFrame, target: str, time: str, keys: list[str], strict: bool) -> dict[str, object]:
    """Problems found in one pass over the values and one over the keys; raises on hard ones."""
    fields = {f.name: f.dataType for f in df.schema}
    problems = [c for c in (target, time, *keys) if c not in fields]
    if problems:
        raise ValueError(f"missing columns: {problems}")
    if not isinstance(fields[time], (T.DateType, T.TimestampType)):
        raise ValueError(f"{time} is no date")
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    out = {"nulls": {c: n for c, n in row.items() if n}, "duplicates": duplicate_keys(df, keys).count(), "not_double": [c for c in numeric_columns(df) if not isinstance(fields[c], T.DoubleType)]}
    if out["duplicates"] or (strict and (out["nulls"] or out["not_double"])):
        raise ValueError(f"panel not valid: {out}")
    return out


def critical_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])))
