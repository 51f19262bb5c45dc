"""Projections, filters and reshaping of wide tables."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.period import period_frequency, period_number, period_year, quarter_end

META = re.compile(r"_(Description|Title|Status|CategoryGroupID)$")


def prune_meta(df: DataFrame, meta=("bronze_pk", "silver_id", "_source_file")) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in meta or META.search(c)])


def normalize_key_name(df: DataFrame, variants: list[str], standard: str) -> DataFrame:
    """The first of the variants that the table has is renamed."""
    found = next((v for v in variants if v in df.columns), None)
    return df.withColumnRenamed(found, standard) if found else df


def start_year(df: DataFrame, date: str, year: int) -> DataFrame:
    return df.where(F.year(date) >= year)


def dimension_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Values compared as text; columns that the table lacks are left out."""
    for c, v in wanted.items():
        if c in df.columns:
            df = df.where(F.col(c).cast("string").isin([str(x) for x in (v if isinstance(v, (list, tuple)) else [v])]))
    return df


def drop_totals(df: DataFrame, dims: list[str], total: str = "^T00") -> DataFrame:
    """Per dimension in turn, rows of total codes go unless only totals remain. Whether others remain is one row, so no rows are gathered."""
    for c in dims:
        other = df.agg(F.coalesce(F.max((~F.col(c).rlike(total)).cast("int")), F.lit(0)).alias("has_other"))
        df = df.crossJoin(F.broadcast(other)).where(~F.col(c).rlike(total) | (F.col("has_other") == 0)).drop("has_other")
    return df


def classify_columns(df: DataFrame, key_marks=("SBI", "Branche", "Bedrijf")) -> dict[str, list[str]]:
    """Text columns that end in a number are metrics; others are dimensions, by key axis or to be pivoted."""
    out: dict[str, list[str]] = {"metric": [], "key": [], "pivot": [], "other": []}
    for f in df.schema:
        if not isinstance(f.dataType, T.StringType):
            out["other"].append(f.name)
        elif re.search(r"_\d+$", f.name):
            out["metric"].append(f.name)
        else:
            out["key" if any(m in f.name for m in key_marks) else "pivot"].append(f.name)
    return out


def metric_allow_deny(columns: list[str], allow: list[str] | None, deny: list[str] | None) -> list[str]:
    """Keep by patterns from the start of the name, then leave out by patterns anywhere, ignoring case."""
    kept = [c for c in columns if not allow or any(re.match(p, c) for p in allow)]
    return [c for c in kept if not any(re.search(p, c, re.IGNORECASE) for p in deny or [])]


def keep_prefixes(df: DataFrame, feature: str, prefixes: list[str]) -> DataFrame:
    """Rows whose feature name begins with an allowed prefix; none are left without prefixes."""
    own = [F.col(feature).startswith(p) for p in prefixes]
    return df.where(functools.reduce(lambda a, b: a | b, own, F.lit(False)))


def prefix_yearly(df: DataFrame, structural: list[str], lag: int, prefix: str = "y_") -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in structural and not c.startswith(prefix)}) if lag > 0 else df


def one_hot(df: DataFrame, column: str, values: list, prefix: str | None = None) -> DataFrame:
    return df.withColumns({f"{prefix or column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values}).drop(column)


def one_hot_decode(df: DataFrame, flags: dict[str, str], out: str) -> DataFrame:
    """The label of the largest flag (of equal ones the last label)."""
    return df.withColumn(out, F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(k).alias("k")) for c, k in flags.items()]))["k"])


def isolate(df: DataFrame, flag: str, flags: list[str], order: str) -> DataFrame:
    if flag not in df.columns:
        raise ValueError(f"no column {flag}")
    return df.where(F.col(flag) == 1).drop(*flags).orderBy(order)


def project_groups(df: DataFrame, groups: dict[str, list[str]], names: list[str], structural: list[str], target: str) -> DataFrame:
    """Structural columns, the target, and the groups' columns in order, each once."""
    wanted = [*structural, target, *[c for n in names for c in groups[n]]]
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def numeric_columns(df: DataFrame, without=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def cast_all_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.NumericType) else F.col(f.name) for f in df.schema])


def cast_plan(df: DataFrame, keys=(), texts=(), numbers=()) -> DataFrame:
    return df.select(*[F.col(c).try_cast("int").alias(c) for c in keys], *[F.trim(F.col(c).cast("string")).alias(c) for c in texts], *[F.col(c).cast("string").try_cast("double").alias(c) for c in numbers])


def holdout(df: DataFrame, time: str, n: int, out: str = "split") -> DataFrame:
    """split: test for the last n distinct periods, else train. The periods alone are ranked, and sent back by a join."""
    periods = df.select(time).distinct()
    ranked = periods.withColumn("from_end", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(time))))
    return df.join(ranked, time).withColumn(out, F.when(F.col("from_end") <= n, "test").otherwise("train")).drop("from_end")


def monthly_to_quarterly(df: DataFrame, keys: list[str], year="year", month="month", value="value", how="mean") -> DataFrame:
    """Months 1 to 12 by quarter: mean, sum (0 where all are null), first or last non-null."""
    ok = F.col(value).isNotNull()
    agg = {
        "mean": F.avg(value), "sum": F.coalesce(F.sum(value), F.lit(0)),
        "first": F.min_by(F.when(ok, F.col(value)), F.when(ok, F.col(month))), "last": F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(month))),
    }[how]
    return df.where(F.col(month).between(1, 12)).groupBy(*keys, year, F.ceil(F.col(month) / 3).cast("int").alias("quarter")).agg(agg.alias(value))


def yearly_to_quarterly(df: DataFrame, year="year", lag: int = 0) -> DataFrame:
    """Each year's row on its four quarters, `lag` years later."""
    d = df.withColumn(year, F.col(year) + lag).withColumn("quarter", F.explode(F.array(*[F.lit(q) for q in range(1, 5)])))
    return d.withColumn("period_enddate", quarter_end(F.col(year), F.col("quarter")))


def frequency_priority(df: DataFrame, code="Perioden") -> DataFrame:
    """Quarterly codes if the table has any, else monthly ones, else yearly ones."""
    rank = F.when(F.col(code).contains("KW"), 1).when(F.col(code).contains("MM"), 2).when(F.col(code).contains("JJ"), 3)
    best = df.agg(F.min(rank).alias("best"))
    return df.crossJoin(F.broadcast(best)).where(rank == F.col("best")).drop("best")


def dimension_pivot(df: DataFrame, keys: list[str], dim: str, values: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric by value of the dimension, as columns metric_value."""
    d = df.groupBy(*keys).pivot(dim, values).agg(*[F.avg(m).alias(m) for m in metrics])
    names = {f"{v}_{m}" if len(metrics) > 1 else v: f"{m}_{v}" for v in values for m in metrics}
    return d.withColumnsRenamed(names)


def period_columns(df: DataFrame, code="Perioden") -> DataFrame:
    c = F.col(code)
    return df.withColumns({"frequency": period_frequency(c), "year": period_year(c), "number": period_number(c)})


def metric_double(column: str) -> Column:
    return F.col(column).try_cast("double")
