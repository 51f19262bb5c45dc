"""Window operators on keyed series. `key` and `time` name the series and its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.period import add_quarters, quarters_since


def by(key, time) -> Window:
    return Window.partitionBy(key).orderBy(time)


def rolling_same_quarter_mean(df: DataFrame, key="sector", time="year", quarter="quarter", y="y", n: int = 3, out: str = "y_pred") -> DataFrame:
    """Mean of the n values before of the same quarter; null if there are fewer."""
    w = Window.partitionBy(key, quarter).orderBy(time).rowsBetween(-n, -1)
    return df.withColumn(out, F.when(F.count(y).over(w) == n, F.avg(y).over(w)))


def lagged(df: DataFrame, columns: list[str], k: int, key="sector", time="period_enddate") -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(by(key, time)) for c in columns})


def seasonal_ma(df: DataFrame, y="y", lags=(4, 8, 12), key="sector", time="period_enddate", out="y_pred") -> DataFrame:
    """Mean of the values at the lags, leaving out nulls."""
    values = [F.lag(y, k).over(by(key, time)) for k in lags]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    count = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return df.withColumn(out, F.try_divide(total, count))


def differences(df: DataFrame, columns: list[str], key="sector", time="period_enddate") -> DataFrame:
    return df.withColumns({c: F.col(c) - F.lag(c).over(by(key, time)) for c in columns})


def leads(df: DataFrame, y="y", horizons=(1, 2, 3, 4), key="sector", time="period_enddate") -> DataFrame:
    return df.withColumns({f"{y}_h{h}": F.lead(y, h).over(by(key, time)) for h in horizons})


def forward_fill(df: DataFrame, columns: list[str], key="sector", time="period_enddate") -> DataFrame:
    w = by(key, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def with_trend(df: DataFrame, time="period_enddate", out="trend_index") -> DataFrame:
    """Quarters since the table's first quarter, from 1; the first is one row that joins all."""
    first = df.agg(F.min(time).alias("first_period"))
    return df.crossJoin(F.broadcast(first)).withColumn(out, quarters_since(F.col(time), F.col("first_period")) + 1).drop("first_period")


def carry_forward(df: DataFrame, steps: int, key="sector", time="period_enddate") -> DataFrame:
    """The last row of each series repeated for the next `steps` quarter ends."""
    rest = [c for c in df.columns if c not in (key, time)]
    last = df.groupBy(key).agg(F.max_by(F.struct(time, *rest), time).alias("last"))
    d = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return d.select(key, add_quarters(F.col("last")[time], F.col("step")).alias(time), *[F.col("last")[c].alias(c) for c in rest], "step")


def first_rows(df: DataFrame, key, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    k = "row_place"
    return df.withColumn(k, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(k) <= n).drop(k)


def average_rank(df: DataFrame, value: str, group, out="rank") -> DataFrame:
    """Rank from the smallest value, ties averaged."""
    ties = F.count("*").over(Window.partitionBy(*([group] if isinstance(group, str) else group), value))
    return df.withColumn(out, F.rank().over(Window.partitionBy(group).orderBy(value)) + (ties - 1) / 2)


def contiguous_tail(df: DataFrame, key="sector", time="period_enddate", least: int = 1) -> DataFrame:
    """What follows the last gap of each series, for series with at least `least` such rows."""
    w = by(key, time)
    gap = F.coalesce(F.lag(time).over(w) != add_quarters(F.col(time), -1), F.lit(True))
    d = df.withColumn("gap", gap)
    d = d.withColumn("tail_from", F.max(F.when(F.col("gap"), F.col(time))).over(Window.partitionBy(key))).where(F.col(time) >= F.col("tail_from"))
    return d.withColumn("n_tail", F.count("*").over(Window.partitionBy(key))).where(F.col("n_tail") >= least).drop("gap", "tail_from", "n_tail")


def gap_report(df: DataFrame, y="y", key="sector", time="period_enddate") -> DataFrame:
    d = df.groupBy(key).agg(F.count("*").alias("n_obs"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_if(F.col(y).isNull()).alias("n_null"))
    return d.withColumn("n_gaps", quarters_since(F.col("last"), F.col("first")) + 1 - F.col("n_obs"))


def calendar_fill(df: DataFrame, key="sector", time="period_enddate") -> DataFrame:
    """All quarters between the first and last of each series; other columns are null where one was missing."""
    span = df.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("z"))
    all_ = span.select(key, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), quarters_since(F.col("z"), F.col("a"))), lambda k: add_quarters(F.col("a"), k.cast("int")))).alias(time))
    return all_.join(df, [key, time], "left")


def contiguous(df: DataFrame, key="sector", time="period_enddate") -> DataFrame:
    """is_contiguous of each series."""
    d = df.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("z"), F.countDistinct(time).alias("n"))
    return d.select(key, (quarters_since(F.col("z"), F.col("a")) + 1 == F.col("n")).alias("is_contiguous"))


def holm(df: DataFrame, p: str, order: list, out="p_holm", group=None) -> DataFrame:
    """Step-down adjusted p-values: running maximum of p times the number of hypotheses left, at most 1."""
    part = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    w = part.orderBy(p, *order)
    left = F.count("*").over(part) - F.row_number().over(w) + 1
    return df.withColumn("scaled", F.col(p) * left).withColumn(out, F.least(F.lit(1.0), F.max("scaled").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("scaled")


def year_ago(df: DataFrame, y="y", key="sector", time="period_enddate", out="y_year_ago") -> DataFrame:
    """The value one year earlier by date, so that gaps give null."""
    past = df.select(key, F.last_day(F.add_months(time, 12)).alias(time), F.col(y).alias(out))
    return df.join(past, [key, time], "left")


def share_of_total(df: DataFrame, value: str, group, out="share") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(group))))


def inner_outer(df: DataFrame, key="sector", origin="origin_date", share: float = 0.4, out="fold_set") -> DataFrame:
    """Origins in order: the first ceil(share * n) are inner, the rest outer; a single one is outer, and one is always left outer."""
    own = df.select(key, origin).distinct()
    n = F.count("*").over(Window.partitionBy(key))
    k = F.row_number().over(by(key, origin))
    inner = F.least(F.ceil(F.lit(share) * n), n - 1)
    return df.join(own.withColumn(out, F.when(k <= inner, "inner").otherwise("outer")), [key, origin])


def regime_correction(df: DataFrame, start: str, end: str, before: int = 3, after: int = 1, y="y", key="sector", time="period_enddate", quarter="quarter") -> DataFrame:
    """Values inside the regime replaced by the mean of the last `before` same-quarter values before it and the first `after` ones behind it."""
    w = Window.partitionBy(key, quarter, "side").orderBy(F.when(F.col("side") == 0, F.col(time)).desc(), F.col(time))
    side = F.when(F.col(time) < F.lit(start).cast("date"), 0).when(F.col(time) > F.lit(end).cast("date"), 1)
    near = df.withColumn("side", side).where("side IS NOT NULL").withColumn("k", F.row_number().over(w))
    mean = near.where(((F.col("side") == 0) & (F.col("k") <= before)) | ((F.col("side") == 1) & (F.col("k") <= after))).groupBy(key, quarter).agg(F.avg(y).alias("normal"))
    d = df.join(mean, [key, quarter], "left")
    return d.withColumn(f"{y}_corrected", F.when(side.isNull(), F.coalesce("normal", y)).otherwise(F.col(y))).drop("normal")
