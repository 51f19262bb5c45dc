"""Exact order over whole tables: places, neighbours and quantiles without one task that holds all rows.

Rows are dealt into ranges of the order, which are saved once. Counts of each range tell how many rows lie before it, so
a row's place is that number and its place in its range; a quantile is looked up in the one or two ranges that hold its
ranks. Neighbours are joined by place, so no range needs the end of the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """df in sorted ranges of the order, saved, with own_range and own_line (the line in its range)."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id's upper bits are the number of the partition, the lower ones the line in it
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("own_id", F.monotonically_increasing_id())
    return saved(d.select(*df.columns, F.shiftright("own_id", 33).cast("int").alias("own_range"), F.col("own_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("own_line")), "ranges")


def _same(a: DataFrame, b: DataFrame, columns: list[str]):
    on = [a[c].eqNullSafe(b[c]) for c in columns]
    out = on[0]
    for c in on[1:]:
        out = out & c
    return out


def placed(df: DataFrame, group: list[str], order: list[str], out: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 1. The order must be total, as ties across runs could change places."""
    d = ranges(df, [*group, *order])
    keys = ["own_range", *group]
    per = d.groupBy(*keys).agg(F.count("*").alias("own_n"), F.min("own_line").alias("own_first"))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("own_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = per.withColumn("own_before", F.coalesce(F.sum("own_n").over(w), F.lit(0))).select(*[F.col(k).alias(f"r_{k}") for k in keys], "own_first", "own_before")
    on = d["own_range"] == per["r_own_range"]
    for g in group:
        on = on & d[g].eqNullSafe(per[f"r_{g}"])
    return d.join(per, on).select(*[d[c] for c in df.columns], (F.col("own_before") + F.col("own_line") - F.col("own_first") + 1).alias(out))


def neighbours(df: DataFrame, group: list[str], place: str, columns: list[str], k: int = 1) -> DataFrame:
    """df with {column}_back{k}: the values k places before in the group, null at its start."""
    past = df.select(*group, (F.col(place) + k).alias(place), *[F.col(c).alias(f"{c}_back{k}") for c in columns])
    return df.join(past, [*group, place], "left")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], group: list[str] | None = None) -> DataFrame:
    """group, column, share and value: exact quantiles of each column's values in each group, linear between neighbours; a column without values has no rows.

    Equal values are counted before they are dealt out, so a frequent value is one row.
    """
    group = group or []
    keys = [*group, "column"]
    values = df.select(*group, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))
    counts = values.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    d = ranges(counts, [*keys, "value"])
    per = d.groupBy("own_range", *keys).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)  # a row for each range
    per = per.select("*", F.coalesce(F.sum("n").over(w.orderBy("own_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))
    at = per.select("*", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")).withColumn("at", F.col("share") * (F.col("total") - 1))
    ranks = F.array(F.struct(F.floor("at").alias("rank"), (1 - (F.col("at") - F.floor("at"))).alias("weight")), F.struct((F.floor("at") + 1).alias("rank"), (F.col("at") - F.floor("at")).alias("weight")))
    want = at.select("own_range", *keys, "share", "n", "before", F.inline(ranks)).where("weight > 0 AND rank >= before AND rank < before + n")
    want = saved(want.select("own_range", *keys, "share", (F.col("rank") - F.col("before")).alias("rank"), "weight"), "ranks")  # at most two rows for each group and share
    held = want.select("own_range", *keys).distinct()
    some = d.join(held, _same(d, held, ["own_range", *keys]), "left_semi")
    up = F.sum("n").over(Window.partitionBy("own_range", *keys).orderBy("value"))  # values of one range
    some = some.select("own_range", *keys, "value", (up - F.col("n")).alias("low"), up.alias("high"))
    hit = some.join(want, _same(some, want, ["own_range", *keys]) & (want["rank"] >= some["low"]) & (want["rank"] < some["high"]))
    return hit.groupBy(*[some[k] for k in keys], "share").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def wide_quantiles(df: DataFrame, names: dict[str, tuple[str, float]], group: list[str] | None = None) -> DataFrame:
    """group and one column for each name -> (column, share)."""
    group = group or []
    q = quantiles(df, list(dict.fromkeys(c for c, _ in names.values())), list(dict.fromkeys(p for _, p in names.values())), group)
    pick = [F.max(F.when((F.col("column") == c) & (F.col("share") == p), F.col("value"))).alias(name) for name, (c, p) in names.items()]
    return q.groupBy(*group).agg(*pick)
