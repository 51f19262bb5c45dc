"""Feature selection on long frames (key, time, feature, value) and wide panels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import corr


def long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))


def near_constant(df: DataFrame, keys: list[str], features: list[str], most: float = 0.95) -> DataFrame:
    """feature, share of its most frequent non-null value (1 if it has none), retained."""
    d = long(df, keys, features)
    counts = d.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n")).groupBy("feature").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    share = F.coalesce(F.try_divide("top", "n"), F.lit(1.0))
    return names.join(counts, "feature", "left").select("feature", share.alias("share"), (share <= most).alias("retained"))


def target_correlation(df: DataFrame, keys: list[str], features: list[str], y: str) -> DataFrame:
    """feature and r with the target over complete pairs."""
    return long(df, [*keys, y], features).groupBy("feature").agg(corr(F.col("value"), F.col(y)).alias("r"))


def lagged_correlation(df: DataFrame, features: list[str], y: str, key: str, time: str, horizons=(1, 2, 3, 4), least: int = 10, agg=F.median) -> DataFrame:
    """feature, horizon and the median over series of |corr(x_t, y_t+h)|, of series with more than `least` pairs."""
    w = Window.partitionBy(key).orderBy(time)
    d = df.withColumn("ahead", F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(y, h).over(w).alias("target")) for h in horizons]))
    d = long(d.select(key, time, F.inline("ahead"), *features), [key, time, "horizon", "target"], features)
    pairs = F.count_if(F.col("value").isNotNull() & F.col("target").isNotNull())
    r = d.groupBy("feature", "horizon", key).agg(F.when(pairs > least, F.abs(corr(F.col("value"), F.col("target")))).alias("r"))
    return r.groupBy("feature", "horizon").agg(agg("r").alias("r"))


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, r of each pair of columns, in one pass. Their number is that of columns, not rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    row = df.agg(*[corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def complete_linkage(near: np.ndarray, most: float) -> list[list[int]]:
    """Clusters in which every pair is at least `most` near, by complete linkage; near: a symmetric matrix of similarities.

    Chains of nearest neighbours: each step goes to the nearest cluster until two are each other's, which merge. As a
    merged cluster is never nearer to another than its parts were, the rest of the chain holds, and all takes quadratic
    time. Only clusters of one component of the pairs at or above `most` can merge, so components go one after another.
    """
    near, left, out = np.array(near, float), set(range(len(near))), []
    np.fill_diagonal(near, -np.inf)
    while left:
        todo, component = [min(left)], []
        left.discard(todo[0])
        while todo:
            i = todo.pop()
            component.append(i)
            for j in np.nonzero(near[i] >= most)[0].tolist():
                if j in left:
                    left.discard(j)
                    todo.append(j)
        at = np.array(sorted(component))
        s, groups, active, chain = near[np.ix_(at, at)].copy(), [[i] for i in at.tolist()], np.ones(len(at), bool), []
        while active.any():
            if not chain:
                chain = [int(np.nonzero(active)[0][0])]
            top = chain[-1]
            row = np.where(active, s[top], -np.inf)
            row[top] = -np.inf
            best = int(row.argmax())
            if len(chain) > 1 and row[chain[-2]] >= row[best]:
                best = chain[-2]
            if row[best] < most:  # nothing will ever be near enough
                out.append(sorted(groups[top]))
                active[top] = False
                chain.pop()
            elif len(chain) > 1 and best == chain[-2]:
                a, b = sorted((top, best))
                groups[a] += groups[b]
                s[a] = np.minimum(s[a], s[b])
                s[:, a] = s[a]
                active[b] = False
                chain = chain[:-2]
            else:
                chain.append(best)
    return sorted(out)


def redundancy(df: DataFrame, features: list[str], y: str, most: float = 0.9) -> list[tuple[str, int, bool]]:
    """feature, cluster, retained: complete linkage at 1 - |r|, the best correlated with y is kept. The p x p matrix is on the driver, as p is the number of columns."""
    place, score = {f: i for i, f in enumerate(features)}, {}
    near = np.zeros((len(features), len(features)))
    for x in correlation_pairs(df, [*features, y]).collect():  # one pass over df for both kinds of pairs
        r = abs(x["r"] or 0.0)
        if x["b"] in place:
            near[place[x["a"]], place[x["b"]]] = near[place[x["b"]], place[x["a"]]] = r
        if x["b"] == y:
            score[x["a"]] = r
    groups = [[features[i] for i in g] for g in complete_linkage(near, most)]
    keep = {max(g, key=lambda f: (score[f], f)) for g in groups}
    return [(f, k, f in keep) for k, g in enumerate(groups) for f in g]


def yearly_evaluation(df: DataFrame, features: list[str], y: str, key: str, year: str) -> DataFrame:
    """feature, medians over series of |corr| of yearly differences and of |corr| with the target one year ahead."""
    own = df.groupBy(key, year).agg(F.avg(y).alias("target"), *[F.avg(f).alias(f) for f in features])
    d = long(own, [key, year, "target"], features)
    w = Window.partitionBy("feature", key).orderBy(year)
    diff: Column = F.col("value") - F.lag("value").over(w)
    d = d.select("feature", key, "value", diff.alias("dv"), (F.col("target") - F.lag("target").over(w)).alias("dt"), F.lead("target").over(w).alias("ahead"))
    r = d.groupBy("feature", key).agg(F.abs(corr(F.col("dv"), F.col("dt"))).alias("r_diff"), F.abs(corr(F.col("value"), F.col("ahead"))).alias("r_ahead"))
    return r.groupBy("feature").agg(F.median("r_diff").alias("r_diff"), F.median("r_ahead").alias("r_ahead"))


def group_by_category(survivors: DataFrame, origin: DataFrame, registry: DataFrame) -> DataFrame:
    """group and its columns: survivors (feature) by the category of the table (column, table_id -> category) they came from; others are ungrouped."""
    d = survivors.join(origin.select(F.col("column").alias("feature"), "table_id"), "feature", "left").join(registry, "table_id", "left")
    return d.groupBy(F.coalesce("category", F.lit("ungrouped")).alias("group")).agg(F.array_sort(F.collect_list("feature")).alias("columns"))


def dedupe_presets(presets: DataFrame) -> DataFrame:
    """Presets (name, columns) with equal sets of columns; the first name stays."""
    return presets.groupBy(F.array_sort(F.array_distinct("columns")).alias("columns")).agg(F.min("name").alias("name"), F.count("*").alias("n_same"))


def partition_candidates(features: DataFrame, origin: DataFrame, yearly_tables: list[str], prefix: str = "y_") -> DataFrame:
    """feature and reason: yearly_prefix, unknown_origin, yearly_origin or candidate. features (feature), origin (column, table_id)."""
    d = features.join(origin.select(F.col("column").alias("feature"), "table_id"), "feature", "left")
    reason = F.when(F.col("feature").startswith(prefix), "yearly_prefix").when(F.col("table_id").isNull(), "unknown_origin").when(F.col("table_id").isin(yearly_tables), "yearly_origin").otherwise("candidate")
    return d.select("feature", reason.alias("reason"))


def propose_groups(features: DataFrame, prefix: Column, merge: dict[str, str]) -> DataFrame:
    """group and its columns: features (feature) by prefix, prefixes merged by a map."""
    name = prefix
    for a, b in merge.items():
        name = F.when(prefix == a, b).otherwise(name)
    return features.groupBy(name.alias("group")).agg(F.array_sort(F.collect_list("feature")).alias("columns"))


def validate_groups(groups: DataFrame, survivors: DataFrame) -> DataFrame:
    """Groups (group, columns) with surviving columns only, and the survivors of no group as `ungrouped`."""
    g = groups.select("group", F.explode("columns").alias("feature"))
    d = survivors.select("feature").join(g, "feature", "left")
    return d.groupBy(F.coalesce("group", F.lit("ungrouped")).alias("group")).agg(F.array_sort(F.collect_set("feature")).alias("columns"))
