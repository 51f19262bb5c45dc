"""Connected components of a graph that is given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root of every node that has an edge; edges: (a, b), longs, in either direction.

    In each round every node goes over to the neighbour (or itself) with the smallest random rank, and the edges between
    the new places are kept; ranks change each round, so the graph shrinks by a constant factor on average, whatever
    its shape. The rounds' moves are put one after another at the end.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    left, moves, k = scratch.save(both.distinct()), [], 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c), F.col(c).alias("to"))
        to = left.groupBy("a").agg(F.min(rank("b")).alias("n")).select(F.col("a").alias("node"), F.least("n", F.struct(F.xxhash64(F.lit(k), "a"), F.col("a").alias("to"))).getField("to").alias("to"))
        moves.append(scratch.save(to))
        m = moves[-1]
        new = left.join(m.toDF("a", "x"), "a").join(m.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = scratch.save(new)
        scratch.drop(left)
        left, k = new, k + 1
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = moves[0].toDF("node", "root")
    for m in moves[1:]:
        out = out.join(m.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.save(out)
