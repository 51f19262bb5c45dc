"""Code hierarchies: lookups, levels, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import range_letters, section_of_division
from .order import saved


def lookup(df: DataFrame, titles: DataFrame, code: str) -> DataFrame:
    """LEFT JOIN titles (Key, title, level) on the trimmed key; unknown codes get '' and 'unknown'."""
    t = titles.select(F.trim("Key").alias("match_key"), "title", "level").dropDuplicates(["match_key"])
    d = df.join(t, F.trim(df[code]) == t["match_key"], "left").drop("match_key")
    return d.withColumns({"title": F.coalesce("title", F.lit("")), "level": F.coalesce("level", F.lit("unknown"))})


def code_is_numeric(df: DataFrame, column: str, order: str | None = None) -> bool:
    """Whether more than half of the first ten non-null values, by order or by themselves, are digits."""
    row = df.where(F.col(column).isNotNull()).orderBy(order or column).select(F.trim(column).rlike("^[0-9]+$").cast("int").alias("d")).limit(10).agg(F.avg("d").alias("share")).first()
    return (row["share"] or 0) > 0.5


def jsonld_extract(df: DataFrame, graph: str = "@graph", language: str = "nl") -> DataFrame:
    """code, label in the language, nace of each entry of a linked-data graph."""
    e = df.select(F.explode(F.col(f"`{graph}`")).alias("e"))
    labels = F.filter(F.col("e")["rdfs:label"], lambda x: x["@language"] == language)
    return e.select(F.col("e")["schema:identifier"].alias("code"), F.get(labels, F.lit(0))["@value"].alias("label"), F.col("e")["schema:nace"].alias("nace"))


def tree_parent(nodes: DataFrame) -> DataFrame:
    """parent of each node (code, title, level): section to the sector whose letters hold it, subdivision to its section, else its sector, else the total."""
    letter = F.substring("title", 1, 1)
    sectors = nodes.where("level = 'sector'").select(F.col("code").alias("sector_code"), F.explode(range_letters(F.col("title"))).alias("letter"))
    sections = nodes.where("level = 'section'").groupBy(letter.alias("section_letter")).agg(F.min("code").alias("section_code"))
    root = nodes.where("level = 'total'").agg(F.coalesce(F.min("code"), F.lit("root")).alias("root_code"))
    own: Column = F.when(F.col("level") == "section", letter).when(F.col("level") == "subdivision", section_of_division(F.regexp_extract("title", "^([0-9]+)", 1).try_cast("int")))
    d = nodes.withColumn("letter", own).withColumn("section_letter", F.when(F.col("level") == "subdivision", F.col("letter"))).join(sections, "section_letter", "left").join(sectors, "letter", "left").crossJoin(F.broadcast(root))
    parent = F.when(F.col("level") == "total", None).when(F.col("level") == "section", F.coalesce("sector_code", "root_code")).when(F.col("level") == "subdivision", F.coalesce("section_code", "sector_code", "root_code")).otherwise(F.col("root_code"))
    return d.select("code", "title", "level", parent.alias("parent"))


def tree_levels(edges: DataFrame) -> list[DataFrame]:
    """The nodes (code, title, parent, path) of each level from the roots down, saved; edges: a row for each node, parent null for roots.

    A node that no root leads to (its parent is missing, or is below it) and a repeated code are errors.
    """
    own = saved(edges.select("code", "title", "parent"), "tree")
    n = own.count()
    level = saved(own.where("parent IS NULL").withColumn("path", F.col("code").cast("string")), "tree")
    out, reached = [], 0
    while (size := level.count()) and reached <= n:
        out.append(level)
        reached += size
        above = level.select(F.col("code").alias("above"), F.col("path").alias("above_path"))
        below = own.join(above, own["parent"] == above["above"])
        level = saved(below.select("code", "title", "parent", F.concat_ws("/", "above_path", "code").alias("path")), "tree")
    if reached != n or own.select("code").distinct().count() != n:
        raise ValueError("not a tree: a cycle, a missing parent or a repeated code")
    return out


def tree_paths(edges: DataFrame) -> DataFrame:
    """code, depth (0 for roots) and path from the root of each node."""
    parts = [d.select("code", F.lit(k).alias("depth"), "path") for k, d in enumerate(tree_levels(edges))]
    if not parts:
        return edges.select("code", F.lit(0).alias("depth"), F.col("code").cast("string").alias("path")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_json(edges: DataFrame) -> DataFrame:
    """code and node of each root: itself and its nested children as JSON, built from the lowest level up, at any depth."""
    levels = tree_levels(edges)
    if not levels:
        return edges.select("code", F.lit("").alias("node")).limit(0)
    text, kids = F.to_json(F.struct("code", "title")), None
    for level in reversed(levels):
        d = level.select("code", "parent", text.alias("own"))
        if kids is None:
            d = d.withColumn("node", F.col("own"))
        else:
            whole = F.concat(F.regexp_replace("own", "\\}$", ""), F.lit(',"children":['), "kids", F.lit("]}"))
            d = d.join(kids, d["code"] == kids["above"], "left").withColumn("node", F.when(F.col("kids").isNull(), F.col("own")).otherwise(whole))
        d = saved(d.select("code", "parent", "node"), "tree")
        kids = d.groupBy(F.col("parent").alias("above")).agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("kids"))
    return d.select("code", "node")


def split_by_level(df: DataFrame, code: str, titles: DataFrame, unmatched: bool = True) -> DataFrame:
    """df with frame: one row for each frame that a row is in, so that a filter on frame gives the frame.

    A row is in the frame of its code's level (titles: Key, level, section); a division with a section is in `section` too,
    and a row whose trimmed code has no title is in `_unmatched`, if asked for.
    """
    t = titles.select(F.trim("Key").alias("match_key"), F.col("level").alias("own_level"), F.col("section").alias("own_section")).dropDuplicates(["match_key"])
    d = df.join(t, F.trim(df[code].cast("string")) == t["match_key"], "left")
    up = (F.col("own_level") == "division") & F.col("own_section").isNotNull()
    frames = F.when(F.col("match_key").isNull(), F.array(F.lit("_unmatched"))).when(up, F.array("own_level", F.lit("section"))).otherwise(F.array("own_level"))
    d = d.select(*[df[c] for c in df.columns], "own_section", F.explode(frames).alias("frame"))
    d = d.withColumn("section", F.when(F.col("frame") == "section", F.col("own_section"))).drop("own_section")
    return d if unmatched else d.where("frame <> '_unmatched'")
