"""Queries of raw scans, catalogues, schemas, hierarchies as documents, yearly smoothing and tree models."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import disaggregation as D
from ..operators import forecast as O
from ..operators import funnel as N
from ..operators import hierarchy as T
from ..operators import joins as J
from ..operators import profile as P
from ..operators import reshape as R
from ..operators.windows import by, first_rows
from ..sources import io
from .frames import panel, table
from .products import place
from .registry import query

six = lambda c: F.round(c, 6)


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def filled(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """column, kind and number of non-null values of each column of kinds."""
    row = df.agg(*[F.count(c).alias(c) for c in kinds])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("n")) for c, k in kinds.items()])))


@query("json_star_scan", "SELECT c_custkey AS ID, c_name AS name, c_acctbal AS v_1, n_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    raw = place(spark, "raw")
    table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v_1")).write.json(f"{raw}/TypedDataSet.json")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("Key"), F.col("n_name").alias("Title")).write.json(f"{raw}/Nation.json")
    t = io.star_scan(spark, raw, "t", lines=True)
    return t["t_fact"].join(t["t_dim_Nation"], F.col("nation") == F.col("Key")).select("ID", "name", "v_1", F.col("Title").alias("title"))


@query("infer_primary_key", "SELECT 'customer' AS name, 'ID' AS key, count(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'nation', 'Key', count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'region', 'DimensionKey', count(DISTINCT r_regionkey) FROM region")
def _(spark, d):
    named = {"customer": {"c_custkey": "ID", "c_name": "Key"}, "nation": {"n_nationkey": "Key"}, "region": {"r_regionkey": "DimensionKey"}, "supplier": {}}
    tables = {n: table(spark, d, n).withColumnsRenamed(c) for n, c in named.items()}
    keys = {n: k for n, t in tables.items() if (k := io.primary_key(t.columns))}
    return union([tables[n].agg(F.countDistinct(k).alias("n")).select(F.lit(n).alias("name"), F.lit(k).alias("key"), "n") for n, k in keys.items()])


COLUMN_KINDS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "string", "o_orderpriority": "string"}


def kinds_sql(kinds: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS n FROM {source}" for c, k in kinds.items())


@query("infer_column_types", kinds_sql(COLUMN_KINDS, "orders"))
def _(spark, d):
    raw = place(spark, "raw")
    table(spark, d, "orders").write.json(raw)
    t = spark.read.json(raw)
    return filled(t, io.column_types(t))


@query("list_tables", "SELECT 'panel_customer_gold' AS name, count(*) AS n FROM customer UNION ALL SELECT 'panel_nation_gold', count(*) FROM nation")
def _(spark, d):
    for view, name in (("panel_customer_gold", "customer"), ("panel_nation_gold", "nation"), ("panel_region_silver", "region"), ("panel_supplier_gold", "supplier")):
        table(spark, d, name).createOrReplaceTempView(view)
    names = io.list_tables(spark, "_gold", {"panel_customer", "panel_nation", "panel_region"})
    return union([spark.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


STEPS = """(SELECT 1 AS step, 'size' AS filter, p_brand AS feature, avg(p_size) AS score, avg(p_size) >= 25 AS retained FROM part GROUP BY p_brand
UNION ALL SELECT 2, 'price', p_brand, avg(p_retailprice), avg(p_retailprice) >= 1300 FROM part GROUP BY p_brand HAVING avg(p_size) >= 25)"""
GROUPS = "(SELECT substr(p_brand, 1, 7) AS g, p_brand AS c FROM part GROUP BY p_brand)"


def catalog(spark, d) -> str:
    """Path of a catalogue of brands kept by size, then by price, and of their groups."""
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    step = lambda k, name, c, least: F.struct(F.lit(k).alias("step"), F.lit(name).alias("filter"), F.col("p_brand").alias("feature"), F.col(c).alias("score"), (F.col(c) >= least).alias("retained"))
    steps = union([brands.select(step(1, "size", "size", 25).alias("s")), brands.where("size >= 25").select(step(2, "price", "price", 1300).alias("s"))]).select("s.*")
    groups = brands.groupBy(F.substring("p_brand", 1, 7).alias("group")).agg(F.array_sort(F.collect_list("p_brand")).alias("columns"))
    path = place(spark, "catalog")
    io.write_catalog(steps, groups, path)
    return path


@query("catalog_json_sink", f"SELECT step, filter, count_if(retained)::BIGINT AS n_retained, count_if(NOT retained)::BIGINT AS n_dropped FROM {STEPS} GROUP BY ALL")
def _(spark, d):
    steps = spark.read.schema("steps array<struct<step:int,filter:string,retained:array<string>,dropped:array<string>>>").json(catalog(spark, d))
    return steps.select(F.inline("steps")).select("step", "filter", F.size("retained").cast("long").alias("n_retained"), F.size("dropped").cast("long").alias("n_dropped"))


@query("catalog_json_scan", f"SELECT g AS \"group\", c AS feature FROM {GROUPS} UNION ALL SELECT 'all_survivors', feature FROM {STEPS} WHERE step = 2 AND retained")
def _(spark, d):
    groups = io.read_catalog(spark, catalog(spark, d))
    return spark.createDataFrame([(g, c) for g, own in groups.items() for c in own], "group string, feature string")


CLASSES = {"v_1": "metric", "v_2": "metric", "SBI_code": "key", "segment": "pivot", "c_custkey": "other"}


@query("classify_columns", kinds_sql(CLASSES, "(SELECT c_custkey, c_acctbal AS v_1, c_nationkey AS v_2, c_nationkey AS SBI_code, c_mktsegment AS segment FROM customer)"))
def _(spark, d):
    raw = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("v_1"), F.col("c_nationkey").cast("string").alias("v_2"), F.format_string("%02d", "c_nationkey").alias("SBI_code"), F.col("c_mktsegment").alias("segment"))
    return filled(raw, {c: k for k, own in R.classify_columns(raw).items() for c in own})


@query("column_origin", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS table_id, count({c}) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT s_nationkey AS n_nationkey, avg(s_acctbal) AS x_bal, count(*) AS n_own FROM supplier GROUP BY 1) USING (n_nationkey)" for c, t in (("n_name", "nation"), ("r_name", "region"), ("x_bal", "supplier"), ("n_own", "supplier"))))
def _(spark, d):
    parts = {"nation": table(spark, d, "nation"), "region": table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "supplier": table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("x_bal"), F.count("*").alias("n_own"))}
    whole = parts["nation"].join(parts["region"], "n_regionkey").join(parts["supplier"], "n_nationkey")
    origin = J.column_origin({n: [c for c in t.columns if not c.endswith("key")] for n, t in parts.items()}, spark)
    counts = filled(whole, {c: "" for c in whole.columns if not c.endswith("key")}).drop("kind")
    return origin.join(counts, "column")


FORMATS = ("p_size", "p_brand", "p_partkey")


@query("code_format_detect", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(regexp_matches(v, '^[0-9]+$')::INT) > 0.5 AS is_numeric FROM (SELECT {c}::VARCHAR AS v FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 10)" for c in FORMATS))
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("place"), *[F.col(c).cast("string").alias(c) for c in FORMATS])
    return spark.createDataFrame([(c, T.code_is_numeric(p, c, "place")) for c in FORMATS], "column string, is_numeric boolean")


@query("jsonld_extract", "SELECT s_suppkey::VARCHAR AS code, CASE WHEN s_nationkey % 3 <> 0 THEN s_name END AS label, 'N' || s_nationkey AS nace FROM supplier")
def _(spark, d):
    label = lambda language, c: F.struct(F.lit(language).alias("@language"), F.col(c).alias("@value"))
    labels = F.when(F.col("s_nationkey") % 3 == 0, F.array(label("en", "s_name"))).otherwise(F.array(label("en", "s_suppkey"), label("nl", "s_name")))
    s = table(spark, d, "supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("string"))
    entry = F.struct(F.col("s_suppkey").alias("schema:identifier"), labels.alias("rdfs:label"), F.concat(F.lit("N"), "s_nationkey").alias("schema:nace"))
    return T.jsonld_extract(s.select(F.array(entry).alias("@graph")))


@query("tree_json", """WITH s AS (SELECT '{"code":"S' || r_regionkey || '","title":"' || r_name || '","children":[' || string_agg('{"code":"N' || n_nationkey || '","title":"' || n_name || '"}', ',' ORDER BY '{"code":"N' || n_nationkey || '","title":"' || n_name || '"}') || ']}' AS node FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)
SELECT 'ALL' AS code, '{"code":"ALL","title":"All","children":[' || string_agg(node, ',' ORDER BY node) || ']}' AS node FROM s""")
def _(spark, d):
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    nations = table(spark, d, "nation").select(name("N", "n_nationkey").alias("code"), F.col("n_name").alias("title"), name("S", "n_regionkey").alias("parent"))
    regions = table(spark, d, "region").select(name("S", "r_regionkey").alias("code"), F.col("r_name").alias("title"), F.lit("ALL").alias("parent"))
    total = spark.createDataFrame([("ALL", "All", None)], "code string, title string, parent string")
    return T.tree_json(nations.unionByName(regions).unionByName(total))


@query("validate_panel", """SELECT 'nulls' AS problem, 'y_before' AS "column", count(DISTINCT sector) AS n FROM {panel} UNION ALL SELECT 'duplicates', NULL, count(*) - count(DISTINCT (sector, period_enddate)) FROM {panel}
UNION ALL SELECT 'not_double', unnest(['year', 'quarter', 'n_orders']), NULL""")
def _(spark, d):
    p = panel(spark, d).withColumn("y_before", F.lag("y").over(by("sector", "period_enddate")))
    found = P.validate_panel(p, "y", "period_enddate", ["sector", "period_enddate"], False)
    out = [("nulls", c, n) for c, n in found["nulls"].items()] + [("duplicates", None, found["duplicates"])] + [("not_double", c, None) for c in found["not_double"]]
    return spark.createDataFrame(out, "problem string, column string, n bigint")


def yearly_panel(spark, d) -> DataFrame:
    """The panel with a column that is the same for all sectors in a year, and one that ends with the last whole year."""
    p, w = panel(spark, d), Window.partitionBy("year")
    last = F.max("quarter").over(w) == 4
    return p.withColumns({"y_all": F.avg("x_bal").over(w), "y_whole": F.when(last, F.avg("n_orders").over(w))})


@query("smooth_yearly", """WITH a AS (SELECT year, avg(x_bal) AS v FROM {panel} GROUP BY 1), b AS (SELECT year, v, coalesce(lag(v) OVER (ORDER BY year), v) AS p, coalesce(lead(v) OVER (ORDER BY year), v) AS n FROM a),
q AS (SELECT year, v, quarter, CASE quarter WHEN 1 THEN v - (v - p) * 0.375 WHEN 2 THEN v - (v - p) * 0.125 WHEN 3 THEN v + (n - v) * 0.125 ELSE v + (n - v) * 0.375 END AS r FROM b, range(1, 5) t(quarter)),
s AS (SELECT year, quarter, r + v - avg(r) OVER (PARTITION BY year) AS y_all FROM q) SELECT sector, p.year, p.quarter, round(y_all, 4) AS y_all FROM {panel} p JOIN s ON p.year = s.year AND p.quarter = s.quarter""")
def _(spark, d):
    out, _ = D.smooth_yearly(yearly_panel(spark, d), "year", "quarter", ["y_all", "y_whole"])
    return out.select("sector", "year", "quarter", F.round("y_all", 4).alias("y_all"))


@query("smooth_yearly_denton")
def _(spark, d):
    out, _ = D.smooth_yearly(yearly_panel(spark, d), "year", "quarter", ["y_all", "y_whole"], ["n_orders", "x_bal"])
    return out.select("sector", "year", "quarter", six("y_all").alias("y_all"), six("y_whole").alias("y_whole"))


@query("forecast_random_forest")
def _(spark, d):
    out, _ = N.random_forest(panel(spark, d), "sector", "period_enddate", "y")
    return out.withColumn("y_pred", six("y_pred"))


@query("champion_importance")
def _(spark, d):
    """Champions of the last four quarters among the forest, the ridge and the seasonal mean."""
    p = panel(spark, d)
    forest, weights = N.random_forest(p, "sector", "period_enddate", "y")
    others = O.walk_forward(p, [("ridge", "ridge", {"window": 8}), ("mean", "seasonal_mean", {})], "sector", "period_enddate", "y", n_test=4).select("sector", F.col("config").alias("model"), "y_true", "y_pred")
    every = others.unionByName(forest.select("sector", F.lit("random_forest").alias("model"), F.col("y").alias("y_true"), "y_pred"))
    best = first_rows(every.groupBy("sector", "model").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae")), "sector", [F.col("mae"), F.col("model")])
    return N.champion_importance(p, best, "sector", "period_enddate", "y", weights).withColumn("weight", six("weight"))
