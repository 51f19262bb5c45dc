"""Scans and sinks of raw files, predictions and reports."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import group_label
from ..operators.reshape import META

_TEXT, _DATE, _NUMBER = T.StringType(), T.DateType(), T.DoubleType()
CANONICAL = T.StructType(
    [T.StructField(n, t) for n, t in (("model_name", _TEXT), ("sector_code", _TEXT), ("origin_date", _DATE), ("target_date", _DATE), ("horizon", T.IntegerType()), ("y_true", _NUMBER), ("y_pred", _NUMBER))]
    + [T.StructField(n, _NUMBER) for n in ("y_lower_80", "y_upper_80", "y_lower_95", "y_upper_95")]
)


def star_scan(spark: SparkSession, folder: str, table_id: str, schema: T.StructType | None = None, lines: bool = False) -> dict[str, DataFrame]:
    """Tables of a raw folder: TypedDataSet.json becomes <id>_fact, any other name <id>_dim_<name>.

    A name is a file with an array or, with lines set, a file or a folder of files with an object per line. Names are
    listed by Spark, so any store will do.
    """
    reader, top = spark.read.option("multiLine", not lines), urlsplit(folder).path.rstrip("/")
    found = spark.read.format("binaryFile").options(pathGlobFilter="*.json", recursiveFileLookup=True).load(folder)
    names = found.select(F.split_part(F.split_part("path", F.lit(top + "/"), F.lit(2)), F.lit("/"), F.lit(1)).alias("name")).distinct()
    out = {}
    for name in sorted(r["name"] for r in names.collect()):
        stem = name.removesuffix(".json")
        fact = stem == "TypedDataSet"
        out[f"{table_id}_fact" if fact else f"{table_id}_dim_{stem}"] = (reader.schema(schema) if schema and fact else reader).json(f"{folder}/{name}")
    return out


def primary_key(columns: list[str]) -> str | None:
    return next((c for c in ("ID", "Key", "DimensionKey") if c in columns), None)


def trim_and_stamp(df: DataFrame, name: str) -> DataFrame:
    """Text trimmed, bronze_pk = name and key joined, and the source file; tables without a key are left out (None)."""
    key = primary_key(df.columns)
    if key is None:
        return None
    trimmed = df.select(*[F.trim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])
    return trimmed.withColumns({"bronze_pk": F.concat_ws("_", F.lit(name), F.col(key).cast("string")), "_source_file": F.lit(name)})


def column_types(df: DataFrame) -> dict[str, str]:
    """int, float or string per column."""
    kind = lambda t: "int" if isinstance(t, T.IntegralType) else "float" if isinstance(t, (T.FractionalType, T.DecimalType)) else "string"
    return {f.name: kind(f.dataType) for f in df.schema}


def sql_query(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    """Run SQL on named tables."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def list_tables(spark: SparkSession, suffix: str, active: set[str]) -> list[str]:
    """Tables of the catalog that end in the suffix and are active."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.endswith(suffix) and t.name.removesuffix(suffix) in active)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", types: dict[str, str] | None = None) -> None:
    df.select(*[F.col(c).cast((types or {}).get(c)).alias(c) if c in (types or {}) else F.col(c) for c in df.columns]).write.mode(mode).parquet(path)


def full_refresh(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Replace the table with the declared columns; NaN becomes null."""
    value = lambda f: F.when(~F.isnan(f.name), F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    df.select(*[(value(f) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header, as Parquet and as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        df.write.mode("overwrite").json(f"{path}/{name}.json")


def write_catalog(steps: DataFrame, groups: DataFrame, path: str) -> None:
    """One JSON document of the filter steps (step, filter, feature, score, retained) and the groups (group, columns)."""
    s = steps.groupBy("step", "filter").agg(F.array_sort(F.collect_list(F.when(F.col("retained"), F.col("feature")))).alias("retained"), F.array_sort(F.collect_list(F.when(~F.col("retained"), F.col("feature")))).alias("dropped"))
    s = s.agg(F.array_sort(F.collect_list(F.struct("step", "filter", "retained", "dropped"))).alias("steps"))
    g = groups.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "columns")))).alias("groups"))
    s.crossJoin(g).select(F.to_json(F.struct("steps", "groups")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_catalog(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Groups of a catalog, with all_survivors and an empty structural_only; the catalog is one small document."""
    row = spark.read.schema("groups map<string, array<string>>, steps array<struct<step:int,retained:array<string>>>").json(path).first()
    if row is None or row["groups"] is None:
        return {"all_survivors": [], "structural_only": []}
    last = max(row["steps"] or [], key=lambda s: s["step"], default=None)
    return dict(row["groups"]) | {"all_survivors": list(last["retained"]) if last else sorted({c for v in row["groups"].values() for c in v}), "structural_only": []}


def to_canonical(df: DataFrame) -> DataFrame:
    """The canonical columns with their types; a missing bound is null, any other missing column an error."""
    need = [f.name for f in CANONICAL if not f.name.startswith(("y_lower", "y_upper"))]
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL])


def canonical_scan(spark: SparkSession, path: str) -> DataFrame:
    return to_canonical(spark.read.parquet(path))


def external_predictions(df: DataFrame, names: dict[str, str], model: str, horizon: int) -> DataFrame:
    """Predictions under other names: constant horizon, origin one quarter end before the target."""
    d = df.select(*[F.col(a).alias(b) for a, b in names.items()])
    return d.select(F.lit(model).alias("model_name"), "sector_code", F.last_day(F.add_months("target_date", -3)).alias("origin_date"), "target_date", F.lit(horizon).alias("horizon"), "y_true", "y_pred")


def resolve_predictions(df: DataFrame) -> DataFrame:
    """Alternative names resolved, fold_set outer where it is missing, absolute error added."""
    d = df.withColumnsRenamed({a: b for a, b in {"fold_origin_date": "origin_date", "horizon_step": "horizon"}.items() if a in df.columns and b not in df.columns})
    d = d.withColumn("fold_set", F.coalesce("fold_set", F.lit("outer")) if "fold_set" in d.columns else F.lit("outer"))
    return d.withColumn("_ae", F.abs(F.col("y_true") - F.col("y_pred")))


def runs(df: DataFrame) -> DataFrame:
    """Tidy runs: label of the feature groups, metric as double; runs without the metric go."""
    return df.select("model_family", group_label(F.col("groups")).alias("feature_group"), "sector", F.col("mase").try_cast("double").alias("mase")).where("mase IS NOT NULL")


def is_meta(column: str) -> bool:
    return bool(META.search(column))
