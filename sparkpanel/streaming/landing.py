"""Incremental landing: files that are new since the last run are landed, once each, and told apart by name and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.keyed import KeyedTable


def file_name(path: Column) -> Column:
    """A path as the table keeps it: one slash after the scheme, however the reader writes it."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def source_files(spark: SparkSession, source: str, pattern: str = "*") -> DataFrame:
    """_source_file, _modified and path of the files below a folder whose names match; their contents are not read, and files of no bytes are passed over."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    return d.select(file_name(F.col("path")).alias("_source_file"), F.col("modificationTime").alias("_modified"), "path")


def new_files(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """The files that the manifest (_source_file, _modified) does not hold, or holds with another time; changed tells which."""
    if manifest is None:
        return files.withColumn("changed", F.lit(False))
    known = manifest.select("_source_file", F.col("_modified").alias("known"))
    d = files.join(known, "_source_file", "left").where("known IS NULL OR known <> _modified")
    return d.withColumn("changed", F.col("known").isNotNull()).drop("known")


def land_files(spark: SparkSession, source: str, schema: T.StructType, target: str, form: str = "parquet", pattern: str = "*", changed: str = "replace", transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64) -> int:
    """Land the new and changed files of `source` below `target`; returns their number.

    Rows carry the file they come from. A changed file's rows take the place of those landed before (changed="replace"), are
    left as landed ("keep") or are an error ("refuse"). The manifest is committed after the rows: a run that fails between
    the two lands the same files again, in the same place.
    """
    data, manifest = KeyedTable(spark, f"{target}/rows", "_source_file", buckets), KeyedTable(spark, f"{target}/files", "_source_file", buckets)
    new = new_files(source_files(spark, source, pattern), manifest.read())
    if changed == "keep":
        new = new.where("NOT changed")
    found = new.select("_source_file", "_modified", "path", "changed").collect()  # the files of one run, as a reader lists them
    if changed == "refuse" and (bad := [r["path"] for r in found if r["changed"]]):
        raise ValueError(f"files changed since they were landed: {bad[:5]}")
    if not found:
        return 0
    own = spark.createDataFrame([(r["_source_file"], r["_modified"]) for r in found], "_source_file string, _modified timestamp")
    rows = spark.read.format(form).schema(schema).load([r["path"] for r in found]).select("*", file_name(F.col("_metadata.file_path")).alias("_source_file"))
    data.replace(transform(rows) if transform else rows, own)
    manifest.replace(own)
    return len(found)


def landed(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows landed so far."""
    return KeyedTable(spark, f"{target}/rows", "_source_file").read()


def manifest(spark: SparkSession, target: str) -> DataFrame | None:
    """The files landed so far (_source_file, _modified)."""
    return KeyedTable(spark, f"{target}/files", "_source_file").read()


def stream_new_files(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, form: str = "parquet") -> int:
    """The same as a stream that ends when nothing is new: append the files that the checkpoint has not seen to a Parquet table; returns the batches run.

    A batch writes to its own folder of the table, so that a batch that is run again after a failure replaces what it wrote.
    """
    stream = spark.readStream.format(form).schema(schema).load(source).select("*", file_name(F.col("_metadata.file_path")).alias("_source_file"))

    def write(batch: DataFrame, epoch: int) -> None:
        out = batch.withColumn("batch_id", F.lit(epoch))
        (transform(out) if transform else out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
