"""What the corpus operators share: tables, the shared scratch folder and saved steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rule of the contracts names it: blank and \t to \r.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes up to which a table is dealt out anew: a small file may be one row group, which one task would read and work on alone.
SMALL_TABLE = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_TABLE
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; sets one where it is unset (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sparkpanel-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that a query writes to the shared folder to cut lineage; each can be dropped when it is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, shared_dir(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and read it again; the plan behind the result is one scan."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps; it acts when the driver collects garbage."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole_text(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def row_key(df: DataFrame, *columns: str) -> Column:
    """128 bits that tell rows apart by these columns; nulls differ from empty strings."""
    return F.md5(F.to_json(F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}))


def without(df: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """df without the rows whose key is in bad (one column), whatever the names of its columns are."""
    names = [f"x{i}" for i in range(len(df.columns))]
    d = df.select(key.alias("own_key"), *[df[c].alias(x) for c, x in zip(df.columns, names, strict=True)])
    d = semi(d, bad.toDF("own_key"), ["own_key"], "left_anti")
    return d.select(*[F.col(x).alias(c) for c, x in zip(df.columns, names, strict=True)])


#: Keys (a few numbers each, some 100 bytes in a hash table) that are sent to all tasks at most; more are joined by a shuffle.
SEND = 250_000


def semi(docs: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """docs with (left_semi) or without (left_anti) these keys; only keys whose number is known to be small are broadcast."""
    return docs.join(F.broadcast(keys) if keys.count() <= SEND else keys, on, how)
