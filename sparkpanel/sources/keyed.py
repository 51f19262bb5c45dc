"""A table whose rows are replaced by key, at any number of keys: hash buckets, versions and one commit for each change.

A change rewrites the buckets of its keys below a new version's folder; the others stay where they are. Then one small
file names the version of every bucket. Until that file has its name, readers see the version before, so a write that
fails leaves the table as it was. What is read is what the last commit names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import saved

BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        """buckets: folders of a version at most; fixed by the first commit."""
        self.spark, self.path, self.key, self.count = spark, path.rstrip("/"), key, buckets

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at(self.path).getFileSystem(conf), at

    def commits(self) -> list[int]:
        """Versions that can be read, oldest first."""
        fs, at = self._files()
        folder = at(f"{self.path}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self, version: int | None = None) -> dict | None:
        own = self.commits()
        version = version if version is not None else own[-1] if own else None
        if version is None:
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/commits/{version:08d}.json").first()[0])

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or one of its earlier versions; None before the first commit."""
        state = self._state(version)
        if state is None:
            return None
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/v{v:08d}/own_bucket={b}" for b, v in state["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, df: DataFrame, keys: DataFrame | None = None) -> int | None:
        """Put df in the place of all rows with its keys (or with the given ones, so that a key can lose all rows); returns the version."""
        state = self._state()
        count = state["count"] if state else self.count
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(count)).cast("int").alias("own_bucket")
        new = saved(df, "keyed")
        gone = new.select(self.key).distinct() if keys is None else keys.select(self.key).union(new.select(self.key)).distinct()
        touched = [r[0] for r in gone.select(bucket).distinct().collect()]  # at most `count` rows
        if not touched:
            return None
        version = state["version"] + 1 if state else 1
        old = self.read(buckets=touched)
        if old is not None:
            names = gone.withColumnRenamed(self.key, "gone_key")
            new = old.join(names, old[self.key].eqNullSafe(names["gone_key"]), "left_anti").unionByName(new)
        folder = f"{self.path}/v{version:08d}-{uuid.uuid4().hex}"
        # rebalancing splits what a frequent key makes too large for one task
        new.select("*", bucket).hint("rebalance", "own_bucket").write.partitionBy("own_bucket").parquet(folder)
        self._commit(folder, version, touched, state, new.schema, count)
        return version

    def _commit(self, folder: str, version: int, touched: list[int], state: dict | None, schema: T.StructType, count: int) -> None:
        fs, at = self._files()
        if fs.exists(at(f"{self.path}/commits/{version:08d}.json")):
            raise ValueError(f"version {version} was committed by another writer")
        kept = {b: v for b, v in (state["buckets"] if state else {}).items() if int(b) not in touched}
        full = {str(b): version for b in touched if fs.exists(at(f"{folder}/own_bucket={b}"))}
        if not fs.rename(at(folder), at(f"{self.path}/v{version:08d}")):
            raise ValueError(f"version {version} is being written by another writer")
        text = json.dumps({"version": version, "count": count, "key": self.key, "buckets": kept | full, "schema": json.loads(schema.json())})
        part = at(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, at(f"{self.path}/commits/{version:08d}.json")):
            raise ValueError(f"version {version} was committed by another writer")

    def vacuum(self, keep: int = 1) -> None:
        """Remove what only versions before the last `keep` name."""
        own = self.commits()
        fs, at = self._files()
        needed = {(int(b), v) for n in own[-keep:] for b, v in self._state(n)["buckets"].items()}
        for n in own[:-keep]:
            fs.delete(at(f"{self.path}/commits/{n:08d}.json"), False)
        for n in own:
            folder = at(f"{self.path}/v{n:08d}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                name = s.getPath().getName()
                if name.startswith("own_bucket=") and (int(name.removeprefix("own_bucket=")), n) not in needed:
                    fs.delete(s.getPath(), True)
