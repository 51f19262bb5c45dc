"""Sharding along a Hilbert curve over metadata, cut into runs of equal row counts.

Language, source and size are quantised to 16 steps each: the values of language and source in their order, with equal
shares of the rows in a step as far as single values allow, sizes by their logarithm. The cell's place on the Hilbert
curve orders the rows, then the text's checksum (inside a cell copies stand together), then a hash of the id, then the
id. Readers that filter on any of the dimensions can skip shards by their ranges. The law is `rows`: shard counts are
at most one apart.

The global rank is taken without one sorted partition: rows are counted by cell, checksum and 12 bits of the id's hash,
and the counts summed up in three steps, inside ranges of checksums (1024 to a cell), over the ranges of a cell, and over
the cells (at most 4096). Copies of one text that fill a third of the table are spread over thousands of buckets. The
steps of values are taken alike, inside range partitions and over these.

Edge cases: null language and source quantise as empty strings, a null text has size 1 and checksum 0; rows equal in
all of it are ranked in any order, which makes no difference to the result as a set of rows; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEND, Scratch, whole_text

BITS, DIMS = 4, 3


def hilbert_table(bits: int = BITS, dims: int = DIMS) -> list[int]:
    """Place on the Hilbert curve of each cell, the first dimension in the highest bits (Skilling's transpose rule)."""

    def place(cell: int) -> int:
        x = [(cell >> bits * (dims - 1 - d)) & ((1 << bits) - 1) for d in range(dims)]
        q = 1 << (bits - 1)
        while q > 1:
            for i in range(dims):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        t, q = 0, 1 << (bits - 1)
        while q > 1:
            if x[dims - 1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        return sum(((x[d] >> b) & 1) << (b * dims + dims - 1 - d) for b in range(bits) for d in range(dims))

    return [place(c) for c in range(1 << bits * dims)]


def before(w: Window) -> Column:
    """Sum of n over the rows before in the window's order."""
    return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def value_steps(values: DataFrame, scratch: Scratch, steps: int = 1 << BITS) -> DataFrame:
    """v and its step q, in the order of the values, so that steps hold equal shares of the rows as far as single values allow; values: v, one row each."""
    d = values.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange("v")
    d = scratch.save(d.withColumn("part", F.spark_partition_id()))
    parts = d.groupBy("part").agg(F.sum("n").alias("n"))  # as many rows as partitions
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    d = d.withColumn("own_start", before(Window.partitionBy("part").orderBy("v"))).join(parts, "part")
    middle = F.col("part_start") + F.col("own_start") + F.col("n") / 2
    return scratch.save(d.select("v", F.floor(middle * steps / F.col("total")).cast("int").alias("q")))


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of each row of docs (doc_id, text, lang, source)."""
    text, scratch = whole_text(docs), Scratch(docs.sparkSession, "hilbert")
    value = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), value("lang").alias("v0"), value("source").alias("v1"))
    for k, c in enumerate(("lang", "source")):
        known = value_steps(docs.select(value(c).alias("v")), scratch).toDF(f"v{k}", f"q{k}")
        d = d.join(F.broadcast(known) if known.count() <= SEND else known, f"v{k}")
    q2 = F.greatest(F.lit(0), F.least(F.lit(15), F.floor(F.log2(F.col("size").cast("double")) - 4))).cast("int")
    curve = F.array(*[F.lit(v) for v in hilbert_table()])
    d = d.withColumn("cell", F.get(curve, F.col("q0") * 256 + F.col("q1") * 16 + q2)).withColumn("mix", F.xxhash64("doc_id"))
    d = d.withColumns({"range": F.shiftright("text_crc32", 22), "salt": F.shiftrightunsigned("mix", 52)}).drop("v0", "v1", "q0", "q1")
    fine, coarse = ["cell", "range", "text_crc32", "salt"], ["cell", "range"]
    fines = d.groupBy(*fine).agg(F.count("*").alias("n"))
    ranges = fines.groupBy(*coarse).agg(F.sum("n").alias("n"))
    cells = ranges.groupBy("cell").agg(F.sum("n").alias("n"))
    cells = cells.select("cell", before(Window.orderBy("cell")).alias("cell_start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    ranges = ranges.select(*coarse, before(Window.partitionBy("cell").orderBy("range")).alias("range_start")).join(cells, "cell")
    fines = fines.select(*fine, before(Window.partitionBy(*coarse).orderBy("text_crc32", "salt")).alias("fine_start")).join(ranges, coarse)
    starts = fines.select(*fine, (F.col("cell_start") + F.col("range_start") + F.col("fine_start")).alias("start"), "total")
    r = d.withColumn("k", F.row_number().over(Window.partitionBy(*fine).orderBy("mix", "doc_id")) - 1).join(starts, fine)
    r = r.withColumn("rank", F.col("start") + F.col("k"))
    r = r.withColumn("shard", F.expr(f"rank * {shards} div total").cast("int"))
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return r.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve"),
    )
