"""Corpus pipeline: quality rules, near-duplicate removal, passage removal, benchmark decontamination, packing.

Each stage takes what the stage before it kept, as a table of its own; all but the last return the columns of documents.
Rows are told apart by doc_id and text, so repeated ids and nulls do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm.common import Scratch, table
from sparkpanel.llm.decontamination import decontaminate
from sparkpanel.llm.ngram_join import one_of_each
from sparkpanel.llm.packing import pack
from sparkpanel.llm.quality_rules import keep_good
from sparkpanel.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by 0.8 of five-word shingles: the one of smallest doc_id."""
    return one_of_each(docs, 5, 80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document of nothing else goes."""
    d = substring_dedup(docs, carry=tuple(docs.columns))
    cut = F.size("spans") > 0
    names = [f"x{i}" for i in range(len(docs.columns))]
    d = d.toDF("own_id", "own_text", "n_units", "spans", "kept", *names).where(~cut | (F.octet_length("kept") > 0))
    text = F.when(cut, F.col("kept").cast("string")).otherwise(F.col(names[docs.columns.index("text")]))
    count = F.when(cut, F.length(F.col("kept").cast("string")).cast("long")).otherwise(F.col(names[docs.columns.index("n_chars")]))
    new = {"text": text, "n_chars": count}
    return d.select(*[new.get(c, F.col(x)).alias(c) for c, x in zip(docs.columns, names, strict=True)])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", passages), ("benchmark_decontamination", benchmark), ("best_fit_packing", packing)]

#: SQL can't run the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
