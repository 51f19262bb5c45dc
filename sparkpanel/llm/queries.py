"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hilbert_shards, license_scan, ngram_join, packing, periodic_runs, quality_rules, spelling, substring_dedup, suffix_dedup, token_files, toxicity, url_filter
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _removed():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n_units").alias("n_bytes"), _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n_units").alias("n_words"), _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), misspell=31)
    return spelling.spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs.find_runs(periodic_runs.plant_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    length = -F.col("b.less")
    exponent = F.floor(1000 * length / F.col("b.period")).alias("exponent_milli")
    return d.select("doc_id", "n_runs", "b.start", length.alias("length"), "b.period", exponent, "runs_sha256", "collapsed_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_suffix_dedup, op4_ngram_jaccard_join, op5_quality_rules, op6_url_filter, op7_decontamination, op8_substring_dedup, op9_token_files, op10_hilbert_shards, op11_spelling_variants, op12_periodic_runs, op13_toxicity)}
ORACLES = {"op1_license_scan": license_scan.SQL, "op4_ngram_jaccard_join": ngram_join.SQL, "op5_quality_rules": quality_rules.SQL, "op6_url_filter": url_filter.SQL, "op7_decontamination": decontamination.SQL}
