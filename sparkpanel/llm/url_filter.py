"""URL filters: host-suffix and path-prefix expressions, matched to rules by hash prefix and then by full digest.

A rule is (host, path, verdict). It fits its host and every subdomain if the URL's path starts with the rule's; the
longest fitting rule (characters of host and path; then the smaller text) wins. Each distinct URL is expanded into the
expressions "host suffix + path prefix" for the lengths that the rules' paths have, so the number of expressions a URL
has is bounded by its labels times the rules' distinct path lengths. The first eight hex digits of an expression's
SHA-256 are joined with those of the rules, and the whole digest is compared on the few rows that meet.

Edge cases: a null URL or one without "://" has empty host and path, no rule and the default verdict; repeated rows and
repeated page ids are judged each by itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: (host, path, verdict). Fixed values.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Used where none of the rules fits.
OWN_RULES = [("spam-farm.example.com", "/", "block"), ("spam-farm.example.net", "/", "block"), ("spam-farm.example.org", "/", "block"), ("cheap-pills.example.com", "/", "block"), ("cheap-pills.example.net", "/", "block"), ("cheap-pills.example.org", "/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: DataFrame | list | tuple) -> DataFrame:
    """rule, verdict, size of the path and the rule's digests; rules: a table (host, path, verdict) of any size, or a short list."""
    r = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    r = r.select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("size"))
    return r.withColumn("full", F.sha2("rule", 256)).withColumn("short", F.substring("full", 1, 8))


def best_rule(urls: DataFrame, rules: DataFrame | list | tuple) -> DataFrame:
    """url, rule (host + path), verdict of the winning rule, for those of the distinct urls (url, host, path) that have one."""
    r = rule_table(urls.sparkSession, rules)
    # a row for each length of a path; an empty table has none
    sizes = sorted(x[0] for x in r.select("size").distinct().collect())
    lengths = F.array(*[F.lit(n) for n in sizes]).cast("array<int>")
    e = urls.withColumn("labels", F.split("host", "\\."))
    e = e.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    e = e.withColumn("suffix", F.array_join(F.slice("labels", F.col("i"), F.size("labels")), "."))
    e = e.withColumn("n", F.explode(lengths)).where(F.length("path") >= F.col("n"))
    e = e.select("url", F.sha2(F.concat("suffix", F.substring("path", F.lit(1), F.col("n"))), 256).alias("e_full"))
    hit = e.withColumn("short", F.substring("e_full", 1, 8)).join(r, "short").where(F.col("e_full") == F.col("full"))
    return hit.groupBy("url").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "rule", "verdict")).alias("best")).select("url", "best.*")


def url_filter(pages: DataFrame, rules: DataFrame | list | tuple = tuple(RULES), own_rules: DataFrame | list | tuple = tuple(OWN_RULES), default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, own_rule and verdict of each row of pages (page_id, url)."""
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", pages["url"].cast("string").alias("url"))
    plain = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    with_host = p.where(plain)
    urls = with_host.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    first, second = best_rule(urls, rules), best_rule(urls, own_rules).toDF("url", "own_rule", "own_verdict")
    # both verdicts of a URL in one row, so that pages are joined once; rows without a host, which may be many, are not
    both = first.join(second, "url", "full")
    d = with_host.join(both, "url", "left").select("page_id", "url", "rule", "own_rule", "verdict", "own_verdict")
    none = F.lit(None).cast("string")
    rest = p.where(~plain).select("page_id", "url", none.alias("rule"), none.alias("own_rule"), none.alias("verdict"), none.alias("own_verdict"))
    return d.unionByName(rest).select("page_id", host.alias("host"), path.alias("path"), "rule", "own_rule", F.coalesce("verdict", "own_verdict", F.lit(default)).alias("verdict"))


def _sql() -> str:
    values = lambda rules: ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    best = lambda name: f"""
  SELECT u.url, arg_min({{'rule': r.h || r.p, 'verdict': r.v}}, (-length(r.h || r.p), r.h || r.p)) AS b FROM u JOIN {name} r
  ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.url"""  # noqa: E731
    return f"""
WITH rules(h, p, v) AS (VALUES {values(RULES)}), own(h, p, v) AS (VALUES {values(OWN_RULES)}),
rest AS (SELECT page_id, url, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
u AS (SELECT DISTINCT url, host, path FROM parts WHERE contains(url, '://')),
b1 AS ({best("rules")}), b2 AS ({best("own")})
SELECT page_id, host, path, b1.b.rule AS rule, b2.b.rule AS own_rule, coalesce(b1.b.verdict, b2.b.verdict, 'allow') AS verdict
FROM parts LEFT JOIN b1 ON parts.url = b1.url LEFT JOIN b2 ON parts.url = b2.url"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = _sql()
