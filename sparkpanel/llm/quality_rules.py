"""Quality rules: base rules on words, lines and repeats, and divergence from a language's reference histograms.

Two histograms are taken of each document: seven classes of characters, and the counts of each of 63 common words of
four languages and of all other words. The reference of a language is the sum of the histograms of the documents that
state it, without the one that is judged; it counts from `min_docs` others on. A document is compared with the
references of its own language and of the four by Jensen-Shannon distance (base 2, 0 to 1), of which the smallest
counts, as a document may hold another language than it states; below a guard of length the distance says nothing and
is not used.

Edge cases: a null or blank text has no words, fails the base rule and has null distances; a null language is a
language of its own; repeated rows are judged each by itself; a very long text is one row of a task and its counts are
whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, row_key, whole_text, without

#: Common words by language; fixed values.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "with", "on", "as", "by", "be", "are", "this"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein"],
    "es": ["el", "los", "las", "y", "del", "se", "por", "con", "para", "su", "al", "lo", "como", "más", "una", "no"],
}
SYMBOLS = "#*$%&|<>"
PARAMS = {"min_words": 10, "max_repeat_pct": 20, "guard_chars": 500, "guard_words": 80, "max_char_js": 0.22, "max_word_js": 0.27, "min_docs": 20}
#: ASCII classes of characters besides white space and SYMBOLS; what is neither nor non-ASCII is `other`.
CLASSES = {"digit": "[0-9]", "punct": "[.,;:!?'\"()-]", "upper": "[A-Z]"}
CHARS = ["space", "symbol", *CLASSES, "wide", "other"]
WORDS = sorted({w for v in COMMON.values() for w in v})


def _times(text: Column, what: str) -> Column:
    """How often a single ASCII character stands in text."""
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and both histograms: chars by CHARS, commons by WORDS and then all other words."""
    total = lambda cols: sum(cols[1:], cols[0])
    d = docs.select("doc_id", docs["lang"].cast("string").alias("lang"), whole_text(docs).alias("t"))
    d = d.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    window = lambda i: F.xxhash64(F.slice("words", i, 5))
    d = d.withColumn("h", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(1), (F.col("n_words") - 4).cast("int")), window)))
    # sorted only where a window occurs twice at all
    twice = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(F.get("s", j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("s", j + 1)["h"] == e["h"], F.lit(False))
    d = d.withColumn("p", F.array_sort(F.transform(F.filter("s", same), lambda e: e["i"])))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("p", k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = d.withColumn("lines", lines)
    # common words, each between blanks of its own, so that they can be counted in one string
    d = d.withColumn("common", F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(WORDS)), "  "), F.lit(" ")))
    t, often = F.col("t"), lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    d = d.select(
        "doc_id", "lang", "n_words",
        total([_times(t, c) for c in " \t\n\x0b\x0c\r"]).cast("long").alias("space"),
        total([_times(t, c) for c in SYMBOLS]).cast("long").alias("symbol"),
        *[F.regexp_count(t, F.lit(rx)).cast("long").alias(c) for c, rx in CLASSES.items()],
        F.regexp_count(t, F.lit("[^\\x00-\\x7F]")).cast("long").alias("wide"),
        F.length(t).cast("long").alias("n_chars_all"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform(F.array(*[F.lit(w) for w in WORDS]), lambda w: ((F.length("common") - F.length(F.replace("common", often(w), F.lit("")))) / (F.length(w) + 2)).cast("long")).alias("named"),
    )
    d = d.withColumn("other", F.col("n_chars_all") - total([F.col(c) for c in CHARS[:-1]]))
    return d.select(
        "doc_id", "lang", "n_words", "n_chars_all", "space", "symbol", "n_dup_lines", "n_repeat_words", F.array(*CHARS).alias("chars"),
        F.concat("named", F.array(F.col("n_words") - F.aggregate("named", F.lit(0).cast("long"), lambda a, x: a + x))).alias("commons"),
    )


def references(saved: DataFrame) -> DataFrame:
    """r_lang, docs, n_chars, n_words and the summed histograms r_chars and r_commons of each language."""
    split = saved.select("lang", F.posexplode(F.concat("chars", "commons")).alias("i", "n")).where("n > 0")
    sums = split.groupBy("lang", "i").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    at = lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))
    part = lambda first, n: F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), at)
    sums = sums.select(F.col("lang").alias("of"), part(0, len(CHARS)).alias("r_chars"), part(len(CHARS), len(WORDS) + 1).alias("r_commons"))
    count = saved.groupBy(F.col("lang").alias("r_lang")).agg(F.count("*").alias("docs"), F.sum("n_chars_all").alias("n_chars"), F.sum("n_words").alias("n_words"))
    return count.join(sums, F.col("r_lang").eqNullSafe(F.col("of"))).drop("of")


def _least(refs: str, own: str, n: Column, total: str, bins: str) -> Column:
    """Smallest Jensen-Shannon distance of the counts in own (n in all) from the references, from which the row itself is left out."""

    def distance(r: Column) -> Column:
        m = r[total] - r["mine"] * n

        def part(x: Column, y: Column) -> Column:
            a, b = x / n, (y - r["mine"] * x) / m
            # a bin that the document lacks adds the reference's share, and all shares add up to 1
            own = a * F.log2(2 * a / (a + b)) - b
            return F.when(x > 0, own + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)).otherwise(0.0)

        total_of = F.aggregate(F.zip_with(F.col(own), r[bins], part), F.lit(1.0), lambda s, x: s + x)
        return F.when(m > 0, F.sqrt(F.greatest(F.lit(0.0), total_of / 2)))

    return F.when(n > 0, F.round(F.array_min(F.transform(refs, distance)), 6))


def quality_rules(docs: DataFrame, **params) -> DataFrame:
    """One row per row of docs (doc_id, lang, text): counts, distances, base_failed and kept."""
    p, spark = PARAMS | params, docs.sparkSession
    scratch = Scratch(spark, "quality")
    saved = scratch.save(features(docs))
    known = scratch.save(references(saved).where(F.col("docs") > p["min_docs"]))
    one = F.struct("r_lang", "docs", "n_chars", "n_words", "r_chars", "r_commons")
    # one row of at most four references for all, and a row's own language if it is another
    four = known.where(F.col("r_lang").isin(list(COMMON))).agg(F.collect_list(one).alias("four"))
    more = known.where(~F.coalesce(F.col("r_lang").isin(list(COMMON)), F.lit(False))).select(one.alias("own_ref"), F.lit(True).alias("has"), F.col("r_lang").alias("own_lang"))
    d = saved.crossJoin(F.broadcast(four)).join(more, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    mine = lambda r: F.struct(r["n_chars"].alias("n_chars"), r["n_words"].alias("n_words"), r["r_chars"].alias("r_chars"), r["r_commons"].alias("r_commons"), r["r_lang"].eqNullSafe(F.col("lang")).cast("long").alias("mine"))
    d = d.withColumn("refs", F.transform(F.when(F.col("has"), F.concat("four", F.array("own_ref"))).otherwise(F.col("four")), mine))
    d = d.select(
        "doc_id", "n_words", (F.col("n_chars_all") - F.col("space")).alias("word_chars"), F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < p["min_words"]) | (100 * F.col("n_repeat_words") > p["max_repeat_pct"] * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("n_chars_all") >= p["guard_chars"], _least("refs", "chars", F.col("n_chars_all"), "n_chars", "r_chars")).alias("char_js"),
        F.when(F.col("n_words") >= p["guard_words"], _least("refs", "commons", F.col("n_words"), "n_words", "r_commons")).alias("word_js"),
    )
    far = F.coalesce(F.col("char_js") > p["max_char_js"], F.lit(False)) | F.coalesce(F.col("word_js") > p["max_word_js"], F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """docs without the rows that the rules reject."""
    key = row_key(docs, "doc_id", "text", "lang")
    judged = quality_rules(docs.select(key.alias("doc_id"), "text", "lang"), **params)
    bad = Scratch(docs.sparkSession, "quality").save(judged.where(~F.col("kept")).select("doc_id").distinct())
    return without(docs, key, bad)


def _sql() -> str:
    quote = lambda words: ", ".join(f"'{w}'" for w in words)
    space = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    count = lambda rx: f"length(t) - length(regexp_replace(t, '{rx}', '', 'g'))"

    def distance(own: str, n: str, ref: str, m: str) -> str:
        a, b, rest = f"(d.{own}[i]::DOUBLE / d.{n})", f"((r.{ref}[i] - mine * d.{own}[i])::DOUBLE / (r.{m} - mine * d.{n}))", f"r.{m} - mine * d.{n} > 0 AND d.{n} > 0"
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({a} + {b})) ELSE 0 END"
        return f"CASE WHEN {rest} THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len(d.{own}) + 1), lambda i: {term(a)} + {term(b)})) / 2)) END"

    return f"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: trim(x, {space}) <> '') AS lines
  FROM raw),
windows AS (
  SELECT rid, i, words[i:i + 4] AS win
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM split)),
flagged AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM flagged) GROUP BY rid),
counts AS (
  SELECT s.rid, s.doc_id, s.lang, len(words)::BIGINT AS n_words, length(t)::BIGINT AS n_all,
         {count("[ \t-\r]")} AS space, {count("[#*$%&|<>]")} AS symbol, {count("[0-9]")} AS digit,
         {count("[.,;:!?''\x22()-]")} AS punct, {count("[A-Z]")} AS upper, {count("[^\x00-\x7F]")} AS wide,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         list_transform([{quote(WORDS)}], lambda w: len(list_filter(words, lambda x: x = w))) AS named
  FROM split s LEFT JOIN covered c ON s.rid = c.rid),
feat AS (
  SELECT *, [space, symbol, digit, punct, upper, wide, n_all - space - symbol - digit - punct - upper - wide] AS chars,
         list_append(named, n_words - list_sum(named)) AS commons FROM counts),
refs AS (
  SELECT lang AS r_lang, count(*) AS docs, sum(n_all) AS m_all, sum(n_words) AS m_words,
         [{", ".join(f"sum(chars[{i + 1}])" for i in range(len(CHARS)))}] AS r_chars, [{", ".join(f"sum(commons[{i + 1}])" for i in range(len(WORDS) + 1))}] AS r_commons
  FROM feat GROUP BY lang HAVING count(*) > {PARAMS["min_docs"]}),
near AS (
  SELECT rid, min(char_js) AS char_js, min(word_js) AS word_js FROM (
    SELECT d.rid, {distance("chars", "n_all", "r_chars", "m_all")} AS char_js, {distance("commons", "n_words", "r_commons", "m_words")} AS word_js
    FROM (SELECT d.*, r.*, (d.lang IS NOT DISTINCT FROM r.r_lang)::INT AS mine FROM feat d JOIN refs r ON r.r_lang IN ({quote(COMMON)}) OR d.lang IS NOT DISTINCT FROM r.r_lang) AS d, LATERAL (SELECT d.r_chars, d.r_commons, d.m_all, d.m_words) AS r)
  GROUP BY rid),
judged AS (
  SELECT d.doc_id, d.n_words, (d.n_all - d.space)::BIGINT AS word_chars, d.symbol::BIGINT AS n_symbols, d.n_dup_lines, d.n_repeat_words,
         (d.n_words < {PARAMS["min_words"]} OR 100 * d.n_repeat_words > {PARAMS["max_repeat_pct"]} * d.n_words) AS base_failed,
         CASE WHEN d.n_all >= {PARAMS["guard_chars"]} THEN round(n.char_js, 6) END AS char_js,
         CASE WHEN d.n_words >= {PARAMS["guard_words"]} THEN round(n.word_js, 6) END AS word_js
  FROM feat d LEFT JOIN near n USING (rid))
SELECT *, NOT base_failed AND NOT coalesce(char_js > {PARAMS["max_char_js"]}, false) AND NOT coalesce(word_js > {PARAMS["max_word_js"]}, false) AS kept
FROM judged"""


SQL = _sql()
