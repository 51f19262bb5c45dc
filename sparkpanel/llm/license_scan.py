"""License scans by a positional index of rare words.

Templates are the openings and key clauses of licence texts and notices; their words that are rare in ordinary prose, at
their places, are mandatory. One pass over the texts keeps, per document, the places of such words only. The words'
inverse document frequencies over all documents name each template's rarest word, by which it stands in the index: a
document's words are looked up there, which gives its candidate templates. The postings of a candidate's words, each
shifted by the word's place in the template, are intersected from the rarest word on, which leaves the starts where every
mandatory word stands at its place. Optional words at their places raise the score.

Edge cases: a null or empty text has no words, empty label strings and score 0; repeated rows are scanned each by
itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, ascii_lower, whole_text

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def clause(text: str) -> list[tuple[int, str]]:
    """(place, word) of the words of a clause; _ stands for any word."""
    return [(i, w) for i, w in enumerate(text.split()) if w != "_"]


#: label: mandatory words. Base labels count towards n_base. Fixed values.
BASE = {"apache": clause("apache license"), "gpl": clause("general public license"), "mit": clause("mit license")}
#: label: mandatory words, optional words as (place, word).
MORE = {
    "agpl": (clause("affero general public license"), [(-1, "gnu")]),
    "apache-2.0": (clause("apache license version 2 0"), [(-3, "licensed")]),
    "apache-2.0-notice": (clause("licensed _ _ apache license version 2 0 _ license _ _ _ _ _ file except _ compliance"), []),
    "bsd": (clause("redistribution _ _ _ source _ binary forms"), [(11, "modification"), (13, "permitted"), (18, "conditions")]),
    "cc-by": (clause("licensed _ cc"), [(3, "by")]),
    "cc-by-nc": (clause("cc by nc"), [(-2, "licensed"), (3, "4"), (4, "0")]),
    "cc-by-text": (clause("licensed _ _ creative commons attribution"), [(6, "4"), (7, "0"), (8, "international")]),
    "gpl-3.0": (clause("general public license version 3"), [(-1, "gnu")]),
    "gpl-notice": (clause("redistribute _ _ _ modify _ _ _ terms _ _ gnu general public license _ published"), [(19, "free"), (20, "software"), (21, "foundation")]),
    "isc-text": (clause("permission _ _ copy modify _ _ distribute _ software _ _ purpose _ _ _ fee _ hereby granted"), []),
    "lgpl": (clause("lesser general public license"), [(-1, "gnu")]),
    "mit-text": (clause("permission _ hereby granted _ _ charge"), [(4, "free"), (10, "obtaining"), (12, "copy"), (15, "software"), (17, "associated"), (18, "documentation"), (19, "files")]),
    "mit-warranty": (clause("software _ provided _ _ without warranty _ _ kind"), [(10, "express"), (12, "implied")]),
    "mpl": (clause("mozilla public license"), [(3, "version")]),
    "mpl-2.0-notice": (clause("source code form _ subject _ _ terms _ _ mozilla public license"), [(14, "2"), (15, "0")]),
    "unlicense": (clause("_ _ _ unencumbered software"), [(2, "and"), (8, "public"), (9, "domain")]),
    "zlib-text": (clause("software _ provided _ _ without _ express _ implied warranty"), []),
}
TEMPLATES = {k: (v, []) for k, v in BASE.items()} | MORE
VOCABULARY = sorted({w for need, more in TEMPLATES.values() for _, w in need + more})


def rare_word_hits(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and hits: array of (p, w), the places of vocabulary words."""
    d = docs.select("doc_id", F.regexp_extract_all(ascii_lower(whole_text(docs)), F.lit(WORD), 0).alias("words"))
    hit = lambda w, i: F.when(w.isin(VOCABULARY), F.struct(i.alias("p"), w.alias("w")))
    return d.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(F.transform("words", hit)).alias("hits"))


def word_idf(hits: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each vocabulary word; at most len(VOCABULARY) rows come to the driver."""
    counts = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").count()
    n, seen = hits.count(), {r["w"]: r["count"] for r in counts.collect()}
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) for w in VOCABULARY}


def _places(word: str, shift: int) -> Column:
    """Starts that a word's places stand for."""
    return F.transform(F.filter("hits", lambda x: x["w"] == word), lambda x: x["p"] - F.lit(shift))


def rarest_first(need: list[tuple[int, str]], idf: dict[str, float]) -> list[tuple[int, str]]:
    return sorted(need, key=lambda x: (-idf[x[1]], x))


def candidates(idf: dict[str, float]) -> Column:
    """Labels of the templates whose rarest word is among a document's hits, from an index of these words."""
    index: dict[str, list[str]] = {}
    for label, (need, _) in TEMPLATES.items():
        index.setdefault(rarest_first(need, idf)[0][1], []).append(label)
    at = F.create_map(*[c for w, own in sorted(index.items()) for c in (F.lit(w), F.array(*[F.lit(k) for k in own]))])
    return F.flatten(F.array_compact(F.transform(F.array_distinct(F.transform("hits", lambda x: x["w"])), lambda w: F.try_element_at(at, w))))


def template_starts(need: list[tuple[int, str]], idf: dict[str, float]) -> Column:
    """Starts at which all mandatory words stand, intersected from the rarest word on."""
    first, *rest = rarest_first(need, idf)
    out = F.array_distinct(_places(first[1], first[0]))
    for place, word in rest:
        out = F.array_intersect(out, _places(word, place))
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): labels, places of base phrases, score."""
    saved = Scratch(docs.sparkSession, "license").save(rare_word_hits(docs))
    idf = word_idf(saved)
    none = F.array().cast("array<int>")
    some = F.size("hits") > 0
    d = saved.withColumn("near", candidates(idf))
    d = d.withColumns({f"s_{k}": F.when(F.array_contains("near", k), template_starts(need, idf)).otherwise(none) for k, (need, _) in TEMPLATES.items()})
    d = d.withColumn("base", F.concat(*[F.col(f"`s_{k}`") for k in sorted(BASE)]))
    found = lambda keys: F.array_join(F.array_compact(F.array(*[F.when(F.size(f"`s_{k}`") > 0, F.lit(k)) for k in sorted(keys)])), ",")
    share = []
    for k, (need, more) in TEMPLATES.items():
        extra = sum((F.size(F.array_intersect(F.col(f"`s_{k}`"), _places(w, p))).cast("boolean").cast("int") for p, w in more), F.lit(0))
        share.append(F.when(F.size(f"`s_{k}`") > 0, (len(need) + extra).cast("double") / (len(need) + len(more))).otherwise(0.0))
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"),
        found(BASE).alias("base_labels"), found(TEMPLATES).alias("labels"),
        F.when(some, F.round(F.greatest(*share), 6)).otherwise(0.0).alias("score"),
    )


def _sql() -> str:
    place = lambda w, p: f"list_transform(list_filter(hits, lambda x: x.w = '{w}'), lambda x: x.p - ({p}))"

    def starts(need):
        (p, w), *rest = need
        out = f"list_distinct({place(w, p)})"
        for p, w in rest:
            out = f"list_intersect({out}, {place(w, p)})"
        return out

    name = lambda k: '"s_' + k + '"'
    found = lambda keys: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({name(k)}) > 0 THEN '{k}' END" for k in sorted(keys)) + "], lambda x: x IS NOT NULL), ',')"
    share = []
    for k, (need, more) in TEMPLATES.items():
        extra = "".join(f" + (len(list_intersect({name(k)}, {place(w, p)})) > 0)::INT" for p, w in more)
        share.append(f"CASE WHEN len({name(k)}) > 0 THEN ({len(need)}{extra})::DOUBLE / {len(need) + len(more)} ELSE 0 END")
    vocabulary = ", ".join(f"'{w}'" for w in VOCABULARY)
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
h AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         list_filter(list_transform(words, lambda x, i: {{'p': i - 1, 'w': x}}), lambda x: x.w IN ({vocabulary})) AS hits FROM w),
s AS (
  SELECT *, {", ".join(f"{starts(need)} AS {name(k)}" for k, (need, _) in TEMPLATES.items())} FROM h),
b AS (SELECT *, {" || ".join(name(k) for k in sorted(BASE))} AS base FROM s)
SELECT doc_id, n_words, len(base)::BIGINT AS n_base, list_min(base)::BIGINT AS first_word, list_max(base)::BIGINT AS last_word,
       {found(BASE)} AS base_labels, {found(TEMPLATES)} AS labels,
       round(greatest({", ".join(share)}), 6) AS score
FROM b"""


SQL = _sql()
