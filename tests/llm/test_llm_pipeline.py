"""The pipeline's stages, each against what its operator says about the rows before it, and the whole against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkpanel.llm import decontamination, license_scan, ngram_join, quality_rules, substring_dedup
from sparkpanel.llm.common import table
from sparkpanel.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept[name] = docs.count()
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == {r[0] for r in quality_rules.quality_rules(before).where("kept").select("doc_id").collect()}
        elif name == "ngram_jaccard_join":
            assert ids == {r[0] for r in ngram_join.classes(before, 5, 80).select("component_id").collect()}
        elif name == "substring_dedup":
            d = substring_dedup.substring_dedup(before)
            want = {r[0]: r[1] for r in d.select("doc_id", F.when(F.size("spans") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {k: v for k, v in want.items() if v}
            assert docs.where("n_chars <> length(text)").isEmpty()
        elif name == "benchmark_decontamination":
            held = {r[0] for r in decontamination.contaminated(before, table(spark, SF, "benchmark")).select("doc_id").collect()}
            assert held and ids == {r[0] for r in before.select("doc_id").collect()} - held
        if k < 4:
            assert docs.columns == before.columns
    assert ids == {r[0] for r in before.select("doc_id").collect()}
    assert all(kept.values())


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def brute_force(sf: str) -> Counter:
    """(doc_id, piece, start, length, checksum) of the whole pipeline, by plain loops; the quality rules' verdict by their SQL."""
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    good = {i for i, kept in c.execute(f"SELECT doc_id, kept FROM ({quality_rules.SQL})").fetchall() if kept}
    docs = [(i, t or "") for i, t in c.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if i in good]
    lower = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [grams(split(lower(t)), 5) for _, t in docs]
    least = list(range(len(docs)))  # the first of a class, as ids ascend
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((least[a], least[b]))
                least = [x if u == y else u for u in least]
    docs = [d for k, d in enumerate(docs) if least[k] == k]

    first: dict[tuple, int] = {}
    for i, t in docs:
        for k in grams(split(t), 50) if len(split(t)) >= 50 else ():
            first[k] = min(first.get(k, i), i)
    kept = []
    for i, t in docs:
        w = split(t)
        cut = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        if len(cut) < len(w) or not cut:
            kept.append((i, " ".join(x for q, x in enumerate(w) if q not in cut) if cut else t))

    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    items = [s for (t,) in c.execute("SELECT text FROM benchmark").fetchall() if (s := grams(plain(t), 5))]
    held = lambda own: any(len(s & own) >= 0.8 * len(s) - 1e-9 for s in items)
    kept = [(i, t) for i, t in kept if not held(grams(plain(t), 5))]

    tokenizer, out = Encoder.get(tokenizer_path()).tokenizer, Counter()
    for i, t in kept:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            out[i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    return out


def test_run_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    want = brute_force(SF)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert 20 < len({k[0] for k in want}) < 190
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_stages_with_clashing_names_nulls_and_repeated_ids(spark):
    words = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n))
    passage = words(1, 60)
    rows = [(1, passage), (2, f"{passage} {words(2, 20)}"), (2, f"{passage} {words(2, 20)}"), (None, passage), (3, None), (None, words(3, 70)), (4, f"{words(4, 9)}\n{passage}")]
    names = ["doc_id", "text", "lang", "source", "n_chars", "id", "t", "x0", "x1", "own_key", "own_id", "own_text", "spans", "kept", "cut", "item_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names[5:])
    docs = spark.createDataFrame([(i, t, "en", None, None, *["c"] * 11) for i, t in rows], schema).repartition(3)
    got = corpus_pipeline.passages(spark, docs, SF)
    assert got.columns == names
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, passage), (2, words(2, 20)), (2, words(2, 20)), (3, None), (None, words(3, 70)), (4, words(4, 9))], key=str)
    items = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    left = decontamination.decontaminate(docs, items)
    assert left.columns == names and sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(3, None), (None, words(3, 70))], key=str)


def test_one_text_of_many_megabytes(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(50_000)]
    big = " ".join(vocabulary[k] for k in rng.integers(0, 50_000, 700_000)) + " Released under the MIT License. " + " ".join(vocabulary[:30])
    docs = spark.createDataFrame([(1, big, "en"), (2, "small text here", "en")], "doc_id long, text string, lang string")
    assert len(big) > 4_000_000
    found = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert found[1]["n_words"] == 700_035 and found[1]["base_labels"] == "mit" and found[1]["first_word"] == 700_003
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[1]["n_words"] == 700_035 and not rules[1]["base_failed"]
    items = spark.createDataFrame([(7, " ".join(vocabulary[:30])), (8, "nothing like it at all in any text")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()] == [(1, 7)]
