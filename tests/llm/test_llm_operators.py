"""Each operator against brute force on small tables with nulls, blanks, ties, repeated rows and clashing columns."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkpanel.llm.common import Scratch
from sparkpanel.llm import decontamination, hilbert_shards, license_scan, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup, token_files, url_filter
from sparkpanel.llm.tokens import Encoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t long, n int, words string, cut int, row_key long, rank int, part int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["the", "on", "ar", "it", "es", "né", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text): prose with copies, near copies, shared passages, periodic, blank, empty and null texts."""
    rng = random.Random(3)
    passage, out = prose(rng, 90), [(90, None), (91, ""), (92, " \t\n"), (93, "word"), (94, "two words"), (95, "a b c"), (None, prose(rng, 60))]
    for i in range(12):
        out.append((i, prose(rng, rng.randint(30, 200))))
    for i in range(12, 18):
        out.append((i, prose(rng, 40) + " " + passage + "\n" + prose(rng, 30)))
    base = prose(rng, 150).split()
    for i in range(18, 24):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((i, " ".join(w)))
    out += [(24, " ".join(base)), (25, " ".join(base)), (25, " ".join(base)), (None, " ".join(base)), (26, "la " * 700), (27, "x" * 1500), (3, passage), (28, " ".join(base[:60]) + " " + passage)]
    out.append((29, prose(rng, 6000) + " Released under the MIT License.\nMit license, GNU General  Public license, version 3"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "a"][k % 2], None, k, k, k, "w", k, k, k, k) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def split(t):
    return (t or "").encode().split()


def test_license_scan(docs, empty):
    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, k) for k, v in license_scan.BASE.items() for i in range(len(w)) if [x for _, x in v] == w[i : i + len(v)]]
        return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at}))

    got = license_scan.license_scan(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((i, *brute(t)) for i, t in texts()), key=str)
    found = got.where("doc_id = 29").first()
    assert found["labels"] == "gpl,gpl-3.0,mit" and found["score"] == 1.0
    assert license_scan.license_scan(empty).count() == 0


def test_license_templates_match_their_texts(spark):
    known = {
        "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "gpl-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "zlib-text": "This software is provided 'as-is', without any express or implied warranty.",
        "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "unlicense": "This is free and unencumbered software released into the public domain.",
    }
    other = {"apache-2.0-notice": "apache,apache-2.0,apache-2.0-notice", "gpl-notice": "gpl,gpl-notice", "mpl-2.0-notice": "mpl,mpl-2.0-notice"}
    prosaic = "the software provided to any person without a copy of the files is subject to the terms of the source code form " * 20
    texts = [(k, f"some words {t} and more") for k, t in enumerate(known.values())] + [(99, prosaic), (98, " ".join(reversed(known["isc-text"].split())))]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(len(known))] == [other.get(k, k) for k in known]
    assert all(got[k]["score"] == 1.0 for k in range(len(known)))
    assert got[99]["labels"] == got[98]["labels"] == "" and got[99]["score"] == got[98]["score"] == 0.0


def test_quality_rules(docs, empty):
    def brute(t):
        w = [x.decode() for x in split(t)]
        many = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if many[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)

    got = quality_rules.quality_rules(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((i, *brute(t)) for i, t in texts()), key=str)
    assert got.where("base_failed AND kept").isEmpty()
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_divergence_rejects_symbols_and_keeps_prose(spark):
    rng = random.Random(5)
    clean = [(i, prose(rng, 120), "en") for i in range(40)]
    junk = [(100 + i, " ".join(w + "###" for w in prose(rng, 120).split()), "en") for i in range(3)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def sequences(path_ids, end):
    return {k: np.array(v + [end], "<u4") for k, v in path_ids.items()}


def encoded():
    t = Encoder.get(tokenizer_path()).tokenizer
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in texts()]


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    want = Counter()
    for i, ids in encoded():
        ids = np.array([*ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= best_fit(Counter(r["length"] for r in got))
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_all_pieces_without_overlap(seed):
    rng = np.random.default_rng(seed)
    counts = dict(Counter(np.minimum(2048, rng.lognormal(5.5, 1.3, 4000).astype(int) + 1).tolist()))
    plan, used = packing.Plan(counts), {}
    for length, runs in plan.runs.items():
        first = [r[0] for r in runs] + [counts[length]]
        for (a, to, each, at), z in zip(runs, first[1:], strict=False):
            for k in range(z - a):
                used.setdefault(to + k // each, []).append((at + k % each * length, length))
    assert sum(len(v) for v in used.values()) == sum(counts.values())
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= best_fit(counts)


def best_fit(counts, capacity=2048):
    """Sequences that best-fit decreasing takes."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(rooms, length)
            room = rooms.pop(i) if i < len(rooms) else capacity
            bisect.insort(rooms, room - length)
    return len(rooms)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_any_tokenizer(name):
    from tokenizers import Tokenizer

    some = ["The Cat's  hat, isn't A.B. hot!\n\n  end", "", None, "ÀÉ é <|endoftext|> x", "x1y22 ... ,,"]
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
    encoder = Encoder.get(tokenizer_path(name))
    assert encoder.chunked == (name == "word_bpe_49k.json") and [x.tolist() for x in encoder.encode(some)] == want


def test_token_files(docs, empty):
    got = token_files.token_files(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())) for i, ids in encoded())
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    assert token_files.token_files(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pair_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, [3, 40, 1000, 70_000, 1, 5][seed], [5000, 5000, 20_000, 3000, 4000, 0][seed]).astype(np.uint32)
    ids = np.concatenate([ids, ids, ids[:100]])
    block = token_files.Block(token_files.compress(ids, 70_000 if seed == 3 else 49_408, at_least=2))
    assert len(block) == len(ids) and (block.ids(0, len(ids)) == ids).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (block.ids(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("limits", [{}, {"group": 2, "bucket": 5}])
def test_suffix_dedup(docs, empty, limits):
    def brute(width=400):
        bs = [(t or "").encode() for _, t in texts()]
        many = Counter(b[p : p + width] for b in bs for p in range(len(b) - width + 1))
        for (i, _), b in zip(texts(), bs, strict=True):
            m = bytearray(len(b))
            for p in range(len(b) - width + 1):
                if many[b[p : p + width]] > 1:
                    m[p : p + width] = b"\1" * width
            yield i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()

    got = suffix_dedup.suffix_dedup(docs, **limits)
    removed = F.aggregate("spans", F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    assert rows(got, "doc_id", "n_units", removed, F.size("spans"), F.sha2("kept", 256)) == sorted(brute(), key=str)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"group": 2, "bucket": 5}])
def test_substring_dedup(docs, empty, limits):
    def brute(width=50):
        key = lambda i: 1 << 62 if i is None else i
        own, first = [(i, split(t)) for i, t in texts()], {}
        for i, w in own:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                first[k] = min(first.get(k, 1 << 62), key(i))
        for i, w in own:
            cut = {q for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < key(i) for q in range(p, p + width)}
            yield i, len(w), len(cut), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in cut)).hexdigest()

    got = substring_dedup.substring_dedup(docs, **limits)
    removed = F.aggregate("spans", F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    assert rows(got, "doc_id", "n_units", removed, F.sha2("kept", 256)) == sorted(brute(), key=str)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_automaton_decides_on_passages(monkeypatch):
    passage = [f"w{k}" for k in range(50)]
    rows = [(5, 100 + i, i, 1, " ".join(f"{x}{i}" for x in "abc"), " ".join(passage)) for i in range(3)]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["r0", "k0", "id", "n", "before", "after"])
    got = substring_dedup.compare_shard(table, 50, 19).to_pylist()
    # the first has no earlier copy; the windows of the others start at place 3 of their stretch, as windows that hold no phrase belong to other stretches
    assert sorted((r["id"], r["first"], r["last"]) for r in got) == [(1, 3, 3), (2, 3, 3)]
    assert len(substring_dedup.count_shard(table, 50, 19)) == 3 * 4
    assert sorted(substring_dedup.located([(1, 2), (2, 1)], [(1, 2, 1, 2), (3,)])) == [(0, 0), (0, 1), (0, 2)]
    monkeypatch.setattr(substring_dedup, "located", lambda *a: iter(()))
    assert len(substring_dedup.compare_shard(table, 50, 19)) == len(substring_dedup.count_shard(table, 50, 19)) == 0


def test_loser_tree_merges_and_knows_common_prefixes():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(k)]
        runs = [(r, suffix_dedup.adjacent(r, 1).tolist()) for r in runs]
        got = list(suffix_dedup.merge_runs(runs))
        out = [runs[r][0][i] for r, i, _ in got]
        assert out == sorted(x for r, _ in runs for x in r)
        assert [n for *_, n in got][1:] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(out, out[1:], strict=False)]


@pytest.mark.parametrize(("n", "pct", "limits"), [(3, 90, {}), (5, 80, {"task_shingles": 200, "frequent": 5}), (3, 40, {"task_shingles": 500, "group": 3}), (3, 90, {"bits": 4})])
def test_ngram_join(docs, empty, n, pct, limits):
    own = [(i, [w.translate(ngram_join.FOLD) for w in split(t)]) for i, t in texts()]
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for _, w in own]
    up = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = [y if u == x else u for u in up]
    least = lambda k: min((i for (i, _), u in zip(own, up, strict=True) if u == up[k] and i is not None), default=None)
    want = sorted(((i, len(sets[k]), least(k)) for k, (i, _) in enumerate(own)), key=str)
    assert rows(ngram_join.classes(docs, n, pct, **limits), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.classes(empty, n, pct).count() == 0
    stay = ngram_join.one_of_each(docs, n, pct, **limits)
    assert stay.columns == docs.columns
    assert stay.count() == len({up[k] for k in range(len(own)) if sets[k]}) + sum(not s for s in sets)


def test_prefix_tree_on_random_sets():
    rng = np.random.default_rng(2)
    for pct in (50, 80, 90):
        base = [rng.choice(400, 40, replace=False) for _ in range(4)]
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0.01, 0.05, 0.2]), rng.integers(400, 900, 40), base[rng.integers(4)])).astype(np.uint64) for _ in range(60)]
        up = list(range(60))
        for a in range(60):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if ngram_join.enough(shared, len(sets[a]), len(sets[b]), pct):
                    x, y = up[a], up[b]
                    up = [y if u == x else u for u in up]
        got = ngram_join.link_sets(sets, pct)
        assert [[got[a] == got[b] for b in range(60)] for a in range(60)] == [[up[a] == up[b] for b in range(60)] for a in range(60)]


def test_url_filter(spark):
    urls = ["http://a.example.com/en/7", "https://Example.COM/en/8?x=/en/7", "http://com/en/", "http://xcom/en/", "http://net/de/8", "http://q.example.net/de/88#f", None, "", "no scheme", "http://", "http://org/es", "http://org/es/", "http://a.org?/es/", "http://a.org/es/://com/en/", "http://com/en/", "http://www.spam-farm.example.net/fr/1"]
    got = url_filter.url_filter(spark.createDataFrame([(i % 14, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string"))

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own = [v for h, p, v in url_filter.OWN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[1], best[2] if best else own[0] if own else "allow"

    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(((i % 14, *brute(u)) for i, u in enumerate(urls)), key=str)
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(8, 60))) for i in range(20)] + [(20, None), (21, ""), (22, "only three words"), (None, prose(rng, 20)), (23, "...")]
    extra = [(200 + i, prose(rng, 900) + "\n" + re.sub("[a-z]+", lambda m: m[0].upper(), t or "") + ". " + prose(rng, 700)) for i, t in items[:10]]
    extra += [(300, " ".join(w for k, w in enumerate(items[11][1].split()) if k != 5)), (301, "Only  three, words!"), (302, items[23][1]), (302, items[23][1])]
    all_texts = texts() + extra
    d = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, None) for i, t in extra], "doc_id long, text string, lang string"))

    def shingles(t):
        w = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    held = [(i, shingles(t)) for i, t in all_texts]
    want = sorted(((i, j, len(s), len(s & h)) for i, h in held for j, t in items if (s := shingles(t)) and len(s & h) >= 0.8 * len(s)), key=str)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) >= 14
    assert rows(decontamination.contaminated(d, bench), "doc_id", "item_id", "n_item_shingles", "n_shared") == want
    assert rows(decontamination.contaminated(d, bench, block=7), "doc_id", "item_id", "n_item_shingles", "n_shared") == want
    assert decontamination.contaminated(d, bench.limit(0)).count() == 0 and decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.decontaminate(d, bench).count() == len(all_texts) - len({(i, t) for i, t in extra}) - 1


def test_decontamination_of_short_and_repeating_items(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(5 + i % 8)) for i in range(240)] + [(300, "again " * 100), (301, (text(9) + " ") * 12)]
    docs = [(k, text(rng.choice([0, 2, 300])) + " " + t + " " + text(300)) for k, t in items]
    docs += [(1000 + k, " ".join([text(50), *t.split()[: 4 + k % 8], text(60)])) for k, t in items[:240]]  # the last word is missing

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    held = [(i, shingles(t)) for i, t in docs]
    want = sorted(((i, j, len(s), len(s & h)) for j, t in items for i, h in held if (s := shingles(t)) and len(s & h) >= 0.8 * len(s)), key=str)
    assert len(want) > len(items) + 50
    d, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontamination.contaminated(d, bench), "doc_id", "item_id", "n_item_shingles", "n_shared") == want
    one = bench.where("item_id = 0")
    assert rows(decontamination.contaminated(d, one), "doc_id", "item_id", "n_item_shingles", "n_shared") == [(0, 0, 1, 1)]


def test_hilbert_shards(docs, empty):
    got = hilbert_shards.hilbert_shards(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts())
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and hilbert_shards.hilbert_shards(empty).count() == 0


def test_hilbert_order_by_brute_force(docs):
    held = docs.select("doc_id", "text", "lang", "source").collect()

    def steps(values):
        count, start, out = Counter(values), 0, {}
        for v in sorted(count):
            out[v] = int((start + count[v] / 2) * 16 / len(values))
            start += count[v]
        return out

    table, lang, source = hilbert_shards.hilbert_table(), steps([r["lang"] or "" for r in held]), steps([r["source"] or "" for r in held])
    size = lambda t: len((t or "").encode()) + 1
    cell = lambda r: table[lang[r["lang"] or ""] * 256 + source[r["source"] or ""] * 16 + max(0, min(15, size(r["text"]).bit_length() - 5))]
    got = sorted(hilbert_shards.hilbert_shards(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert Counter((r["doc_id"], r["text_crc32"], r["curve"]) for r in got) == Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), cell(r)) for r in held)
    order = [(r["curve"], r["text_crc32"]) for r in got]
    assert order == sorted(order)


def test_value_steps_share_rows_evenly(spark):
    values = spark.createDataFrame([(f"s{k:03d}",) for k in range(320)] + [("t",)] * 160, "v string")
    got = {r["v"]: r["q"] for r in hilbert_shards.value_steps(values, Scratch(spark, "steps")).collect()}
    assert [got[f"s{k:03d}"] for k in range(320)] == [k * 16 // 480 for k in range(320)] and got["t"] == 13


def test_hilbert_curve_steps_by_one_cell():
    at = {p: c for c, p in enumerate(hilbert_shards.hilbert_table())}
    assert sorted(at) == list(range(4096))
    for p in range(4095):
        assert sum(abs((at[p] >> s & 15) - (at[p + 1] >> s & 15)) for s in (0, 4, 8)) == 1


def test_encoder_equals_tokenizer():
    e = Encoder(tokenizer_path())
    odd = ["<|endoftext|> hi<|startoftext|>there", "it's don't. A... b.,", "İstanbul ǅ ﬁ é ́x", "a b\x1cc\x85d", "", " \n\t", "Σίσυφος ΣΑΣ.", "x y 😀. 12,345.6 ½.", None, "l'été, ÉTÉ. été.", "«a». b", "x×. y÷, z", "a.. b., c,. d", "ab. cd, ef.\n«g", "12. 3, x.", "ª. µ, º", "<|ENDOFTEXT|>. A, B", ". , .", "a.\nb,\nc.", "ß. ÿ, ÀÖ.", "don't, I'll. we've'd"]
    assert [x.tolist() for x in e.encode(odd)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_url_rules_from_a_table_and_many_pages_without_hosts(spark):
    urls = [(k, u) for k, u in enumerate([None, "", "no host", "http://a.example.com/en/7x?q", "http://EXAMPLE.com/en/1", "x://b.org/es/", "ftp://other.fr/en/", "http://deep.deep.block.net", "http://block.net/"] * 5)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(4)
    table = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("block.net", "", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, table, table.limit(0)).collect()}
    want = [(None, "allow")] * 3 + [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), ("block.net", "block"), ("block.net", "block")]
    assert [got[k] for k in range(len(urls))] == want * 5
