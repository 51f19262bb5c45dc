"""Spelling variants against brute force: planted variants, ties, long words, odd letters, several rounds of filters."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from sparkpanel.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, size int, key long, form string, id string"


def brute(rows, least=7, often=2, times=10, misspell=31):
    count = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % misspell == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= least:
                count[r] += 1
    own = {w: n for w, n in count.items() if n >= often}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {w: [v for v in own if near(w, v)] for w in own}
    best = {w: min(v, key=lambda x: (-own[x], x), default=None) for w, v in found.items()}
    form = {w: b if b and own[b] >= times * own[w] else None for w, b in best.items()}
    out = []
    for w in own:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, own[w], len(found[w]), own[form[w]] if form[w] else None))
    return sorted(out)


def texts():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdenoÉéñ÷×ÿ") for _ in range(n))
    base, out = [word(rng.randint(6, 12)) for _ in range(25)], [(900, None), (901, ""), (902, " 12 \t-- a b"), (None, "Repeated repeated REPEATED repeateds")]
    for w in list(base[:12]):  # chains of forms: each ten times as frequent as the one before
        a, b = w[:3] + "z" + w[3:], w[:3] + "zz" + w[3:]
        out += [(rng.randrange(10**6), " ".join([w.upper() if w.isascii() else w] * 10)) for _ in range(25)] + [(rng.randrange(10**6), " ".join([a] * 4)) for _ in range(6)] + [(rng.randrange(10**6), f"{b}, {b}!")]
    for w in base[12:]:  # ties, and words of one letter less and more
        edited = [w[:2] + c + w[3:] for c in "xy"] + [w[:-1], w + "q"]
        out += [(rng.randrange(10**6), " ".join(edited * 2)), (rng.randrange(10**6), w), (7, " ".join([w] * 21))]
    out += [(5, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaaĀaaaaaaaaa"), (5, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaaĀaaaaaaaaa")]
    long = "".join(rng.choice("abcd") for _ in range(30_000))
    return out + [(k, f"{long} {long} {long[:9]}{long[10:]} {long[:99]}z{long[100:]}") for k in (1, 2)]


@pytest.mark.parametrize("blocks", [spelling.ROUND, 40])
def test_forms(spark, blocks):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "w", 1, 1, 1, "f", "x") for i, t in rows], SCHEMA).repartition(3)
    got = spelling.spelling_forms(spelling.word_counts(docs, misspell=31), blocks=blocks).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute(rows)
    assert sorted(tuple(r) for r in got) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and any(len(r[0]) > 20_000 and r[4] for r in want)


def test_words_are_whole_and_counts_kept(spark):
    docs = spark.createDataFrame([(1, "Grande grande Straße Straße straßen naïve-naïve xĀnaïve")], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, least=5).collect()}
    assert got == {"grande": 2, "straße": 2, "straßen": 1, "naïve": 3}


def test_filters_hold_every_word():
    import numpy as np

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(9)) for _ in range(500)]
    filters = spelling.Filters({9: 500})
    ((_, m),) = spelling.by_length(words).values()
    raw = spelling.prefixes(m)[:, -1]
    key = spelling.mix(raw)
    bits = np.zeros((filters.total, spelling.LANES), np.uint64)
    for k in range(spelling.LANES):
        np.bitwise_or.at(bits[:, k], filters.block(key, 9), filters.bit(key, k))
    assert len(filters.probe(bits, 0, raw, 9)[0]) == 500
    other = np.array([rng.getrandbits(64) for _ in range(100_000)], np.uint64)
    assert len(filters.probe(bits, 0, other, 9)[0]) < 500  # false positives stay rare


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "ab cd")]])
def test_no_words(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert spelling.spelling_forms(spelling.word_counts(docs)).count() == 0
