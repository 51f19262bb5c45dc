"""Runs by suffix trees against brute force over all starts and periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparkpanel.llm import periodic_runs as P
from sparkpanel.llm import queries


def brute(words, least=P.LEAST, times=P.TIMES):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted((a, n, q) for (a, n), q in out.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def answer(doc_id, text):
    words = planted(doc_id, [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
    runs = brute(words)
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(((-n, a, q) for a, n, q in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return doc_id, len(runs), *top, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop))


def nested(rng):
    """Words with runs in runs, side by side, overlapping, and cut by one word."""
    out = []
    while len(out) < rng.randint(20, 160):
        root = [rng.choice("abcd") for _ in range(rng.randint(1, 6))]
        part = root * rng.randint(1, 7) + root[: rng.randint(0, len(root))]
        out += part * rng.choice([1, 1, 2, 4]) + [rng.choice(["a", "b", "x", "y%d" % rng.randrange(9)]) for _ in range(rng.randint(0, 3))]
    return out


def test_runs_of_small_lists():
    rng = random.Random(12)
    for trial in range(1500):
        words = nested(rng) if trial % 3 else [rng.choice("ab" if trial % 2 else "abc") for _ in range(rng.randint(0, 60))]
        for least, times in ((6, 4), (2, 2), (5, 3)):
            want = brute(words, least, times)
            assert P.periodic_runs([w.encode() for w in words], least, times) == want, (words, least, times)


def test_common_extensions_are_depths_of_ancestors():
    rng = random.Random(4)
    text = [rng.randint(1, 3) for _ in range(120)] + [0]
    tree = P.SuffixTree(text, 4)
    suffixes, turns = tree.tour(np.arange(4))
    assert suffixes.tolist() == sorted(range(121), key=lambda i: text[i:])
    ext = P.Extension(suffixes, turns)
    i, j = np.array([(a, b) for a in range(121) for b in range(121) if a != b]).T

    def common(a, b):
        k = 0
        while max(a, b) + k < 121 and text[a + k] == text[b + k]:
            k += 1
        return k

    assert ext.of(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = [(None, "la " * 40), (None, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "a"), (3, "a"), (4, "a a a a a"), (5, "a a a a a a"), (6, "x y " * 9), (7, "b a " * 2000 + "b c")]
    out += [(i, rng.choice([" ", "\n", " \t"]).join(nested(rng))) for i in range(100, 180)]
    return out + [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 900)))) for i in range(200, 260)]


def test_query(spark, texts, tmp_path):
    path = f"{tmp_path}/sf"
    rows = [(i, t, 1, 2, "k", "w") for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, n int, h int, kept string, words string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, path)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names and {t for c, t in got.dtypes if c not in names[-2:]} == {"bigint"}
    want = [answer(i, t) for i, t in texts]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 40


def test_long_periodic_text():
    rng = random.Random(9)
    root = [b"%d" % rng.randrange(50) for _ in range(6000)]
    words = [b"first", *root * 5, *root[:77], b"last", *[b"la"] * 20_000]
    found = P.periodic_runs(words)
    assert (1, 30_077, 6000) in found and (30_079, 20_000, 1) in found
    assert P.collapsed(words, [r for r in found if r[2] in (1, 6000)])[:6001] == words[:6001]


def test_empty_table(spark):
    assert P.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
