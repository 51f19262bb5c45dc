"""Anchors depend on their window alone: hashes that differ in low bits only, at any size of the texts read together."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from sparkpanel.llm import repeats, substring_dedup, suffix_dedup
from sparkpanel.llm.words import mix


def unmixed(x: np.ndarray) -> np.ndarray:
    """The numbers that words.mix takes to x."""
    back = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * back
    return x ^ (x >> np.uint64(32))


def twins(bit: int) -> tuple[bytes, bytes]:
    """Two ASCII strings of eight bytes with small hashes that differ in one bit; the second has the smaller hash."""
    v = np.arange(1 << 22, dtype=np.uint64) << np.uint64(23)
    a, b = unmixed(v | np.uint64(1 << bit)), unmixed(v)
    plain = lambda x: (x & np.uint64(0x8080808080808080)) == 0
    ok = np.nonzero(plain(a) & plain(b))[0]
    assert len(ok)
    return a[ok[0]].tobytes(), b[ok[0]].tobytes()


def letters(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def covered(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Which bytes of each text lie in a window that starts elsewhere too; windows are told apart by two polynomial hashes."""
    keys, sizes = [], []
    for t in texts:
        b = np.frombuffer(t, np.uint8).astype(object if len(t) < 9 else np.uint64)
        n = max(0, len(t) - width + 1)
        sizes.append(n)
        if not n:
            continue
        own = []
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            p = np.full(len(t), base, np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
            s = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * p)])
            inverse = np.full(n, np.uint64(pow(base, -1, 1 << 64)), np.uint64)
            inverse[0] = 1
            own.append((s[width:] - s[:-width]) * np.multiply.accumulate(inverse))
        keys.append(np.stack(own, axis=1))
    _, code, count = np.unique(np.concatenate(keys), axis=0, return_inverse=True, return_counts=True)
    many, out, at = count[code.ravel()] > 1, [], 0
    for t, n in zip(texts, sizes, strict=True):
        hit = np.zeros(len(t), bool)
        for k in np.nonzero(many[at : at + n])[0]:
            hit[k : k + width] = True
        out.append(hit)
        at += n
    return out


def test_passage_in_a_short_and_a_long_text(spark):
    rng = random.Random(1)
    large, small = twins(15)
    body = letters(rng, 400)
    passage = body[:60] + large.decode() + body[68:150] + small.decode() + body[158:]
    texts = ["x", letters(rng, 300) + passage + letters(rng, 300), letters(rng, 1_200_000) + passage + letters(rng, 1_300_000), letters(rng, 5000), ""]
    unit = repeats.Unit(False, 400, 256, 8)
    places = []
    for t, at in ((texts[1], 300), (texts[2], 1_200_000)):
        _, first, last, s = unit.read([t.encode()]).anchors()
        places.append(s[(first <= at) & (last >= at)][0] - at)
    assert places == [150, 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (sum(s["stop"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.suffix_dedup(docs).collect()}
    want = {}
    for i, (t, hit) in enumerate(zip(texts, covered([t.encode() for t in texts], 400), strict=True)):
        kept = np.frombuffer(t.encode(), np.uint8)[~hit].tobytes()
        want[i] = int(hit.sum()), hashlib.sha256(kept).hexdigest()
    assert got == want and got[1][0] == got[2][0] >= 400


@pytest.mark.parametrize("words", [False, True])
def test_anchor_is_the_smallest_whole_hash(monkeypatch, words):
    """Hashes with few values, which differ in their lowest bits only."""
    rng = np.random.default_rng(2)
    few = rng.integers(0, 50, 1 << 20).astype(np.uint64)
    made = lambda x, *_: few[x % np.uint64(1 << 20)] if not words else few[: max(0, len(x) - 2)]
    monkeypatch.setattr(repeats, "shingles" if words else "mix", made)
    unit = repeats.Unit(words, 50, 32, 3)
    data = " ".join(random.Random(k).choice(["aa", "b", "ccc"]) for k in range(4000)).encode()
    x = unit.read([data, b"b b", data[:700]])
    _, first, last, s = x.anchors()
    if words:
        keys = few
    else:
        b = np.frombuffer(x.buffer, np.uint8).astype(np.uint64)
        keys = made(b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16))
    for a, z, at in zip(first.tolist(), last.tolist(), s.tolist(), strict=True):
        assert {p + int(np.argmin(keys[p : p + 32])) for p in range(a, z + 1)} == {at}


def test_passage_of_words_among_long_texts(spark):
    rng = random.Random(7)
    word = lambda: letters(rng, rng.randint(2, 9)).replace(" ", "q")
    passage = " ".join(word() for _ in range(50))
    texts = [(5, " ".join(word() for _ in range(30)) + " " + passage), (9, " ".join(word() for _ in range(200_000)) + " " + passage + " end"), (7, "a b"), (1, " ".join(word() for _ in range(60)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: sum(s["stop"] - s["start"] for s in r["spans"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {5: 0, 9: 50, 7: 0, 1: 0}


def test_mix_is_undone():
    x = np.random.default_rng(3).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (mix(unmixed(x)) == x).all()
