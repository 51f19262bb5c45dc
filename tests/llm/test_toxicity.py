"""Toxicity: the trigram model and Viterbi decoding against brute force, restored disguises, held-out accuracy, edge cases."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkpanel.llm import queries
from sparkpanel.llm import toxicity as T
from sparkpanel.llm.common import table

BAD = ["idiot", "moron", "pathetic", "worthless", "trash"]
PLAIN = "the river and an old house near stone bridges where people often meet before market day begins with bread fruit or wine".split()


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(PLAIN) + rng.choice(["", "", "s", "er"]) for _ in range(rng.randint(15, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def model(spark, rows):
    t = T.trigrams(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)).toArrow()
    return T.Model(t.column("cell").to_numpy(), t.column("n").to_numpy())


def test_trigrams_count_whole_texts(spark):
    texts = ["Ab, é日!", None, "", "zz top ÷ ÀÞ", "?日"]
    got = {r["cell"]: r["n"] for r in T.trigrams(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    want = Counter()
    for t in texts:
        c = [0, 0, *[T.number(x) for x in (t or "").lower()], 0, 0] if t else []
        want.update((a * 64 + b) * 64 + z for a, b, z in zip(c, c[1:], c[2:], strict=False))
    want.pop(0, None)
    assert got == want


def test_viterbi_takes_the_best_of_all_paths(model):
    def brute(token):
        best = None
        ways = []
        for k, ch in enumerate(token):
            own = T.number(ch)
            ways.append([("put", own, 0.0)] * bool(own) + [("put", T.number(c), T.LOOK) for c in T.LOOKS.get(ch, "")])
            ways[-1] += [("again", {c for _, c, _ in ways[-1]}, T.REPEAT)] * bool(k and token[k - 1] == ch and ch * 3 in token) + [("skip", None, T.DROP if ch in T.LOOKS else T.SKIP), ("stop", 0, T.DROP if ch in T.LOOKS else T.STOP)] * (not own)
        for path in itertools.product(*ways):
            a, b, value, out = 0, 0, 0.0, []
            for kind, c, price in path:
                if kind == "put":
                    value, out, a, b = value + price + float(model.log[a, b, c]), [*out, T.LETTER[c]], b, c
                elif kind == "stop" and not b:
                    continue  # a word that has not begun can't end: such a sign is free
                elif kind == "stop":
                    value, out, a, b = value + price + float(model.log[a, b, 0]), [*out, " "], b, 0
                elif kind == "again":
                    value = value + price if b and b in c else -1e9
                elif b:
                    value += price
            value += float(model.log[a, b, 0]) if b else 0.0
            if best is None or value > best[0]:
                best = value, "".join(out).strip()
        return best[1]

    for token in ("1d10t", "m0r0n", "tr4ash", "i.d.1o", "br3ad!", "w1ne", "iddio0t", "iddd10", "w0ooo", "a-b"):
        assert model.decode(token) == brute(token), token


@pytest.mark.parametrize("hidden,word", [("1d10t", "idiot"), ("1D1OT!", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idioooot", "idiot"), ("p4th3t1c", "pathetic"), ("w0r7hl355", "worthless"), ("tr@$h", "trash"), ("m-o-r-o-n", "moron"), ("mmmooorrrooonnn", "moron")])
def test_disguises(model, hidden, word):
    text, n = T.Restorer(model).text(f"the old {hidden} and wine")
    assert text.strip("!") == f"the old {word} and wine" and n == 1


def test_plain_text_stays(model):
    for text in ("the river, (and) old! 'house' near stone... 1994 108.51.216.133", "a y", "", "###", "— «über» naïve"):
        assert T.Restorer(model).text(text) == (text, 0)


def test_held_out_and_disguised_documents(spark, rows, tmp_path):
    rng = random.Random(8)
    hide = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5"}
    extra = [(1000 + i, t if y == 0 else " ".join("".join(hide.get(c, c) for c in w) if w in BAD else w for w in t.split()), y) for i, t, y in corpus(80, 5)]
    docs = [(i, t, f"src{y}", "en", y, y) for i, t, y in [*rows, *extra]] + [(None, None, "a", "b", 1, 1), (7, "", None, None, 0, 0), (7, " \n", None, None, 0, 0), (-1, "idiot " * 3000, "a", "en", 0, 0)]
    rng.shuffle(docs)
    path = f"{tmp_path}/sf"
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, toxic int, score int").repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in rows] + [(3, 0, None), (None, 1, 1), (10**6, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    d = queries.QUERIES["op13_toxicity"](spark, path)
    assert dict(d.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = d.collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    said = {r["doc_id"]: r["predicted"] for r in got}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(y for _, y in held) > 10 and all(said[i] == y for i, y in held)
    assert all(said[i] == y for i, _, y in extra) and said[-1] == 1 and said[7] == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    other = labels.withColumn("toxic", T.F.when(T.fold() == 0, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = ({(r["doc_id"], r["score"]) for r in T.toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_without_labels_or_rows(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows[:5]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in T.toxicity(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(r[0], 1) for r in rows[:5]], "doc_id long, toxic int")
    assert {r["score"] for r in T.toxicity(docs, one).collect()} == {1.0}
    assert T.toxicity(docs.limit(0), one).count() == 0


def test_best_words_are_different_ones():
    words = T.Words([b"bad bad worse fine", b"", b"fine"])
    top = T.best_words(words, np.array([2.0, 2.0, 3.0, 0.0, 0.0]), words.hashes())
    assert top.tolist() == [[3.0, 2.0, 0.0], [0.0] * 3, [0.0] * 3]
