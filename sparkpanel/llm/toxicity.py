"""Toxicity of documents, scored on texts that a noisy channel has restored.

The channel: a writer who hides a word puts digits and signs for letters ("1d10t"), blanks or dots between letters
("i d i o t") or repeats letters ("idioooot"). Each odd token (digits or signs among letters, a letter three times in a
row, single characters in a row) becomes a lattice: every character may stand for itself, for the letters that it looks
like, for nothing, or for the end of a word, each at a price. Viterbi's algorithm takes the path of the best sum of these
prices and of a language model's: trigrams of letters, counted over the whole texts of all documents, which interpolate
with pairs and single letters. All other tokens stay as they are.

The classifier looks at each word of the restored text: the word itself and its beginnings of several lengths, hashed
into a fixed number of cells. A cell's weight is the lower confidence bound of the log odds that a document with such a
word is toxic, from the documents of a sample of labelled rows (`ROWS` at most, picked by a hash of the id; the model's
size is fixed by `CELLS`). A word has the weight of its best cell; the three best different words of a document go into a
logistic function, which is fitted on the same rows with each row's own counts left out of its weights. Each of the three
has a few bends, so that one word of great weight can do.

Edge cases: a null or blank text has no words, and the score of a document without evidence; without labels of either
kind every score is the share of toxic ones (0 without labels); repeated rows are scored alike; of several labels of one
doc_id the largest counts; a null doc_id is in no sample; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .words import PLAIN, Words, mix, slices

#: Labelled rows that the classifier is fitted on at most; cells of its weights; documents of every FOLDS-th checksum are held out.
ROWS, CELLS, FOLDS = 100_000, 1 << 20, 5
#: Bytes of a word's beginnings; standard errors below the estimate that a weight is taken at; where the logistic function bends.
STEMS, BOUND, BENDS = (4, 5, 6, 8), 1.64, (2.0, 4.0, 6.0)

#: What characters are used for. Fixed values.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "§": "s"}
#: Prices (logarithms): a sign for a letter; left out: a sign that looks like a letter (or that as the end of a word), another sign, a repeated character; another sign as the end of a word.
LOOK, DROP, SKIP, REPEAT, STOP = -1.0, -5.0, -1.5, -0.5, -2.0
#: Marks of sentences, which are no part of a word's disguise at its ends.
MARKS = ".,;:?!\"'()[]{}"

#: Letters as numbers: 0 any other character, 1 to 26 a to z, 27 to 57 the lower-case letters of Latin-1, 58 all other letters.
SYMBOLS = 64
_CODES = np.zeros(256, np.uint8)
_CODES[97:123] = np.arange(1, 27)
_CODES[224:255] = np.arange(27, 58)
_CODES[247] = 0
_CODES[1] = 58


def codes(text: str) -> np.ndarray:
    """Numbers of the lower-cased text, between two 0 on either side."""
    t = text.lower()
    data = t.encode("latin-1", "replace")
    if not t.isascii() and data.count(b"?") != t.count("?"):
        data = "".join(c if c < "Ā" else "\x01" if c.isalpha() else " " for c in t).encode("latin-1")
    out = np.zeros(len(data) + 4, np.uint8)
    out[2:-2] = _CODES[np.frombuffer(data, np.uint8)]
    return out


def trigrams(docs: DataFrame) -> DataFrame:
    """cell (three letters as one number) and n over all texts; a task counts in one array of all cells."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            c = np.concatenate([np.zeros(0, np.uint8), *[codes(t) for t in batch.column("text").to_pylist()]]).astype(np.int32)
            if len(c) > 2:
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        total[0] = 0  # blanks in a row say nothing
        at = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    d = docs.select(docs["text"].cast("string").alias("text")).where("text <> ''")
    return d.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Model:
    """Logarithms of a letter's chance after two letters; what the channel restores."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        n = np.zeros(SYMBOLS**3)
        n[cells] = counts
        n = n.reshape((SYMBOLS,) * 3)
        pair, one = n.sum(axis=0), n.sum(axis=(0, 1))
        single = (one + 0.5) / (one.sum() + 0.5 * SYMBOLS)
        follow = pair.sum(axis=1, keepdims=True)
        double = (pair + 20 * single) / (follow + 20)
        before = n.sum(axis=2, keepdims=True)
        self.log = np.log((n + 20 * double) / (before + 20)).astype(np.float32)

    def decode(self, token: str) -> str:
        """The most likely words behind a token, joined by blanks."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        # only a character that stands three times in a row counts as repeated
        often = {k for m in THRICE.finditer(token) for k in range(m.start() + 1, m.end())}
        for k, ch in enumerate(token):
            own = number(ch)
            options = [(own, 0.0)] if own else []
            options += [(number(c), LOOK) for c in LOOKS.get(ch, "")]
            again = {c for c, _ in options} if k in often else ()
            skip = None if own else DROP if ch in LOOKS else SKIP
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def put(key, value, path, new=new):
                if key not in new or value > new[key][0]:
                    new[key] = value, path

            for (a, b), (value, path) in states.items():
                for c, price in options:
                    put((b, c), value + price + float(log[a, b, c]), (c, ch, path))
                if b in again:
                    put((a, b), value + REPEAT, path)
                elif skip is not None and b:
                    put((a, b), value + skip, path)
                if not own:
                    if b:
                        put((b, 0), value + (DROP if ch in LOOKS else STOP) + float(log[a, b, 0]), (0, ch, path))
                    else:
                        put((a, b), value, path)
            states = new
        best, path = max(((v + float(log[a, b, 0] if b else 0.0), p) for (a, b), (v, p) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            c, ch, path = path
            out.append(ch if c == 58 else LETTER[c])
        return "".join(reversed(out)).strip()


LETTER = [" ", *"abcdefghijklmnopqrstuvwxyz", *(chr(c) for c in range(224, 255)), *" " * 6]


@lru_cache(1 << 12)
def number(ch: str) -> int:
    return int(_CODES[ord(ch)]) if ch < "Ā" and ch != "\x01" else 58 if ch.isalpha() else 0


EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘¿¡–—…"
THRICE = re.compile(r"(.)\1\1+")
#: Three or more single characters in a row.
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


class Restorer:
    """Restores texts; remembers what it made of each token, a bounded number of them."""

    def __init__(self, model: Model, held: int = 200_000):
        self.model, self.held, self.known = model, held, {}

    def token(self, t: str) -> str | None:
        """What an odd token stands for; None if it isn't odd."""
        if len(t) < 3:
            return None
        own = t.strip(MARKS)
        core = own.strip(EDGES)
        odd = THRICE.search(own) or not core.isalpha() or any(c in LOOKS for c in own if c not in core)
        if not odd or not any(map(str.isalpha, core)):
            return None
        return self.model.decode(own.lower())

    def text(self, text: str) -> tuple[str, int]:
        """The restored text, lower case, and the number of tokens changed."""
        changed = 0

        def joined(m):
            nonlocal changed
            changed += 1
            return self.model.decode(m[0])

        text = text.lower()
        if " " in text:
            text = SPACED.sub(joined, text)
        tokens, known = text.split(), self.known
        if len(known) > self.held:
            known.clear()
        odd = {}
        for t in set(tokens):
            if t not in known:
                known[t] = self.token(t)
            if known[t] is not None and known[t] != t:
                odd[t] = known[t]
        if odd:
            changed += sum(t in odd for t in tokens)
            text = " ".join([odd.get(t, t) for t in tokens])
        return text, changed


def cells(words: Words) -> np.ndarray:
    """Cells of each word and its beginnings, one row a word."""
    b = np.frombuffer(words.buffer, np.uint8).astype(np.uint64)
    out, keys = np.zeros((len(words), len(STEMS) + 1), np.int64), words.hashes()
    out[:, 0] = (keys % np.uint64(CELLS)).astype(np.int64)
    sizes = words.ends - words.starts
    h = np.zeros(len(words), np.uint64)
    for k in range(max(STEMS)):
        at = np.nonzero(sizes > k)[0]
        h[at] = (h[at] ^ b[words.starts[at] + k]) * np.uint64(0x100000001B3) + np.uint64(0xCBF29CE484222325)
        if k + 1 in STEMS:
            # a shorter word has no such beginning; its own cell stands in
            long = sizes > k + 1
            i = STEMS.index(k + 1) + 1
            out[:, i] = np.where(long, (mix(h + np.uint64(k)) % np.uint64(CELLS)).astype(np.int64), out[:, 0])
    return out


def weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Lower confidence bounds of log odds ratios, 0 at least."""
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (n_toxic - toxic + 0.5)) - np.log(b / (n_clean - clean + 0.5))
    return np.maximum(0, odds - BOUND * np.sqrt(1 / a + 1 / b))


def best_words(words: Words, weight: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The three largest weights of different words of each text."""
    out = np.zeros((len(words.counts), 3))
    for i, (first, n) in enumerate(zip(words.firsts.tolist(), words.counts.tolist(), strict=True)):
        own = weight[first : first + n]
        at = np.nonzero(own)[0]
        if len(at):
            _, one = np.unique(keys[first + at], return_index=True)
            top = np.sort(own[at[one]])[::-1][:3]
            out[i, : len(top)] = top
    return out


def bent(top: np.ndarray) -> np.ndarray:
    """The weights, and what each has above BENDS."""
    return np.concatenate([top, *[np.maximum(0, top - x) for x in BENDS]], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (the first one constant) by Newton's method."""
    m = np.column_stack([np.ones(len(x)), x])
    beta, keep = np.zeros(m.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + keep, m.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, restored (the text as the channel reads it), n_restored (tokens) and score of each row of docs (doc_id, text); labels: doc_id, toxic."""
    spark = docs.sparkSession
    scratch, context = Scratch(spark, "toxicity"), spark.sparkContext
    d = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    counted = trigrams(docs).toArrow()  # at most SYMBOLS^3 rows
    model = context.broadcast(Model(counted.column("cell").to_numpy(), counted.column("n").to_numpy()))

    def read(batches) -> Iterator[tuple[pa.RecordBatch, list[str], list[int], Words, np.ndarray]]:
        restorer = Restorer(model.value)
        for batch in slices(batches, 64):
            pairs = [restorer.text(t) for t in batch.column("text").to_pylist()]
            words = Words([t.encode("utf-8", "surrogatepass") for t, _ in pairs], PLAIN)
            yield batch, [t for t, _ in pairs], [n for _, n in pairs], words, cells(words)

    # a sample of labelled rows of a fixed size, so it can be sent round
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    train = d.join(F.broadcast(known), "doc_id")

    def count(batches):
        """Documents of each cell, by label; two rows of cell -1 hold all documents."""
        total, n = np.zeros((2, CELLS), np.int64), [0, 0]
        for batch, _, _, words, own in read(batches):
            label = np.minimum(batch.column("toxic").to_numpy(), 1)
            text = np.repeat(np.arange(batch.num_rows), words.counts)
            both = np.unique((text[:, None] * CELLS + own).ravel())
            for y in (0, 1):
                n[y] += int((label == y).sum())
                total[y] += np.bincount((both % CELLS)[label[both // CELLS] == y], minlength=CELLS)
        at = np.nonzero(total.any(axis=0))[0]
        columns = [np.append(at, -1), np.append(total[1, at], n[1]), np.append(total[0, at], n[0])]
        yield pa.record_batch([pa.array(c) for c in columns], ["cell", "toxic", "clean"])

    sums = train.mapInArrow(count, "cell long, toxic long, clean long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()  # at most CELLS rows
    cell = sums.column("cell").to_numpy()
    per, total = np.zeros((2, CELLS), np.int32), [0, 0]
    for y, name in enumerate(("clean", "toxic")):
        n = sums.column(name).to_numpy()
        per[y][cell[cell >= 0]] = n[cell >= 0]
        total[y] = int(n[cell < 0].sum())
    share, sent = total[1] / max(1, sum(total)), context.broadcast(per)

    def evidence(batches):
        """Weights of the three best words of labelled rows, without their own counts."""
        clean, toxic = sent.value
        for batch, _, _, words, own in read(batches):
            label = np.repeat(np.minimum(batch.column("toxic").to_numpy(), 1), words.counts)[:, None]
            w = weights(toxic[own] - label, clean[own] - 1 + label, total[1] - label, total[0] - 1 + label).max(axis=1, initial=0)
            top = best_words(words, w, words.hashes())
            yield pa.record_batch([batch.column("toxic"), *[pa.array(top[:, k]) for k in range(3)]], ["toxic", "w1", "w2", "w3"])

    beta = None
    if min(total):
        fit = train.mapInArrow(evidence, "toxic int, w1 double, w2 double, w3 double").toArrow()  # a row of four numbers for each of the sample
        beta = logistic(bent(np.stack([fit.column(f"w{k}").to_numpy() for k in (1, 2, 3)], axis=1)), np.minimum(fit.column("toxic").to_numpy(), 1))

    def score(batches):
        clean, toxic = sent.value
        weight = weights(toxic.astype(np.float64), clean.astype(np.float64), *total[::-1]) if beta is not None else None
        for batch, texts, changed, words, own in read(batches):
            out = np.full(batch.num_rows, float(share))
            if weight is not None:
                top = best_words(words, weight[own].max(axis=1, initial=0), words.hashes())
                out = 1 / (1 + np.exp(-np.clip(beta[0] + bent(top) @ beta[1:], -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts), pa.array(changed, pa.int64()), pa.array(out)], ["doc_id", "restored", "n_restored", "score"])

    return d.mapInArrow(score, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, restored string, n_restored long, score double")
