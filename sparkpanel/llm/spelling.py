"""Groups of spelling variants: each word's near words and the more frequent form that it is a variant of.

Two words are near if one inserted, deleted or replaced code point leads from one to the other. The words of each length
have a blocked Bloom filter of their own (512 bits a block, one bit in each of its eight lanes), laid one after another
in one row of blocks. Tasks generate every edit of every word - each code point left out, and each replaced by a later
one of the alphabet, which finds each pair of words once - and probe it against the filter of its length, which is sent
round. Only positives are shuffled, to an exact join with the vocabulary that compares whole strings, so false positives
of the filter leave no trace.

What is sent at once has a fixed bound (`ROUND` blocks of 64 bytes): a larger vocabulary is probed in several rounds,
each with the filters of one range of blocks. Filters are built by aggregates of bits, so no vocabulary is collected.

Edge cases: a null or empty text has no words; a null doc_id counts as an empty one; a very long word is edited a part
at a time; rows of equal doc_id are counted as they are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .words import mix, slices

#: Letters are ASCII and U+00C0 to U+00FF, one byte each in Latin-1; A-Z become a-z and all other bytes blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
LANES, BITS = 8, 24
#: Blocks of 64 bytes that are sent round at once (32 MB), some 11 million words; edits of one pass over a batch; words counted before they are sent on.
ROUND, EDITS, HELD = 1 << 19, 1 << 20, 200_000
_BASE = 0x9E3779B97F4A7C15


def word_counts(docs: DataFrame, least: int = 7, misspell: int | None = None) -> DataFrame:
    """word, n: runs of letters of at least `least` code points, A-Z lower-cased, over the whole texts of docs (doc_id, text).

    misspell: a run loses one code point in the documents that a checksum picks, one in so many, to plant known variants.
    """

    def count(batches):
        own: dict[bytes, int] = {}

        def out():
            return pa.record_batch([pa.array([w.decode("latin-1") for w in own], pa.string()), pa.array(own.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(t.encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if len(w) < least:
                        continue
                    if misspell:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head)
                        if h % misspell == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                            if len(w) < least:
                                continue
                    own[w] = own.get(w, 0) + n
                if len(own) > HELD:
                    yield out()
                    own.clear()
        if own:
            yield out()

    d = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), docs["text"].cast("string").alias("text")).where("text <> ''")
    return d.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def by_length(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places in the list, bytes of the words as a matrix)."""
    own: dict[int, list[int]] = {}
    data = [w.encode("latin-1") for w in words]
    for i, w in enumerate(data):
        own.setdefault(len(w), []).append(i)
    return {n: (np.array(at), np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), n)) for n, at in own.items()}


def prefixes(m: np.ndarray) -> np.ndarray:
    """Sums of byte times power of its place, of all prefixes of each row; the last column is the word's raw hash."""
    out = np.zeros((m.shape[0], m.shape[1] + 1), np.uint64)
    np.cumsum((m.astype(np.uint64) + np.uint64(1)) * powers(m.shape[1]), axis=1, out=out[:, 1:])
    return out


def keyed(words: DataFrame) -> DataFrame:
    """word, n, size and key (64 bits) of words over Latin-1."""

    def run(batches):
        for batch in batches:
            text = batch.column("word").to_pylist()
            key, size = np.zeros(len(text), np.uint64), np.zeros(len(text), np.int32)
            for n, (at, m) in by_length(text).items():
                key[at], size[at] = mix(prefixes(m)[:, -1]), n
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(size), pa.array(key.view(np.int64))], ["word", "n", "size", "key"])

    return words.mapInArrow(run, "word string, n long, size int, key long")


class Filters:
    """The blocks of each length in one row, and the bits of a key; blocks outside of the range at hand are not probed."""

    def __init__(self, counts: dict[int, int]):
        self.first, self.count, self.total = {}, {}, 0
        for size, n in sorted(counts.items()):
            self.first[size], self.count[size] = self.total, -(-n * BITS // 512) + 7
            self.total += self.count[size]

    def block(self, key: np.ndarray, size: int) -> np.ndarray:
        return self.first[size] + ((key >> np.uint64(32)) * np.uint64(self.count[size]) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def bit(key: np.ndarray, lane: int) -> np.ndarray:
        return np.uint64(1) << (mix(key + np.uint64(_BASE)) >> np.uint64(6 * lane) & np.uint64(63))

    def table(self, words: DataFrame) -> DataFrame:
        """block, b0 to b7: the bits of all words."""

        def run(batches):
            for batch in batches:
                key, size = batch.column("key").to_numpy().view(np.uint64), batch.column("size").to_numpy()
                block = np.zeros(len(key), np.int64)
                for s in np.unique(size).tolist():
                    block[size == s] = self.block(key[size == s], s)
                yield pa.record_batch([pa.array(block), *[pa.array(self.bit(key, k).view(np.int64)) for k in range(LANES)]], ["block", *[f"b{k}" for k in range(LANES)]])

        d = words.select("size", "key").mapInArrow(run, "block long, " + ", ".join(f"b{k} long" for k in range(LANES)))
        return d.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(LANES)])

    def probe(self, bits: np.ndarray, low: int, raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in raw (hashes of edits of one length) that the filter holds, and their keys; bits: rows of blocks from `low` on."""
        key = mix(raw)
        block = self.block(key, size) - low
        at = np.nonzero((block >= 0) & (block < len(bits)))[0]
        key, block = key[at], block[at]
        for k in range(LANES):
            ok = bits[block, k] & self.bit(key, k) != 0
            at, key, block = at[ok], key[ok], block[ok]
        return at, key


def edits(words: DataFrame, filters: Filters, alphabet: bytes, bits, low: int) -> DataFrame:
    """word, n and the edits that the filters hold: size, key, p (place from 1) and c (the code point put there, empty: left out)."""
    letters = np.frombuffer(alphabet, np.uint8)
    names = ["word", "n", "size", "key", "p", "c"]

    def run(batches):
        block = bits.value
        for batch in batches:
            text, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for size, (own, m) in by_length(text).items():
                reach = lambda s: s in filters.first and filters.first[s] < low + len(block) and filters.first[s] + filters.count[s] > low
                if not reach(size) and not reach(size - 1):
                    continue
                step = max(1, EDITS // (size * len(letters)))
                for k in range(0, len(own), step):
                    rows = m[k : k + step]
                    sums, power = prefixes(rows), powers(size)
                    found = []
                    if reach(size - 1):
                        # of equal neighbours only the first is left out, as leaving out each gives the same word
                        row, p = np.nonzero(np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1))
                        raw = sums[row, p] + (sums[row, -1] - sums[row, p + 1]) * np.uint64(pow(_BASE, -1, 1 << 64))
                        at, key = filters.probe(block, low, raw, size - 1)
                        found.append((row[at], p[at], np.full(len(at), -1), key, size - 1))
                    if reach(size):
                        wide = max(1, EDITS // (len(rows) * len(letters)))
                        for a in range(0, size, wide):
                            part = rows[:, a : a + wide]
                            row, p, c = np.nonzero(letters[None, None, :] > part[:, :, None])
                            put = letters[c].astype(np.uint64) - part[row, p].astype(np.uint64)
                            at, key = filters.probe(block, low, sums[row, -1] + put * power[p + a], size)
                            found.append((row[at], p[at] + a, letters[c[at]], key, size))
                    for row, p, c, key, target in found:
                        for j in range(0, len(row), 20_000):
                            some = own[k + row[j : j + 20_000]].tolist()
                            columns = [[text[i] for i in some], [n[i] for i in some], np.full(len(some), target, np.int32), key[j : j + 20_000].view(np.int64)]
                            columns += [(p[j : j + 20_000] + 1).astype(np.int32), [chr(x) if x >= 0 else "" for x in c[j : j + 20_000].tolist()]]
                            yield pa.record_batch([pa.array(x) for x in columns], names)

    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, key long, p int, c string")


def near_words(words: DataFrame, scratch: Scratch, blocks: int = ROUND) -> DataFrame:
    """word, n, near, near_n of every pair of near words, once; words: keyed."""
    spark = words.sparkSession
    counts = {r["size"]: r["n"] for r in words.groupBy("size").agg(F.count("*").alias("n")).collect()}
    filters = Filters(counts)
    table = scratch.save(filters.table(words))
    alphabet = bytes(sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()))
    out = []
    for low in range(0, filters.total, blocks):
        rows = table.where((F.col("block") >= low) & (F.col("block") < low + blocks)).toArrow()
        bits = np.zeros((min(blocks, filters.total - low), LANES), np.uint64)
        if rows.num_rows:
            bits[rows.column("block").to_numpy() - low] = np.stack([rows.column(f"b{k}").to_numpy().view(np.uint64) for k in range(LANES)], axis=1)
        sent = spark.sparkContext.broadcast(bits)
        found = edits(words, filters, alphabet, sent, low).alias("e")
        made = F.concat(F.expr("substring(e.word, 1, e.p - 1)"), F.col("e.c"), F.expr("substring(e.word, e.p + 1)"))
        v = words.alias("v")
        pairs = found.join(v, (F.col("e.size") == F.col("v.size")) & (F.col("e.key") == F.col("v.key")) & (made == F.col("v.word")))
        out.append(scratch.save(pairs.select("e.word", "e.n", F.col("v.word").alias("near"), F.col("v.n").alias("near_n"))))
        sent.destroy()
    pairs = out[0] if out else words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    for d in out[1:]:
        pairs = pairs.unionByName(d)
    return pairs


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the last form reached from word; forms: (word, form). The distance covered doubles with each round."""
    links = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        # names of one side change, so that the join of the table with itself is told apart
        step = links.join(links.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = scratch.save(step)
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def spelling_forms(words: DataFrame, often: int = 2, times: int = 10, blocks: int = ROUND) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words (word, n) that occur at least `often` times.

    form: the near word of largest n (ties: the smallest), if that is at least `times` the word's own; root: the end of its chain of forms.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    vocabulary = scratch.save(keyed(words.where(F.col("n") >= often)))
    ends = F.array(F.struct("word", "n", F.col("near").alias("other"), F.col("near_n").alias("other_n")), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    both = near_words(vocabulary, scratch, blocks).select(F.inline(ends))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    large = -F.col("best.less") >= times * F.col("n")
    best = scratch.save(best.select("word", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")))
    last = roots(best.where("form IS NOT NULL"), scratch)
    d = vocabulary.select("word", "n").join(best, "word", "left").join(last, "word", "left")
    return d.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
