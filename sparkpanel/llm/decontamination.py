"""Benchmark decontamination: MinHash containment search partitioned by size, exact lookup of short items, then exact shingle containment.

Words are runs of digits, letters and non-ASCII characters of the lower-cased text; a text's shingles are its distinct
sequences of five words (a shorter text: its whole sequence; without words: none). A document is contaminated by a
benchmark item if it holds at least 0.8 of the item's shingles.

Items are put into size partitions, each 1.5 times as long as the one before. For a partition of up to m shingles, every
document is cut into blocks of m shingles; MinHash values of two neighbouring blocks make up the window's signature, so
any stretch of m shingles of a document of any length lies wholly in one window that is at most 3.75 times as long as
the item. A window that agrees with an item in any of `perms` values makes its document a candidate for the item, and
candidates are verified on the sets themselves in the same task. For hashes like random ones, the chance to miss an item
that stands in one stretch is at most (1 - 1 / 3.75)^40 = 4e-6 if it is whole and (1 - 0.8 / 3.95)^40 = 1.2e-4 if 0.8 of
it is left; an item whose shingles are spread over more than 1.25 times its size has no such bound.

Items of fewer than `FEW` distinct shingles, and those that repeat a shingle, are too small a part of such a window and are
looked up exactly: of an item of c shingles that must share r, any c - r + 1 have one that the document holds, so documents
that hold one of these (the ones that fewest items have) are the candidates, and none is missed.

Only items travel: blocks of about `block` items and `block_bytes` bytes at most are sent to the tasks, one pass over the
documents for each block and one block at a time, so a benchmark of any size is searched and no text is shuffled.

Edge cases: null and empty texts and items match nothing; repeated rows of either table match each by itself; other
columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, Scratch, row_key, without
from .words import PLAIN, Words, chunks, shingle_sets, shingles

SHINGLE, SHARE, PERMS, RATIO, FEW = 5, 0.8, 40, 1.5, 8
BLOCK, BLOCK_BYTES = 50_000, 32_000_000
FOUND = "item_id long, n_item_shingles long, n_shared long, containment double"


class ItemIndex:
    """Items by size partition, with the sorted MinHash values of each permutation; short and repeating ones by shingle."""

    def __init__(self, ids: list[int | None], texts: list[str | None], share: float = SHARE, n: int = SHINGLE, perms: int = PERMS):
        self.n, self.share = n, share
        self.factors = np.random.default_rng(7).integers(1, 1 << 63, perms, np.uint64) * np.uint64(2) + np.uint64(1)
        words = Words([(t or "").encode("utf-8", "surrogatepass") for t in texts], PLAIN)
        self.sets = shingle_sets(words, n)
        self.ids = ids
        sizes = [max(1, c - n + 1) for c in words.counts.tolist()]
        parts: dict[int, list[int]] = {}
        exact = [i for i, size in enumerate(sizes) if 0 < len(self.sets[i]) < max(FEW, size)]
        self._look_up(exact)
        for i, size in enumerate(sizes):
            if len(self.sets[i]) >= max(FEW, size):
                m = 8
                while m < 1.25 * size:  # room for words put in between
                    m = int(m * RATIO)
                parts.setdefault(m, []).append(i)
        self.parts = {}
        for m, own in parts.items():
            values = np.array([[(self.sets[i] * f).min() for i in own] for f in self.factors], np.uint64)
            order = np.argsort(values, axis=1)
            self.parts[m] = np.array(own), np.take_along_axis(values, order, 1), order

    _own: tuple[str, ItemIndex] | None = None

    @classmethod
    def get(cls, name: str, sent: Broadcast, share: float) -> ItemIndex:
        """The one index that this Python worker holds, made anew for another block of items."""
        if cls._own is None or cls._own[0] != name:
            rows = sent.value
            cls._own = name, cls([r[0] for r in rows], [r[1] for r in rows], share)
        return cls._own[1]

    def _look_up(self, exact: list[int]) -> None:
        """keys, owners: sorted shingles, and their items, of which a text must hold one to hold share of the item."""
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        known, often = np.unique(np.concatenate([*keys, *(self.sets[i] for i in exact)]), return_counts=True)
        for i in exact:
            own = self.sets[i]
            least = max(1, int(np.ceil(self.share * len(own) - 1e-9)))
            rare = np.argsort(often[np.searchsorted(known, own)], kind="stable")[: len(own) - least + 1]
            keys.append(own[rare])
            owners.append(np.full(len(rare), i, np.int64))
        k, o = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(k, kind="stable")
        self.keys, self.owners = k[order], o[order]

    def candidates(self, s: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of texts whose shingles are s[first : first + count], count > 0, that share a value or a key with an item."""
        found: set[tuple[int, int]] = set()
        if len(self.keys):
            i = np.searchsorted(self.keys, s)
            i[i == len(self.keys)] = 0
            hits = np.nonzero(self.keys[i] == s)[0]
            text = np.searchsorted(firsts, hits, "right") - 1
            for t, k in np.unique(np.stack([text, i[hits]], axis=1), axis=0).tolist():
                stop = int(np.searchsorted(self.keys, self.keys[k], "right"))
                found.update((t, o) for o in self.owners[k:stop].tolist())
        cuts = {}
        for m in self.parts:
            blocks = -(-counts // m)
            text = np.repeat(np.arange(len(counts)), blocks)
            at = firsts[text] + m * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            # reduceat runs from each cut to the next: texts stand one after another, the odd shingles between them are cut off
            cuts[m] = text, at
        for p, f in enumerate(self.factors):
            v = s * f
            for m, (own, values, order) in self.parts.items():
                text, at = cuts[m]
                least = np.minimum.reduceat(v, at)
                both = least.copy()
                same = text[1:] == text[:-1]
                both[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                i = np.searchsorted(values[p], both)
                i[i == len(own)] = 0
                for w in np.nonzero(values[p][i] == both)[0].tolist():
                    k = int(i[w])
                    while k < len(own) and values[p][k] == both[w]:
                        found.add((int(text[w]), int(own[order[p][k]])))
                        k += 1
        return found

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, size of the item's set, shared) of texts that hold at least share of an item."""
        words, n = Words(texts, PLAIN), self.n
        h = words.hashes()
        # shingles of each text without those over its end; a short text's only one
        s, whole = [], shingles(h, n)
        for first, count in zip(words.firsts.tolist(), words.counts.tolist(), strict=True):
            s.append(whole[first : first + count - n + 1] if count >= n else shingles(h[first : first + count], count) if count else whole[:0])
        counts = np.array([len(x) for x in s], np.int64)
        some = np.nonzero(counts)[0]
        if not len(some) or not self.parts and not len(self.keys):
            return []
        firsts = np.cumsum(counts[some]) - counts[some]
        out, sets = [], {}
        for t, i in sorted(self.candidates(np.concatenate(s), firsts, counts[some])):
            t = int(some[t])
            if t not in sets:
                sets[t] = np.unique(s[t])
            shared = int(np.isin(self.sets[i], sets[t], assume_unique=True).sum())
            if shared >= self.share * len(self.sets[i]) - 1e-9:
                out.append((t, i, len(self.sets[i]), shared))
        return out


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (doc_id, text) and benchmark item (item_id, text) that it holds."""
    spark = docs.sparkSession
    items = items.select("item_id", items["text"].cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(-(-size["n"] // block), -(-size["b"] // block_bytes))
    docs = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(FOUND).fields])
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def search_for(own: DataFrame) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])
        name = uuid.uuid4().hex

        def search(batches):
            index = ItemIndex.get(name, sent, share)
            for batch in batches:
                ids = batch.column("doc_id")
                kinds[0] = ids.type
                for part in chunks(batch.column("text")):
                    found = [(ids[part[t][0]].as_py(), index.ids[i], n, shared, shared / n) for t, i, n, shared in index.search([b for _, b in part])]
                    if found:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], schema.names)

        return docs.mapInArrow(search, schema), sent

    if blocks <= 1:
        return search_for(items)[0]
    # one pass a block; its items leave the driver before the next block comes
    scratch, out = Scratch(spark, "benchmark"), None
    items = scratch.save(items.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
    for k in range(blocks):
        d, sent = search_for(items.where(F.col("block") == k).select("item_id", "text"))
        d = scratch.save(d)
        sent.destroy()
        out = d if out is None else out.unionByName(d)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    key = row_key(docs, "doc_id", "text")
    found = contaminated(docs.select(key.alias("doc_id"), "text"), items, share).select("doc_id").distinct()
    return without(docs, key, Scratch(docs.sparkSession, "decontamination").save(found))


_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_SHINGLES = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: w[i:i + {SHINGLE - 1}]) WHEN len(w) > 0 THEN [w] ELSE [] END"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT rid, doc_id, s FROM (SELECT rid, doc_id, unnest({_SHINGLES}) AS s FROM d)),
si AS (SELECT DISTINCT iid, item_id, s FROM (SELECT iid, item_id, unnest({_SHINGLES}) AS s FROM i)),
n AS (SELECT iid, count(*) AS n FROM si GROUP BY iid)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / any_value(n) AS containment
FROM ds JOIN si USING (s) JOIN n USING (iid) GROUP BY rid, doc_id, iid, item_id HAVING count(*) >= {SHARE} * any_value(n) - 1e-9"""
