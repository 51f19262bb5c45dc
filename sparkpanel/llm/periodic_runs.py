"""Runs: stretches of a document's words that repeat with a period, found by suffix trees.

A run has a smallest period q, at least `times` periods and `least` words, and no neighbouring word extends it. Each is
found from a Lyndon root: for one of two orders of the words (the given one and its reverse), the longest Lyndon word
that starts somewhere in the run is as long as its period. That word reaches from a suffix to the next smaller one, so
two ranks of suffixes give all candidates, two for each place. A candidate is extended to both sides as far as the words
agree one period apart: to the right by the longest common extension in the document, to the left by that in its
reversal. Both are depths of lowest common ancestors in Ukkonen's suffix trees of the document and of its reversal. The
Euler tour of a tree goes down to the lowest common ancestor between one leaf and the next, so a range minimum over
those turning points (a sparse table) answers each in constant time, for all candidates at once.

Before, words are set aside that no run can hold: each word of a run occurs in it `times` times at least, so words that
are rarer in a stretch cut it, again and again until none is rarer. The stretches left are put one after another with
separators that occur once. Most documents have none, and build no tree.

Edge cases: a null or blank text has no words and no runs; a very long text is worked on by one task, which holds some
800 bytes for each word that is left; repeated rows are rows of their own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE
from .words import slices

LEAST, TIMES = 6, 4
RUNS = "array<struct<start:long,length:long,period:long>>"


class SuffixTree:
    """Ukkonen's tree of a list of numbers below `top`; the last one occurs only at the end."""

    def __init__(self, text: list[int], top: int):
        n, self.text = len(text), text
        start, stop, link, child = [0], [0], [0], {}
        node = edge = length = left = 0
        for i, c in enumerate(text):
            left += 1
            last = 0  # inner node that still lacks its link
            while left:
                if not length:
                    edge = i
                key = node * top + text[edge]
                down = child.get(key)
                if down is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    a = start[down]
                    size = min(stop[down], i + 1) - a
                    if length >= size:
                        edge, length, node = edge + size, length - size, down
                        continue
                    if text[a + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start += (a, i)
                    stop += (a + length, n)
                    link += (0, 0)
                    child[key], child[split * top + c] = split, split + 1
                    start[down] = a + length
                    child[split * top + text[a + length]] = down
                    if last:
                        link[last] = split
                    last = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.n, self.start, self.stop = n, np.array(start, np.int64), np.array(stop, np.int64)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self.parent, self.letter, self.node = keys // top, keys % top, np.fromiter(child.values(), np.int64, len(child))

    def tour(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of the leaves, children taken by order[first letter], and the depth of the ancestor between each leaf and the one before."""
        by = np.lexsort((order[self.letter], self.parent))
        nodes, first = self.node[by].tolist(), np.searchsorted(self.parent[by], np.arange(len(self.start) + 1)).tolist()
        size, n = (self.stop - self.start).tolist(), self.n
        suffixes, turns, turn = [], [], 0
        stack = [(0, 0, -1)]
        while stack:
            node, depth, before = stack.pop()
            if before >= 0:
                turn = before
            a, z = first[node], first[node + 1]
            if a == z:
                suffixes.append(n - depth)
                turns.append(turn)
                continue
            for k in range(z - 1, a, -1):
                stack.append((nodes[k], depth + size[nodes[k]], depth))
            stack.append((nodes[a], depth + size[nodes[a]], -1))
        return np.array(suffixes, np.int64), np.array(turns, np.int64)


class Extension:
    """Longest common extensions of pairs of suffixes."""

    def __init__(self, suffixes: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.least, step = [turns.astype(np.int32)], 1
        while 2 * step <= len(turns):
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))
            step *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        out = np.empty(len(i), np.int64)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.nonzero(level == k)[0]
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k) + 1])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """The next place of smaller rank; the last place has the smallest."""
    out, stack = [0] * len(rank), [len(rank) - 1]
    for i in range(len(rank) - 2, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


def runs_of(text: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of numbers from 1."""
    n, top = len(text), int(text.max(initial=0)) + 1
    there = [*text.tolist(), 0]
    tree = SuffixTree(there, top)
    up, down = np.arange(top), -np.arange(top)
    down[0] = -top  # the end is the smallest in both orders
    suffixes, turns = tree.tour(up)
    right, reverse = Extension(suffixes, turns), tree.tour(down)[0]
    back = Extension(*SuffixTree([*there[-2::-1], 0], top).tour(up))
    other = np.empty(n + 1, np.int64)
    other[reverse] = np.arange(n + 1)
    found = []
    for rank in (right.rank, other):
        i, j = np.arange(n), np.array(next_smaller(rank.tolist())[:n], np.int64)
        period = j - i
        # a place j before the end stands at n - j in the reversal, and its left side begins there
        before, after = back.of(n - i, n - j), right.of(i, j)
        length = before + period + after
        ok = (length >= least) & (length >= times * period)
        found.append(np.stack([i[ok] - before[ok], length[ok], period[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0)[:, [0, 1, 2]].tolist()


def stretches(ids: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose word occurs `times` times in their stretch of such places, of `least` words at least, and the number of the stretch."""
    at = np.nonzero(np.bincount(ids)[ids] >= times)[0]
    while len(at):
        group = np.cumsum(np.diff(at, prepend=at[0] - 1) != 1)
        _, code, count = np.unique(group * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = (count[code] >= times) & (np.bincount(group)[group] >= least)
        if keep.all():
            return at, group
        at = at[keep]
    return at, at


def periodic_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document, by start and period."""
    if len(words) < max(least, times):
        return []
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    if len(names) > len(words) - times + 1:
        return []
    at, group = stretches(ids, least, times)
    if not len(at):
        return []
    _, own = np.unique(ids[at], return_inverse=True)
    # a separator of its own before each stretch but the first
    new = np.nonzero(np.diff(group))[0] + 1
    text = np.insert(own + 1, new, own.max() + 2 + np.arange(len(new)))
    place = np.insert(at, new, -1)
    return sorted((int(place[a]), length, q) for a, length, q in runs_of(text, least, times))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that any run holds after its first period."""
    out, at = [], 0
    for a, z in sorted((start + q, start + length) for start, length, q in runs):
        if a > at:
            out += words[at:a]
        at = max(at, z)
    return out + words[at:]


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and kept (words outside of repeated periods, joined by blanks)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, found, kept = [], [], []
            for t in batch.column("text").to_pylist():
                words = t.encode("utf-8", "surrogatepass").split()
                runs = periodic_runs(words, least, times)
                counts.append(len(words))
                found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind), texts], ["doc_id", "n_words", "runs", "kept"])

    d = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, kept string")


def plant_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text, where a checksum of the id picks one document in ten whose words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split: Column = F.filter(F.split("text", SPACE), lambda w: w != "")
    d = docs.select("doc_id", docs["text"].cast("string").alias("text"), h.alias("h"))
    d = d.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, split).alias("words"))
    d = d.select("*", F.size("words").alias("n"))
    a = F.col("g") % F.when(F.col("n") > 0, F.col("n"))
    d = d.select("*", a.cast("int").alias("a")).select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    return d.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))
