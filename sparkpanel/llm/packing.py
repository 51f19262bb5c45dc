"""Best-fit packing of token sequences by linear grouping.

Documents are encoded and cut into pieces in one pass over the texts. Only the counts of the piece lengths, of which
there are at most `capacity`, come to the driver; the plan is made on counts and so costs the same at any number of
documents:

1. Large lengths, sorted downwards, are dealt into groups of equal numbers of pieces and rounded up to their group's
   largest length.
2. Configurations of a few rounded sizes that fill a sequence best are chosen and applied as often as their sizes allow.
3. Actual pieces take the places of the rounded ones, which leaves runs of sequences with the same contents by length.
4. Small lengths, from the largest down, go where the least room is left that holds them, run by run.

A piece finds its place from its rank among the pieces of its length; ranks are made of a local count within each
partition and the counts of the partitions before it, so no partition holds all pieces of a length.

Edge cases: a null or empty text is one piece with the end id only; repeated rows are packed each by itself; a text of
any length is cut whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import Encoder, tokenizer_path
from .words import slices

#: More groups round lengths up less; the plan's cost depends on the number of lengths, which `capacity` bounds.
CAPACITY, END, GROUPS, SMALL = 2048, 0, 8192, 512


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """part, doc_id, piece, start, length, ids_crc32 and k, the piece's rank among those of its length in its partition."""
    fields = [("part", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("k", pa.int64())]

    def cut(batches):
        encoder, part, seen = Encoder.get(path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, 1024):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, end).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((part, doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), seen[len(own)]))
                    seen[len(own)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(cut, "part long, doc_id long, piece int, start long, length long, ids_crc32 long, k long")


class Plan:
    """Where the r-th piece of each length goes: runs[length] has (first rank, first sequence, pieces in each sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        self.capacity, self.n = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.taken: Counter[int] = Counter()
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first sequence, sequences)
        self.rooms: list[int] = []
        self._large({k: v for k, v in counts.items() if k > small}, groups)
        self._small({k: v for k, v in counts.items() if k <= small})

    def _put(self, length: int, first: int, sequences: int, each: int, offset: int) -> None:
        self.runs[length].append((self.taken[length], first, each, offset))
        self.taken[length] += sequences * each

    def _leave(self, room: int, first: int, sequences: int) -> None:
        if room and sequences:
            if not self.room[room]:
                insort(self.rooms, room)
            self.room[room].append((first, sequences))

    def _large(self, counts: dict[int, int], groups: int) -> None:
        total = sum(counts.values())
        # groups of equal numbers of pieces, from the longest down: lists of [length, pieces]
        members, at, size = [[] for _ in range(groups)], 0, max(1, -(-total // groups))
        for length in sorted(counts, reverse=True):
            left = counts[length]
            while left:
                take = min(left, (at // size + 1) * size - at)
                members[at // size].append([length, take])
                at, left = at + take, left - take
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            if m:
                merged.setdefault(m[0][0], []).extend(m)
        left = {size: sum(n for _, n in m) for size, m in merged.items()}
        while left:
            shape = self._configuration(left)
            times = min(left[s] // n for s, n in Counter(shape).items())
            streams = []
            for s in shape:
                streams.append(self._take(merged[s], times))
                left[s] -= times
                if not left[s]:
                    del left[s]
            self._apply(streams, times)

    def _configuration(self, left: dict[int, int]) -> list[int]:
        """The largest size that is left, and those that fill the rest of the sequence best: one, two or three at a time."""
        shape, have = [max(left)], Counter(left)
        have[shape[0]] -= 1
        free = self.capacity - shape[0]
        while True:
            sizes = np.array(sorted(s for s, n in have.items() if n > 0 and s <= free))
            if not len(sizes):
                return shape
            best = [int(sizes[-1])]
            pair = sizes[:, None] + sizes[None, :]
            pair = np.where(pair <= free, pair, 0)
            twice = np.array([have[int(s)] > 1 for s in sizes])
            pair[np.arange(len(sizes)), np.arange(len(sizes))] *= twice
            i, j = np.unravel_index(pair.argmax(), pair.shape)
            if pair[i, j] > sum(best):
                best = [int(sizes[i]), int(sizes[j])]
            for s in best:
                shape.append(s)
                have[s] -= 1
                free -= s

    @staticmethod
    def _take(stream: list[list[int]], n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            length, have = stream[0]
            take = min(n, have)
            out.append((length, take))
            n -= take
            if take == have:
                stream.pop(0)
            else:
                stream[0][1] -= take
        return out

    def _apply(self, streams: list[list[tuple[int, int]]], times: int) -> None:
        """Sequences in runs of equal contents."""
        edges = {0, times}
        for s in streams:
            at = 0
            for _, n in s:
                at += n
                edges.add(at)
        cuts, places = sorted(edges), [0] * len(streams)
        done = [0] * len(streams)
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for k, s in enumerate(streams):
                length, n = s[places[k]]
                self._put(length, self.n, b - a, 1, offset)
                offset += length
                done[k] += b - a
                if done[k] == n:
                    places[k], done[k] = places[k] + 1, 0
            self._leave(self.capacity - offset, self.n, b - a)
            self.n += b - a

    def _small(self, counts: dict[int, int]) -> None:
        for length in sorted(counts, reverse=True):
            left = counts[length]
            while left:
                i = bisect_left(self.rooms, length)
                if i == len(self.rooms):
                    each = min(self.capacity // length, left)
                    n = left // each
                    self._put(length, self.n, n, each, 0)
                    self._leave(self.capacity - each * length, self.n, n)
                    self.n, left = self.n + n, left - n * each
                    continue
                room = self.rooms[i]
                first, have = self.room[room].pop()
                if not self.room[room]:
                    self.rooms.pop(i)
                each = min(room // length, left)
                n = min(have, left // each)
                self._put(length, first, n, each, self.capacity - room)
                self._leave(room, first + n, have - n)
                self._leave(room - each * length, first, n)
                left -= n * each


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of docs (doc_id, text): its place in a sequence."""
    saved = Scratch(docs.sparkSession, "packing").save(pieces(docs, path or tokenizer_path(), capacity, end))
    counts = saved.groupBy("part", "length").agg(F.count("*").alias("n"))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    runs = {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in plan.runs.items()}
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = saved.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.nonzero(length == n)[0]
                first, to, each, at = runs[n]
                i = np.searchsorted(first, rank[own], "right") - 1
                k = rank[own] - first[i]
                sequence[own], offset[own] = to[i] + k // each[i], at[i] + k % each[i] * n
            out = batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield out

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
