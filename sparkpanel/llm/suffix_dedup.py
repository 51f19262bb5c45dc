"""Exact removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Of all suffixes only those at anchors are sorted (see `repeats`): every repeated string has equal anchors at equal
offsets. Suffixes whose first `inner` bytes occur once are told apart by that prefix already and are not exchanged. The
others, each distinct context once, are sorted per task into runs, which are exchanged front-coded: a suffix is sent as
the length it has in common with the one before and the rest. A bucket holds all suffixes of its inner prefixes; its
runs are combined by a loser tree that keeps, for every loser, the prefix length it shares with the winner that passed
it, so that no comparison looks at bytes that are known to be equal. The merge yields the common prefix of each suffix
with the one before, and with the same on the side before the anchors follows which windows are repeated.

Groups of more than `repeats.GROUP` distinct contexts, which one task should not hold, have their windows counted by a
128-bit digest instead, with partial sums before the exchange.

Edge cases: a null or empty text has no bytes and none removed; repeated rows are places of their own, so they remove
each other; equal doc_ids on different texts are different documents; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BUCKET, GROUP, Repeats, Unit, adjacent, coverage

WIDTH, SPREAD = 400, 256
RUN_BYTES = 24_000_000
FOUND = "r0 long, k0 long, id long, n long, first int, last int"


class Run:
    """A sorted run of suffixes, front-coded."""

    FIELDS = (("r0", "<i8"), ("k0", "<i8"), ("id", "<i8"), ("n", "<i8"), ("lcp", "<u4"), ("right", "<u4"), ("left", "<u4"))

    @staticmethod
    def encode(rows: list[tuple[bytes, bytes, dict]]) -> bytes:
        """rows: (suffix, bytes before the anchor, context fields), in the order of suffixes."""
        suffixes = [r[0] for r in rows]
        lcp = adjacent(suffixes, 1)
        columns = {k: [r[2][k] for r in rows] for k in ("r0", "k0", "id", "n")} | {"lcp": lcp, "right": [len(s) for s in suffixes], "left": [len(r[1]) for r in rows]}
        parts = [np.array(columns[k], t).tobytes() for k, t in Run.FIELDS]
        return b"".join([np.array([len(rows)], "<u4").tobytes(), *parts, *[s[n:] for s, n in zip(suffixes, lcp.tolist(), strict=True)], *[r[1] for r in rows]])

    def __init__(self, data: bytes):
        n, at = int(np.frombuffer(data, "<u4", 1)[0]), 4
        for k, t in self.FIELDS:
            setattr(self, k, np.frombuffer(data, t, n, at).astype(np.int64))
            at += n * np.dtype(t).itemsize
        self.common, self.suffixes, self.lefts, last = self.lcp.tolist(), [], [], b""
        for have, size in zip(self.common, self.right.tolist(), strict=True):
            last = last[:have] + data[at : at + size - have]
            at += size - have
            self.suffixes.append(last)
        for size in self.left.tolist():
            self.lefts.append(data[at : at + size])
            at += size


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, the first `known` bytes of which are equal."""
    top, step = min(len(a), len(b)), 16
    while known < top and a[known : known + step] == b[known : known + step]:
        known, step = known + step, step * 2
    if known >= top:
        return top
    stop = min(top, known + step)
    while known < stop:
        half = (known + stop + 1) // 2
        if a[known:half] == b[known:half]:
            known = half
            if known >= top:
                return top
        elif half == known + 1:
            return known
        else:
            stop = half
    return known


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the suffix before) over all runs of (suffixes, common prefixes) in sorted order.

    Each node of the tree keeps a loser as (common, run): what it has in common with the last winner that passed the
    node. Of two players, the one with more in common with the last suffix put out is the smaller; only at equal lengths
    are bytes compared, from that length on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    place = [0] * size
    ended = [k >= len(runs) or not runs[k][0] for k in range(size)]
    tree: list[tuple[int, int]] = [(0, 0)] * size

    def play(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser of two players (common, run)."""
        if ended[a[1]]:
            return b, a
        if ended[b[1]]:
            return a, b
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y = runs[a[1]][0][place[a[1]]], runs[b[1]][0][place[b[1]]]
        n = common_prefix(x, y, a[0])
        if x[n : n + 1] < y[n : n + 1] or (x[n : n + 1] == y[n : n + 1] and a[1] < b[1]):
            return a, (n, b[1])
        return b, (n, a[1])

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return 0, node - size
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while not ended[winner[1]]:
        run = winner[1]
        yield run, place[run], winner[0]
        place[run] += 1
        if place[run] == len(runs[run][0]):
            ended[run] = True
            player = 0, run
        else:
            player = runs[run][1][place[run]], run
        node = (run + size) // 2
        while node:
            player, tree[node] = play(player, tree[node])
            node //= 2
        winner = player


def compare_bucket(payloads: list[bytes], width: int) -> dict[str, np.ndarray]:
    """Contexts of a bucket's runs with repeated windows, by name of FOUND's columns."""
    runs = [Run(p) for p in payloads]
    order = np.array(list(merge_runs([(r.suffixes, r.common) for r in runs])), np.int64).reshape(-1, 3)
    starts = np.cumsum([0] + [len(r.common) for r in runs])
    at = starts[order[:, 0]] + order[:, 1]
    take = lambda k: np.concatenate([getattr(r, k) for r in runs])[at]
    flat = [x for r in runs for x in r.lefts]
    lefts = [flat[i][::-1] for i in at.tolist()]
    left_order = np.array(sorted(range(len(lefts)), key=lefts.__getitem__), np.int64)
    left_lcp = adjacent([lefts[i] for i in left_order.tolist()], 1)
    right, left, n = take("right"), take("left"), take("n")
    most, least = coverage(order[:, 2], right, lefts, left_lcp, left_order, left, width)
    whole = n > 1
    first, last = np.where(whole, 0, left - most), np.where(whole, left + right - width, left - least)
    hit = whole | (most >= 0)
    return {"r0": take("r0")[hit], "k0": take("k0")[hit], "id": take("id")[hit], "n": n[hit], "first": first[hit].astype(np.int32), "last": last[hit].astype(np.int32)}


def suffix_dedup(docs: DataFrame, width: int = WIDTH, spread: int = SPREAD, group: int = GROUP, bucket: int = BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_units (bytes), spans removed and kept bytes of each row of docs (doc_id, text), and the carried columns."""
    r = Repeats(docs.sparkSession, docs, Unit(False, width, spread, 8), "suffix-dedup", False, group, bucket, carry)

    def compare(contexts: DataFrame) -> DataFrame:
        buckets = r.buckets()

        def runs(rows):
            own: dict[int, list] = defaultdict(list)
            held = 0

            def flush():
                keys = sorted(own)
                payloads = [Run.encode(sorted(own[k], key=lambda x: x[0])) for k in keys]
                for i in range(0, len(keys), 16):
                    yield pa.record_batch([pa.array(keys[i : i + 16], pa.int64()), pa.array(payloads[i : i + 16], pa.binary())], ["bucket", "payload"])
                own.clear()

            for c, before, after in rows:
                own[c["r0"] % buckets].append((after, before, c))
                held += len(before) + len(after) + 300
                if held > RUN_BYTES:
                    yield from flush()
                    held = 0
            if own:
                yield from flush()

        def merged(table: pa.Table) -> pa.Table:
            return pa.table(compare_bucket(table.column("payload").to_pylist(), width))

        sent = r.strings(contexts, runs, "bucket long, payload binary")
        return sent.groupBy("bucket").applyInArrow(merged, FOUND)

    found = r.found(compare).where("first IS NOT NULL")
    return r.finish(r.intervals(found, F.col("lo") + F.col("first"), F.col("lo") + F.col("last")), kept_bytes)


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    out, at = [], 0
    for a, z in spans:
        out.append(text[at:a])
        at = z
    return len(text), b"".join([*out, text[at:]])
