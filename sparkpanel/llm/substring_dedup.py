"""Removal of passages that an earlier document has, by automata of repeated phrases.

Words are runs of anything but ASCII white space. Anchors (see `repeats`) whose next `inner` words occur in more than
one document are phrases that may begin a repeated passage. They are dealt into shards of bounded size, and so are the
stretches of all documents in which one of a shard's phrases can stand; words of a document outside of these hold no
repeated phrase. Each shard confirms its phrases word for word, compiles those that recur into an Aho-Corasick automaton
over word numbers and streams its stretches through it. Of the occurrences that the automaton finds, those that lie in all windows of a
stretch are compared word by word to both sides: a window of `width` words is removed if a document of smaller doc_id
has it.

Each distinct stretch is streamed once, for its smallest doc_id; copies of it in other documents follow from that.
Groups of more than `repeats.GROUP` distinct stretches of one phrase are spread over several shards; there the windows
around each occurrence are counted by a 128-bit digest, with partial minima before the exchange.

Edge cases: a null or blank text has no words; rows with equal doc_id never remove each other's words; a null doc_id
counts as the largest; a very long text is worked on by one task, which holds some 60 bytes for each of its words; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BUCKET, GROUP, WINDOWS, Repeats, Unit, adjacent, coverage, signed
from .suffix_dedup import FOUND

WIDTH, SPREAD = 50, 32


def located(phrases: list[tuple[int, ...]], stretches: list[tuple[int, ...]]) -> Iterator[tuple[int, int]]:
    """(stretch, place) of every occurrence of a phrase; words are numbers, all phrases of one length."""
    import ahocorasick

    if not phrases:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in phrases:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    for i, stretch in enumerate(stretches):
        for end, size in automaton.iter(stretch):
            yield i, end + 1 - size


class Shard:
    """Stretches (r0, k0, id, n, words before the anchor, words from it on) and the occurrences of their recurring phrases."""

    def __init__(self, table: pa.Table, width: int, inner: int, least: int = 2):
        """least: copies that a phrase must have here. Kept are occurrences that lie in all windows of their stretch."""
        names: dict[str, int] = {}
        number = lambda text: [names.setdefault(w, len(names)) for w in text.split(" ")] if text else []
        before, after = [number(t) for t in table.column("before").to_pylist()], [number(t) for t in table.column("after").to_pylist()]
        self.stretches = [tuple(a + b) for a, b in zip(before, after, strict=True)]
        copies: Counter[tuple[int, ...]] = Counter()
        for a, n in zip(after, table.column("n").to_pylist(), strict=True):
            copies[tuple(a[:inner])] += n
        found = located([p for p, n in copies.items() if n >= least and len(p) == inner], self.stretches)
        found = [(i, q) for i, q in found if len(self.stretches[i]) - width <= q <= width - inner]
        self.row, self.place = np.array(found, np.int64).reshape(-1, 2).T
        self.columns = {k: table.column(k).to_numpy()[self.row] for k in ("r0", "k0", "id", "n")}


def compare_shard(table: pa.Table, width: int, inner: int) -> pa.Table:
    """FOUND's columns for each occurrence with repeated windows."""
    s = Shard(table, width, inner)
    packed = lambda words: np.array(words, ">u4").tobytes()
    sides = [(packed(s.stretches[i][q:]), packed(s.stretches[i][:q][::-1])) for i, q in zip(s.row.tolist(), s.place.tolist(), strict=True)]
    order = np.array(sorted(range(len(sides)), key=lambda i: sides[i][0]), np.int64)
    rights, lefts = [sides[i][0] for i in order.tolist()], [sides[i][1] for i in order.tolist()]
    lcp = adjacent(rights, 4)
    left_order = np.array(sorted(range(len(lefts)), key=lefts.__getitem__), np.int64)
    left_lcp = adjacent([lefts[i] for i in left_order.tolist()], 4)
    left, right = s.place[order], np.array([len(x) // 4 for x in rights], np.int64)
    c = {k: v[order] for k, v in s.columns.items()}
    most, least = coverage(lcp, right, lefts, left_lcp, left_order, left, width, c["id"])
    hit = (most >= 0) | (c["n"] > 1)
    some = lambda x: pa.array(np.where(most >= 0, left - x, 0)[hit].astype(np.int32), mask=(most < 0)[hit])
    return pa.table({**{k: v[hit] for k, v in c.items()}, "first": some(most), "last": some(least)})


def count_shard(table: pa.Table, width: int, inner: int) -> pa.Table:
    """WINDOWS' columns for the windows around each occurrence; the phrases are those of hot groups, which are known to recur."""
    s = Shard(table, width, inner, 1)
    words = [f"{a} {b}".split() for a, b in zip(table.column("before").to_pylist(), table.column("after").to_pylist(), strict=True)]
    own: dict[tuple[int, int], tuple] = {}
    for k, (i, q) in enumerate(zip(s.row.tolist(), s.place.tolist(), strict=True)):
        for p in range(max(0, q + inner - width), min(q, len(words[i]) - width) + 1):
            if (i, p) not in own:
                d = xxhash.xxh3_128_intdigest(" ".join(words[i][p : p + width]).encode("utf-8", "surrogatepass"))
                own[i, p] = (signed(d >> 64), signed(d & ((1 << 64) - 1)), *(int(s.columns[c][k]) for c in ("r0", "k0", "id", "n")), p)
    return pa.table([pa.array(c, pa.int64()) for c in (list(zip(*own.values(), strict=True)) or [()] * 7)], WINDOWS)


def substring_dedup(docs: DataFrame, width: int = WIDTH, spread: int = SPREAD, group: int = GROUP, bucket: int = BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_units (words), spans of words removed and kept (UTF-8, joined by blanks) of each row of docs (doc_id, text), and the carried columns."""
    unit = Unit(True, width, spread, 3)
    r = Repeats(docs.sparkSession, docs, unit, "substring-dedup", True, group, bucket, carry)

    inner, names = unit.inner, ["shard", "r0", "k0", "id", "n"]

    def sent(contexts: DataFrame, shard) -> DataFrame:
        def send(rows):
            out = []

            def batch():
                columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:5]]
                return pa.record_batch([*columns, pa.array([x[5] for x in out], pa.string()), pa.array([x[6] for x in out], pa.string())], [*names, "before", "after"])

            for c, before, after in rows:
                out.append((shard(c), c["r0"], c["k0"], c["id"], c["n"], before.decode("utf-8", "replace").rstrip(" "), after.decode("utf-8", "replace")))
                if len(out) == 4000:
                    yield batch()
                    out = []
            if out:
                yield batch()

        return r.strings(contexts, send, "shard long, r0 long, k0 long, id long, n long, before string, after string").groupBy("shard")

    def compare(contexts: DataFrame) -> DataFrame:
        shards = r.buckets()
        return sent(contexts, lambda c: c["r0"] % shards).applyInArrow(lambda t: compare_shard(t, width, inner), FOUND)

    def windows(contexts: DataFrame) -> DataFrame:
        parts = max(1, r.buckets())
        return sent(contexts, lambda c: (c["r0"] ^ c["k0"]) % parts).applyInArrow(lambda t: count_shard(t, width, inner), ", ".join(f"{c} long" for c in WINDOWS))

    found = r.found(compare, windows).where("first IS NOT NULL OR n > 1")
    at = lambda c, own: F.when(F.col("id") > F.col("owner"), F.col(c)).otherwise(F.col("lo") + F.col(own))
    return r.finish(r.intervals(found, at("lo", "first"), at("hi", "last")), kept_words)


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    words = text.split()
    out, at = [], 0
    for a, z in spans:
        out += words[at:a]
        at = z
    return len(words), b" ".join(out + words[at:])
