"""What finding repeated stretches of bytes or of words has in common: anchors, contexts, coverage and the way back.

A window is `width` units (bytes or words) long. Each window has an anchor: the first place of the smallest hash among
its first `spread` places. It depends on the window's content alone, so equal windows have their anchors at equal
offsets. Windows that follow each other mostly share an anchor; from the first to the last of them they span the
anchor's context. All windows of an anchor contain the `inner` = width - spread + 1 units from the anchor on, so only
anchors whose inner units occur more than once can have a repeated window. Of these, each distinct context is compared
once, however many copies of it there are.

For two contexts with the same inner units, L units in common before the anchor and R from it on, the windows in the
common stretch are equal if L + R >= width. All those stretches contain the anchor, so what a context has repeated is
one interval.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEND, Scratch
from .words import Words, chunks, mix, shingles, slices

#: Contexts of one inner stretch that are compared in one task; beyond it their windows are counted one by one.
GROUP = 20_000
#: Contexts in a bucket.
BUCKET = 10_000
WINDOWS = ["d1", "d2", "r0", "k0", "id", "n", "p"]
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Unit:
    """Bytes or words: width and spread as above, gram: neighbours hashed together for the choice of anchors."""

    words: bool
    width: int
    spread: int
    gram: int

    @property
    def inner(self) -> int:
        return self.width - self.spread + 1

    def read(self, texts: list[bytes]) -> Text:
        return Text(self, texts)


class Text:
    """Some texts as units in one array of places."""

    def __init__(self, unit: Unit, texts: list[bytes]):
        self.unit = unit
        if unit.words:
            self.words = Words(texts)
            self.counts, self.firsts = self.words.counts, self.words.firsts
            self.cut = self.words.text
        else:
            self.counts = np.array([len(t) for t in texts], np.int64)
            self.firsts = np.cumsum(self.counts) - self.counts
            self.buffer = b"".join(texts)
            self.cut = lambda a, b: self.buffer[a:b]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, first window, last window and place of each anchor."""
        unit, none = self.unit, (np.zeros(0, np.int64),) * 4
        total = int(self.counts.sum())
        if total < unit.width:
            return none
        if unit.words:
            keys = shingles(self.words.hashes(), unit.gram)
        else:
            b = np.frombuffer(self.buffer, np.uint8).astype(np.uint64)
            keys = np.zeros(total - unit.gram + 1, np.uint64)
            for k in range(unit.gram):
                keys |= b[k : k + len(keys)] << np.uint64(8 * k)
            keys = mix(keys)
        # the smallest whole hash of `spread` places, the first of equal ones: nothing but the window decides
        low, at, size = keys, np.arange(len(keys)), 1

        def joined(step: int):
            right = low[step:] < low[:-step]
            return np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])

        while size * 2 <= unit.spread:
            low, at = joined(size)
            size *= 2
        if size < unit.spread:
            low, at = joined(unit.spread - size)
        # windows that lie within one text
        long = np.nonzero(self.counts >= unit.width)[0]
        if not len(long):
            return none
        n = self.counts[long] - unit.width + 1
        text = np.repeat(long, n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.firsts[text]
        at = at[window]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(at)) - 1
        return text[first], window[first], window[last], at[first]


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) with id (doc_id, null as the largest) and t (a hash of the text), which tell rows apart; carried columns as x0, x1 and so on."""
    d = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c].alias(f"x{i}") for i, c in enumerate(carry)])
    return d.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "t": F.xxhash64("text")})


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def find_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """id, t, r0 (hash of the inner units), k0 (hash of the context), lo, hi (first and last window), s (anchor)."""
    names = ["id", "t", "r0", "k0", "lo", "hi", "s"]

    def find(batches):
        for batch in batches:
            ids, ts = batch.column("id").to_numpy(), batch.column("t").to_numpy()
            for part in chunks(batch.column("text")):
                x, rows = unit.read([b for _, b in part]), np.array([i for i, _ in part])
                text, lo, hi, s = x.anchors()
                if not len(text):
                    continue
                cut, inner, width, hash64 = x.cut, unit.inner, unit.width, xxhash.xxh3_64_intdigest
                r0 = np.array([hash64(cut(a, a + inner)) for a in s.tolist()], np.uint64).view(np.int64)
                k0 = np.array([hash64(cut(a, b + width), 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64)
                base, row = x.firsts[text], rows[text]
                yield pa.record_batch([pa.array(c) for c in (ids[row], ts[row], r0, k0, (lo - base).astype(np.int32), (hi - base).astype(np.int32), (s - base).astype(np.int32))], names)

    return docs.select("id", "t", "text").mapInArrow(find, "id long, t long, r0 long, k0 long, lo int, hi int, s int")


def coverage(lcp: np.ndarray, right: np.ndarray, left: list[bytes], left_lcp: np.ndarray, left_order: np.ndarray, lengths: np.ndarray, width: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in the order of their right sides: the largest and smallest L for which a window L before the anchor is repeated, or -1.

    lcp and left_lcp: units in common with the one before, in the order of right sides and of reversed left sides;
    right, lengths: units on either side. owner: only windows that a context of a smaller owner has count.
    """
    n = len(lcp)
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for back in range(int(lengths.max(initial=0)) + 1):
        own = np.nonzero((lengths >= back) & (right >= width - back))[0]
        if len(own) < 2:
            continue
        a = np.cumsum(lcp < width - back)
        b = np.empty(n, np.int64)
        b[left_order] = np.cumsum(left_lcp < back)
        code = a[own] * (n + 1) + b[own]
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.ones(len(code), bool)
        first[1:] = code[1:] != code[:-1]
        group = np.cumsum(first) - 1
        if owner is None:
            hit = np.bincount(group)[group] > 1
        else:
            smallest = np.minimum.reduceat(owner[own][order], np.nonzero(first)[0])
            hit = smallest[group] < owner[own][order]
        found = own[order[hit]]
        most[found] = back
        least[found] = np.where(least[found] < 0, back, least[found])
    return most, least


class Repeats:
    """The steps around the comparison of contexts.

    twice: whether anchors count as repeated by their number (n) or by their owners (the ids). compare gets contexts of
    whole groups and yields those with repeated windows.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, unit: Unit, name: str, by_owner: bool, group: int = GROUP, bucket: int = BUCKET, carry: tuple[str, ...] = ()):
        self.spark, self.unit, self.by_owner, self.group, self.bucket = spark, unit, by_owner, group, bucket
        self.scratch = Scratch(spark, name)
        self.docs, self.carry = keyed(docs, carry), carry

    def contexts(self) -> DataFrame:
        """Anchors with repeated inner units are kept in self.places; returned: one row for each distinct context."""
        found = self.scratch.save(find_anchors(self.docs, self.unit))
        many = F.min("id") < F.max("id") if self.by_owner else F.count("*") > 1
        # saved, and dealt out at any size: both sides are plain exchanges, so that a frequent stretch can be split over tasks
        often = self.scratch.save(found.groupBy("r0").agg(many.alias("many")).where("many").select("r0"))
        self.places = self.scratch.save(found.join(often.hint("merge"), "r0", "left_semi"))
        self.scratch.drop(found)
        self.scratch.sweep()
        own = F.min_by(F.struct("t", "lo", "hi", "s"), F.struct("id", "t", "lo")).alias("o")
        self.distinct = self.scratch.save(self.places.groupBy("r0", "k0").agg(F.count("*").alias("n"), F.min("id").alias("id"), own).select("r0", "k0", "n", "id", "o.*"))
        self.scratch.sweep()
        self.keys = self.distinct.select("id", "t").distinct()
        self.small = self.places.select("id", "t").distinct().count() <= SEND
        return self.distinct

    def _some(self, keys: DataFrame) -> DataFrame:
        """The documents with these keys; their texts alone are dealt out if the keys are few enough to be sent round."""
        return self.docs.join(F.broadcast(keys), ["id", "t"], "left_semi") if self.small else self.docs.join(keys, ["id", "t"], "left_semi")

    def strings(self, contexts: DataFrame, emit: Callable, schema: str) -> DataFrame:
        """emit(rows) for the contexts with their texts: rows yield (context fields as a dict, bytes before the anchor, bytes from it on)."""
        lists = contexts.groupBy("id", "t").agg(F.collect_list(F.struct("r0", "k0", "n", "lo", "hi", "s")).alias("contexts"))
        d = self._some(self.keys).select("id", "t", "text").join(lists, ["id", "t"])
        unit = self.unit

        def rows(batches) -> Iterator[tuple[dict, bytes, bytes]]:
            seen: set[tuple[int, int]] = set()
            for batch in slices(batches):
                for row in batch.to_pylist():
                    if (key := (row["id"], row["t"])) in seen:
                        continue
                    seen.add(key)
                    x = unit.read([row["text"].encode("utf-8", "surrogatepass")])
                    for c in row["contexts"]:
                        c["id"] = row["id"]
                        yield c, x.cut(c["lo"], c["s"]) if c["lo"] < c["s"] else b"", x.cut(c["s"], c["hi"] + unit.width)

        return d.mapInArrow(lambda batches: emit(rows(batches)), schema)

    def hot(self) -> DataFrame | None:
        """Inner stretches with more contexts than one task compares, if there are any."""
        hot = self.scratch.save(self.distinct.groupBy("r0").count().where(F.col("count") > self.group).select("r0"))
        return None if hot.isEmpty() else hot

    def windows(self, contexts: DataFrame) -> DataFrame:
        """WINDOWS' columns of all windows of contexts: 128-bit digest, context, window counted from its first."""
        unit = self.unit

        def windows(rows):
            out = []
            for c, before, after in rows:
                x = unit.read([before + after])
                for p in range(c["hi"] - c["lo"] + 1):
                    d = xxhash.xxh3_128_intdigest(x.cut(p, p + unit.width))
                    out.append((signed(d >> 64), signed(d & ((1 << 64) - 1)), c["r0"], c["k0"], c["id"], c["n"], p))
                if len(out) > 20_000:
                    yield batch_of(out, WINDOWS)
                    out = []
            if out:
                yield batch_of(out, WINDOWS)

        return self.strings(contexts, windows, ", ".join(f"{c} long" for c in WINDOWS))

    def counted(self, windows: DataFrame) -> DataFrame:
        """Repeated windows of contexts in hot groups, counted one by one: r0, k0, id, first, last (windows from the context's first)."""
        w = self.scratch.save(windows)
        per = w.groupBy("d1", "d2").agg(F.sum("n").alias("total"), F.min("id").alias("least"))
        hit = w.join(per, ["d1", "d2"]).where(F.col("least") < F.col("id") if self.by_owner else F.col("total") > 1)
        return hit.groupBy("r0", "k0", "id").agg(F.min("p").cast("int").alias("first"), F.max("p").cast("int").alias("last"))

    def intervals(self, found: DataFrame, first: Column, last: Column) -> DataFrame:
        """id, t and the sorted list of (first, stop) units removed; found: by r0, k0; first and last window counted in the text."""
        d = self.places.join(found.withColumnRenamed("id", "owner"), ["r0", "k0"]).select("id", "t", first.alias("a"), last.alias("b"))
        d = d.where(F.col("a").isNotNull()).select("id", "t", F.struct("a", (F.col("b") + self.unit.width).cast("int").alias("z")).alias("x"))
        return self.scratch.save(d.groupBy("id", "t").agg(F.array_sort(F.collect_set("x")).alias("cut")))

    def finish(self, cut: DataFrame, keep: Callable) -> DataFrame:
        """doc_id, text, n_units, spans (start, stop) removed and kept (bytes) of every row; keep(text bytes, spans) -> (n_units, kept)."""
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

        def run(batches):
            for batch in slices(batches):
                lists = batch.column("cut").to_pylist() if "cut" in batch.schema.names else [None] * batch.num_rows
                spans = [merged(c or []) for c in lists]
                out = [keep(t.encode("utf-8", "surrogatepass"), c) for t, c in zip(batch.column("text").to_pylist(), spans, strict=True)]
                columns = [batch.column("doc_id"), batch.column("text"), pa.array([n for n, _ in out], pa.int64()), pa.array([[{"start": a, "stop": z} for a, z in c] for c in spans], span), pa.array([k for _, k in out], pa.binary())]
                yield pa.record_batch([*columns, *[batch.column(c) for c in more]], ["doc_id", "text", "n_units", "spans", "kept", *more])

        more = [f"x{i}" for i in range(len(self.carry))]
        own = "doc_id long, text string, n_units long, spans array<struct<start:int,stop:int>>, kept binary"
        schema = T.StructType([*T.StructType.fromDDL(own).fields, *[self.docs.schema[c] for c in more]])
        keys = cut.select("id", "t")
        if self.small:
            hit = self._some(keys).join(cut, ["id", "t"]).select("doc_id", "text", "cut", *more)
            rest = self.docs.join(F.broadcast(keys), ["id", "t"], "left_anti").select("doc_id", "text", *more)
            out = hit.mapInArrow(run, schema).unionByName(rest.mapInArrow(run, schema))
        else:
            out = self.docs.join(cut, ["id", "t"], "left").select("doc_id", "text", "cut", *more).mapInArrow(run, schema)
        return out.withColumnsRenamed(dict(zip(more, self.carry, strict=True)))

    def found(self, compare: Callable[[DataFrame], DataFrame], windows: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """r0, k0, id, n, first and last repeated window of each context (null: none); compare does it for whole groups of bounded size, windows lists those of hot ones."""
        contexts, hot = self.contexts(), self.hot()
        if hot is None:
            return compare(contexts)
        most = contexts.join(hot, "r0", "left_semi")
        counted = most.select("r0", "k0", "id", "n").join(self.counted((windows or self.windows)(most)).drop("id"), ["r0", "k0"], "left")
        return compare(contexts.join(hot, "r0", "left_anti")).unionByName(counted)

    def buckets(self) -> int:
        return max(1, -(-self.distinct.count() // self.bucket))


def adjacent(rows: list[bytes], size: int) -> np.ndarray:
    """Units in common with the row before, each unit of size bytes; 0 for the first row."""
    out = np.zeros(len(rows), np.int64)
    step = max(1, (1 << 22) // max(1, max(map(len, rows), default=1)))
    for k in range(0, len(rows), step):
        some = rows[max(0, k - 1) : k + step]
        width = max(1, max(map(len, some)))
        m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in some), np.uint8).reshape(len(some), width)
        same = np.ones((len(some) - 1, width + 1), bool)
        same[:, :width] = m[1:] == m[:-1]
        same[:, width] = False
        lengths = np.array([len(x) for x in some])
        common = np.minimum(same.argmin(axis=1), np.minimum(lengths[1:], lengths[:-1])) // size
        at = 1 if k == 0 else k
        out[at : at + len(common)] = common
    return out


def merged(cuts: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in cuts:
        a, z = c["a"], c["z"]
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], z)
        else:
            out.append((a, z))
    return out


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
