"""Token ids in files, compressed by a grammar of frequent pairs (Re-Pair) per block.

Documents are put into ascending doc_id order by range partitioning (equal ids are ordered, and may be split, by a hash
of their text). Each partition writes blocks of whole documents. In a block, pairs of neighbouring symbols are replaced
by new symbols until no pair pays for its rule, many pairs a round: those of a round never overlap, because no symbol is
a right side of one and a left side of another. A block keeps its rules, the expansion length of each, and the sequence
left, so any stretch of ids can be decoded from the running sum of expansion lengths.

A block's payload: 4-byte magic, then as unsigned 32-bit little-endian numbers the first free symbol, the symbol width
in bytes, the count of rules and the length of the sequence; then left sides, right sides (both in the width), expansion
lengths (32 bits) and the sequence (in the width). Blocks are rows of a Parquet table, so any store that Spark reaches
will do.

Edge cases: a null or empty text has the end id only; null doc_ids come first; repeated rows are written each by
itself; a document is never split over blocks, so a very long one is a block by itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import Encoder, tokenizer_path
from .words import slices

END, MAGIC, BLOCK_IDS, AT_LEAST = 1, b"RPG1", 1 << 19, 6


def choose(pairs: np.ndarray, counts: np.ndarray, half: int, symbols: int) -> np.ndarray:
    """Of pairs (codes), which can be replaced together, from the most frequent down: no symbol ends one and begins another, and x, x stands alone."""
    order = np.argsort(-counts, kind="stable")
    role, chosen = bytearray(symbols), []  # 1: begins pairs, 2: ends pairs, 3: its own pair
    lefts, rights = (pairs[order] >> pairs.dtype.type(half)).tolist(), (pairs[order] & pairs.dtype.type((1 << half) - 1)).tolist()
    for i, x, y in zip(order.tolist(), lefts, rights, strict=True):
        if x == y:
            if not role[x]:
                role[x] = 3
                chosen.append(i)
        elif role[x] < 2 and role[y] in (0, 2):
            role[x], role[y] = 1, 2
            chosen.append(i)
    return np.array(chosen, np.int64)


def numbered(pairs: np.ndarray, codes: np.ndarray, bits: int = 18) -> np.ndarray:
    """For each code its index in pairs (distinct), or -1; by tables of 2^bits slots, a second for pairs that lost theirs, and so on."""
    out, todo, own, salt = np.full(len(codes), -1, np.int32), None, np.arange(len(pairs), dtype=np.int32), 0x9E3779B1
    while len(own):
        slot = lambda x: (x * x.dtype.type(salt & 0xFFFFFFFF) >> x.dtype.type(32 - bits)) & x.dtype.type((1 << bits) - 1)  # noqa: B023, E731
        at = slot(pairs[own])
        table = np.full(1 << bits, -1, np.int32)
        table[at] = own
        i = table[slot(codes if todo is None else codes[todo])]
        good = np.nonzero(i >= 0)[0]
        good = good[pairs[i[good]] == (codes[good] if todo is None else codes[todo[good]])]
        out[good if todo is None else todo[good]] = i[good]
        own = own[table[at] != own]
        todo, salt = np.nonzero(out < 0)[0], salt + 0x85EBCA6A
    return out


def compress(ids: np.ndarray, free: int, at_least: int = AT_LEAST) -> bytes:
    """The payload of a block; free: the first symbol that no id uses.

    Each round counts the pairs at live places: those whose pair was frequent when last counted, and those next to a new
    symbol. Other pairs can only get rarer. Rounds go on until no pair occurs at_least times, at which a rule of 8 bytes
    pays with symbols of two bytes. Where ids fit into two bytes so do all symbols: a rule past 65,536 would double every
    symbol of the block, so the rarest pairs are then left as they are.
    """
    seq, left, right, size = ids.astype(np.uint32), [], [], np.ones(free, np.int64)
    half = 16 if free < 1 << 16 else 32
    kind, limit = (np.uint32, 1 << 16) if half == 16 else (np.uint64, 1 << 31)
    live = np.arange(len(seq) - 1) if len(seq) > 1 else np.zeros(0, np.int64)
    while len(live) and free + len(left) < limit:
        # symbols of 16 bits make codes of 32, which sort faster
        codes = seq[live].astype(kind) << kind(half) | seq[live + 1].astype(kind)
        order = np.sort(codes)
        starts = np.concatenate([[0], np.nonzero(order[1:] != order[:-1])[0] + 1])
        counts = np.diff(starts, append=len(order))
        often = counts >= at_least
        if not often.any():
            break
        pairs, counts = order[starts[often]], counts[often]
        i = numbered(pairs, codes)
        frequent = i >= 0
        live, i = live[frequent], i[frequent]
        chosen = choose(pairs, counts, half, free + len(left))[: limit - free - len(left)]
        new = np.full(len(pairs), -1, np.int64)
        new[chosen] = free + len(left) + np.arange(len(chosen))
        x, y = (pairs[chosen] >> kind(half)).astype(np.int64), (pairs[chosen] & kind((1 << half) - 1)).astype(np.int64)
        left += x.tolist()
        right += y.tolist()
        size = np.concatenate([size, size[x] + size[y]])
        hit = new[i] >= 0
        at, name = live[hit], new[i[hit]]
        # of a run of x, x the first, third and so on are replaced
        same = np.nonzero(seq[at] == seq[at + 1])[0]
        if len(same):
            own = at[same]
            first = np.concatenate([[True], (own[1:] != own[:-1] + 1)])
            start = own[first][np.cumsum(first) - 1]
            keep = np.ones(len(at), bool)
            keep[same[(own - start) % 2 == 1]] = False
            at, name = at[keep], name[keep]
        seq[at] = name
        gone = np.zeros(len(seq), bool)
        gone[at + 1] = True
        # live places of what is left: frequent pairs that still stand, and both sides of new symbols
        alive = np.zeros(len(seq), bool)
        alive[live] = True
        alive[at] = True
        alive = alive[~gone]
        seq = seq[~gone]
        fresh = at - np.arange(len(at))
        alive[fresh[fresh > 0] - 1] = True
        alive[-1] = False
        live = np.nonzero(alive)[0]
    kind = np.dtype("<u2") if free + len(left) <= 1 << 16 else np.dtype("<u4")
    head = np.array([free, kind.itemsize, len(left), len(seq)], "<u4").tobytes()
    return b"".join([MAGIC, head, np.array(left, kind).tobytes(), np.array(right, kind).tobytes(), size[free:].astype("<u4").tobytes(), seq.astype(kind).tobytes()])


class Block:
    """A payload to read from: len() and any stretch of ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.free, width, rules, n = np.frombuffer(payload, "<u4", 4, 4).tolist()
        kind, at = np.dtype(f"<u{width}"), 20
        self.left = np.frombuffer(payload, kind, rules, at).astype(np.int64)
        self.right = np.frombuffer(payload, kind, rules, at + rules * width).astype(np.int64)
        self.size = np.frombuffer(payload, "<u4", rules, at + 2 * rules * width).astype(np.int64)
        self.seq = np.frombuffer(payload, kind, n, at + 2 * rules * width + 4 * rules).astype(np.int64)
        each = np.ones(n, np.int64)
        rule = self.seq >= self.free
        each[rule] = self.size[self.seq[rule] - self.free]
        self.ends = np.cumsum(each)
        self.flat, self.at = None, np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to before stop; only the symbols that cover them are expanded."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, [start, stop - 1], "right")
        before = int(self.ends[a - 1]) if a else 0
        seq = self.seq[a : b + 1]
        if self.flat is None and b - a < len(self.left):
            return self._expanded(seq)[start - before : stop - before].astype(np.uint32)
        if self.flat is None:  # expansions of all rules, one after another
            self.flat = self._expanded(np.arange(self.free, self.free + len(self.left)))
        rule = seq >= self.free
        own = seq[rule] - self.free
        each, source = np.ones(len(seq), np.int64), np.arange(len(seq)) + len(self.flat)
        each[rule], source[rule] = self.size[own], self.at[own]
        ends = np.cumsum(each)
        out = np.concatenate([self.flat, seq])[np.repeat(source - (ends - each), each) + np.arange(ends[-1])]
        return out[start - before : stop - before].astype(np.uint32)

    def _expanded(self, seq: np.ndarray) -> np.ndarray:
        """Symbols with every rule replaced by its sides until only ids are left."""
        while (rule := seq >= self.free).any():
            at = np.cumsum(1 + rule) - (1 + rule)
            out = np.empty(len(seq) + int(rule.sum()), np.int64)
            out[at[~rule]] = seq[~rule]
            own = seq[rule] - self.free
            out[at[rule]], out[at[rule] + 1] = self.left[own], self.right[own]
            seq = out
        return seq


def write_blocks(docs: DataFrame, scratch: Scratch, path: str, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write docs (doc_id, text) in ascending doc_id order: part, block, before (ids of the part's earlier blocks), doc_ids, lengths, payload."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def write(batches):
        encoder, part = Encoder.get(path), TaskContext.get().partitionId()
        free = max(encoder.tokenizer.get_vocab_size(), end + 1)
        own, names, block, before, total = [], [], 0, 0, 0

        def flush():
            ids = np.concatenate(own)
            row = [part, block, before, len(ids), names, [len(x) for x in own], compress(ids, free)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches, 1024):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                own.append(np.append(ids, np.array(end, ids.dtype)))
                names.append(doc_id)
                total += len(own[-1])
                if total >= block_ids:
                    yield flush()
                    before, block, total, own, names = before + total, block + 1, 0, [], []
        if own:
            yield flush()

    d = docs.select("doc_id", docs["text"].cast("string").alias("text")).withColumn("mix", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "mix").sortWithinPartitions("doc_id", "mix").select("doc_id", "text")
    return scratch.save(d.mapInArrow(write, "part long, block long, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the blocks alone."""
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("part_start"))
    d = blocks.join(parts, "part").select((F.col("part_start") + F.col("before")).alias("base"), "doc_ids", "lengths", "payload")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, at, rows = Block(row["payload"]), 0, []
                ids = block.ids(0, len(block)).astype("<u4")
                for doc_id, n in zip(row["doc_ids"], row["lengths"], strict=True):
                    rows.append((doc_id, row["base"] + at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at += n
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return d.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_blocks(write_blocks(docs, Scratch(docs.sparkSession, "token-files"), path or tokenizer_path()))
