"""Exact Jaccard join of documents' word n-gram sets by prefix trees, returned as connected classes.

Words of the A-Z lower-cased text are runs of anything but ASCII white space; a document's set are its distinct n-word
shingles (with fewer words the whole sequence; without words nothing). Two documents link when the intersection is at
least share_pct per cent of the union. Shingles are held as 64-bit digests, sets as 128-bit ones: a set's number is
half of it, and other numbers are taken if two sets of one number differ in the other half.

1. All sets are put into one global order, rarest shingle first; rarity is estimated from the counts of a shingle's
   words, of which up to `FREQUENT` of the most frequent ones are known exactly. Any order gives the same result.
2. Linked sets share a shingle among the first |set| - ceil(share * |set|) + 1 of that order. Equal sets count once. Two
   sets with a common prefix shingle are tied if sizes, places of the shingle and parity bitmaps (which differ in no more
   bits than the sets differ in shingles, and are folded to the shorter one's length) allow the link; of the ties in the
   group of one shingle a spanning forest is put out, never all pairs. A group of more than `GROUP` sets is cut into
   blocks; each component of a block's ties is then stood for by one set with its radius in bits, so that a test widened
   by the radii ties what may be linked across blocks. Ties give candidate classes closed under linking.
3. The sets of a class go to one task, where they are stored in a prefix tree, most frequent shingle first, so that
   alike sets share their paths. A set is looked up before it is put in: overlaps are summed up once for each shared
   path, and subtrees are left out where the shingles that remain on either side can't reach the overlap needed, or all
   of whose sets are already in the set's class.
4. A candidate class that is too large for a task is cut into blocks, each with a tree of its own. The classes found there
   are joined by a tree of one set of each; sets that are still outside the largest class then meet all blocks.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing, not even each other; repeated
rows are linked; a null doc_id takes part but is never a class's smallest id unless all are null; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, semi
from .components import components
from .repeats import NO_ID, keyed, signed
from .words import FOLD, Words, chunks, shingles

FREQUENT = 250_000
#: Groups of sets with a common prefix shingle: up to PAIRED sets are looked at pair by pair; over GROUP they are cut into blocks.
PAIRED, GROUP = 12, 4096
#: Bits of a parity bitmap: the power of two from a set's size on, within these limits.
LEAST_BITS, MOST_BITS = 512, 16_384
#: Shingles in the sets that one task compares.
TASK_SHINGLES = 4_000_000


def word_counts(docs: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent words; at most `frequent` of them come to the driver."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            keys, at = np.unique(h, return_inverse=True)
            held[:] = [(keys, np.bincount(at, n, len(keys)).astype(np.int64))]

        def rows():
            fold()
            h, n = held[0]
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["w", "n"])

        for batch in batches:
            for part in chunks(batch.column("text")):
                held.append(np.unique(Words([b for _, b in part], FOLD).hashes(), return_counts=True))
                if len(held) >= 16:
                    fold()
                    if len(held[0][0]) > 1_000_000:
                        yield rows()
                        held = []
        if held:
            yield rows()

    d = scratch.save(docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    # the smallest count that leaves no more than `frequent` words; counts above 1000 stand together
    least, have = 1, 0
    for r in sorted(d.groupBy(F.least("n", F.lit(1000)).alias("n")).count().collect(), key=lambda r: -r["n"]):
        have += r["count"]
        if have > frequent:
            least = r["n"] + 1
            break
    top = d.where(F.col("n") >= least).limit(frequent).toArrow()
    h, n = top.column("w").to_numpy().view(np.uint64), top.column("n").to_numpy()
    scratch.drop(d)
    order = np.argsort(h)
    return h[order], n[order]


def ordered_sets(words: Words, n: int, known: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, rarest first."""
    h = words.hashes()
    weight = np.zeros(len(h))
    if len(known) and len(h):
        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
        weight = np.where(known[i] == h, np.log2(counts[i]), 0.0)
    s, out = shingles(h, n), []
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    for first, count in zip(words.firsts.tolist(), words.counts.tolist(), strict=True):
        if count < n:
            out.append(shingles(h[first : first + count], count) if count else s[:0])
            continue
        own, at = np.unique(s[first : first + count - n + 1], return_index=True)
        rarity = np.round((sums[first + at + n] - sums[first + at]) * 4)
        out.append(own[np.lexsort((own, rarity))])
    return out


def digests(shingle_set: np.ndarray, seed: int = 0, bits: int = 64) -> tuple[int, int]:
    """The number of a set, and 64 more bits that tell whether two sets have the same number."""
    both = xxhash.xxh3_128_intdigest(np.sort(shingle_set).tobytes(), seed)
    return signed((both >> 64) >> (64 - bits)), signed(both & ((1 << 64) - 1))


def parity(shingle_set: np.ndarray) -> bytes:
    """Bitmap of which bits an odd number of the set's shingles fall on."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(shingle_set) - 1).bit_length()))
    at = (shingle_set >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1 != 0).tobytes()


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap (bytes) of the same set with size bytes."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def prefix_length(size: int, pct: int) -> int:
    """Shingles of the global order among which every linked set has one too."""
    return size - -(-pct * size // 100) + 1


def enough(shared: int, a: int, b: int, pct: int) -> bool:
    return 100 * shared >= pct * (a + b - shared)


class _Node:
    __slots__ = ("label", "children", "sets", "most", "least", "depth", "one", "mixed")

    def __init__(self, label: np.ndarray, depth: int):
        self.label, self.children, self.sets, self.depth = label, {}, [], depth  # depth: shingles on the path, with its own
        self.most, self.least, self.one, self.mixed = 0, 1 << 62, -1, False


class PrefixTree:
    """Sets as paths of token numbers in ascending order; links of a new set with those stored."""

    def __init__(self, tokens: int, pct: int, n: int):
        self.pct, self.root, self.up, self.mark = pct, _Node(np.zeros(0, np.int64), 0), list(range(n)), np.zeros(tokens, bool)
        self.sizes = np.zeros(n, np.int64)

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def _settled(self, node: _Node, k: int) -> bool:
        """Whether all sets at and below the node are in the class of k."""
        if node.one < 0:
            return True
        if node.mixed:
            classes = {self.find(c.one) for c in node.children.values()} | {self.find(s) for s in node.sets}
            if any(c.mixed for c in node.children.values()) or len(classes) > 1:
                return False
            node.mixed = False
        return self.find(node.one) == self.find(k)

    def link(self, k: int, x: np.ndarray) -> None:
        """Join the class of set k, whose sorted tokens are x, with those of the stored sets (0 to k - 1) it links with."""
        size, pct = len(x), self.pct
        self.mark[x] = True
        todo = [(self.root, 0)]
        while todo:
            node, shared = todo.pop()
            if self._settled(node, k):
                continue
            for s in node.sets:
                if enough(shared, size, self.sizes[s], pct):
                    self.up[self.find(s)] = self.find(k)
            near = []
            for child in node.children.values():
                if 100 * min(size, child.most) < pct * max(size, child.least):
                    continue
                # what can still be shared: by the longest set below, and by the tokens of x that come later
                first, last = child.label[0], child.label[-1]
                later = size - int(x.searchsorted(first))
                if (100 + pct) * (shared + min(child.most - node.depth, later)) < pct * (size + max(child.least, shared)) or self._settled(child, k):
                    continue
                got = shared + int(np.count_nonzero(self.mark[child.label]))
                rest = min(child.most - child.depth, size - int(x.searchsorted(last, "right")))
                if (100 + pct) * (got + rest) >= pct * (size + max(child.least, got)):
                    near.append((got, child))
            near.sort(key=lambda c: c[0])
            todo += [(c, got) for got, c in near]
        self.mark[x] = False

    def insert(self, k: int, x: np.ndarray) -> None:
        self.sizes[k] = size = len(x)
        node, at = self.root, 0
        while True:
            node.most, node.least = max(node.most, size), min(node.least, size)
            if node.one < 0:
                node.one = k
            elif not node.mixed and self.find(node.one) != self.find(k):
                node.mixed = True
            if at == size:
                node.sets.append(k)
                return
            child = node.children.get(int(x[at]))
            if child is None:
                child = node.children[int(x[at])] = _Node(x[at:], size)
                at, node = size, child
                continue
            n = min(len(child.label), size - at)
            differ = np.nonzero(child.label[:n] != x[at : at + n])[0]
            n = int(differ[0]) if len(differ) else n
            if n < len(child.label):  # split the path
                upper = _Node(child.label[:n], node.depth + n)
                upper.most, upper.least, upper.one, upper.mixed = child.most, child.least, child.one, child.mixed
                upper.children[int(child.label[n])] = child
                child.label = child.label[n:]
                node.children[int(x[at])] = child = upper
            node, at = child, at + n


def link_sets(sets: list[np.ndarray], pct: int) -> list[int]:
    """For each set the index of the set that stands for its class."""
    if not sets:
        return []
    tokens, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(tokens), np.int64)
    number[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    paths = [np.sort(x) for x in np.split(number[at], np.cumsum([len(s) for s in sets])[:-1])]
    tree = PrefixTree(len(tokens), pct, len(sets))
    for k, x in enumerate(paths):
        tree.link(k, x)
        tree.insert(k, x)
    return [tree.find(k) for k in range(len(sets))]


class Ties:
    """Ties between the sets of groups with a common prefix shingle; rows stand in the order of groups, then of sizes.

    A row is a set (low = high = its size, radius 0) or stands for several of sizes low to high, whose bitmaps of
    LEAST_BITS differ from its own in radius bits at most.
    """

    def __init__(self, pct: int, low: np.ndarray, high: np.ndarray, place: np.ndarray, radius: np.ndarray, bitmaps: list[bytes]):
        self.pct, self.low, self.high, self.place, self.radius = pct, low, high, place, radius
        self.bitmaps = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self.bits = np.array([folded(b, LEAST_BITS // 8) for b in self.bitmaps], np.uint8).reshape(-1, LEAST_BITS // 8).view(np.uint64)

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs (x, y) may be linked, or stand for sets that may."""
        pct, total = self.pct, self.high[x] + self.high[y]
        own = (100 * np.minimum(self.high[x], self.high[y]) >= pct * np.maximum(self.low[x], self.low[y])) & ((self.place[x] + self.place[y]) * (100 + pct) <= total * (100 - pct))
        at = np.nonzero(own)[0]
        x, y = x[at], y[at]
        spare = self.radius[x] + self.radius[y]
        differ = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(axis=1, dtype=np.int64) - spare
        good = differ * (100 + pct) <= total[at] * (100 - pct)
        for i in np.nonzero(good & (spare == 0) & (self.low[x] > LEAST_BITS) & (self.low[y] > LEAST_BITS))[0].tolist():
            a, b = self.bitmaps[x[i]], self.bitmaps[y[i]]
            size = min(len(a), len(b))
            good[i] = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=np.int64)) * (100 + pct) <= total[at[i]] * (100 - pct)
        own[at] = good
        return own

    def pairs(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ties of small groups."""
        found, i = [(np.zeros(0, np.int64),) * 2], np.arange(len(group))
        for step in range(1, PAIRED):
            i = i[i + step < len(group)]
            i = i[group[i] == group[i + step]]
            i = i[100 * self.high[i] >= self.pct * self.low[i + step]]  # sizes ascend in a group
            if not len(i):
                break
            good = i[self.fits(i, i + step)]
            found.append((good, good + step))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def forest(self, first: int, stop: int) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spanning forest of the ties between rows first to before stop, and each row's component by its number there."""
        label, edges, floor = np.arange(stop - first), [], 0
        for k in range(1, stop - first):
            while 100 * self.high[first + floor] < self.pct * self.low[first + k]:
                floor += 1  # rows before are too small for all that follow
            rest = np.arange(floor, k)
            for some in (rest[-1:], rest[:-1]):  # most often the row before settles it
                some = some[label[some] != label[k]]
                if len(some):
                    for j in some[self.fits(np.full(len(some), first + k), first + some)].tolist():
                        if label[j] != label[k]:
                            edges.append((first + j, first + k))
                            label[label == label[j]] = label[k]
        return edges, label

    def summary(self, first: int, label: np.ndarray):
        """For each component of a forest: the row that stands for it, low, high, place and radius."""
        for c in np.unique(label).tolist():
            own = first + np.nonzero(label == c)[0]
            rep = int(own[0])
            far = np.bitwise_count(self.bits[own] ^ self.bits[rep]).sum(axis=1, dtype=np.int64) + self.radius[own] + self.radius[rep] * (own != rep)
            yield rep, int(self.low[own].min()), int(self.high[own].max()), int(self.place[own].min()), int(far.max())


def classes(docs: DataFrame, n: int = 3, share_pct: int = 90, **limits) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    back = lambda c: F.when(c < NO_ID, c)
    d = labelled(keyed(docs), Scratch(docs.sparkSession, "ngram-join"), n, share_pct, **limits)
    return d.select(back(F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), back(F.col("least.id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, share_pct: int = 80, **limits) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id; rows without words stay."""
    scratch, columns = Scratch(docs.sparkSession, "ngram-join"), docs.columns
    d = keyed(docs, tuple(columns))
    labels = scratch.save(labelled(d, scratch, n, share_pct, **limits))
    stay = labels.where((F.col("n") == 0) | ((F.col("id") == F.col("least.id")) & (F.col("t") == F.col("least.t")))).select("id", "t", "n")
    out = semi(d, scratch.save(stay.select("id", "t").distinct()), ["id", "t"])
    again = scratch.save(stay.where("n > 0").groupBy("id", "t").count().where("count > 1").select("id", "t"))
    if not again.isEmpty():  # rows repeated as a whole
        out = semi(out, again, ["id", "t"], "left_anti").unionByName(semi(out, again, ["id", "t"]).dropDuplicates(["id", "t"]))
    return out.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(columns)])


def labelled(docs: DataFrame, scratch: Scratch, n: int, share_pct: int, frequent: int = FREQUENT, task_shingles: int = TASK_SHINGLES, group: int = GROUP, seed: int = 0, bits: int = 64) -> DataFrame:
    """id, t, n (set size) and least (id and t of the class's smallest row) of each row of keyed docs.

    seed, bits: of the sets' numbers. If two different sets have one number, all is done again with other numbers.
    """
    spark = docs.sparkSession
    known, counts = word_counts(docs, scratch, frequent)
    sent = spark.sparkContext.broadcast((known, counts))

    names = ["id", "t", "n", "g", "g2", "bits", "token", "place"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

    def read(batches):
        """Rows of documents (token null) and of prefix shingles (id null)."""
        known, counts = sent.value
        for batch in batches:
            ids, ts = batch.column("id").to_pylist(), batch.column("t").to_pylist()
            for part in chunks(batch.column("text")):
                sets = ordered_sets(Words([b for _, b in part], FOLD), n, known, counts)
                both = [digests(s, seed, bits) for s in sets]
                own = [g for g, _ in both]
                columns = [[ids[i] for i, _ in part], [ts[i] for i, _ in part], [len(s) for s in sets], own, [g for _, g in both], [parity(s) for s in sets], [None] * len(part), [None] * len(part)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                first = {g: s for g, s in zip(own, sets, strict=True) if len(s)}
                if first:
                    sizes = [prefix_length(len(s), share_pct) for s in first.values()]
                    g, size = np.repeat(np.array(list(first), np.int64), sizes), np.repeat(np.array([len(s) for s in first.values()], np.int32), sizes)
                    tokens = np.concatenate([s[:k] for s, k in zip(first.values(), sizes, strict=True)]).view(np.int64)
                    place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                    yield pa.record_batch([pa.nulls(len(g), kinds[0]), pa.nulls(len(g), kinds[1]), pa.array(size), pa.array(g), pa.nulls(len(g), kinds[4]), pa.nulls(len(g), kinds[5]), pa.array(tokens), pa.array(place)], names)

    seen = scratch.save(docs.select("id", "t", "text").mapInArrow(read, "id long, t long, n int, g long, g2 long, bits binary, token long, place int"))
    scratch.sweep()
    # n and place as one number: narrow rows are dealt out
    postings = seen.where("token IS NOT NULL").select("token", "g", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")).alias("x"))
    rows = scratch.save(seen.where("token IS NULL").select("id", "t", "n", "g", "g2", "bits"))
    if not rows.groupBy("g").agg(F.min("g2").alias("a"), F.max("g2").alias("z")).where("a <> z").isEmpty():
        return labelled(docs, scratch, n, share_pct, frequent, task_shingles, group, seed + 1)
    # a shingle that two sets share is left out if their sizes or its places rule out a link
    shared = postings.groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("z"), F.count("*").alias("many"), F.min("x").alias("x"), F.max("x").alias("y")).where("a <> z")
    of = lambda c: (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    (low, i), (high, j) = of("x"), of("y")
    fits = (100 * low >= share_pct * high) & ((i + j) * (100 + share_pct) <= (low + high) * (100 - share_pct))
    shared = shared.where((F.col("many") > 2) | fits).select("token", "many")
    shared = scratch.save(shared)
    scratch.sweep()
    bits = rows.where("n > 0").select("g", "bits").dropDuplicates(["g"])
    common = scratch.save(postings.join(shared, "token").dropDuplicates(["token", "g"]))
    scratch.drop(seen)
    scratch.sweep()
    edges = scratch.save(_edges(common, bits, scratch, share_pct, group))
    scratch.sweep()
    candidates = components(edges, scratch)
    sets = scratch.save(rows.where("n > 0").groupBy("g").agg(F.min(F.struct("id", "t")).alias("own"), F.min("n").alias("n")).join(candidates.withColumnRenamed("node", "g"), "g").select("g", "n", "own.id", "own.t", "root"))
    again = scratch.save(rows.where("n > 0").groupBy("id", "t").count().where("count > 1").select("id", "t"))
    if not again.isEmpty():  # rows repeated as a whole; one of each is enough to compare
        docs = semi(docs, again, ["id", "t"], "left_anti").unionByName(semi(docs, again, ["id", "t"]).dropDuplicates(["id", "t"]))
    links = scratch.save(_links(docs, sets, scratch, n, share_pct, task_shingles))
    labels = rows.join(links.withColumnRenamed("node", "g"), "g", "left").select("id", "t", "n", F.coalesce("root", "g").alias("root"))
    least = labels.where("n > 0").groupBy("root").agg(F.min(F.struct("id", "t")).alias("class"))
    own = F.struct("id", "t")
    return labels.join(least, "root", "left").select("id", "t", "n", F.when(F.col("n") > 0, F.col("class")).otherwise(own).alias("least"))


TIE = "token long, a long, b long, low int, high int, place int, radius int, bits binary"


def _ties(d: DataFrame, pct: int, stand: bool) -> DataFrame:
    """TIE's columns: ties (a, b) in each group (token, block) of d, and, if stand is set and the block is one of many, rows (b null) that stand for its components."""

    def run(batches):
        held: list[pa.Table] = []
        schema = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("place", pa.int32()), ("radius", pa.int32()), ("bits", pa.binary())])

        def flush(t: pa.Table):
            take = lambda c: t.column(c).to_numpy().astype(np.int64)
            token, g, block = take("token"), take("a"), take("block")
            bitmaps = t.column("bits").to_pylist()
            ties = Ties(pct, take("low"), take("high"), take("place"), take("radius"), bitmaps)
            starts = np.concatenate([[0], np.nonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1]))[0] + 1])
            sizes = np.diff(starts, append=len(token))
            group = np.repeat(np.arange(len(starts)), sizes)
            whole = (sizes > PAIRED) | (block[starts] >= 0 if stand else np.zeros(len(starts), bool))
            group[np.repeat(whole, sizes)] = -1 - np.nonzero(np.repeat(whole, sizes))[0]  # each a group of its own
            x, y = ties.pairs(group)
            more, out = [], []
            for first, stop in zip(starts[whole].tolist(), (starts + sizes)[whole].tolist(), strict=True):
                edges, label = ties.forest(first, stop)
                more += edges
                if stand and block[first] >= 0:
                    out += [(int(token[first]), int(g[r]), None, low, high, place, radius, bitmaps[r]) for r, low, high, place, radius in ties.summary(first, label)]
            if more:
                m = np.array(more, np.int64)
                x, y = np.concatenate([x, m[:, 0]]), np.concatenate([y, m[:, 1]])
            both = np.unique(np.stack([np.minimum(g[x], g[y]), np.maximum(g[x], g[y])], axis=1), axis=0)
            both = both[both[:, 0] != both[:, 1]]
            if len(both):
                none = lambda f: pa.nulls(len(both), f.type)
                yield pa.record_batch([none(schema[0]), pa.array(both[:, 0]), pa.array(both[:, 1]), *[none(f) for f in list(schema)[3:]]], schema=schema)
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 60_000:
                t = pa.concat_tables(held)
                token, block = t.column("token").to_numpy(), t.column("block").to_numpy()
                last = np.nonzero((token != token[-1]) | (block != block[-1]))[0]
                cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                if cut:
                    yield from flush(t.slice(0, cut))
                held, rows = [t.slice(cut)], t.num_rows - cut
        if rows:
            yield from flush(pa.concat_tables(held))

    d = d.select("token", "block", "a", "low", "high", "place", "radius", "bits")
    return d.repartition("token", "block").sortWithinPartitions("token", "block", "low").mapInArrow(run, TIE)


def _edges(common: DataFrame, bits: DataFrame, scratch: Scratch, pct: int, group: int) -> DataFrame:
    """a, b: ties of sets that may link, from the prefix shingles (token, g, x: size and place, many: how many sets have it) that sets share."""
    n, blocks = F.shiftright("x", 32).cast("int"), F.ceil(F.col("many") / group).cast("int")
    part = lambda k: F.when(k > 1, F.pmod(F.xxhash64("a"), k)).otherwise(-1).cast("long")
    d = common.join(bits, "g").select("token", F.col("g").alias("a"), n.alias("low"), n.alias("high"), F.col("x").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"), F.lit(0).alias("radius"), "bits", blocks.alias("blocks"))
    first = scratch.save(_ties(d.withColumn("block", part(F.col("blocks"))), pct, True))
    stand = first.where("b IS NULL")
    edges = first.where("b IS NOT NULL").select("a", "b")
    if stand.isEmpty():
        return edges.distinct()
    # what stands for components of blocks meets in one group, or where that is too large in each pair of blocks
    many = stand.groupBy("token").agg(F.ceil(2 * F.count("*") / group).cast("int").alias("k"))
    d = stand.join(many, "token").withColumn("own", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    d = d.withColumn("block", (F.least("own", "other") * F.col("k") + F.greatest("own", "other")).cast("long"))
    second = scratch.save(_ties(d, pct, False).select("a", "b"))
    return edges.unionByName(second).distinct()


def _trees(docs: DataFrame, placed: DataFrame, n: int, pct: int) -> DataFrame:
    """a, b: each set and the one that stands for its class in a task; placed: g, id, t, root, task. Texts travel, once to each task that needs them: they are smaller than the sets."""
    placed = placed.groupBy("id", "t", "g", "root").agg(F.collect_set("task").alias("tasks"))
    d = semi(docs.select("id", "t", "text"), placed.select("id", "t"), ["id", "t"]).join(placed, ["id", "t"])
    d = d.select("g", "root", F.explode("tasks").alias("task"), "text")

    def join(table: pa.Table) -> pa.Table:
        rows: dict[int, dict[int, np.ndarray]] = {}
        gs, roots = table.column("g").to_pylist(), table.column("root").to_pylist()
        for part in chunks(table.column("text")):
            for (i, _), s in zip(part, ordered_sets(Words([b for _, b in part], FOLD), n, np.zeros(0, np.uint64), np.zeros(0)), strict=True):
                rows.setdefault(roots[i], {})[gs[i]] = s
        node, to = [], []
        for own in rows.values():
            names = sorted(own)
            found = link_sets([own[g] for g in names], pct)
            node += names
            to += [names[k] for k in found]
        return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(to, pa.int64())})

    return d.groupBy("task").applyInArrow(join, "a long, b long")


def _links(docs: DataFrame, sets: DataFrame, scratch: Scratch, n: int, pct: int, task_shingles: int) -> DataFrame:
    """node, root: classes of the candidate sets (g, n, id, t, root)."""
    sizes = sets.groupBy("root").agg(F.sum("n").alias("total"))
    tasks = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // task_shingles) * 4)
    large = scratch.save(sizes.where(F.col("total") > task_shingles))
    small = F.pmod(F.xxhash64("root"), F.lit(tasks)).cast("string").alias("task")
    if large.isEmpty():
        return _trees(docs, sets.select("g", "id", "t", "root", small), n, pct).select(F.col("a").alias("node"), F.col("b").alias("root"))
    # blocks have half a task's shingles
    cut = large.select("root", F.ceil(F.col("total") * 2 / task_shingles).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
    d = scratch.save(sets.join(cut, "root", "left").withColumn("block", block))
    small = F.when(F.col("blocks").isNull(), small).otherwise(F.format_string("%d.%d", "root", "block")).alias("task")
    own = scratch.save(_trees(docs, d.select("g", "id", "t", "root", small), n, pct))
    split = scratch.save(d.where("blocks IS NOT NULL").join(own.toDF("g", "label"), "g"))
    # one set of each class found in a block
    ones = scratch.save(split.where("g = label").select("g", "n", "id", "t", "root"))
    edges = own
    if 2 * (ones.agg(F.sum("n")).first()[0] or 0) < split.agg(F.sum("n")).first()[0]:
        joined = scratch.save(_links(docs, ones, scratch, n, pct, task_shingles))
        edges = edges.unionByName(joined.toDF("a", "b"))
        split = split.join(joined.toDF("label", "next"), "label", "left").withColumn("label", F.coalesce("next", "label")).drop("next")
    main = split.groupBy("root", "label").agg(F.sum("n").alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    split = scratch.save(split.join(main, "root").withColumn("open", F.col("label") != F.col("main")))
    left = split.where("open").groupBy("root").agg(F.ceil(F.sum("n") * 2 / task_shingles).cast("int").alias("parts"))
    met = split.join(left, "root")
    parts = F.sequence(F.lit(0), F.col("parts") - 1)
    here = met.select("g", "id", "t", "root", F.explode(parts).alias("part"), "block")
    there = met.where("open").select("g", "id", "t", "root", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = here.unionByName(there).select("g", "id", "t", "root", F.format_string("%d.%d.%d", "root", "part", "block").alias("task"))
    return components(scratch.save(edges.unionByName(_trees(docs, met, n, pct))), scratch)


SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, s FROM (
    SELECT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM d)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.s = b.s AND a.rid <> b.rid JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
  GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach r ON r.a = d.rid JOIN d e ON e.rid = r.b LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id"""
