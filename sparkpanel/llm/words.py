"""Words of many texts at once, as arrays: places in one buffer and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A-Z to a-z; and that with every other ASCII character but digits and letters made a blank.
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
CHUNK = 1 << 20  # bytes of text that are worked on together

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK * 2)
        out = []
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def slices(batches, rows: int = 256):
    """Arrow batches of a few rows each, so that few texts are held as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def chunks(texts, limit: int = CHUNK) -> Iterator[list[tuple[int, bytes]]]:
    """(index, UTF-8 bytes) of texts (a list or an Arrow column), some at a time; one text is never split."""
    own, size = [], 0
    some = (t for k in range(0, len(texts), 256) for t in (texts[k : k + 256] if isinstance(texts, list) else texts.slice(k, 256).to_pylist()))
    for i, t in enumerate(some):
        b = (t or "").encode("utf-8", "surrogatepass")
        if own and size + len(b) > limit:
            yield own
            own, size = [], 0
        own.append((i, b))
        size += len(b)
    if own:
        yield own


class Words:
    """Words of some texts in one buffer: blanks between words, a line end after each text."""

    def __init__(self, texts: list[bytes], fold: bytes | None = None):
        split = [(t.translate(fold) if fold else t).split() for t in texts]
        self.counts = np.array([len(w) for w in split], np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.buffer = b"\n".join(b" ".join(w) for w in split if w)
        b = np.frombuffer(self.buffer, np.uint8)
        gap = np.nonzero((b == 32) | (b == 10))[0]
        if len(b):
            self.starts = np.concatenate([[0], gap + 1])
            self.ends = np.concatenate([gap, [len(b)]])
        else:
            self.starts = self.ends = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        b = np.frombuffer(self.buffer, np.uint8)
        power, inverse = _power(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, first: int, stop: int) -> bytes:
        """Words first to before stop, joined by blanks; they must be of one text."""
        return self.buffer[self.starts[first] : self.ends[stop - 1]]


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours each; those that reach over the end of a text are left to the caller to skip."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out + hashes[k : len(hashes) - n + 1 + k]) * (_BASE + np.uint64(2 * k))
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; a shorter text has its whole sequence as one, an empty one none."""
    h = words.hashes()
    s = shingles(h, n)
    out = []
    for first, count in zip(words.firsts.tolist(), words.counts.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(s[first : first + count - n + 1]))
        else:
            out.append(shingles(h[first : first + count], count) if count else np.zeros(0, np.uint64))
    return out
