"""Token ids of whole texts by a public tokenizer, word by word through a bounded cache.

Where the tokenizer's file lower-cases and splits words from signs and white space before it merges pairs (`SPLITS`), the
ids of a text are those of its blank-separated chunks one after another. A worker keeps the ids of chunks it has met, and
encodes the new chunks of a batch together. A text of any other tokenizer is encoded as a whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

VOCABULARY_FILE = "word_bpe_49k.json"
#: Entries of each of the cache's two generations.
CACHE = 600_000
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Letters and digits to one class, blanks to another, all other ASCII to a third; and what is left when only texts of
#: ASCII and the letters from U+00C0 to U+00FF are looked at.
CLASSES = bytes(97 if c >= 128 or chr(c).isalnum() else 32 if c in b" \t\n\x0b\x0c\r" else 46 for c in range(256))
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3])
PLAIN = bytes([*range(128), *range(0x80, 0xC0), 0xC3])

#: The normalisers and the rule of splitting that make chunks independent. Fixed values, as in the tokenizer's file.
SPLITS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "rule": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "end": "</w>",
}


def tokenizer_path(name: str = VOCABULARY_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unified(text: bytes) -> bytes:
    """The same ids from fewer different chunks: A-Z lower-cased and, where no two symbols stand together, full stops and commas set apart."""
    if b"<|" in text:  # could name a special token
        return text
    text = text.translate(FOLD)
    if not text.translate(None, PLAIN) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text and b".." not in text.translate(CLASSES):
        for stop in (b".", b","):
            for blank in (b" ", b"\n"):
                text = text.replace(stop + blank, b" " + stop + b" ")
    return text


class Encoder:
    """Encodes texts with the tokenizers library. The cache has two generations: a full one takes the other's place, and
    chunks that are met again move back; its size changes speed only."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        own = {"normalizer": (rules["normalizer"] or {}).get("normalizers"), "rule": steps[0].get("pattern"), "end": rules["model"].get("end_of_word_suffix")}
        self.chunked = own == SPLITS and not rules["post_processor"] and all(t["special"] and t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in rules["added_tokens"])
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        special = sorted((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|"))
        self.mark = (special[0][0].encode(), special[0][1]) if special else None

    @classmethod
    def get(cls, path: str) -> Encoder:
        """The one of this Python worker."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        """Put the ids of new chunks into the cache."""
        if len(self.known) + len(new) > CACHE:
            self.known, self.older = {}, self.known
        known, older, words, others = self.known, self.older, [], []
        for b in new:
            if (ids := older.get(b)) is not None:
                known[b] = ids
            # words of letters, each of which the tokenizer takes as one piece whose end it marks
            elif not b.translate(None, LETTERS) and b"\xc3\x97" not in b and b"\xc3\xb7" not in b:
                words.append(b)
            elif self.mark is None or b"<|" in b:
                known[b] = self._ids(b.decode("utf-8", "replace"))
            else:
                others.append(b)
        self._together(words, b" ", lambda ids: np.nonzero(self.last[ids])[0] + 1, 0)
        if self.mark is not None:  # a special token after each chunk, as no chunk holds it
            self._together(others, b" " + self.mark[0] + b" ", lambda ids: np.append(np.nonzero(ids == self.mark[1])[0] + 1, len(ids) + 1), 1)

    def _together(self, chunks: list[bytes], between: bytes, ends_of, gap: int, step: int = 128) -> None:
        """Put into the cache what chunks encode to, some at a time; ends_of: where each one's ids end, with gap ids of what stands between."""
        known, size = self.known, self.kind.itemsize
        groups = [chunks[k : k + step] for k in range(0, len(chunks), step)]
        texts = [between.join(g).decode("utf-8", "replace") for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.kind)
            ends = ends_of(ids).tolist()
            if len(ends) != len(group):
                known.update((b, self._ids(b.decode("utf-8", "replace"))) for b in group)
                continue
            data, at = ids.tobytes(), 0
            for b, end in zip(group, ends, strict=True):
                known[b] = data[at * size : (end - gap) * size]
                at = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        return [x for k in range(0, len(texts), 256) for x in self._encode(texts[k : k + 256])]

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.chunked:
            whole = [(t or "").encode("utf-8", "replace").decode("utf-8", "replace") for t in texts]
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        get, todo, new = self.known.get, [], set()
        for t in texts:
            chunks = unified((t or "").encode("utf-8", "surrogatepass")).split()
            ids = list(map(get, chunks))
            missed = [(k, chunks[k]) for k, i in enumerate(ids) if i is None] if None in ids else []
            new.update(c for _, c in missed)
            todo.append((ids, missed))
        if new:
            self._learn(new)
        get, older, out = self.known.get, self.older.get, []
        for ids, missed in todo:
            for k, c in missed:
                ids[k] = get(c) or older(c, b"")
            out.append(np.frombuffer(b"".join(ids), self.kind))
        return out
