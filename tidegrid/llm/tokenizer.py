"""Whole texts to token ids by the tokenizers library, a distinct word at a time.

The vocabularies served here drop white space and never join pieces over it, so
the ids of a text are those of its words on end. Each distinct word is encoded
once a worker (a bounded cache); a text with a special token's string is encoded
as it is.
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np
import pyarrow as pa

from .words import Words, numbered, span_hashes

#: Words that a worker's cache holds before it starts anew.
CACHE = 600_000
#: Words that are encoded at once; the library's result of a word takes far more memory than its ids.
AT_ONCE = 4_000
#: Id appended to every document.
END = 1


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the words held, ascending
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, at: np.ndarray, hashes: np.ndarray, words) -> None:
        """words, which aren't held: their hashes ascending, and where these go in keys."""
        length = np.empty(len(hashes), np.int64)
        start = self.used
        for k in range(0, len(hashes), AT_ONCE):
            for i, ids in enumerate(self._encode(list(islice(words, AT_ONCE))), k):
                n = length[i] = len(ids)
                while self.used + n > len(self.ids):
                    self.ids = np.resize(self.ids, 2 * len(self.ids))
                self.ids[self.used : self.used + n] = ids
                self.used += n
        self.keys = np.insert(self.keys, at, hashes)
        self.start = np.insert(self.start, at, start + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in many(texts, add_special_tokens=False)]

    @property
    def width(self) -> int:
        """Bytes that any id of the vocabulary fits in: 2 or 4."""
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the offsets of each (one more than texts). Null counts as empty."""
        w = Words(texts, lower=True)
        n = len(w.buf)
        # a mark of special tokens: those texts go as they are
        mark = np.flatnonzero((w.buf[:-1] == 60) & (w.buf[1:] == 124)) if n else np.zeros(0, np.int64)
        whole = np.unique(np.searchsorted(w.offsets, mark, side="right") - 1)
        s, e, owner = w.starts, w.ends, w.owner()
        if len(s):
            tail = w.buf[e - 1]
            before = w.buf[np.maximum(e - 2, 0)]
            plain = ((before - np.uint8(48)) < 10) | ((before - np.uint8(97)) < 26)
            point = (tail == 44) | (tail == 46) | (tail == 33) | (tail == 63) | (tail == 58) | (tail == 59)
            two = point & plain & (e - s > 1)
            # a closing point after an ASCII letter or digit is a piece of its own
            reps = 1 + two.astype(np.int64)
            at = np.cumsum(reps) - reps
            s2, e2 = np.repeat(s, reps), np.repeat(e, reps)
            e2[at[two]] -= 1
            s2[at[two] + 1] = e[two] - 1
            s, e, owner = s2, e2, np.repeat(owner, reps)
        found, first, back = numbered(span_hashes(w.buf, s, e))
        if len(self.keys) + len(found) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, found)
        held = at < len(self.keys)
        held[held] = self.keys[at[held]] == found[held]
        missing = np.flatnonzero(~held)
        if len(missing):
            spans = zip(s[first[missing]].tolist(), e[first[missing]].tolist())
            self._add(at[missing], found[missing], (w.buf[a:z].tobytes().decode() for a, z in spans))
            at = np.searchsorted(self.keys, found)
        place = at[back]
        length = self.length[place]
        total = int(length.sum())
        begin = np.cumsum(length) - length
        ids = self.ids[np.repeat(self.start[place] - begin, length) + np.arange(total)]
        counts = np.bincount(owner, weights=length, minlength=w.docs).astype(np.int64)
        offsets = np.r_[0, np.cumsum(counts)]
        if len(whole):
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(w.docs)]
            for i, own in zip(whole.tolist(), self._encode([texts[i].as_py() for i in whole.tolist()])):
                parts[i] = np.array(own, np.uint32)
            ids, offsets = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, offsets

    def encode_ended(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same with END after each text."""
        ids, offsets = self.encode(texts)
        return np.insert(ids, offsets[1:], END).astype("<u4"), offsets + np.arange(len(offsets))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
