"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside space and 0x09-0x0D, which on UTF-8
equals ``[^\\x20\\x09-\\x0D]+`` on code points. Hashes are 64-bit: a polynomial
over byte values, finished by a mixer.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 // 8 * 8 + 5)  # 5 mod 8: powers of nearby positions stay far apart
_powers = np.ones(1, U64)

BLOCK = 1 << 16


def trim() -> None:
    """Hand free memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run):
    """A function of record batches that trims at its end: a worker lives on, beside others and the JVM."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return own


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def is_word(b: np.ndarray) -> np.ndarray:
    return (b != 0x20) & ((b - np.uint8(9)) > 4)


def lowered(b: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return b | (((b - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(n, _BASE, U64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end and their offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """The words of a batch of texts: byte spans, owners and hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False, is_word=is_word):
        raw, self.offsets = buffer_of(texts)
        self.buf = lowered(raw) if lower else raw
        inside = is_word(self.buf)
        n = len(inside)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        edge = self.offsets[:-1]
        before[edge[edge < n]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        edge = self.offsets[1:] - 1
        after[edge[edge >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of text i: bounds[i]:bounds[i+1]
        self.docs = len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        return sums_between(flags, self.offsets[:-1], self.offsets[1:])


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each of ascending spans; blocks end between spans, so memory is bounded."""
    out = np.empty(len(starts), U64)
    k = 0
    while k < len(out):
        at = starts[k]
        j = max(k + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        end = ends[j - 1]
        p = _powers_to(int(end - at) + 1)
        sums = np.zeros(end - at + 1, U64)
        np.cumsum((buf[at:end].astype(U64) + U64(1)) * p[: end - at], out=sums[1:])
        s, e = starts[k:j] - at, ends[k:j] - at
        out[k:j] = mix((sums[e] - sums[s]) * _inverse(p, s)) ^ (e - s).astype(U64)
        k = j
    return out


_inv = np.ones(1, U64)


def _inverse(powers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BASE ** -at modulo 2 ** 64."""
    global _inv
    if len(_inv) < len(powers):
        full = np.full(len(powers), U64(pow(int(_BASE), -1, 1 << 64)), U64)
        full[0] = 1
        _inv = np.multiply.accumulate(full)
    return _inv[at]


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (order matters)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, a place of each, and the number of each element's value."""
    order = np.argsort(x)
    ascending = x[order]
    new = np.r_[np.ones(min(1, len(x)), bool), ascending[1:] != ascending[:-1]]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return ascending[new], order[new], back


def chunks(batches, columns_bytes: str, limit: int = 4 << 20):
    """Regroup Arrow batches so that each carries about ``limit`` text bytes at most (or one row)."""
    for b in batches:
        off = buffer_of(b.column(b.schema.get_field_index(columns_bytes)))[1]
        i, n = 0, b.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield b.slice(i, min(j, n) - i)
            i = min(j, n)
