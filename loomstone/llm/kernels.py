"""Vectorised work on the bytes of an Arrow text column.

A column is one byte buffer with row offsets. Words, hashes and shingles of
thousands of rows are found with a few numpy passes over that buffer, so no
Python object is made for a word. Rows are handled in slices of about a MB, which
bounds the memory; one row longer than a slice is a slice of its own, and is
handled in overlapping stretches (word_windows, byte_windows).
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE = 5

U64 = np.uint64
#: The white space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Hash value of a byte.
BYTE_HASH = _BYTE
_PLACE = [U64(int(x) * 2 + 1) for x in _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64)]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes up to which strings are hashed eight at a time; longer ones go through BLAKE2b.
LANES = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number, zeros beyond the end; a view that costs no more than the bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each data[start:end]; equal bytes, equal hash, and no algebra by which unequal ones would meet."""
    n = (end - start).astype(np.int64)
    h = mix64(n.astype(U64) + U64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
    if not len(n):
        return h
    lane = eights(data)
    live, at = np.arange(len(n)), 0
    while True:
        live = live[(n[live] > at) & (n[live] <= LANES)]
        if not len(live):
            break
        h[live] = mix64(h[live] ^ (lane[start[live] + at] & _MASK[np.minimum(n[live] - at, 8)])) + U64(at + 1)
        at += 8
    for i in np.flatnonzero(n > LANES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


_power = np.ones(1, U64)
_inverse = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, min(2 * len(_power), SLICE_BYTES + 1))
        _power, _inverse = np.full(size, U64(_BASE)), np.full(size, U64(_BASE_INV))
        _power[0] = _inverse[0] = 1
        np.multiply.accumulate(_power, out=_power)
        np.multiply.accumulate(_inverse, out=_inverse)
    return _power[:n], _inverse[:n]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] the hash of data[i:j] times the base to the power i."""
    c = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(len(data))[0], out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end] from its prefix hash; equal bytes, equal hash."""
    if not len(start):
        return np.zeros(0, U64)
    return mix64((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(U64))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of so many bytes from each position on."""
    if len(data) < size:
        return np.zeros(0, U64)
    c = prefix_hash(data, BYTE_HASH)
    return mix64((c[size:] - c[:-size]) * powers(len(c))[1][: len(data) - size + 1])


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(col) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, kind, len(col) + 1, col.offset * kind.itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def released(run: Callable) -> Callable:
    """run, after which a worker hands back to the system what it has freed, so that idle workers hold little."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_windows(lo: int, hi: int, most: int, over: int) -> Iterator[tuple[int, int]]:
    """Stretches of the range, each repeating the last `over` bytes of the one before."""
    while hi - lo > most + over:
        yield lo, lo + most + over
        lo += most
    yield lo, hi


def word_windows(data: np.ndarray, lo: int, hi: int, most: int = SLICE_BYTES, over: int = SHINGLE - 1) -> Iterator[tuple[int, int]]:
    """Stretches of data[lo:hi] that end at word ends; each but the first repeats the last `over` words of the one before and holds more.

    So a run of over + 1 words lies in one of them; a stretch grows beyond
    `most` bytes only as far as so many words take.
    """
    while hi - lo > most:
        end = lo
        while True:
            end = min(hi, end + most)
            while end < hi and not SPACE[data[end - 1]]:  # to the end of the word
                space = np.flatnonzero(SPACE[data[end : end + 4096]])
                end = end + int(space[0]) + 1 if len(space) else min(hi, end + 4096)
            word = ~SPACE[data[lo:end]]
            word[1:] &= SPACE[data[lo : end - 1]]
            starts = np.flatnonzero(word)
            if end == hi or len(starts) > over:
                break
        after = end
        while after < hi and SPACE[data[after : after + 4096]].all():
            after += 4096
        if after >= hi:
            break
        yield lo, end
        lo = lo + int(starts[-over]) if over else end
    yield lo, hi


class Words:
    """The words of some rows: start, end (byte positions), and first[r], the first word of row r."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = d = data[offs[0] : offs[-1]]
        self.offs = o = offs - offs[0]
        if len(d):
            word = ~SPACE[d]
            cut = np.zeros(len(d) + 1, bool)
            cut[o] = True
            cut[1:-1] |= ~word[:-1] | ~word[1:]
            cut[0] = cut[-1] = True
            self.start = np.flatnonzero(word & cut[:-1])
            self.end = np.flatnonzero(word & cut[1:]) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, o)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        return hash_ranges(LOWER[self.data] if lower else self.data, self.start, self.end)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every 5-word shingle in text order, in lower case.

    A row of one to four words has one shingle, its whole sequence; a row
    without words has none.
    """
    h, n = w.hashes(), w.counts
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    padded = np.concatenate([h, np.zeros(SHINGLE - 1, U64)])
    total = h * _PLACE[0]
    left = np.repeat(w.first[1:], n) - np.arange(len(h))  # words from here to the row's end
    for j in range(1, SHINGLE):
        total += np.where(left > j, padded[j : j + len(h)], U64(0)) * _PLACE[j]
    rows = w.rows()
    keep = left >= SHINGLE
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    keep[w.first[short]] = True
    total[w.first[short]] += n[short].astype(U64)
    return mix64(total[keep]), rows[keep]
