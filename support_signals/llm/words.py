"""Words of many texts at once, as NumPy arrays of 64-bit hashes.

A Spark task gets Arrow batches of texts.  ``slices`` cuts a batch into runs of
whole documents of about ``SLICE_BYTES`` (a longer document is a run of its own),
and ``scan`` finds the words of a run in one pass over its UTF-8 bytes.  Both
separator sets used here are ASCII, so byte classes and code-point classes agree.

The hash of a word is a polynomial over its bytes modulo 2^64, taken from prefix
sums and finished with a bijective mixer, so equal words always have equal hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19

_FACTOR = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def give_back() -> None:
    """Returns freed memory to the system, as a Python worker lives on into later stages beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def byte_class(separators: str) -> np.ndarray:
    """256 booleans: True where a byte belongs to a word."""
    word = np.ones(256, dtype=bool)
    word[list(separators.encode())] = False
    return word


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class(" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased first
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (the SplitMix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _FACTOR, dtype=np.uint64)
    down = np.full(n, pow(_FACTOR, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(2 * SLICE_BYTES, 1 << (n - 1).bit_length() if n > 1 else 1))


@dataclass
class Words:
    """Words of consecutive documents; arrays are parallel per word unless noted."""

    buf: np.ndarray        # UTF-8 bytes of the run (as given, not lower-cased)
    text_at: np.ndarray    # per document: first byte; one entry more than documents
    start: np.ndarray      # first byte
    end: np.ndarray        # one past the last byte
    hash: np.ndarray       # uint64
    first: np.ndarray      # per document: first word; one entry more than documents

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def span(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of about ``size`` bytes."""
    buf, at = texts(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def scan(buf: np.ndarray, text_at: np.ndarray, word: np.ndarray = SPACED, fold: np.ndarray = SAME) -> Words:
    """Words of the documents in ``buf``; ``fold`` maps bytes before hashing."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(buf, text_at, empty, empty, np.zeros(0, np.uint64), np.zeros(len(text_at), np.int64))
    inside = word[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[text_at] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[fold][buf] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(buf, text_at, start, end, hashed, np.searchsorted(start, text_at))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``k`` consecutive words of one document."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        total += w.hash[j:n - k + 1 + j] * _PLACE[j]
    last = np.repeat(w.first[1:], np.diff(w.first))[:n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return at, mix(total[at])


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer than 64 words; sequences of different lengths differ."""
    total = np.append(h * _PLACE[:len(h)], np.array([len(h)], dtype=np.uint64) * _PLACE[63:])
    return mix(total.sum(dtype=np.uint64, keepdims=True))[0]
