"""Merged Burrows-Wheeler order of text shards, refined up to a fixed depth (the in-task part of operator 13).

A *shard* is a run of pieces of text with its own suffix order, that is its own Burrows-Wheeler transform; a symbol is eight
bytes, so what stands before a suffix is the symbol eight bytes earlier.  Shards are merged by refining their interleave:
two suffixes that agree in ``k`` bytes lie in one block of the interleave of depth ``k``.  The interleave of depth ``k + 8``
is that of the suffixes eight bytes earlier, by (symbol, block of depth ``k``); as each shard is in order already, this is a
merge of sorted runs, never a new sort.  The step at which two neighbours part is the length of their common prefix; blocks
that still have two or more suffixes at the last depth are the repeated intervals.  A block of one suffix is finished and
takes no part in later steps, and neither does a suffix whose piece ends before the depth.
"""

from __future__ import annotations

import numpy as np

SYMBOL = 8
WINDOW = 100
SHARD_BYTES = 1 << 18


def symbols(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers in text order (zeros follow the end)."""
    padded = np.concatenate([buf, np.zeros(SYMBOL, np.uint8)])
    return np.ndarray((len(buf),), dtype=">u8", buffer=padded.tobytes(), strides=(1,)).astype(np.uint64)


def blocks_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the index at which each one's block starts, and whether the block has more than one."""
    n = len(key)
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    return np.repeat(start, size), np.repeat(size > 1, size)


def shard_order(symbol: np.ndarray) -> np.ndarray:
    """Positions of a shard in the order of their suffixes, to a depth of ``WINDOW`` at least.

    Blocks of equal prefixes are refined by the rank of what follows them, twice as deep each time."""
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    first, many = blocks_of(symbol[order])
    rank = np.zeros(n + 1, dtype=np.int32)                   # 0 beyond the end
    rank[order] = first + 1
    depth = SYMBOL
    at = np.flatnonzero(many)
    while depth < WINDOW and len(at):
        suffix = order[at]
        key = rank[suffix].astype(np.int64) << 32 | rank[np.minimum(suffix + depth, n)]
        s = np.argsort(key, kind="stable")
        order[at] = suffix = suffix[s]
        key = key[s]
        start, many = blocks_of(key)
        rank[suffix] = at[start] + 1                         # blocks are contiguous in ``order``
        at = at[many]
        depth *= 2
    return order


def shard_bounds(lengths: np.ndarray, size: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """First and last byte (one past) of shards of whole pieces of about ``size`` bytes."""
    ends = np.cumsum(lengths)
    out, lo = [], 0
    while lo < (ends[-1] if len(ends) else 0):
        hi = int(ends[min(np.searchsorted(ends, lo + size), len(ends) - 1)])
        out.append((lo, hi))
        lo = hi
    return out


def merged_intervals(buf: np.ndarray, lengths: np.ndarray, window: int = WINDOW, shard: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(position, interval) of every start whose ``window`` bytes also start elsewhere in the pieces; equal windows have
    equal intervals.  ``buf`` holds the pieces one after the other."""
    n = len(buf)
    symbol = symbols(buf)
    left = np.repeat(np.cumsum(lengths).astype(np.int32), lengths) - np.arange(n, dtype=np.int32)     # bytes up to the end of the piece
    order = np.concatenate([(lo + shard_order(symbol[lo:hi])).astype(np.int32) for lo, hi in shard_bounds(lengths, shard)] or [np.zeros(0, np.int32)])
    order = order[left[order] >= SYMBOL]
    rank = np.full(n + window, -1, dtype=np.int32)

    def merge(live: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Interleaves the shards by ``key``; returns those of ``live``, shard by shard, that share their block."""
        s = np.argsort(key, kind="stable")                               # merges the runs of the shards
        block, many = blocks_of(key[s])
        rank[live[s[many]]] = block[many]
        return live[rank[live] >= 0]

    live = merge(order, symbol[order])
    by_symbol = rank.copy()
    depth = SYMBOL
    while depth < window and len(live):
        step = min(SYMBOL, window - depth)
        if step == SYMBOL:
            head, depth = by_symbol[live], depth + step
        else:
            head, depth = rank[live], window                             # the last bytes: the block of the suffix a few on
        after = rank[live + step]
        ok = (after >= 0) & (left[live] >= depth)
        rank[live] = -1
        live = live[ok]
        live = merge(live, head[ok].astype(np.int64) << 32 | after[ok])
    return live, rank[live]
