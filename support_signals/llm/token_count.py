"""Operator 5: token counts of a sentencepiece BPE model with the whole-token shortcut.

The model file is a parameter; its bytes are broadcast (a fixed file of under a MB).  No piece of the model holds a
blank mark after another character, and some characters are in no piece of several characters; so merges never cross
the start of a blank-marked word or such a character, and a text falls apart into *units* that can be encoded alone.
(Both facts are read off the vocabulary when it is loaded, not assumed.)

Offline, ``prove`` runs the merges on every vocabulary string that can be a unit and keeps those that end as one token.
A unit among them counts one without any merge; other units are merged, once per worker for repeated ones.

Defined results: null text counts as empty: 0 bytes, 0 tokens.  Strings of special tokens inside texts are plain
characters, as the library treats them by default.  Repeated rows give repeated results, extra columns are ignored,
an empty table gives an empty result; long texts are counted whole.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
NO_RANK = float("inf")
CACHE_UNITS = 250_000
LIMIT = 4096


def fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        head = varint()
        kind = head & 7
        if kind == 0:
            yield head >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield head >> 3, raw[i:i + n]
            i += n


class Counter:
    """Counts tokens under one model."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

    def __init__(self, model: bytes):
        pieces: list[tuple[str, int, float]] = []
        self.prefix = True
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(3, self.NORMAL), struct.unpack("<f", piece.get(2, bytes(4)))[0]))
            elif number == 3:
                norm = dict(fields(value))
                if norm.get(1) != b"identity" or norm.get(4, 1):
                    raise ValueError("only models without normalisation of characters and blanks are read")
                self.prefix = bool(norm.get(3, 1))
        if any(kind in (self.USER, self.UNUSED) for _, kind, _ in pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        #: merge order: the best score first
        self.rank = {p: -score for p, kind, score in pieces if kind == self.NORMAL}
        self.single = {p for p in self.rank if len(p) == 1}
        several = [p for p in self.rank if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in several):
            raise ValueError("a piece holds a blank mark after another character")
        joined = set("".join(several))
        #: neighbouring characters inside pieces; elsewhere a unit falls apart again
        self.pairs = {p[i:i + 2] for p in several for i in range(len(p) - 1)}
        #: characters that no merge touches, of those met most often in texts
        self.apart = [c for c in "\n\t\r" if c not in joined]
        cut = "".join(map(re.escape, self.apart))
        self.unit = re.compile(f"{BLANK}+[^{BLANK}{cut}]*|[^{BLANK}{cut}]+" + (f"|[{cut}]" if cut else ""))
        self.whole = self.prove()
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def prove(self) -> set[str]:
        """Vocabulary strings that are units and whose merges end as one token."""
        return {p for p in self.rank if self.unit.fullmatch(p) and self.merge(p) == 1}

    def merge(self, unit: str) -> int:
        """Tokens of a unit: merge the pair with the best score, leftmost first, until none is a piece."""
        if len(unit) > 64:
            return self.merge_long(unit)
        parts, rank = list(unit), self.rank
        ranks = [rank.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], NO_RANK)
        return self.tokens(parts)

    def merge_long(self, unit: str) -> int:
        """The same for long units, with a heap of the pairs."""
        parts: list[str | None] = list(unit)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(made + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, made + parts[k]))
            if (h := before[i]) >= 0 and (r := rank.get(parts[h] + made)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + made))
        return self.tokens(filter(None, parts))

    def tokens(self, parts: Iterable[str]) -> int:
        """A piece is one token, a character without a piece as many as it has bytes."""
        single = self.single
        return sum(1 if len(p) > 1 or p in single else len(p.encode()) for p in parts)

    def learn(self, unit: str) -> int:
        """Tokens of a unit, summed over what no piece's neighbouring characters hold together."""
        total, from_, pairs, known = 0, 0, self.pairs, self.known
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1:i + 1] not in pairs:
                part = unit[from_:i]
                n = known.get(part)
                if n is None:
                    known[part] = n = self.merge(part)
                total += n
                from_ = i
        known[unit] = total
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        units = self.unit.findall((BLANK if self.prefix else "") + text.replace(" ", BLANK))
        new = set(units).difference(self.known)
        if len(self.known) + len(new) > CACHE_UNITS:
            self.known = dict.fromkeys(self.whole, 1)
            new = set(units).difference(self.known)
        for u in new:
            self.learn(u)
        return sum(map(self.known.__getitem__, units))


@lru_cache(maxsize=1)
def worker_counter(model: bytes) -> Counter:
    """One per Python worker and model; later tasks of the worker find its units known."""
    return Counter(model)


def count_tokens(docs: DataFrame, model: bytes, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spec = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(key, text)
    kind = chosen.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(spec.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                n_bytes.append(len(t.encode()))
                n_tokens.append(counter.count(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    return chosen.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
