"""Operator 2: BPE encoding and decoding with word ends, many words per NumPy merge round.

The vocabulary file (JSON of the public ``tokenizers`` format: NFC, white space to one blank, lower case,
words by a pattern, byte-level symbols, ``</w>`` at word ends) is a parameter; its bytes are broadcast to the tasks
(a vocabulary is a fixed file of a few MB, independent of the data).

``Bpe.encode_words`` holds the symbols of all distinct words of a batch in one flat array.  In each round the rank of
every adjacent pair is found by binary search over the sorted pair keys, each word's lowest rank by a segmented
minimum, and all its occurrences are merged left to right; words without a known pair leave the array.  Merging all
occurrences at once equals merging one by one because a merge never uses a symbol that a later merge creates
(checked when the vocabulary is loaded).

Defined results: null text is encoded as empty; empty text has no ids, and both digests are those of the empty
string.  Rows are independent: repeated rows give repeated results, extra columns are ignored, an empty table gives
an empty result.  Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import give_back

#: Fixed values of the file format: words of a lower-cased text; blanks are the format's ``\\s``.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
BLANKS = regex.compile(r"[^\S\x1c-\x1f]+")
#: Letters and digits that Unicode 16 added, which the format's reader knows and ``unicodedata`` may not.
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Their capitals.
ADDED_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
ADDED_LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
ADDED_CAPITAL = re.compile("[" + "".join(map(chr, ADDED_LOWER)) + "]")
NO_RANK = np.iinfo(np.int64).max
#: Chunks, and words, that a worker keeps (about 0.6 kB each).
CACHE_CHUNKS = 300_000


@lru_cache(maxsize=1)
def word_pattern() -> regex.Pattern:
    """Words of any text.  ``regex`` may know letters that are newer than the format's; those count as symbols."""
    known = {c for a, z in ADDED for c in range(a, z + 1)}
    free = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in known and unicodedata.category(chr(c)) == "Cn")
    late = "".join(sorted(regex.findall(r"[\p{L}\p{N}]", free)))
    runs = "".join(f"{m[0]}-{m[-1]}" for m in _runs(late)) or "\ud800"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{runs}]]+|[\p{{N}}--[{runs}]]|[^\s[\p{{L}}\p{{N}}--[{runs}]]]+")


def _runs(chars: str) -> list[str]:
    out: list[str] = []
    for c in chars:
        if out and ord(out[-1][-1]) + 1 == ord(c):
            out[-1] += c
        else:
            out.append(c)
    return out


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    stand = {b: chr(b) for b in plain}
    return [stand.get(b) or chr(next(other)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        stand = byte_symbols()
        self.inner = np.array([vocab[s] for s in stand], dtype=np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in stand], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.width = max(self.tokens) + 1
        self.names = [self.tokens.get(i) for i in range(self.width)]
        born = np.full(self.width, -1, dtype=np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        ranks = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (born[left] >= ranks).any() or (born[right] >= ranks).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        key = left * self.width + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order, made
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each position of ``at``; NO_RANK where none does."""
        inside = at[at + 1 < len(sym)]
        key = sym[inside] * self.width + sym[inside + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[found] == key) & (owner[inside] == owner[inside + 1])
        out = np.full(len(at), NO_RANK, dtype=np.int64)
        out[:len(inside)] = np.where(hit, self.ranks[found], NO_RANK)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (non-empty UTF-8 bytes) one after another, and where each word's ids begin.

        All words are merged in rounds together; a word leaves the flat arrays when none of its pairs has a rank."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), size)
        rank = self.rank(sym, owner, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = best == NO_RANK
            if over.any():
                done.append((owner[over], sym[over]))
                stay = ~over
                sym, owner, rank, best = sym[stay], owner[stay], rank[stay], best[stay]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            run = np.concatenate(([True], np.diff(at) != 1))   # overlapping occurrences: every second one of a run
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))                           # where the merged symbols are now
            touched = np.zeros(len(sym), dtype=bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(touched)
            rank[changed] = self.rank(sym, owner, changed)
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.searchsorted(owners[order], np.arange(len(words) + 1))

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if ADDED_CAPITAL.search(text):
            text = text.translate(ADDED_LOWER)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """Blank-free runs and special tokens, in order."""
        if self.cut is None or "<|" not in text:
            return self.blank_free(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += ["\n" + part] if i % 2 else self.blank_free(part)   # a blank first: no run has one
        return out

    def blank_free(self, text: str) -> list[str]:
        text = self.normal(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):   # blank to str.split, not to the format
            return [x for x in BLANKS.split(text) if x]
        return text.split()

    def decode(self, ids: list[int]) -> str:
        """Tokens of ``ids`` joined by a blank, as the format names no decoder; ids without a token are left out."""
        return " ".join(filter(None, map(self.names.__getitem__, ids)))

    def words(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        return ASCII_WORD.findall(chunk) if chunk.isascii() else word_pattern().findall(chunk)

    def encode_chunks(self, chunks: list[str]) -> Iterator[list[int]]:
        """Ids of each chunk."""
        pieces = [[c] if c[:1] == "\n" else self.words(c) for c in chunks]
        wanted = {w: i for i, w in enumerate(dict.fromkeys(w for p in pieces for w in p if w[0] != "\n"))}
        flat, at = self.encode_words([w.encode() for w in wanted]) if wanted else (np.zeros(0, int), np.zeros(1, int))
        flat, at = flat.tolist(), at.tolist()
        ids = {w: flat[at[i]:at[i + 1]] for w, i in wanted.items()}
        for p in pieces:
            if len(p) == 1:
                yield [self.special[p[0][1:]]] if p[0][0] == "\n" else ids[p[0]]
            else:
                yield [t for w in p for t in ids[w]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        per_text = [self.chunks(t) for t in texts]
        known = list(dict.fromkeys(c for cs in per_text for c in cs))
        ids = dict(zip(known, self.encode_chunks(known)))
        return [[t for c in cs for t in ids[c]] for cs in per_text]


class Cache:
    """Id text and decoded text of the words and the blank-free chunks a worker process has met.

    Both are kept in two generations of half of ``size`` (CACHE_CHUNKS): when the young one is full the old one goes, and what is met
    again in the old one moves to the young.  So frequent entries stay however many rare ones pass by."""

    def __init__(self, bpe: Bpe, size: int | None = None):
        self.bpe, self.size = bpe, size
        self.empty()
        self.digits = [str(i) for i in range(bpe.width)]

    def learn(self, chunks: set[str]) -> None:
        """Afterwards ``known`` has all ``chunks``."""
        new = [c for c in chunks if c not in self.known]
        if self.known and len(self.known) + len(new) > (self.size or CACHE_CHUNKS) // 2:
            self.known, self.old, new = {}, self.known, list(chunks)
        known, old = self.known, self.old
        known.update((c, old[c]) for c in new if c in old)
        rest = [c for c in new if c not in old]
        cut, special = self.bpe.words, self.bpe.special
        pieces = [() if c[0] == "\n" else cut(c) for c in rest]
        self.learn_words(dict.fromkeys(w for p in pieces for w in p))
        words = self.words
        for c, p in zip(rest, pieces):
            if len(p) == 1:
                known[c] = words[p[0]]
            elif len(p) == 2:
                (a, x), (b, y) = words[p[0]], words[p[1]]
                known[c] = (f"{a} {b}", f"{x} {y}" if x and y else x or y)
            elif p:
                known[c] = (" ".join([words[w][0] for w in p]), " ".join(filter(None, [words[w][1] for w in p])))
            else:
                i = special[c[1:]]
                known[c] = (self.digits[i], self.bpe.decode([i]))

    def learn_words(self, wanted: dict[str, None]) -> None:
        if self.words and len(self.words) + len(wanted) > (self.size or CACHE_CHUNKS) // 2:
            self.words, self.old_words = {}, self.words
        new = [w for w in wanted if w not in self.words]
        digits, decode, words, old = self.digits.__getitem__, self.bpe.decode, self.words, self.old_words
        rest = [w for w in new if w not in old]
        words.update((w, old[w]) for w in new if w in old)
        if rest:
            flat, at = self.bpe.encode_words([w.encode() for w in rest])
            flat, at = flat.tolist(), at.tolist()
            for w, a, z in zip(rest, at, at[1:]):
                ids = flat[a:z]
                words[w] = (" ".join(map(digits, ids)), decode(ids))

    def empty(self) -> None:
        self.known, self.old, self.words, self.old_words = {}, {}, {}, {}

    def texts(self, chunks: list[str]) -> tuple[str, str]:
        """Ids and tokens of learned chunks, each joined by blanks."""
        if not chunks:
            return "", ""
        ids, tokens = zip(*map(self.known.__getitem__, chunks))
        return " ".join(ids), " ".join(tokens)


@lru_cache(maxsize=1)
def worker_cache(spec: bytes, size: int | None = None) -> Cache:
    """One per Python worker and vocabulary; later tasks of the worker find it filled."""
    return Cache(Bpe(spec), size)


def encode(docs: DataFrame, vocabulary: bytes, with_ids: bool = False, keep: tuple[str, ...] = (),
           text: str = "text", key: str = "doc_id", cache_size: int | None = None) -> DataFrame:
    """Per row: key, columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    With ``cache_size`` a worker keeps at most so many chunks and words, and none after a task: for jobs whose other stages
    need the memory of the same workers."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary)
    chosen = docs.select(key, *keep, text)
    types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (key, *keep)) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(spec.value, cache_size)
        for batch in batches:
            column = batch.column(len(keep) + 1)
            for lo in range(0, batch.num_rows, 512):
                part = column.slice(lo, 512).to_pylist()
                split = [cache.bpe.chunks(t or "") for t in part]
                n, a, b, ids = [], [], [], []
                for group in groups(split):
                    cache.learn(set().union(*group))
                    for cs in group:
                        joined, back = cache.texts(cs)
                        n.append(joined.count(" ") + 1 if joined else 0)
                        a.append(hashlib.sha256(joined.encode()).hexdigest())
                        b.append(hashlib.sha256(back.encode()).hexdigest())
                        if with_ids:
                            ids.append(np.array(joined.split(), dtype=np.int32))
                columns = [batch.column(i).slice(lo, 512) for i in range(len(keep) + 1)]
                columns += [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
                names = [key, *keep, "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if cache_size:
            cache.empty()
        give_back()

    return chosen.mapInArrow(run, schema)


def groups(split: list[list[str]], most: int = CACHE_CHUNKS // 9) -> Iterator[list[list[str]]]:
    """Consecutive texts with about ``most`` chunks together (one longer text is a group of its own)."""
    group, n = [], 0
    for cs in split:
        if group and n + len(cs) > most:
            yield group
            group, n = [], 0
        group.append(cs)
        n += len(cs)
    if group:
        yield group
