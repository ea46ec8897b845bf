"""Operator 4: substring dedup by suffix automata of reference shards.

A window of 13 consecutive words is removed from a document if its word sequence also starts in a document with a smaller
id.  Words covered by such a window go; windows are judged on the input.

**Candidates.**  Each window stands under its *minimizer*, the word 7-gram of the smallest hash inside it, so equal windows
have equal minimizers.  Minimizers are a quarter of the words; one pass finds those of two or more documents (aggregated
before the shuffle) and the smallest document of each, its *owner*.  Windows under other minimizers are unique.

**Reference shards.**  A shard is an owner's text under its shared minimizers.  Its suffix automaton is built where the
other documents' candidate runs of that owner are streamed through it; matching statistics give the longest match that
ends at each word, and matches of 13 words or more are maximal spans to remove.  Reference shards grow with the corpus, so
they are not broadcast to all tasks: streams are routed to the owner's shard, and an owner with many streams has its
shard (the text of one document) sent to several salted groups.

**Rest.**  A candidate window that is not in its owner's text may still repeat between later documents (the minimizer is
equal, the words around it are not).  These leftover windows meet on 128 bits of their words; the smallest document keeps.

Defined results: null or short texts lose nothing; rows with a null id neither lose words nor count as earlier; rows with
equal ids are told apart by a hash of their text and never count as earlier than each other; repeated rows give equal
results; ties of minimizers do not matter, as equal windows tie alike; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .components import bit_of, bitmap, exact_bitmap, has_bit
from .words import U64, Words, mix, scan, slices, windows

WINDOW = 13
GRAM = 7
KEY_BITS = 25
DOC_BITS = 23
STREAMS = 2_000        # documents that one copy of a reference shard serves


def minimizers(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimizer) of every window."""
    first, _ = windows(w, window)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    at, h = windows(w, gram)
    every = np.full(len(w.hash), np.iinfo(np.uint64).max, dtype=np.uint64)
    every[at] = mix(h ^ U64(0x5DEECE66D))
    span, best = 1, every
    while span * 2 <= window - gram + 1:
        best = np.minimum(best, np.append(best[span:], np.full(span, np.iinfo(np.uint64).max, np.uint64)))
        span *= 2
    rest = window - gram + 1 - span
    return first, np.minimum(best[first], best[first + rest])


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def minimizer_rows(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """Distinct (minimizer, doc_id, text_hash); with ``wanted``, those whose bit is set."""
    flags = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, buf, at in slices(batch.column(2)):
                w = scan(buf, at)
                first, m = minimizers(w)
                doc = np.searchsorted(w.first, first, side="right") - 1
                new = np.ones(len(m), dtype=bool)
                new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])       # repeated ones mostly follow each other
                if flags.value is not None:
                    new &= has_bit(flags.value, (m >> U64(64 - KEY_BITS)).astype(np.int64))
                m, doc = m[new].view(np.int64), doc[new] + lo
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(ids[doc]), pa.array(hashes[doc])], names=["minimizer", "doc_id", "text_hash"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "minimizer bigint, doc_id bigint, text_hash bigint")


def with_bit(docs: DataFrame, flags: np.ndarray) -> DataFrame:
    """The documents whose id has its bit set."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = has_bit(shared.value, batch.column(3).to_numpy(zero_copy_only=False))
            if keep.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:3]], names=["doc_id", "text_hash", "text"])

    return docs.where("doc_id IS NOT NULL").withColumn("bit", bit_of(F.col("doc_id"), DOC_BITS)).mapInArrow(run, "doc_id bigint, text_hash bigint, text string")


def pieces(joined: DataFrame) -> DataFrame:
    """Runs of candidate windows with one owner: (owner, doc_id, text_hash, first word, word hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, buf, at in slices(batch.column(2)):
                w = scan(buf, at)
                first, m = minimizers(w)
                cut = np.searchsorted(first, w.first)
                out: list[tuple] = []
                for i in range(hi - lo):
                    keys = np.array(batch.column(3)[lo + i].as_py(), dtype=np.int64).view(np.uint64)
                    owners = np.array(batch.column(4)[lo + i].as_py(), dtype=np.int64)
                    order = np.argsort(keys)
                    keys, owners = keys[order], owners[order]
                    mine, start = m[cut[i]:cut[i + 1]], first[cut[i]:cut[i + 1]]
                    if not len(mine):
                        continue
                    found = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    known = keys[found] == mine
                    owner = owners[found]
                    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (known[1:] != known[:-1])))
                    begin = np.flatnonzero(new)
                    for a, z in zip(begin, np.append(begin[1:], len(mine))):
                        if known[a]:
                            out.append((int(owner[a]), ids[lo + i], hashes[lo + i], int(start[a] - w.first[i]),
                                        w.hash[start[a]:start[z - 1] + WINDOW].tobytes()))
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())],
                    names=["owner", "doc_id", "text_hash", "first", "words"])

    return joined.mapInArrow(run, "owner bigint, doc_id bigint, text_hash bigint, first int, words binary")


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[int]) -> None:
        next_, link, size = self.next, self.link, self.size
        last = 0
        for c in words:
            q = next_[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                made = len(next_)
                next_.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p != -1 and c not in next_[p]:
                    next_[p][c] = made
                    p = link[p]
                if p != -1:
                    q = next_[p][c]
                    link[made] = q if size[q] == size[p] + 1 else self._split(p, q, c)
                last = made
            else:
                last = self._split(last, q, c)

    def _split(self, p: int, q: int, c: int) -> int:
        next_, link, size = self.next, self.link, self.size
        clone = len(next_)
        next_.append(dict(next_[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and next_[p].get(c) == q:
            next_[p][c] = clone
            p = link[p]
        return clone

    def statistics(self, words: list[int]) -> list[int]:
        """The length of the longest match that ends at each word."""
        next_, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for c in words:
            to = next_[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = next_[state].get(c)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append(length)
        return out


def match_streams(routed: DataFrame) -> DataFrame:
    """Spans [start, end) of words found in the owner's shard, and leftover windows with 128 bits of their words.

    ``routed`` is dealt by (owner, salt) and sorted, the reference first, so a task holds one automaton at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple[int, int] | None = None
        automaton = Automaton()
        place = np.random.default_rng(77).integers(1, 2**63, (2, WINDOW), dtype=np.uint64) * U64(2) + U64(1)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "text_hash", "start", "end", "w1", "w2")}
            for owner, salt, stream, doc, text, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, salt) != shard:
                    shard, automaton = (owner, salt), Automaton()
                h = np.frombuffer(raw, dtype=np.uint64)
                if not stream:
                    automaton.add(h.tolist())
                    continue
                length = np.array(automaton.statistics(h.tolist()))
                end = np.flatnonzero(length >= WINDOW)
                if len(end):
                    begin, stop = end - length[end] + 1, end + 1
                    last = np.maximum.accumulate(stop)
                    new = np.concatenate(([True], begin[1:] > last[:-1]))
                    starts, ends = begin[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                    out["start"] += (starts + first).tolist()
                    out["end"] += (ends + first).tolist()
                    out["w1"] += [None] * len(starts)
                    out["w2"] += [None] * len(starts)
                    out["doc_id"] += [doc] * len(starts)
                    out["text_hash"] += [text] * len(starts)
                left = np.flatnonzero(length[WINDOW - 1:] < WINDOW)
                if len(left):
                    seen = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[left]
                    out["start"] += (left + first).tolist()
                    out["end"] += (left + first + WINDOW).tolist()
                    out["w1"] += mix((seen * place[0]).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist()
                    out["w2"] += mix((mix(seen) * place[1]).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist()
                    out["doc_id"] += [doc] * len(left)
                    out["text_hash"] += [text] * len(left)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["text_hash"], pa.int64()), pa.array(out["start"], pa.int32()),
                 pa.array(out["end"], pa.int32()), pa.array(out["w1"], pa.int64()), pa.array(out["w2"], pa.int64())], names=list(out))

    return routed.mapInArrow(run, "doc_id bigint, text_hash bigint, start int, end int, w1 bigint, w2 bigint")


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, spans): covered words of every document that loses some, as sorted [start, end) pairs."""
    rows = _rows(docs, text, key)
    shared = write_table(
        minimizer_rows(rows, None).groupBy("minimizer").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .where("owner < last").select("minimizer", "owner"), "shared-minimizers")
    top = F.shiftrightunsigned(F.col("minimizer"), 64 - KEY_BITS)
    again = minimizer_rows(rows, exact_bitmap(shared.select(top.alias("at")), KEY_BITS))
    owned = write_table(again.join(shared, "minimizer").groupBy("doc_id", "text_hash")
                        .agg(F.collect_list(F.struct("minimizer", "owner")).alias("o"))
                        .select("doc_id", "text_hash", F.col("o.minimizer").alias("minimizers"), F.col("o.owner").alias("owners")), "owned-minimizers")
    joined = (with_bit(rows, bitmap(owned, "doc_id", DOC_BITS)).dropDuplicates(["doc_id", "text_hash"])
              .join(owned, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "minimizers", "owners"))
    cut = write_table(pieces(joined), "pieces")
    copies = cut.where("doc_id <> owner").groupBy("owner").agg(F.ceil(F.count("*") / STREAMS).cast("int").alias("copies"))
    placed = cut.join(copies, "owner")
    routed = (placed.withColumn("salt", F.explode(F.when(F.col("doc_id") == F.col("owner"), F.sequence(F.lit(0), F.col("copies") - 1))
                                                  .otherwise(F.array(F.pmod(F.xxhash64("doc_id", "first"), "copies").cast("int")))))
              .select("owner", "salt", (F.col("doc_id") != F.col("owner")).alias("stream"), "doc_id", "text_hash", "first", "words")
              .repartition("owner", "salt").sortWithinPartitions("owner", "salt", "stream"))
    matched = write_table(match_streams(routed), "matches")
    left = matched.where("w1 IS NOT NULL")
    earlier = left.groupBy("w1", "w2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").drop("last")
    again = left.join(earlier, ["w1", "w2"]).where("doc_id > keeper").select("doc_id", "text_hash", "start", "end")
    return (matched.where("w1 IS NULL").select("doc_id", "text_hash", "start", "end").unionByName(again)
            .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))


def without_spans(joined: DataFrame, key: str, kind: str, with_text: bool) -> DataFrame:
    """Kept words of rows (key, text, spans)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for lo, hi, buf, at in slices(batch.column(1)):
                w = scan(buf, at)
                n, removed, sha, kept = [], [], [], []
                for i in range(hi - lo):
                    begin, end = w.start[w.span(i)], w.end[w.span(i)]
                    found = spans[lo + i].as_py() or ()
                    if found:
                        gone = np.zeros(len(begin) + 1, dtype=np.int64)
                        for s in found:
                            gone[s["start"]] += 1
                            gone[s["end"]] -= 1
                        stay = np.cumsum(gone[:-1]) == 0
                        begin, end = begin[stay], end[stay]
                        removed.append(int((~stay).sum()))
                    else:
                        removed.append(0)
                    n.append(len(begin) + removed[-1])
                    raw = buf[at[i]:at[i + 1]].tobytes()
                    base = int(at[i])
                    joined_words = b" ".join([raw[a - base:z - base] for a, z in zip(begin.tolist(), end.tolist())])
                    sha.append(hashlib.sha256(joined_words).hexdigest())
                    kept.append(joined_words.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                    + ([pa.array(kept, pa.string())] if with_text else []),
                    names=[key, "n_words", "n_removed", "kept_sha256"] + (["kept_text"] if with_text else []))

    return joined.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else ""))


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one blank)."""
    spans = write_table(repeated_spans(docs, text, key), "repeated-spans").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    flags = docs.sparkSession.sparkContext.broadcast(bitmap(spans, "_id", DOC_BITS))
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
                has = (bit >= 0) & has_bit(flags.value, np.maximum(bit, 0))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(has if hit else ~has)) for c in batch.columns[:2]], names=["_key", "_text"])

        bit = F.when(F.col("_key").isNotNull(), bit_of(F.col("_key").cast("bigint"), DOC_BITS))
        return rows.withColumn("bit", bit).mapInArrow(run, f"_key {kind}, _text string")

    touched = (split(True).withColumn("_h", F.xxhash64("_text")).join(spans, (F.col("_key").cast("bigint") == F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
               .select("_key", "_text", "spans"))
    clean = split(False).withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    return without_spans(touched, key, kind, with_text).unionByName(without_spans(clean, key, kind, with_text))
