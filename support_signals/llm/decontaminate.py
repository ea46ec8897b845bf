"""Operator 7: benchmark decontamination over a distributed positional inverted index.

**Index.**  One pass over the whole texts stores the postings of training tokens: a row per shard (a run of whole
documents) and term with the term's word positions in the shard, and a row per shard with its documents.  Only terms that
the benchmark has are stored while their number is below ``MAX_TERMS``; beyond it every term is.  The index is a table in
the shared checkpoint folder; a document is in one shard, so phrases are found within shards.

**Search.**  The benchmark is a stated query set, cut into blocks of about ``BLOCK_WORDS`` words, each broadcast by itself.
A window (ten consecutive words of an item, or a whole shorter item) starts from the postings of its rarest term in the
corpus, and its other terms are intersected from rare to common, each list shifted by the term's offset.  ``near`` finds
windows whose rarest terms all occur within ``slop`` words of where they should.

Defined results: null or empty texts and items have no words; windows never cross documents; items that repeat an id are
one item; items with a null id count with the id ``null`` as a string; repeated rows are separate rows with equal results;
extra columns are ignored; without items every document is clean; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .words import ALNUM, LOWER, scan, slices

WINDOW = 10
GAP = WINDOW                  # free positions between documents of a shard
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 200_000
MAX_TERMS = 2_000_000
CANDIDATES = 2_000_000        # starts that are intersected at once


def item_words(items: list[tuple[str, str]]) -> list[tuple[str, np.ndarray]]:
    """(item, word hashes) of items that have words."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    out = []
    for lo, hi, buf, at in slices(texts):
        w = scan(buf, at, ALNUM, LOWER)
        out += [(items[lo + i][0], w.hash[w.span(i)]) for i in range(hi - lo) if w.first[i + 1] > w.first[i]]
    return out


def build_index(docs: DataFrame, terms: np.ndarray | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (shard, term, n, positions) and, with a null term, (shard, doc_ids, hashes, first, n_words)."""
    wanted = docs.sparkSession.sparkContext.broadcast(terms)
    chosen = docs.select(key, F.xxhash64(text).alias("text_hash"), text)
    kind = chosen.schema[0].dataType.simpleString()
    schema = f"shard bigint, term bigint, n bigint, positions binary, doc_ids array<{kind}>, hashes array<bigint>, first array<int>, n_words array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            for lo, hi, buf, at in slices(batch.column(2), SHARD_BYTES):
                shard += 1
                w = scan(buf, at, ALNUM, LOWER)
                size = np.diff(w.first)
                position = np.arange(len(w.hash)) + np.repeat(np.arange(hi - lo), size) * GAP
                h = w.hash
                if wanted.value is not None:
                    found = np.searchsorted(wanted.value, h)
                    hit = np.zeros(len(h), dtype=bool)
                    inside = found < len(wanted.value)
                    hit[inside] = wanted.value[found[inside]] == h[inside]
                    h, position = h[hit], position[hit]
                order = np.argsort(h, kind="stable")
                h, position = h[order], position[order].astype(np.int32)
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                end = np.append(start[1:], len(h))
                postings = [np.diff(position[a:z], prepend=np.int32(0)).astype(np.int32).tobytes() for a, z in zip(start, end)]
                n = len(start)
                ids = batch.column(0).slice(lo, hi - lo)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + 1, shard)), pa.concat_arrays([pa.array(h[start].view(np.int64)), pa.nulls(1, pa.int64())]),
                     pa.array(np.append(end - start, hi - lo)), pa.array([*postings, None], pa.binary()),
                     *(pa.concat_arrays([pa.nulls(n, c.type), c]) for c in (
                         one(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids),
                         one(batch.column(1).slice(lo, hi - lo)),
                         one(pa.array((w.first[:-1] + np.arange(hi - lo) * GAP).astype(np.int32))), one(pa.array(size.astype(np.int64)))))],
                    names=["shard", "term", "n", "positions", "doc_ids", "hashes", "first", "n_words"])

    return chosen.mapInArrow(run, schema)


@dataclass(frozen=True)
class Queries:
    """Windows of a block of items: terms and offsets from rare to common, -1 beyond a shorter window."""

    terms: np.ndarray     # sorted hashes
    term: np.ndarray      # windows x WINDOW, numbers into ``terms``
    offset: np.ndarray    # windows x WINDOW
    length: np.ndarray
    item: np.ndarray
    items: list[str]


def windows_of(items: list[tuple[str, np.ndarray]], frequency: dict[int, int]) -> Queries:
    terms = np.unique(np.concatenate([h for _, h in items]))
    often = np.array([frequency.get(int(t.view(np.int64)), 0) for t in terms])
    term, offset, length, number, names = [], [], [], [], []
    for k, (name, h) in enumerate(items):
        names.append(name)
        t = np.searchsorted(terms, h)
        for s in range(max(1, len(t) - WINDOW + 1)):
            x = t[s:s + WINDOW]
            order = np.argsort(often[x], kind="stable")
            fill = np.full(WINDOW - len(x), -1)
            term.append(np.concatenate((x[order], fill)))
            offset.append(np.concatenate((order, fill)))
            length.append(len(x))
            number.append(k)
    return Queries(terms, np.array(term), np.array(offset), np.array(length), np.array(number), names)


class Postings:
    """The lists of one shard, for the terms of a block of queries."""

    def __init__(self, q: Queries, rows: list[tuple[int, bytes]]):
        lists: dict[int, np.ndarray] = {}
        for term, raw in rows:
            t = np.uint64(term & (2**64 - 1))
            i = int(np.searchsorted(q.terms, t))
            if i < len(q.terms) and q.terms[i] == t:
                lists[i] = np.cumsum(np.frombuffer(raw, dtype=np.int32), dtype=np.int64)
        self.span = 1 + max([int(x[-1]) for x in lists.values()], default=0) + 2 * WINDOW
        self.count = np.zeros(len(q.terms) + 1, dtype=np.int64)
        for i, x in lists.items():
            self.count[i] = len(x)
        self.at = np.concatenate(([0], np.cumsum(self.count)))
        self.position = np.concatenate([lists[i] for i in sorted(lists)]) if lists else np.zeros(0, np.int64)
        self.key = np.repeat(np.arange(len(self.count)), self.count) * self.span + self.position

    def has(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether each term occurs at a position from lo to hi."""
        lo, hi = np.clip(lo, 0, self.span - 1), np.clip(hi, -1, self.span - 1)
        return np.searchsorted(self.key, term * self.span + lo) < np.searchsorted(self.key, term * self.span + hi, side="right")


def match(q: Queries, p: Postings, slop: int = 0, anchors: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of phrases; with ``slop``, of windows whose ``anchors`` rarest terms are all about in place."""
    size = p.count[q.term[:, 0]]
    lo = 0
    total = np.concatenate(([0], np.cumsum(size)))
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CANDIDATES, side="right")) - 1)
        part = np.arange(lo, hi)
        n = size[lo:hi]
        window = np.repeat(part, n)
        place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = p.position[p.at[q.term[window, 0]] + place] - q.offset[window, 0]
        for k in range(1, anchors):
            if not len(window):
                break
            t, at = q.term[window, k], start + q.offset[window, k]
            ok = (t < 0) | p.has(np.maximum(t, 0), at - slop, at + slop)
            window, start = window[ok], start[ok]
        if len(window):
            yield window, start
        lo = hi


RUN = "shard bigint, doc int, starts array<int>, ends array<int>, items array<string>"


def search(index: DataFrame, q: Queries, slop: int = 0, anchors: int = WINDOW) -> DataFrame:
    """Per document with matches: (shard, doc, covered runs of words, items)."""
    shared = index.sparkSession.sparkContext.broadcast(q)

    def run(table: pa.Table) -> pa.Table:
        term, raw, first, n_words = (table[c].to_pylist() for c in ("term", "positions", "first", "n_words"))
        doc_row = term.index(None)
        begin, size = np.array(first[doc_row], dtype=np.int64), np.array(n_words[doc_row], dtype=np.int64)
        q = shared.value
        p = Postings(q, [(t, r) for t, r in zip(term, raw) if t is not None])
        found = list(match(q, p, slop, anchors))
        out: dict[str, list] = {c: [] for c in ("shard", "doc", "starts", "ends", "items")}
        if found:
            window, start = (np.concatenate(x) for x in zip(*found))
            doc = np.searchsorted(begin, np.maximum(start, 0), side="right") - 1
            order = np.lexsort((start, doc))
            window, start, doc = window[order], start[order], doc[order]
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, z in zip(cut, np.append(cut[1:], len(doc))):
                d = int(doc[a])
                s = np.clip(start[a:z] - begin[d], 0, size[d])
                e = np.clip(start[a:z] - begin[d] + q.length[window[a:z]], 0, size[d])
                last = np.maximum.accumulate(e)
                new = np.concatenate(([True], s[1:] > last[:-1]))
                out["shard"].append(table["shard"][0].as_py())
                out["doc"].append(d)
                out["starts"].append(s[new].tolist())
                out["ends"].append(last[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)].tolist())
                out["items"].append(sorted({q.items[i] for i in np.unique(q.item[window[a:z]])}))
        return pa.table({"shard": pa.array(out["shard"], pa.int64()), "doc": pa.array(out["doc"], pa.int32()),
                         "starts": pa.array(out["starts"], pa.list_(pa.int32())), "ends": pa.array(out["ends"], pa.list_(pa.int32())),
                         "items": pa.array(out["items"], pa.list_(pa.string()))})

    return index.select("shard", "term", "positions", "first", "n_words").groupBy("shard").applyInArrow(run, RUN)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", slop: int = 0, anchors: int = WINDOW) -> DataFrame:
    """Per row: key, text_hash, n_words, runs (covered words, as [start, end) pairs of one or several blocks), items."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").alias("text"))
    words = int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // 2 + 1     # at most so many
    n_blocks = -(-words // BLOCK_WORDS)
    blocks = [item_words([tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).distinct().collect()])
              for b in range(n_blocks)] if n_blocks <= MAX_TERMS // BLOCK_WORDS else None
    terms = np.unique(np.concatenate([h for b in blocks for _, h in b])) if blocks and any(blocks) else None if blocks is None else np.zeros(0, np.uint64)
    index = write_table(build_index(docs, terms, text, key), "postings")
    found = None
    for b in range(n_blocks):
        block = blocks[b] if blocks is not None else item_words(
            [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).distinct().collect()])
        if not block:
            continue
        own = spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([h for _, h in block])).view(np.int64)], "term bigint")
        frequency = {r[0]: r[1] for r in index.where("term IS NOT NULL").join(F.broadcast(own), "term").groupBy("term").agg(F.sum("n")).collect()}
        part = search(index, windows_of(block, frequency), slop, anchors)
        found = part if found is None else found.unionByName(part)
    rows = (index.where("term IS NULL").select("shard", F.posexplode(F.arrays_zip("doc_ids", "hashes", "n_words")).alias("doc", "d"))
            .select("shard", "doc", F.col("d.doc_ids").alias(key), F.col("d.hashes").alias("text_hash"), F.col("d.n_words").alias("n_words")))
    if found is None:
        return rows.select(key, "text_hash", "n_words", F.expr("CAST(array() AS array<struct<s:int,e:int>>)").alias("runs"), F.expr("CAST(array() AS array<string>)").alias("items"))
    merged = (found.select("shard", "doc", "items", F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")).alias("runs"))
              .groupBy("shard", "doc").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
                                           F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    none = F.expr("array()")
    return (rows.join(merged, ["shard", "doc"], "left")
            .select(key, "text_hash", "n_words", F.coalesce("runs", none).alias("runs"), F.coalesce("items", none).alias("items")))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to")),
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["to"], r["s"]))).alias("n"), F.greatest(a["to"], r["e"]).alias("to")),
        lambda a: a["n"])
    return (found.withColumn("n_hit", covered)
            .select(key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))
