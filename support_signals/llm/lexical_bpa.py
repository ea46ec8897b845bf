"""Operator 11: ranked lexical search by the Best Position Algorithm.

**Index.**  One pass over the whole texts stores the postings of the items' terms, a row per shard: a shard is a run of whole
documents of one task (``SHARD_BYTES`` of text; a longer document is a shard of its own) with, per term, its documents and
occurrences.  N, L and the terms' document frequencies are sums over the shards.  Shards grow in number, not in size.

**Search.**  A shard turns its postings into impact lists (falling impact, then place).  For an item the lists of its terms
are read from the top, some entries at a time; each new document is looked up directly in all the other lists, which gives
its score and marks its positions there as seen.  The *best position* of a list is the last one up to which all are seen,
by either kind of access.  A document not seen yet stands behind the best positions of all lists, so the sum of the impacts
that follow them bounds its score: an item stops when this bound is strictly below its k-th best score so far (equal scores
may still win by their id).  That score is kept from shard to shard of a task.  The k best of each task are merged, first
within salted parts of an item, then per item.

Items are a stated query set, taken in blocks of about ``BLOCK_WORDS`` words, each broadcast by itself.

Defined results: null or empty texts and items have no terms; an item without terms, or whose terms score nothing, has no
rows; repeated items have their rows repeatedly; documents with a null id count in the statistics and are never ranked;
rows with equal ids are documents of their own; terms found in about every document weigh 0 and are not read; extra columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .words import ALNUM, LOWER, scan, slices

TOP = 10
SHARD_BYTES = 32 << 20
BLOCK_WORDS = 100_000
#: Entries of each list that the first round of sorted accesses reads; later rounds read twice as many as the one before.
FIRST_READ = 8


@dataclass(frozen=True)
class Items:
    """A block of items: per item its id and its distinct terms, as numbers into ``terms``."""

    terms: np.ndarray
    names: list
    of: list[np.ndarray]


def item_block(rows: list[tuple]) -> Items:
    texts = pa.array([t or "" for _, t in rows], pa.string())
    hashes: list[np.ndarray] = []
    for lo, hi, buf, at in slices(texts):
        w = scan(buf, at, ALNUM, LOWER)
        hashes += [np.unique(w.hash[w.span(i)]) for i in range(hi - lo)]
    terms = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    return Items(terms, [i for i, _ in rows], [np.searchsorted(terms, h) for h in hashes])


def index(docs: DataFrame, terms: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per shard: its documents that have terms (ids, n_terms) and the postings of ``terms``: term numbers, how many
    documents each has, and those documents' places and occurrences, term by term."""
    wanted = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        words: list[np.ndarray] = []
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held, docs_held, v = 0, 0, max(1, len(wanted.value))

        def shard() -> pa.RecordBatch:
            pair, tf = np.concatenate(found), np.concatenate(counts)
            doc, term = pair // v, pair % v
            order = np.argsort(term, kind="stable")
            doc, term, tf = doc[order], term[order], tf[order]
            start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [one(pa.concat_arrays(ids)), one(pa.array(np.concatenate(words))), one(pa.array(term[start].astype(np.int32))),
                 one(pa.array(np.diff(np.append(start, len(term))).astype(np.int32))), one(pa.array(doc.astype(np.int32))),
                 one(pa.array(tf.astype(np.int64)))], names=["ids", "n_terms", "terms", "df", "docs", "tf"])

        for batch in batches:
            column = batch.column(0).cast(pa.int64())
            for lo, hi, buf, at in slices(batch.column(1)):
                w = scan(buf, at, ALNUM, LOWER)
                place = np.searchsorted(wanted.value, w.hash)
                place[place == len(wanted.value)] = 0
                hit = wanted.value[place] == w.hash if len(wanted.value) else np.zeros(len(place), dtype=bool)
                pair, tf = np.unique((w.doc_of_word()[hit] + docs_held) * v + place[hit], return_counts=True)
                ids.append(column.slice(lo, hi - lo))
                words.append(np.diff(w.first))
                found.append(pair)
                counts.append(tf)
                held += len(buf)
                docs_held += hi - lo
                if held >= SHARD_BYTES:
                    yield shard()
                    ids, words, found, counts = [], [], [], []
                    held = docs_held = 0
        if docs_held:
            yield shard()

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).mapInArrow(
        run, "ids array<bigint>, n_terms array<bigint>, terms array<int>, df array<int>, docs array<int>, tf array<bigint>")


def statistics(shards: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term of the block."""
    some = F.filter("n_terms", lambda n: n > 0)
    n, total = shards.agg(F.sum(F.size(some).cast("bigint")), F.sum(F.aggregate("n_terms", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    df = np.zeros(terms, dtype=np.int64)
    pairs = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy("p.terms").agg(F.sum("p.df").alias("df"))
    for row in pairs.collect():                       # as many rows as a block has terms at most
        df[row["terms"]] = row["df"]
    return n or 0, total or 0, df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


@dataclass
class Lists:
    """Impact lists of a shard, one after the other (``at``: first entry per term number, one more than terms), and the
    same entries by document for direct access."""

    at: np.ndarray
    doc: np.ndarray         # by falling impact
    impact: np.ndarray
    key: np.ndarray         # term * documents + doc, rising
    position: np.ndarray    # of the entry with that key, in ``doc``
    docs: int


def impact_lists(n_terms: np.ndarray, terms: np.ndarray, df: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: int, total: int, vocabulary: int) -> Lists:
    term = np.repeat(terms, df).astype(np.int64)
    doc = doc.astype(np.int64)
    m = 10 + 90 * n_terms[doc] * n // total if len(doc) else doc
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
    order = np.lexsort((doc, -impact, term))
    size = np.zeros(vocabulary, dtype=np.int64)
    size[terms] = df
    position = np.empty(len(order), dtype=np.int64)
    position[order] = np.arange(len(order))
    return Lists(np.concatenate(([0], np.cumsum(size))), doc[order], impact[order], term * len(n_terms) + doc, position, len(n_terms))


def best_positions(lists: Lists, ids: np.ndarray, known: np.ndarray, terms: np.ndarray, weight: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
    """Updates ``best``, (-score, doc_id) of the k best documents so far, with those of the shard; documents scored."""
    terms = terms[(lists.at[terms + 1] > lists.at[terms]) & (weight[terms] > 0)]
    if not len(terms):
        return 0
    start, end, w = lists.at[terms], lists.at[terms + 1], weight[terms]
    off = np.concatenate(([0], np.cumsum(end - start)))
    seen = np.zeros(off[-1] + 1, dtype=bool)              # the last one stays unseen and ends the last list
    done = np.zeros(lists.docs, dtype=bool)
    at = np.zeros(len(terms), dtype=np.int64)             # entries read
    first_unseen = start.copy()
    step, scored = FIRST_READ, 0
    while True:
        bound = int((w * np.where(first_unseen < end, lists.impact[np.minimum(first_unseen, end - 1)], 0)).sum())
        if bound == 0 or (len(best) == k and bound < -best[-1][0]):
            return scored
        upto = np.minimum(at + step, end - start)
        n = upto - at
        entry = np.repeat(start + at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        at, step = upto, 2 * step
        new = lists.doc[entry]
        new = np.unique(new[~done[new]])
        if len(new):
            done[new] = True
            scored += len(new)
            keys = (terms[:, None] * lists.docs + new[None, :]).ravel()
            place = np.searchsorted(lists.key, keys)
            place[place == len(lists.key)] = 0
            hit = np.flatnonzero(lists.key[place] == keys)
            row = hit // len(new)
            position = lists.position[place[hit]]
            seen[position - start[row] + off[row]] = True
            score = np.zeros(len(new), dtype=np.int64)
            np.add.at(score, hit % len(new), w[row] * lists.impact[position])
            score[~known[new]] = 0
            good = score > 0
            if len(best) == k:
                good &= score >= -best[-1][0]
            if good.any():
                top, who = score[good], ids[new[good]]
                some = np.lexsort((who, -top))[:k]
                best[:] = sorted(best + list(zip((-top[some]).tolist(), who[some].tolist())))[:k]
        for i in range(len(terms)):
            if first_unseen[i] < end[i]:
                rest = seen[first_unseen[i] - start[i] + off[i]:off[i + 1]]
                gap = int(rest.argmin())
                first_unseen[i] += len(rest) if rest[gap] else gap


def search_block(docs: DataFrame, items: Items, k: int, text: str, key: str) -> DataFrame:
    """(item, rank, doc_id, score); ``item`` numbers the items of the block."""
    spark = docs.sparkSession
    shards = write_table(index(docs, items.terms, text, key), "impact-shards")
    n, total, df = statistics(shards, len(items.terms))
    shared = spark.sparkContext.broadcast((items.of, weights(n, df), n, total, len(items.terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weight, n, total, vocabulary = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in of]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_terms, terms, df, doc, tf = (batch.column(c)[i].values for c in range(6))
                known = np.asarray(ids.is_valid())
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                lists = impact_lists(*(x.to_numpy(zero_copy_only=False) for x in (n_terms, terms, df, doc, tf)), n, total, vocabulary)
                for item, t in enumerate(of):
                    best_positions(lists, ids, known, t, weight, best[item], k)
        rows = [(item, d, -s) for item, b in enumerate(best) for s, d in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    found = shards.mapInArrow(run, "item int, doc_id bigint, score bigint").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    order = [F.desc("score"), F.asc("doc_id")]
    part = found.withColumn("place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("place") <= k)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "doc_id", "score")


def item_blocks(items: DataFrame, text: str, key: str) -> Iterator[list[tuple]]:
    """The items in blocks of about ``BLOCK_WORDS`` words (a longer item is a block of its own), one on the driver at a time."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        size = len(row["t"] or "") // 6 + 1
        if block and held + size > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row["k"], row["t"]))
        held += size
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Per item its ``k`` best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    for rows in item_blocks(items, text, item_key):
        block = item_block(rows)
        if not len(block.terms):
            continue
        names = spark.createDataFrame(list(enumerate(block.names)), f"item int, item_id {kind.simpleString()}")
        out = out.unionByName(search_block(docs, block, k, text, key).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
