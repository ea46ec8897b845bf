"""Operator 9: n-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct five-word shingles; two documents link when the Jaccard similarity of
their sets is at least 0.8 (in integers: ``100 * common >= 80 * union``).  Equal sets are one *class* from the start.

**Sketch.**  For a pair of sizes ``x <= y`` that links, the symmetric difference has at most ``(x + y) / 9`` elements.
Sizes are cut into bands so that a partner is in the same or the next band; each band has a bound ``d`` on the
difference of its pairs, and a class sketches itself for its own band and the one below.  A sketch has ``d + 1 + s``
blocks of 64 parity bits: each shingle flips one bit of one block.  The Hamming distance of two sketches is a lower bound
of the symmetric difference, and a difference of ``d`` elements touches at most ``d`` blocks, so linking classes agree in
at least ``1 + s`` whole blocks (pigeonhole).  Blocks of fewer than two elements are *thin*: they say little and join many
classes.  Blocks in which two linking classes have no difference hold equal elements, so they are thin on both sides or on
neither.  Hence two families of keys: every class gives its full blocks to a common key space, and a class with ``s`` or more
thin blocks gives all its blocks to a second one.  Two classes with fewer than ``s`` thin blocks each share ``1 + s`` full
blocks less the thin ones of either; such a class and one with more share two full blocks at least; two classes with more
share ``1 + s`` keys of the second space.

**Join.**  Blocks meet on (band, block number, bits).  Documents that meet on one of their rarest shared blocks form small
clusters; within a cluster sizes, then 256-bit parity sketches (again a lower bound), then the sets themselves are compared.
A comparison is left out when its two documents are connected already, and a cluster gives a forest of links instead of all
pairs, which has the same components.

Defined results: null or empty texts, or such without words, have no shingles and link with nothing; a text of one to four
words has its whole sequence as its one shingle; component_id is the smallest doc_id reachable, itself included; rows with
equal ids are one node, so repeated rows are fine; a row with a null id is no candidate for links and gets the component of
the rows that have its set and an id, or null if there are none; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .components import bit_of, bitmap, components, exact_bitmap, has_bit
from .words import LOWER, U64, give_back, mix, scan, sequence_hash, slices, windows

SHINGLE = 5
SHARE = 80
#: Bits of the fixed-size bitmaps of document ids and of keys (1 MB and 4 MB).
KEEP_BITS = 23
KEY_BITS = 25
#: Shingles of a part of a large cluster.
TILE = 400_000
LARGEST = 1 << 40


def band_edges(largest: int = LARGEST, share: int = SHARE) -> list[int]:
    """Smallest sizes of the bands: a partner of a size in one band lies in it or the next."""
    edges = [1, 2]
    while edges[-1] < largest:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // share + 1))
    return edges


EDGES = np.array(band_edges())


def most_different(band: int, share: int = SHARE) -> int:
    """Bound of the symmetric difference of linking sets whose smaller one is in ``band``."""
    x = int(EDGES[band + 1]) - 1
    return (x + x * 100 // share) * (100 - share) // (100 + share)


def shingle_sets(lo: int, hi: int, buf: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text."""
    w = scan(buf, at, fold=LOWER)
    first, h = windows(w, k)
    cut = np.searchsorted(first, w.first)
    out = []
    for i in range(hi - lo):
        n = w.first[i + 1] - w.first[i]
        if n >= k:
            out.append(np.unique(h[cut[i]:cut[i + 1]]))
        elif n:
            out.append(np.array([sequence_hash(w.hash[w.span(i)])], dtype=np.uint64))
        else:
            out.append(h[:0])
    return out


def class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = mix(s + U64(0x1234567)).sum(dtype=np.uint64)
    b = mix(s ^ U64(0x7654321FEDCBA987)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(mix(np.array([b + U64(len(s))]))[0].view(np.int64))


def parity(s: np.ndarray, words: int = 4) -> np.ndarray:
    """``64 * words`` parity bits: every element flips one of them."""
    h = mix(s ^ U64(0xA5A5A5A5))
    bits = np.bincount((h % U64(64 * words)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def blocks(s: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity words of ``n`` blocks, and how many elements each has.

    A block's parity bits stand at 2^64 - 1 positions, each with a 64-bit pattern; it is kept as the XOR of the patterns
    of its set positions, which differs whenever the bits differ (up to a chance of 2^-64)."""
    h = mix(s ^ U64(salt))
    block = ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    size = np.bincount(block, minlength=n)
    word = np.zeros(n, dtype=np.uint64)
    full = np.flatnonzero(size)
    word[full] = np.bitwise_xor.reduceat(mix(h)[order], (np.cumsum(size) - size)[full])
    return word, size


def block_keys(s: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(needed, join keys) of up to four families: for each band in which the set may meet a partner of another set, its own
    and the one below, the full blocks, and all blocks if many are thin.  A linking partner shares at least ``needed`` of the
    keys of one family."""
    n = len(s)
    if not n:
        return []
    own = int(np.searchsorted(EDGES, n, side="right")) - 1
    out = []
    for band in (own, own - 1) if own and n <= (int(EDGES[own]) - 1) * 100 // SHARE else (own,):
        d = most_different(band)
        if not d:
            continue                      # only equal sets link, and those are one class already
        spare = 1 + d // 8
        word, size = blocks(s, d + 1 + spare, 1000003 * (band + 1))
        thin = size < 2
        few = int(thin.sum())
        number = np.arange(len(word))
        keys = lambda use, space: mix(word[use] + mix(use.astype(np.uint64) + U64((2 * band + space) << 32)))  # noqa: E731, B023
        out.append((1 + spare - min(few, spare - 1), keys(number[~thin], 0)))
        if few >= spare:
            out.append((1 + spare, keys(number, 1)))
    return out


def sets_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles and the class (c1, c2) of its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, at in slices(batch.column(1)):
                sets = shingle_sets(lo, hi, buf, at)
                c = [class_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([x for x, _ in c], pa.int64()), pa.array([y for _, y in c], pa.int64())],
                    names=["doc_id", "n_shingles", "c1", "c2"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint")


def chosen_sets(docs: DataFrame, flags: np.ndarray, text: str, key: str, make, schema: str) -> DataFrame:
    """Rows that ``make(doc_id, set)`` gives for the documents whose id has its bit in ``flags``."""
    shared = docs.sparkSession.sparkContext.broadcast(flags)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), bit_of(F.col(key).cast("bigint"), KEEP_BITS).alias("bit"), text).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(shared.value, batch.column(1).to_numpy(zero_copy_only=False))))
            for lo, hi, buf, at in slices(batch.column(2)):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                yield make(ids, shingle_sets(lo, hi, buf, at))
            give_back()

    return rows.mapInArrow(run, schema)


def _key_ranges(ids: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """(key, smallest node, largest node) over the given sets."""
    every = _keys(ids, sets, None)
    key, node = every.column(0).to_numpy(), every.column(1).to_numpy()
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(key)) - 1 if len(key) else start
    return pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(node[start]), pa.array(node[end])], names=["key", "lo", "hi"])


def _keys(ids: np.ndarray, sets: list[np.ndarray], wanted: np.ndarray | None) -> pa.RecordBatch:
    owner, need, keys = [], [], []
    for i, s in zip(ids.tolist(), sets):
        for family, (needed, k) in enumerate(block_keys(s)):
            if wanted is not None:
                k = k[has_bit(wanted, (k >> U64(64 - KEY_BITS)).astype(np.int64))]
                if len(k) < needed:
                    continue              # too few blocks are shared with anyone
            owner.append(np.full(len(k), 4 * i + family, dtype=np.int64))
            need.append(np.full(len(k), needed, dtype=np.int32))
            keys.append(k.view(np.int64))
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys) if keys else empty), pa.array(np.concatenate(owner) if owner else empty),
         pa.array(np.concatenate(need) if need else empty.astype(np.int32))], names=["key", "node", "need"])


def candidate_clusters(docs: DataFrame, members: np.ndarray, text: str, key: str) -> DataFrame:
    """(doc_id, cluster) of documents that may link: linking ones are in the same cluster.

    ``node`` is four times the id, plus the family of the keys.  A first pass counts the documents at each key (aggregated
    before the shuffle); the second only sends keys that more than one document has.  Of those a document needs only its
    rarest, all but as many as a partner shares anyway, so passages that many documents have do not chain them."""
    schema = "key bigint, node bigint, need int"
    # the tasks' own ranges are the partial aggregate; a hash table over their mostly single keys would only take memory
    every = chosen_sets(docs, members, text, key, _key_ranges, "key bigint, lo bigint, hi bigint").repartition("key")
    shared = write_table(every.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
                         .select("key", "lo"), "shared-keys")
    top = F.shiftrightunsigned(F.col("key"), 64 - KEY_BITS)
    wanted = docs.sparkSession.sparkContext.broadcast(exact_bitmap(shared.select(top.alias("at")), KEY_BITS))
    again = chosen_sets(docs, members, text, key, lambda i, s: _keys(i, s, wanted.value), schema)
    rows = write_table(again.join(shared, "key"), "shared-blocks")
    size = rows.groupBy("key").agg(F.count("*").alias("size"))
    own = Window.partitionBy("node")
    # of n shared keys a partner shares ``need`` at least, so one of the n - need + 1 rarest
    kept = (rows.join(size, "key").withColumn("n", F.count("*").over(own))
            .withColumn("place", F.row_number().over(own.orderBy("size", "key")))
            .where("place <= n - need + 1").select("key", "node"))
    least = kept.groupBy("key").agg(F.min("node").alias("leader"))
    edges = kept.join(least, "key").select(F.shiftright("node", 2).alias("a"), F.shiftright("leader", 2).alias("b"))
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))


def links_in(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """A forest of links among the sets of a tile, or between its two sides, that connects whatever all links would.

    Sizes and the parity sketches (a lower bound of the symmetric difference) are compared first, then the sets."""
    n = np.array([len(s) for s in sets])
    sketch = np.array([parity(s) for s in sets])
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(where, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(every)))))
    owners, cut = owner[order], np.concatenate(([0], np.cumsum(n)))
    root = np.arange(len(sets))
    out = []
    for i in range(len(sets)):
        others = np.arange(i) if same else np.flatnonzero(sides[:i] != sides[i])
        others = others[root[others] != root[i]]
        if not len(others):
            continue
        far = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
        ok = (far * (100 + SHARE) <= (n[others] + n[i]) * (100 - SHARE)) & (100 * np.minimum(n[others], n[i]) >= SHARE * np.maximum(n[others], n[i]))
        others = others[ok]
        if not len(others):
            continue
        mine = where[cut[i]:cut[i + 1]]
        common = np.bincount(np.concatenate([owners[at[x]:at[x + 1]] for x in mine]), minlength=len(sets))[others]
        for j in others[100 * common >= SHARE * (n[others] + n[i] - common)]:
            if root[j] != root[i]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def verified_links(docs: DataFrame, clusters: DataFrame, sizes: DataFrame, text: str, key: str, tile: int) -> DataFrame:
    """(a, b): links found inside candidate clusters.

    A cluster of more than ``tile`` shingles is split by a hash into parts, and every pair of parts is a group of its
    own, so that a group holds about twice ``tile`` shingles however large its cluster is."""
    sized = clusters.join(sizes, "doc_id")
    total = sized.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / tile).cast("int").alias("parts"))
    place = write_table(sized.join(total, "cluster").select("doc_id", "cluster", "parts", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part")), "tiles")
    flags = bitmap(place, "doc_id", KEEP_BITS)

    def make(ids: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    sets = chosen_sets(docs, flags, text, key, make, "doc_id bigint, shingles binary")
    cells = (sets.join(place, "doc_id")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cluster", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "doc_id", "shingles"))

    def check(table: pa.Table) -> pa.Table:
        # repeated ids with different texts stay apart; their links name the same id
        rows = sorted(set(zip(table["doc_id"].to_pylist(), table["part"].to_pylist(), table["shingles"].to_pylist())))
        found = links_in(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]),
                         [np.frombuffer(r[2], dtype=np.uint64) for r in rows], table["x"][0].as_py() == table["y"][0].as_py())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cells.groupBy("cluster", "x", "y").applyInArrow(check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    table = write_table(sets_table(docs, text, key), "shingle-classes")
    classes = (table.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2")
               .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")))
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"))
    clusters = candidate_clusters(docs, bitmap(sizes, "doc_id", KEEP_BITS), text, key)
    links = verified_links(docs, clusters, sizes, text, key, tile)
    # rows with equal ids but different sets are one node, as a link to an id reaches all of them
    roots = components(links)
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("c1", "c2", F.coalesce("root", "rep").alias("root"))
    return (table.join(named, ["c1", "c2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id")))
