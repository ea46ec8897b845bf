"""Operator 13: suffix-array dedup by merged Burrows-Wheeler transforms.

A byte is removed if it is covered by a string of 100 bytes that also starts earlier: in a document with a smaller id, or
earlier in the same document.  Strings are judged on the input, overlaps count, and no string crosses documents.

**Pieces.**  Every window of 100 bytes stands under its *minimizer*, the 32-byte gram of the smallest hash inside it, so equal
windows have equal minimizers and meet wherever they are.  A run of windows under one minimizer is a *piece*.  Minimizers
that occur once in the corpus are left out (counted with aggregation before the shuffle); nothing under them repeats.

**One text per content.**  Equal pieces are one string with many starts: the first of them is its *head* (a minimum that
is aggregated before the shuffle), all bytes of the others are removed.  So a passage that a third of all documents hold is
one string to the order below.  Fixed-size bitmaps tell in the second pass over the texts which pieces may be heads; those
are aggregated once more by content, so a full bitmap costs shuffle, not rows.

**Merged order.**  The heads under minimizers that have several contents, or that repeat inside a piece, go to groups of
about ``GROUP_BYTES`` by minimizer.  A group cuts them into shards, each with its own Burrows-Wheeler transform, and merges
these by interleave refinement (``bwt_merge``).  Repeated intervals of depth 100 give the windows with an earlier start.
Where one key alone has more bytes of different heads than a group (many contexts around one passage), its heads are cut by
the minimizer's place in the window into pieces of a few windows, which meet on the bytes all those windows are sure to
have, and are told by content again: of ``WIDTHS`` windows first, and of two where a key still has too many.  Pieces of two
windows that meet differ in their first and last byte only, so there are never more than 65,536 of a key, however large the
input.

Defined results: null or short texts lose nothing; rows with a null id neither lose bytes nor count as earlier; rows with
equal ids and different texts are one document, whose texts follow each other by the xxhash64 of id and text; repeated rows
are one document and have equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .bwt_merge import WINDOW, merged_intervals
from .components import bit_of, bitmap, exact_bitmap, has_bit
from .words import SLICE_BYTES, U64, give_back, mix, powers, slices

#: Long enough that unrelated prose seldom shares a gram by chance, so that candidates grow in proportion to the input.
GRAM = 32
BITS = 25
DOC_BITS = 23
GROUP_BYTES = 1 << 20
#: Windows of the pieces into which the heads of a crowded key are cut.
WIDTHS = (16, 2)
NAMES = ["key", "h", "doc_id", "row", "at", "size", "bytes"]
PIECES = "key bigint, h bigint, doc_id bigint, row bigint, at bigint, size int, bytes binary"
#: Windows of a piece at most (only periodic text has more under one minimizer in a row).
LONGEST = 4096
_BYTE = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PART = np.random.default_rng(20240614).integers(1, 2**63, GRAM // 8, dtype=np.uint64) * U64(2) + U64(1)


@dataclass
class Pieces:
    """Runs of windows under one minimizer in a stretch of texts; arrays are parallel per piece."""

    buf: np.ndarray
    doc: np.ndarray        # row of the batch
    at: np.ndarray         # first byte in ``buf``
    base: np.ndarray       # first byte in the text
    windows: np.ndarray
    least: np.ndarray      # the minimizer
    key: np.ndarray        # the same, mixed again: smallest hashes are small numbers, and bitmaps want even ones
    again: np.ndarray      # the piece may hold a window twice
    gram: np.ndarray       # hash of the gram at each byte of ``buf``

    def hashes(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each stretch of ``buf``."""
        n = len(self.buf)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.buf] * up[:n], out=total[1:])
        return mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))


def stretches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets of its texts, place in the text) of runs of whole texts, or of parts of a long one that
    overlap so that each window is in one of them."""
    for lo, hi, buf, at in slices(column):
        if hi - lo == 1 and len(buf) > 2 * SLICE_BYTES:
            for a in range(0, len(buf) - WINDOW + 1, SLICE_BYTES):
                part = buf[a:a + SLICE_BYTES + WINDOW - 1]
                yield lo, part, np.array([0, len(part)]), a
        elif len(buf) >= WINDOW:
            yield lo, buf, at, 0


def pieces_of(lo: int, buf: np.ndarray, at: np.ndarray, place: int) -> Pieces:
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(GRAM, np.uint8)]).tobytes()
    eight = np.ndarray((n + GRAM - 8,), dtype="<u8", buffer=padded, strides=(1,))
    gram = eight[:n] * _PART[0]
    for k in range(1, GRAM // 8):
        gram ^= eight[8 * k:8 * k + n] * _PART[k]
    gram = mix(gram)
    width = WINDOW - GRAM + 1
    best, span = gram, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    rest = width - span
    best = np.minimum(best[:len(best) - rest], best[rest:]) if rest else best
    # best[i] is the minimizer of the window at i; windows over the end of a text do not count
    last = np.repeat(at[1:], np.diff(at))[:len(best)]
    ok = np.arange(len(best)) + WINDOW <= last
    new = ok.copy()
    new[1:] &= (best[1:] != best[:-1]) | ~ok[:-1] | (last[1:] != last[:-1])
    start = np.flatnonzero(new)
    stop = ok.copy()
    stop[:-1] &= (best[1:] != best[:-1]) | ~ok[1:] | (last[1:] != last[:-1])
    count = np.flatnonzero(stop) + 1 - start
    if len(count) and count.max() > LONGEST:
        parts = -(-count // LONGEST)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + k * LONGEST, np.minimum(np.repeat(count, parts) - k * LONGEST, LONGEST)
    # a window can be there twice only if one starts with the minimizer and another follows it
    hits = np.concatenate(([0], np.cumsum(ok & (gram[:len(best)] == best))))
    doc = np.searchsorted(at, start, side="right") - 1
    return Pieces(buf, doc + lo, start, start - at[doc] + place, count, best[start], mix(best[start]),
                  hits[start + count - 1] > hits[start], gram)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, row, text); ``row`` names a document's text, and orders the texts of an id."""
    id_ = F.col(key).cast("bigint")
    return docs.select(id_.alias("doc_id"), F.xxhash64(id_, F.col(text)).alias("row"), F.col(text).alias("text"))


def minimizer_counts(rows: DataFrame) -> DataFrame:
    """(key, n) of the minimizers with more than one place; tasks count their own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stretches(batch.column(0)):
                p = pieces_of(*part)
                key, inverse = np.unique(p.key, return_inverse=True)
                n = np.bincount(inverse, weights=1.0 + p.again, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["key", "n"])
        give_back()

    return rows.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "key bigint, n tinyint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def top_bits(column: str) -> F.Column:
    return F.shiftrightunsigned(F.col(column), 64 - BITS)


def shared_pieces(rows: DataFrame, shared: np.ndarray) -> DataFrame:
    """(key, h, doc_id, row, at, size, again) of the pieces whose minimizer has its bit set."""
    flags = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in stretches(batch.column(2)):
                p = pieces_of(*part)
                k = np.flatnonzero(has_bit(flags.value, (p.key >> U64(64 - BITS)).astype(np.int64)))
                size = p.windows[k] + WINDOW - 1
                h = p.hashes(p.at[k], p.at[k] + size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.key[k].view(np.int64)), pa.array(h.view(np.int64)), pa.array(ids[p.doc[k]]), pa.array(names[p.doc[k]]),
                     pa.array(p.base[k].astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(p.again[k])],
                    names=["key", "h", "doc_id", "row", "at", "size", "again"])
        give_back()

    return rows.where("doc_id IS NOT NULL").mapInArrow(run, "key bigint, h bigint, doc_id bigint, row bigint, at bigint, size int, again boolean")


def head_bits() -> F.Column:
    """The top bits of what names a start: content, text and place."""
    return F.shiftrightunsigned(F.col("h").bitwiseXOR(F.col("row")).bitwiseXOR(F.shiftleft(F.col("at"), 64 - BITS)), 64 - BITS)


def narrower(heads: DataFrame, width: int) -> DataFrame:
    """The windows of heads (doc_id, row, at, bytes) anew, as pieces of at most ``width`` windows whose minimizer stands in
    about the same place; their key is the hash of the bytes that all such windows have."""
    sure = WINDOW - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for part in stretches(batch.column(3)):
                p = pieces_of(*part)
                owner, first, size, common = [], [], [], []
                for j in range(len(p.at)):
                    a, n = int(p.at[j]), int(p.windows[j])
                    places = a + np.flatnonzero(p.gram[a:a + n + WINDOW - GRAM] == p.least[j])
                    start = a + np.arange(n)
                    off = places[np.searchsorted(places, start)] - start          # to the leftmost minimizer of each window
                    new = np.ones(n, dtype=bool)
                    new[1:] = (off[1:] // width != off[:-1] // width) | (off[1:] >= off[:-1])
                    s = np.flatnonzero(new)
                    owner.append(np.full(len(s), j))
                    first.append(start[s])
                    size.append(np.diff(np.append(s, n)) + WINDOW - 1)
                    common.append(start[s] + off[s] - off[s] // width * width)
                owner, first, size, common = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (owner, first, size, common))
                full, doc = p.buf.tobytes(), p.doc[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.hashes(common, common + sure).view(np.int64)), pa.array(p.hashes(first, first + size).view(np.int64)),
                     pa.array(ids[doc]), pa.array(names[doc]), pa.array(base[doc] + p.base[owner] + first - p.at[owner]), pa.array(size.astype(np.int32)),
                     pa.array([full[x:x + y] for x, y in zip(first.tolist(), size.tolist())], pa.binary())], names=NAMES)

    return heads.select("head.doc_id", "head.row", "head.at", "bytes").mapInArrow(run, PIECES)


def decided(rows: DataFrame, shared: np.ndarray, heads: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """The second pass: spans of pieces that are no heads (``key`` null), and the pieces that may be heads, with their bytes
    where their minimizer has several contents."""
    flags = rows.sparkSession.sparkContext.broadcast((shared, heads, mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, heads, mixed = flags.value
        for batch in batches:
            ids, names = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in stretches(batch.column(2)):
                p = pieces_of(*part)
                top = (p.key >> U64(64 - BITS)).astype(np.int64)
                k = np.flatnonzero(has_bit(shared, top))
                size, top = p.windows[k] + WINDOW - 1, top[k]
                h = p.hashes(p.at[k], p.at[k] + size)
                name = h ^ names[p.doc[k]].view(np.uint64) ^ (p.base[k].astype(np.uint64) << U64(64 - BITS))
                maybe = has_bit(heads, (name >> U64(64 - BITS)).astype(np.int64))
                # neighbouring pieces that go are one span
                gone = k[~maybe]
                a, z, d = p.base[gone], p.base[gone] + size[~maybe], p.doc[gone]
                new = np.ones(len(gone), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (a[1:] > z[:-1])
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(gone))[:len(s)] - 1
                n = len(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(ids[d[s]]), pa.array(names[d[s]]), pa.array(a[s].astype(np.int64)),
                     pa.array((z[e] - a[s]).astype(np.int32)), pa.nulls(n, pa.binary())], names=NAMES)
                full = p.buf.tobytes()
                j, i = k[maybe], np.flatnonzero(maybe)
                with_bytes = has_bit(mixed, top[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.key[j].view(np.int64)), pa.array(h[i].view(np.int64)), pa.array(ids[p.doc[j]]), pa.array(names[p.doc[j]]),
                     pa.array(p.base[j].astype(np.int64)), pa.array(size[i].astype(np.int32)),
                     pa.array([full[x:x + y] if b else None for x, y, b in zip(p.at[j].tolist(), size[i].tolist(), with_bytes.tolist())], pa.binary())],
                    names=NAMES)
        give_back()

    return rows.where("doc_id IS NOT NULL").mapInArrow(run, PIECES)


def earlier_spans(table: pa.Table) -> pa.Table:
    """(doc_id, row, start, stop) of what the merged order of a group's heads removes."""
    pieces = table["bytes"].to_pylist()
    lengths = np.array([len(b) for b in pieces], dtype=np.int64)
    doc, row, at = (table[c].to_numpy() for c in ("doc_id", "row", "at"))
    position, interval = merged_intervals(np.frombuffer(b"".join(pieces), dtype=np.uint8), lengths)
    begin = np.cumsum(lengths) - lengths
    piece = np.searchsorted(begin, position, side="right") - 1
    start = at[piece] + position - begin[piece]
    order = np.lexsort((start, row[piece], doc[piece], interval))
    later = np.zeros(len(order), dtype=bool)
    later[order[1:]] = interval[order[1:]] == interval[order[:-1]]       # all but the first start of an interval
    position = np.sort(position[later])
    piece = np.searchsorted(begin, position, side="right") - 1
    new = np.ones(len(position), dtype=bool)
    new[1:] = (np.diff(position) > 1) | (piece[1:] != piece[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(position))[:len(s)] - 1
    own = piece[s]
    first = at[own] + position[s] - begin[own]
    give_back()
    return pa.table({"doc_id": pa.array(doc[own]), "row": pa.array(row[own]), "start": pa.array(first),
                     "stop": pa.array(first + position[e] - position[s] + WINDOW)})


SPANS = "doc_id bigint, row bigint, start bigint, stop bigint"


def told_by_content(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, spans of the other pieces): the first piece of a content is its head."""
    heads = write_table(pieces.groupBy("key", "h", "size").agg(head_struct(), F.count("*").alias("n"), F.any_value("bytes").alias("bytes")), "heads")
    other = (F.col("doc_id") != F.col("head.doc_id")) | (F.col("row") != F.col("head.row")) | (F.col("at") != F.col("head.at"))
    rest = (pieces.select("key", "h", "size", "doc_id", "row", "at")
            .join(heads.where("n > 1").select("key", "h", "size", "head"), ["key", "h", "size"]).where(other))
    return heads, span(rest)


def span(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "row", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"))


def head_struct() -> F.Column:
    return F.min(F.struct("doc_id", "row", "at")).alias("head")


def removed_spans(rows: DataFrame, group: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, row, start, stop): stretches of bytes to remove; they may overlap."""
    counted = minimizer_counts(rows)
    shared = exact_bitmap(counted.select(top_bits("key").alias("at")), BITS)
    contents = write_table(shared_pieces(rows, shared).groupBy("key", "h", "size").agg(head_struct(), F.max("again").alias("again")), "piece-contents")
    keys = write_table(contents.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("again").alias("again"))
                       .where("n > 1 OR again"), "mixed-minimizers")
    heads = exact_bitmap(contents.select("h", "head.*").select(head_bits().alias("at")), BITS)
    mixed = exact_bitmap(keys.select(top_bits("key").alias("at")), BITS)
    table = write_table(decided(rows, shared, heads, mixed), "pieces")
    own, found = told_by_content(table.where("key IS NOT NULL"))
    found = span(table.where("key IS NULL")).unionByName(found)
    whole = own.where("bytes IS NOT NULL")
    ready = []
    for width in WIDTHS:
        crowded = write_table(whole.groupBy("key").agg(F.sum("size").alias("all")).where(F.col("all") > group).select("key"), "crowded-keys")
        if crowded.isEmpty():
            break
        ready.append(whole.join(crowded, "key", "left_anti"))
        cut = write_table(narrower(whole.join(crowded, "key", "left_semi"), width), "narrow-pieces")
        whole, rest = told_by_content(cut)
        found = found.unionByName(rest)
    for other in ready:
        whole = whole.unionByName(other.select(whole.columns))
    groups = max(1, -(-(whole.agg(F.sum("size")).first()[0] or 0) // group))
    merged = (whole.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("part"), "head.*", "bytes")
              .groupBy("part").applyInArrow(earlier_spans, SPANS))
    return found.unionByName(merged)


def kept_text(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, the rest)."""
    if not len(starts):
        return 0, 0, text
    order = np.argsort(starts, kind="stable")
    a, z = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], a[1:] > z[:-1]))
    first = a[new]
    last = z[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
    kept, at = [], 0
    for x, y in zip(first.tolist(), last.tolist()):
        kept.append(text[at:x])
        at = y
    kept.append(text[at:])
    return int((last - first).sum()), len(first), b"".join(kept)


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", group: int = GROUP_BYTES, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also the text that is left (bytes, as a
    cut can fall inside a character)."""
    rows = _rows(docs, text, key)
    spans = write_table(removed_spans(rows, group), "removed-spans")
    flags = docs.sparkSession.sparkContext.broadcast(bitmap(spans, "doc_id", DOC_BITS))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")

    def result(ids: pa.Array, values: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        numbers = [pa.array([v[i] for v in values], pa.int64()) for i in range(3)]
        kept = [pa.array([v[3] for v in values], pa.binary())] if with_text else []
        return pa.RecordBatch.from_arrays([ids, *numbers, pa.array([hashlib.sha256(v[3]).hexdigest() for v in values]), *kept],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result(batch.column(0), [(len(t or b""), 0, 0, t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, starts, stops in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                t = t or b""
                out.append((len(t), *kept_text(t, np.array(starts or [], np.int64), np.array(stops or [], np.int64))))
            yield result(batch.column(0), out)

    def flagged(want: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                keep = pa.array((has_bit(flags.value, batch.column(3).to_numpy(zero_copy_only=False)) & known) == want)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:3]], names=["doc_id", "row", "text"])

        return rows.withColumn("bit", F.coalesce(bit_of(F.col("doc_id"), DOC_BITS), F.lit(0))).mapInArrow(run, "doc_id bigint, row bigint, text string")

    lists = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("s"))
    touched = (flagged(True).join(lists, ["doc_id", "row"], "left").select("doc_id", "text", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))
               .mapInArrow(cut, schema))
    return touched.unionByName(flagged(False).select("doc_id", "text").mapInArrow(untouched, schema))
