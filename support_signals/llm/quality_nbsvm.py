"""Operator 1: quality classifier, naive Bayes support vectors.

Every whole text becomes a set of hashed n-gram indicators: words and word pairs, and one to four consecutive word
*shapes* (which classes of characters a word holds, how it begins and ends, whether it repeats the word before).  An
indicator is scaled by the log ratio of its smoothed class counts; a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent and interpolated with its mean weight; a sigmoid fitted on out-of-fold margins
turns margins into probabilities of label 1.

Learning takes at most ``fit_rows`` labelled rows (a documented bound; those with the smallest hash of their id among
the rows whose crc32(doc_id) mod 5 is not 0).  Only their indicator numbers reach the driver, and only the weights
(``2**BITS`` floats) are broadcast.  Scoring covers every row in one pass without a shuffle.

Defined results: null and empty texts have the constant indicator alone and get its score; labels that are null or not
0/1 are not used, a document with contradicting labels counts as 0; without labelled rows of both classes the score is
the share of label 1 among the labelled rows, 0.5 without any.  Rows are independent, so repeated rows get equal
results; null ids are not held out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import smallest_hashes
from .words import LOWER, Words, mix, scan, slices

BITS = 18
FIT_ROWS = 8_000
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.uint16)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (1 if "a" <= _c <= "z" or _b >= 0x80 else 2 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9" else 8 if _c in ".,;:'\"()-"
                  else 16 if _c in "!?" else 32 if _c in "#*$%&|<>" else 64)


def shapes(w: Words) -> np.ndarray:
    """A small number per word for its classes of characters, its first and last one and whether it repeats."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    kinds = _CLASS[w.buf]
    blank = np.isin(w.buf, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    kinds[blank] = 0
    shape = np.bitwise_or.reduceat(kinds, w.start).astype(np.uint64)
    shape |= _CLASS[w.buf[w.start]].astype(np.uint64) << np.uint64(8)
    shape |= _CLASS[w.buf[w.end - 1]].astype(np.uint64) << np.uint64(16)
    again = np.zeros(len(shape), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1])
    again[w.first[:-1][w.first[:-1] < len(shape)]] = False
    return shape | (again.astype(np.uint64) << np.uint64(24))


def indicators(lo: int, hi: int, buf: np.ndarray, at: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct indicator numbers per text; the number 2**bits is the constant."""
    w = scan(buf, at, fold=LOWER)
    n = len(w.hash)
    last = np.repeat(w.first[1:], np.diff(w.first))
    shape = mix(shapes(w) + np.uint64(1))
    streams: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(n), mix(w.hash ^ np.uint64(11)))]
    for k, source, salt in ((2, w.hash, 22), (1, shape, 33), (2, shape, 44), (3, shape, 55), (4, shape, 66)):
        if n < k:
            continue
        total = np.full(n - k + 1, salt, dtype=np.uint64)
        for j in range(k):
            total = mix(total * np.uint64(31) + source[j:n - k + 1 + j])
        where = np.flatnonzero(np.arange(n - k + 1) + k <= last[:n - k + 1])
        streams.append((where, total[where]))
    mask = np.uint64((1 << bits) - 1)
    cuts = [np.searchsorted(p, w.first) for p, _ in streams]
    ids = [(h & mask).astype(np.int32) for _, h in streams]
    constant = np.array([1 << bits], dtype=np.int32)
    return [np.concatenate([np.unique(np.concatenate([x[c[i]:c[i + 1]] for x, c in zip(ids, cuts)])), constant]) for i in range(hi - lo)]


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float, passes: int, seed: int = 7) -> np.ndarray:
    """Weights (on scaled indicators) of an L2-regularised hinge-loss model; coordinates in random order per pass."""
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in (scale[r] for r in rows)])
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if square[i] == 0:
                continue
            r = rows[i]
            v = scale[r]          # not kept for all rows: it is twice the indicators in the driver's memory
            slope = y[i] * float(w[r] @ v) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[r] += step * y[i] * v
                moved = max(moved, abs(step))
        if moved < 1e-4 * c:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of P(1) = 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    p, n = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, float(np.log((p + 1) / (n + 1)))
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = q - target, q * (1 - q) + 1e-9
        g = np.array([(d * margin).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray    # float32 per indicator, already scaled
    a: float
    b: float
    constant: float | None = None   # the score of every text if nothing could be learned

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum(dtype=np.float64)) / np.sqrt(len(row))

    def score(self, row: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(row) + self.b, -35, 35))))


def _train(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float, c: float, passes: int, blend: float) -> np.ndarray:
    up, down = np.full(size, smooth), np.full(size, smooth)
    for r, label in zip(rows, y):
        (up if label > 0 else down)[r] += 1
    ratio = np.log(up / (y > 0).sum()) - np.log(down / (y < 0).sum())
    w = dual_descent([r for r in rows], y, ratio, c, passes)
    w = blend * w + (1 - blend) * np.abs(w).mean()
    return (w * ratio).astype(np.float32)


def fit(rows: list[np.ndarray], quality: np.ndarray, bits: int = BITS, smooth: float = 1.0, c: float = 0.01, passes: int = 12,
        blend: float = 0.9, folds: int = 3) -> Model:
    y = np.where(quality > 0, 1.0, -1.0)
    size = (1 << bits) + 1
    if len(y) == 0 or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(0, np.float32), 0.0, 0.0, float((y > 0).mean()) if len(y) else 0.5)
    margin = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    seen = np.zeros(len(y), dtype=bool)
    for f in range(folds):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if (y[train] > 0).all() or (y[train] < 0).all():
            continue
        part = Model(_train([rows[i] for i in train], y[train], size, smooth, c, passes, blend), 1.0, 0.0)
        margin[test] = [part.margin(rows[i]) for i in test]
        seen[test] = True
    weights = _train(rows, y, size, smooth, c, passes, blend)
    if not (y[seen] > 0).any() or not (y[seen] < 0).any():
        whole = Model(weights, 1.0, 0.0)
        margin, seen = np.array([whole.margin(r) for r in rows]), np.ones(len(y), dtype=bool)
    a, b = sigmoid_fit(margin[seen], y[seen])
    return Model(weights, a, b)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of the learning rows; the ids (at most ``fit_rows``) are broadcast, the texts stay put.  Equal rows of
    an id count once and are dropped before they leave Spark; at most ``fit_rows`` rows, by hash of the id, reach the driver, so
    an id with many different texts does not either."""
    chosen = smallest_hashes(labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
                             .groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", fit_rows)
    joined = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, at in slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo).cast(pa.int32()),
                     pa.array([r.tobytes() for r in indicators(lo, hi, buf, at, bits)], pa.binary())],
                    names=["doc_id", "quality", "row"])

    rows = joined.mapInArrow(run, "doc_id bigint, quality int, row binary").dropDuplicates(["doc_id", "row"])
    table = rows.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id", "row").limit(fit_rows).toArrow()
    return fit_table(table)


def fit_table(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of distinct rows (doc_id, quality, row) by hash of the id, id and row; the indicators are views of the
    table's own memory."""
    views: list[np.ndarray] = []
    for chunk in table.column("row").cast(pa.binary()).chunks:
        _, at, data = chunk.buffers()
        at = np.frombuffer(at, np.int32)[chunk.offset:chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        views += [data[a:z].view(np.int32) for a, z in zip(at[:-1], at[1:])]
    ids, quality = table.column("doc_id").to_pylist(), table.column("quality").to_pylist()
    often = Counter(ids)
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], views[i].tobytes() if often[ids[i]] > 1 else b""))
    return [views[i] for i in order], np.array([quality[i] for i in order])


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, text: str = "text",
                   keep: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """Per row: doc_id, ``keep``, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, fit_rows, text, bits), bits=bits))
    chosen = docs.select("doc_id", *keep, held_out().alias("held_out"), F.col(text))
    fixed = [*range(len(keep) + 2)]
    names = [chosen.columns[i] for i in fixed]
    schema = ", ".join(f"`{n}` {chosen.schema[i].dataType.simpleString()}" for i, n in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            for lo, hi, buf, at in slices(batch.column(len(fixed))):
                s = [score(r) for r in indicators(lo, hi, buf, at, bits)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in fixed] + [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())],
                    names=[*names, "score", "predicted"])

    return chosen.mapInArrow(run, schema + ", score double, predicted int")
