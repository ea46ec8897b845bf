"""Pair generation: the trailing-window range self-join and block products.

Trailing-window join
--------------------
The trend rule compares each trigger with the tickets of the same key
(category, or topic for evaluation) created in ``[t - window, t)``.  A plain
equi-join on the key alone is quadratic per key and skewed (a handful of
categories).  Instead both sides get a time bucket of ``bucket_hours``:

* a candidate lives in exactly one bucket ``floor(epoch / width)``;
* a trigger is replicated to every bucket its window touches
  (``window / width + 1`` replicas), so every pair is produced exactly once;
* the join key is ``(key, bucket, salt_c, salt_t)``; the exact half-open test is a
  residual predicate of the join; the score is computed only for pairs that
  pass it.

Hot groups are split on both sides.  Per (key, bucket) the candidate count
``n_c`` and the count ``n_t`` of triggers reaching the bucket give
``s_c = ceil(n_c / target)`` and ``s_t = ceil(n_t / target)``.  A candidate
takes salt_c by hash and is replicated to every salt_t; a trigger takes
salt_t by hash and is replicated to every salt_c; the join key is
(key, bucket, salt_c, salt_t).  A join group then holds about ``target``
rows of each side, so per-task work is bounded by ~target^2 however hot the
category-day is, while cold buckets keep (1, 1) and are not replicated.
The split counts are computed in the plan, for every group that needs one,
and joined like any other table (AQE broadcasts them when they are small).

Scoring: pairs that must reach a score are found by multiplying the two sides
of a salted group tile by tile; the products only preselect, with a margin,
and each preselected pair gets the score that ``functions.vectors.dot``
defines (a sum from left to right), so a listed score, a score at the cut and
a score in a plain join are the same number.  Where only their number is
wanted (``window_counts``), pairs are folded into counts inside the task: a
burst of near-equal tickets, in which every pair matches, leaves one row per
trigger and group.  Listed pairs leave the task in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.functions.vectors import bucket_of, dot, epoch_micros, epoch_seconds
from support_signals.operators.blocks import _rough

# Far above the rounding error of a product of unit vectors, far below any score step.
MARGIN = 1e-6
# Pairs that leave a task in one batch.
PAIRS_OUT = 1 << 18


def group_splits(cand: DataFrame, trig: DataFrame | None, keys: Sequence[str], cfg: TrendConfig, span: int) -> DataFrame:
    """(key, bucket, s_c, s_t) of every candidate bucket that is split.

    ``s_c`` splits the candidates of the bucket, ``s_t`` splits the triggers
    that reach it (those of buckets b .. b + span, a range-frame sum over the
    small per-bucket count table), so a join group holds about
    ``target_rows_per_group`` rows of each side.  ``trig=None``: the
    triggers are the candidates themselves (one aggregate serves both).
    """
    c = cand.groupBy(*keys, "bkt").agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(*keys).orderBy("bkt").rangeBetween(0, span)   # rows per key = buckets, not data
    if trig is None:
        st = c.withColumn("n_t", F.sum("n_c").over(w))
    else:
        t = trig.groupBy(*keys, F.col("t_bkt").alias("bkt")).agg(F.count(F.lit(1)).alias("n_own"))
        st = (c.join(t, [*keys, "bkt"], "full")
              .withColumn("n_t", F.sum(F.coalesce("n_own", F.lit(0))).over(w))
              .where(F.col("n_c").isNotNull()))

    def split(n):
        return F.greatest(F.lit(1), F.ceil(n / F.lit(cfg.target_rows_per_group))).cast("int")

    return (st.select(*keys, "bkt", split(F.col("n_c")).alias("s_c"), split(F.col("n_t")).alias("s_t"))
            .where((F.col("s_c") > 1) | (F.col("s_t") > 1)))


def window_pairs(
    triggers: DataFrame,
    candidates: DataFrame,
    cfg: TrendConfig,
    keys: Sequence[str] = ("category",),
    trigger_cols: Sequence[str] = (),
    candidate_cols: Sequence[str] = (),
    with_score: bool = True,
    closed_end: bool = False,
    min_score: float | None = None,
) -> DataFrame:
    """Pairs (t_id, c_id[, score]) with equal ``keys`` and
    ``t.created_at - window <= c.created_at < t.created_at`` (``<=`` when
    ``closed_end``), excluding the trigger itself.

    Both inputs need ``id``, ``created_at``, ``embedding`` and ``keys``.
    Extra columns are carried through prefixed ``t_`` / ``c_``.  With
    ``min_score`` only pairs scoring at least that much are returned, and the
    others never leave the task that compares them.  Rows with a null key or
    time are in no window.
    """
    keys = list(keys)
    trig, cand, cond = salted_sides(triggers, candidates, cfg, keys, trigger_cols, candidate_cols)
    upper = (F.col("c_ts") <= F.col("t_ts")) if closed_end else (F.col("c_ts") < F.col("t_ts"))
    if with_score and min_score is not None:
        return block_matches(trig, cand, cond, keys, cfg, closed_end, min_score, trigger_cols, candidate_cols)
    out = [*keys, "t_id", "t_ts", "c_id", "c_ts",
           *[f"t_{c}" for c in trigger_cols], *[f"c_{c}" for c in candidate_cols]]

    def joined(t: DataFrame, c: DataFrame) -> DataFrame:
        return t.join(c, cond).where((F.col("c_ts") >= F.col("t_ts") - F.make_dt_interval(F.lit(cfg.window_days)))
                                     & upper & (F.col("c_id") != F.col("t_id")))

    if not with_score:
        return joined(trig, cand).select(*out)
    # the scores of vectors without a gap are computed tile by tile; pairs with another vector have a null score
    dims = candidates.select(F.max(F.size("embedding"))).scalar()

    def whole(p: str) -> F.Column:
        v = F.col(f"{p}_vec")
        return F.coalesce((F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))

    t, c = whole("t"), whole("c")
    tiled = block_matches(trig.where(t), cand.where(c), cond, keys, cfg, closed_end, None, trigger_cols, candidate_cols)
    score = dot("t_vec", "c_vec").alias("score")
    return (tiled.select(*out, "score").unionByName(joined(trig.where(~t), cand).select(*out, score))
            .unionByName(joined(trig.where(t), cand.where(~c)).select(*out, score)))


def salted_sides(triggers: DataFrame, candidates: DataFrame, cfg: TrendConfig, keys: list[str],
                 trigger_cols: Sequence[str] = (), candidate_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """(triggers, candidates, join key): both sides bucketed, salted and replicated, so that each pair meets in one group."""
    w, width = cfg.window_seconds, cfg.bucket_seconds
    cand = candidates.select(
        *keys, F.col("id").alias("c_id"), F.col("created_at").alias("c_ts"),
        F.col("embedding").alias("c_vec"), *[F.col(c).alias(f"c_{c}") for c in candidate_cols],
    ).withColumn("bkt", bucket_of("c_ts", width))
    t_sec = epoch_seconds("t_ts")
    trig = triggers.select(
        *keys, F.col("id").alias("t_id"), F.col("created_at").alias("t_ts"),
        F.col("embedding").alias("t_vec"), *[F.col(c).alias(f"t_{c}") for c in trigger_cols],
    ).withColumn("t_bkt", F.floor(t_sec / F.lit(width)).cast("bigint"))
    span = -(-w // width)                                # buckets a window reaches back
    same = triggers is candidates
    hot = group_splits(cand.select(*keys, "bkt"), None if same else trig.select(*keys, "t_bkt"), keys, cfg, span)
    s_c, s_t = F.coalesce(F.col("s_c"), F.lit(1)), F.coalesce(F.col("s_t"), F.lit(1))
    # candidates: one candidate salt by hash, replicated to every trigger salt
    cand = (cand.join(hot, [*keys, "bkt"], "left")
            .withColumn("salt_c", F.pmod(F.xxhash64("c_id"), s_c).cast("int"))
            .withColumn("salt_t", F.explode(F.sequence(F.lit(0), s_t - 1)))
            .drop("s_c", "s_t"))
    # triggers: every bucket their window touches; one trigger salt by hash,
    # replicated to every candidate salt of that bucket
    trig = (trig.withColumn("bkt", F.explode(F.sequence(
        F.floor((t_sec - F.lit(w)) / F.lit(width)).cast("bigint"), F.col("t_bkt"))))
        .join(hot, [*keys, "bkt"], "left")
        .withColumn("salt_t", F.pmod(F.xxhash64("t_id"), s_t).cast("int"))
        .withColumn("salt_c", F.explode(F.sequence(F.lit(0), s_c - 1)))
        .drop("s_c", "s_t", "t_bkt"))
    return trig, cand, [*keys, "bkt", "salt_c", "salt_t"]


def tiles(tv: np.ndarray, cv: np.ndarray, in_window, tile: int, row_tile: int | None = None) -> Iterator[tuple[slice, slice, np.ndarray, float]]:
    """(trigger rows, candidate rows, products, margin) of the tiles of two vector blocks.

    Products are in single precision and within ``margin`` of the score; minus infinity where ``in_window(rows, columns)``,
    a mask or one boolean for the whole tile, is false.  A tile is good until the next one is asked for."""
    t, c, err = _rough(tv, cv)
    row_tile = row_tile or tile
    room = np.empty(min(row_tile, len(t)) * min(tile, len(c)), t.dtype)
    for a in range(0, len(t), row_tile):
        rows = slice(a, min(a + row_tile, len(t)))
        margin = MARGIN + float(err[rows][np.isfinite(err[rows])].max(initial=0.0))
        for b in range(0, len(c), tile):
            cols = slice(b, min(b + tile, len(c)))
            inside = in_window(rows, cols)
            if inside is False:
                continue
            s = np.matmul(t[rows], c[cols].T, out=room[:(rows.stop - a) * (cols.stop - b)].reshape(rows.stop - a, cols.stop - b))
            if inside is not True:
                s[~inside] = -np.inf
            yield rows, cols, s, margin


def _pairs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.flatnonzero(hit.any(axis=1))
    r, c = np.divmod(np.flatnonzero(hit[some]), hit.shape[1])
    return some[r], c


def exact_scores(tv: np.ndarray, cv: np.ndarray) -> np.ndarray:
    """Scores of paired rows, left to right as ``functions.vectors.dot``."""
    score = np.zeros(len(tv))
    for k in range(tv.shape[1]):
        score += tv[:, k] * cv[:, k]
    return score


# Pairs whose vectors are multiplied at once: their products stay in the processor's cache.
SUMMED_AT_ONCE = 1024


def paired_scores(tv: np.ndarray, cv: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact_scores`` of the rows ``i`` of one side and ``j`` of the other, a few pairs at a time."""
    score = np.zeros(len(i))
    for lo in range(0, len(i), SUMMED_AT_ONCE):
        part = slice(lo, lo + SUMMED_AT_ONCE)
        for x in np.ascontiguousarray((tv[i[part]] * cv[j[part]]).T):
            score[part] += x
    return score


def matches_by_tile(tv: np.ndarray, cv: np.ndarray, in_window, min_score: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(trigger row, candidate row, score) of the pairs that reach ``min_score``, at most ``PAIRS_OUT`` at a time.

    ``in_window`` as in ``tiles``.  One tile of ``tile`` x ``tile`` products and its pairs are held."""
    for rows, cols, s, margin in tiles(tv, cv, in_window, tile):
        r, c = _pairs_of(s >= s.dtype.type(min_score - margin))
        for lo in range(0, len(r), PAIRS_OUT):
            i, j = rows.start + r[lo:lo + PAIRS_OUT], cols.start + c[lo:lo + PAIRS_OUT]
            score = paired_scores(tv, cv, i, j)
            ok = score >= min_score
            yield i[ok], j[ok], score[ok]


# Side of a tile of scores of which each one is listed: it stays in the processor's cache.
SCORE_TILE = 256


def scores_by_tile(tv: np.ndarray, cv: np.ndarray, in_window) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(trigger row, candidate row, score) of all pairs in the window, the scores summed as in ``exact_scores``."""
    t, c = np.ascontiguousarray(tv.T), np.ascontiguousarray(cv.T)
    for a in range(0, len(tv), SCORE_TILE):
        rows = slice(a, min(a + SCORE_TILE, len(tv)))
        for b in range(0, len(cv), SCORE_TILE):
            cols = slice(b, min(b + SCORE_TILE, len(cv)))
            inside = in_window(rows, cols)
            if inside is False:
                continue
            s = np.zeros((rows.stop - a, cols.stop - b))
            part = np.empty_like(s)
            for x, y in zip(t[:, rows], c[:, cols]):
                s += np.multiply(x[:, None], y[None, :], out=part)
            i, j = np.nonzero(np.ones(s.shape, bool) if inside is True else inside)
            yield a + i, b + j, s[i, j]


def tile_matches(tv: np.ndarray, cv: np.ndarray, in_window, min_score: float, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of ``matches_by_tile`` at once."""
    found = list(matches_by_tile(tv, cv, in_window, min_score, tile))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def tile_hits(tv: np.ndarray, cv: np.ndarray, in_window, min_score: float, tile: int,
              row_tile: int | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(trigger rows, candidate rows, matrix of the matches) tile by tile, all tiles of some rows after each other.

    Products within the margin are settled by the exact score, so the matches are those of ``matches_by_tile``."""
    for rows, cols, s, margin in tiles(tv, cv, in_window, tile, row_tile):
        hit = s >= s.dtype.type(min_score + margin)
        r, c = _pairs_of((s >= s.dtype.type(min_score - margin)) ^ hit)
        for lo in range(0, len(r), PAIRS_OUT):
            i, j = r[lo:lo + PAIRS_OUT], c[lo:lo + PAIRS_OUT]
            hit[i, j] = paired_scores(tv, cv, rows.start + i, cols.start + j) >= min_score
        yield rows, cols, hit


def tile_counts(tv: np.ndarray, cv: np.ndarray, in_window, cuts: Sequence[float], tile: int) -> np.ndarray:
    """Per trigger row and cut, how many candidates in the window score at least the cut.

    Memory is that of one tile, whatever the number of pairs.  Products within the margin of a cut are settled by the exact
    score, so the counts are those of the listed pairs."""
    out = np.zeros((len(tv), len(cuts)), dtype=np.int64)
    for rows, cols, s, margin in tiles(tv, cv, in_window, tile):
        for k, cut in enumerate(cuts):
            sure = s >= s.dtype.type(cut + margin)
            n = np.bitwise_count(np.packbits(sure, axis=1)).sum(axis=1, dtype=np.int64)
            out[rows, k] += n
            maybe = s >= s.dtype.type(cut - margin)
            if np.count_nonzero(maybe) == n.sum():
                continue
            r, c = _pairs_of(maybe ^ sure)
            for lo in range(0, len(r), PAIRS_OUT):
                i, j = r[lo:lo + PAIRS_OUT], c[lo:lo + PAIRS_OUT]
                ok = paired_scores(tv, cv, rows.start + i, cols.start + j) >= cut
                out[rows, k] += np.bincount(i[ok], minlength=s.shape[0])
    return out


class _Group:
    """Both sides of one salted group, from its Arrow batches."""

    def __init__(self, batches: Iterator[pa.RecordBatch], w_us: int, closed_end: bool):
        table = pa.Table.from_batches(list(batches))
        side = table["t_side"].to_numpy()
        # in order of time most tiles lie wholly inside or outside the window
        self.trig, self.cand = (table.filter(pa.array(side == x)).sort_by([("us", "ascending"), (i, "ascending")]).combine_chunks()
                                for x, i in ((True, "t_id"), (False, "c_id")))
        self.tv, self.cv = _matrix(self.trig["vec"]), _matrix(self.cand["vec"])
        tu, cu = self.trig["us"].to_numpy(), self.cand["us"].to_numpy()
        code, _ = pd.factorize(np.concatenate([self.trig["t_id"].to_numpy(), self.cand["c_id"].to_numpy()]))
        self.tu, self.cu, self.ti, self.ci, self.w_us, self.closed_end = tu, cu, code[:len(tu)], code[len(tu):], w_us, closed_end

    def in_window(self, rows: slice | np.ndarray, cols: slice | np.ndarray) -> np.ndarray | bool:
        """Which candidates are in the window of which triggers and are not the trigger itself; one boolean where all are alike."""
        t, c, ti, ci, w_us = self.tu[rows], self.cu[cols], self.ti[rows], self.ci[cols], self.w_us
        t0, t1, c0, c1 = t.min(), t.max(), c.min(), c.max()
        if c1 < t0 - w_us or (c0 > t1 if self.closed_end else c0 >= t1):
            return False
        if c0 >= t1 - w_us and (c1 <= t0 if self.closed_end else c1 < t0) and not np.isin(ti, ci).any():
            return True
        t, c = t[:, None], c[None, :]
        return (c >= t - w_us) & ((c <= t) if self.closed_end else (c < t)) & (ti[:, None] != ci[None, :])

    def __bool__(self) -> bool:
        return len(self.tv) > 0 and len(self.cv) > 0


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _both_sides(trig: DataFrame, cand: DataFrame, cond: list[str], t_extra: list[str], c_extra: list[str]) -> DataFrame:
    """Triggers and candidates as one table: a group by ``cond`` has the two sides of a join group.  Rows with a null key,
    time or vector are in no window."""
    def side(df: DataFrame, p: str, extra: list[str], is_trigger: bool) -> DataFrame:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*cond, f"{p}_ts", f"{p}_vec")])
        return df.where(known).select(
            *[F.col(c).alias(c) for c in (*cond, f"{p}_id", f"{p}_ts", *extra)], F.lit(is_trigger).alias("t_side"),
            epoch_micros(f"{p}_ts").alias("us"), F.col(f"{p}_vec").alias("vec"))

    return side(trig, "t", t_extra, True).unionByName(side(cand, "c", c_extra, False), allowMissingColumns=True)


def block_matches(trig: DataFrame, cand: DataFrame, cond: list[str], keys: list[str], cfg: TrendConfig,
                  closed_end: bool, min_score: float | None, trigger_cols, candidate_cols) -> DataFrame:
    """Compares the salted groups tile by tile; only pairs at or above ``min_score`` (None: all pairs in the window) leave
    the task, batch by batch."""
    w_us = int(cfg.window_seconds) * 1_000_000
    t_out, c_out = ["t_id", "t_ts", *[f"t_{c}" for c in trigger_cols]], ["c_id", "c_ts", *[f"c_{c}" for c in candidate_cols]]
    both = _both_sides(trig, cand, cond, t_out[2:], c_out[2:])
    out_cols = [*keys, "t_id", "t_ts", "c_id", "c_ts", *t_out[2:], *c_out[2:], "score"]
    fields = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join(f"{c} {'double' if c == 'score' else fields[c]}" for c in out_cols)

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, w_us, closed_end)
        if not g:
            return
        pairs = (scores_by_tile(g.tv, g.cv, g.in_window) if min_score is None
                 else matches_by_tile(g.tv, g.cv, g.in_window, min_score, cfg.block_rows))
        for r, c, score in pairs:
            i, j = pa.array(r), pa.array(c)
            cols = {k: g.trig[k].take(i) for k in (*keys, *t_out)} | {k: g.cand[k].take(j) for k in c_out} | {"score": pa.array(score)}
            yield from pa.table({k: cols[k] for k in out_cols}).combine_chunks().to_batches()

    return both.groupBy(*cond).applyInArrow(group, schema=schema)


def window_counts(triggers: DataFrame, candidates: DataFrame, cfg: TrendConfig, cuts: Sequence[float],
                  keys: Sequence[str] = ("category",), closed_end: bool = False) -> DataFrame:
    """(t_id, n): per trigger the number of pairs of ``window_pairs`` at or above each cut, as an array in the order of
    ``cuts``.  Pairs are counted in the task that compares them and are never rows; a trigger without any has no row."""
    cuts = [float(c) for c in cuts]
    trig, cand, cond = salted_sides(triggers, candidates, cfg, list(keys))
    w_us = int(cfg.window_seconds) * 1_000_000
    both = _both_sides(trig, cand, cond, [], [])

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, w_us, closed_end)
        if g:
            n = tile_counts(g.tv, g.cv, g.in_window, cuts, cfg.block_rows)
            some = np.flatnonzero(n.any(axis=1))
            yield pa.RecordBatch.from_arrays([g.trig["t_id"].combine_chunks().take(pa.array(some)), *[pa.array(x) for x in n[some].T]],
                                             names=["t_id", *[f"n{k}" for k in range(len(cuts))]])

    schema = f"t_id {both.schema['t_id'].dataType.simpleString()}, " + ", ".join(f"n{k} bigint" for k in range(len(cuts)))
    per = both.groupBy(*cond).applyInArrow(group, schema=schema)
    sums = per.groupBy("t_id").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(cuts))])
    return sums.select("t_id", F.array(*[F.col(f"n{k}") for k in range(len(cuts))]).alias("n"))
