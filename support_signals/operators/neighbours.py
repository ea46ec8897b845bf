"""Exact k nearest neighbours over pivot cells.

Candidates belong to the cell of their nearest pivot; a cell knows its number of rows and the smallest and largest
angle and norm of its members.  For a query, the triangle inequality on angles bounds every score that a cell can
hold.  A first pass compares the query with a part of its own cell, which bounds its k-th best score from below; a
second pass visits only cells whose bound reaches that score.  Results are exact: a bound is loosened by more than its
rounding, and cells with equal bounds are visited, so ties go to the smaller candidate id.

* Pivots: the ``sqrt(n)`` candidates with the smallest id hashes, at most ``MAX_PIVOTS``.  They and the statistics of
  their cells are the only data that pass through the driver.
* Tasks: cells are packed, neighbours together, into blocks of at most about ``BLOCK_TILES * block_rows`` candidates; a crowded
  cell is cut into several blocks by id hash.  The queries that visit a block are cut into parts of that size as well, so
  a task holds two blocks of vectors, whatever the data, and the products of one tile of ``block_rows`` x ``block_rows``.
  A row is shuffled once per block of the other side: large blocks keep the copies few, small tiles the memory.
* Products of a tile are in single precision and only preselect, by more than their rounding; what is kept is scored
  exactly.
* The slacks are absolute: scores are taken to be below about 10,000 (unit vectors: at most 1).
* Where nothing can be skipped (vectors without clusters) the work is that of all blocks against all blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from support_signals.operators.blocks import _empty, _rough, _stack
from support_signals.session import write_table

MAX_PIVOTS = 1024
ANGLE_SLACK = 1e-6          # above the rounding of an arc cosine near 0
SCORE_SLACK = 1e-9          # above the rounding of a product
EXACT_CHUNK = 65_536        # pairs whose scores are summed at once
BLOCK_TILES = 32            # most tiles of block_rows on a side of a block: 65,536 vectors of 64 floats are 16 MB
MIN_BLOCKS = 8              # smaller blocks where there would be fewer: some 64 tasks


@dataclass(frozen=True)
class Cells:
    """Candidates with their ``cell``, and per cell the pivot, the statistics and the block it is packed into."""

    rows: DataFrame
    pivots: np.ndarray      # cells x dimensions, unit length
    angles: np.ndarray      # cells x (smallest, largest) angle between member and pivot
    norms: np.ndarray       # cells x (smallest, largest) norm of a member
    sizes: np.ndarray
    block: np.ndarray       # block of every cell
    parts: np.ndarray       # per block: into how many parts its candidates are cut
    block_rows: int         # candidates, and queries, that a task holds


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norm > 0, norm, 1.0)[:, None], norm


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (number of the nearest pivot), ``angle`` to it and ``norm``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("angle", T.DoubleType()), T.StructField("norm", T.DoubleType())])

    def nearest(batches):
        for p in batches:
            if len(p):
                unit, norm = _unit(_stack(p["embedding"]))
                a = _angles(unit, pivots)
                cell = a.argmin(axis=1)
                p = p.assign(cell=cell.astype("int32"), angle=a[np.arange(len(p)), cell], norm=norm)
                yield p

    return rows.mapInPandas(nearest, schema)


def _pack(pivots: np.ndarray, sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of neighbouring cells: walk from pivot to nearest unvisited pivot and close a block before it is overfull."""
    block = np.zeros(len(sizes), dtype=np.int32)
    parts: list[int] = []
    left = np.ones(len(sizes), dtype=bool)
    at, room = 0, 0
    while left.any():
        left[at] = False
        if sizes[at] > room or not parts:
            parts.append(max(1, math.ceil(sizes[at] / block_rows)))
            room = max(block_rows, int(sizes[at]))
        block[at] = len(parts) - 1
        room -= int(sizes[at])
        near = np.where(left, pivots @ pivots[at], -np.inf)
        at = int(near.argmax())
    return block, np.array(parts, dtype=np.int32)


def build_cells(candidates: DataFrame, block_rows: int, max_pivots: int = MAX_PIVOTS) -> Cells | None:
    """Cells of the candidates (``id``, ``embedding``, other columns); None without any vector.  The assignment is stored
    once, so that statistics and both passes see the same cells."""
    c = candidates.where(F.col("embedding").isNotNull())
    n = c.count()
    if n == 0:
        return None
    want = max(1, min(max_pivots, math.ceil(math.sqrt(n))))
    chosen = c.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(want).toPandas()
    pivots, _ = _unit(_stack(chosen["embedding"]))
    rows = write_table(assign(c, pivots), "cells", "cell")
    stats = (rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("a0"), F.max("angle").alias("a1"),
                                      F.min("norm").alias("n0"), F.max("norm").alias("n1"))
             .toPandas().set_index("cell").sort_index())                      # at most max_pivots rows
    sizes = stats["n"].reindex(range(len(pivots)), fill_value=0).to_numpy()
    pair = lambda a, b: stats[[a, b]].reindex(range(len(pivots)), fill_value=0.0).to_numpy()
    held = min(BLOCK_TILES * max(1, block_rows), max(1, block_rows, math.ceil(n / MIN_BLOCKS)))
    block, parts = _pack(pivots, sizes, held)
    return Cells(rows, pivots, pair("a0", "a1"), pair("n0", "n1"), sizes, block, parts, held)


def score_bounds(queries: np.ndarray, pivots: np.ndarray, angles: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Largest score that each query can reach in each cell: the angle to a member is at least the gap between the angle to
    the pivot and the cell's range of angles."""
    unit, qn = _unit(queries)
    a = _angles(unit, pivots)
    gap = np.maximum(np.maximum(a - angles[:, 1], angles[:, 0] - a) - ANGLE_SLACK, 0.0)
    cos = np.cos(np.minimum(gap, np.pi))
    return qn[:, None] * np.where(cos >= 0, norms[:, 1], norms[:, 0]) * cos + SCORE_SLACK


def _exact(qv: np.ndarray, cv: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores of the listed pairs, summed left to right as the JVM does, so equal vectors get equal scores."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), EXACT_CHUNK):
        r, c = rows[i:i + EXACT_CHUNK], cols[i:i + EXACT_CHUNK]
        out[i:i + EXACT_CHUNK] = np.cumsum(qv[r] * cv[c], axis=1)[:, -1]
    return out


def _below(low: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """``low`` as a column of the type of the products, rounded down."""
    return np.nextafter(low.astype(dtype), dtype.type(-np.inf))[:, None]


def _heads(rows: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first ``k`` of their row, in sorted rows."""
    new = np.r_[True, rows[1:] != rows[:-1]]
    return np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k


def _full(rows: np.ndarray, k: int) -> np.ndarray:
    """Where the rows with ``k`` entries begin, in sorted rows with at most ``k`` entries each."""
    return np.flatnonzero(rows[k - 1:] == rows[:len(rows) - k + 1]) if len(rows) >= k else np.zeros(0, np.int64)


def k_best(qv: np.ndarray, cv: np.ndarray, tau: np.ndarray, k: int, tie: np.ndarray, tile: int,
           own: tuple[np.ndarray, np.ndarray] | None = None,
           closed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of every query's ``k`` best candidates, of those that reach its ``tau``.  Order of a
    query: score desc, ``tie`` of the candidate asc.  ``own``: codes of both sides, pairs with the same code are left out;
    ``closed``: cell of every candidate, and queries x cells, which of them are not searched.  One tile is held at a time."""
    rough_q, rough_c, err = _rough(qv, cv)
    err = err + SCORE_SLACK
    products = np.empty(min(tile, len(qv)) * min(tile, len(cv)), rough_q.dtype)
    found = []
    for a in range(0, len(qv), tile):
        low = tau[a:a + tile] - err[a:a + tile]
        at, to, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(cv), tile):
            shut = None
            if closed is not None:
                shut = closed[1][a:a + tile][:, closed[0][b:b + tile]]
                if shut.all():
                    continue
            q, c = rough_q[a:a + tile], rough_c[b:b + tile]
            s = np.matmul(q, c.T, out=products[:len(q) * len(c)].reshape(len(q), len(c)))
            if shut is not None:
                s[shut] = -np.inf
            if own is not None and np.isin(own[0][a:a + tile], own[1][b:b + tile]).any():
                s[own[0][a:a + tile, None] == own[1][None, b:b + tile]] = -np.inf
            hit = s >= _below(low, s.dtype)
            if s.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(s):
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                low = np.fmax(low, kth - 2 * err[a:a + tile])
                hit = s >= _below(low, s.dtype)
            some = np.flatnonzero(hit.any(axis=1))          # few rows have any
            r, c = np.divmod(np.flatnonzero(hit[some]), s.shape[1])
            r = some[r]
            usable = np.isfinite(s[r, c])
            r, c = r[usable], c[usable] + b
            if len(r) == 0:
                continue
            at, to = np.r_[at, r], np.r_[to, c]
            score = np.r_[score, _exact(qv, cv, r + a, c)]
            order = np.lexsort((tie[to], -score, at))
            at, to, score = at[order], to[order], score[order]
            keep = _heads(at, k)
            at, to, score = at[keep], to[keep], score[keep]
            full = _full(at, k)
            low[at[full]] = np.fmax(low[at[full]], score[full + k - 1] - err[a + at[full]])
        found.append((at + a, to, score))
    return tuple(np.concatenate(x) for x in zip(*found))


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, _ = pd.factorize(np.concatenate([a, b]))
    return code[:len(a)], code[len(a):]


def _cogroup(queries: DataFrame, cells: Cells, load: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn`` on every (block, part, query part).  ``queries`` has ``block`` and ``part``; ``load`` the number of
    queries per block and part (as many rows as there are blocks and parts with queries)."""
    load = load.select("block", "part", F.ceil(F.col("n") / F.lit(cells.block_rows)).cast("int").alias("splits"))
    spark = cells.rows.sparkSession
    of_cell = F.broadcast(spark.createDataFrame(        # one row per pivot
        [(c, int(b), int(cells.parts[b])) for c, b in enumerate(cells.block)], "cell int, block int, parts int"))
    c = (cells.rows.drop("angle", "norm").join(of_cell, "cell")
         .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
         .join(load, ["block", "part"]).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
         .drop("splits"))
    q = (queries.join(load, ["block", "part"])
         .withColumn("split", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("splits")).cast("int")).drop("splits"))
    keys = ["block", "part", "split"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(fn, schema)


def lower_bounds(queries: DataFrame, cells: Cells, k: int, block_rows: int, exclude_self: bool) -> DataFrame:
    """First pass: per query ``tau``, a score that its k-th best is not below (minus infinity where fewer than k candidates
    were met).  Each query meets one part of the block of its own cell."""
    spark = queries.sparkSession
    home = F.broadcast(spark.createDataFrame(
        [(c, int(b), int(cells.parts[b])) for c, b in enumerate(cells.block)], "cell int, block int, parts int"))
    q = (assign(queries.select("id", "embedding"), cells.pivots).select("id", "embedding", "cell").join(home, "cell")
         .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("id", "embedding", "block", "part"))
    load = q.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"))

    def kth(qp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        if len(qp) == 0:
            return _empty(["id", "tau"], {"tau": "float64"})
        tau = np.full(len(qp), -np.inf)
        if len(cp):
            own = _codes(qp["id"].to_numpy(), cp["id"].to_numpy()) if exclude_self else None
            at, _, score = k_best(_stack(qp["embedding"]), _stack(cp["embedding"]), tau, k, np.arange(len(cp)),
                                  max(1, block_rows), own)
            full = _full(at, k)
            tau[at[full]] = score[full + k - 1] - SCORE_SLACK
        return pd.DataFrame({"id": qp["id"].to_numpy(), "tau": tau})

    return _cogroup(q, cells, load, kth, "id string, tau double")


def visits(queries: DataFrame, cells: Cells, tau: DataFrame) -> DataFrame:
    """Per query the blocks with a cell that can still hold one of its k best, and which of the block's cells: one bit per
    cell of the block, in order of their numbers."""
    q = queries.select("id", "embedding").join(tau.groupBy("id").agg(F.min("tau").alias("tau")), "id", "left")
    pivots, angles, norms, sizes = cells.pivots, cells.angles, cells.norms, cells.sizes
    members = [np.nonzero(cells.block == b)[0] for b in range(len(cells.parts))]

    def plan(batches):
        for p in batches:
            if len(p):
                t = p["tau"].fillna(-np.inf).to_numpy()
                open_ = (score_bounds(_stack(p["embedding"]), pivots, angles, norms) >= t[:, None]) & (sizes > 0)
                lists = [[] for _ in range(len(p))]
                for b, at in enumerate(members):
                    bits = np.packbits(open_[:, at], axis=1)
                    for i in np.nonzero(bits.any(axis=1))[0]:
                        lists[i].append({"block": b, "open": bits[i].tobytes()})
                yield p.assign(tau=t, visits=lists)

    kind = q.schema["embedding"].dataType.simpleString()
    return q.mapInPandas(plan, f"id string, embedding {kind}, tau double, visits array<struct<block: int, open: binary>>")


def topk_neighbours(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int, exclude_self: bool = True,
                    candidate_cols: tuple[str, ...] = (), max_pivots: int = MAX_PIVOTS,
                    cells: Cells | None = None) -> DataFrame:
    """Exact k best candidates (inner product, cosine on unit vectors) of every query.

    ``queries``: ``id``, ``embedding``; ``candidates``: ``id``, ``embedding`` and ``candidate_cols``.  Order: score
    desc, candidate id asc.  Output: ``q_id, rank, c_id, score, <candidate_cols>``.  Rows without a vector take no part;
    a query without a candidate has no row; queries that repeat an id are answered once.  ``cells`` of the same candidates
    (``build_cells``) may be given, so that several searches share them.
    """
    extra = list(candidate_cols)
    base = candidates.select("id", "embedding", *extra)
    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name in extra)
    schema = f"q_id string, c_id string, score double{types}"
    q = queries.where(F.col("embedding").isNotNull()).select("id", "embedding")
    q = q.dropDuplicates(["id"])
    cells = cells or build_cells(base, block_rows, max_pivots)
    if cells is None:
        return queries.sparkSession.createDataFrame([], f"q_id string, rank int, c_id string, score double{types}")
    todo = write_table(visits(q, cells, lower_bounds(q, cells, k, block_rows, exclude_self)), "visits")
    parts = F.broadcast(q.sparkSession.createDataFrame(
        [(b, int(n)) for b, n in enumerate(cells.parts)], "block int, parts int"))

    def spread(*cols):
        return (todo.select(*cols, F.explode("visits").alias("v")).select(*cols, "v.block", "v.open").join(parts, "block")
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))

    load = spread("id").groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"))

    members = [np.nonzero(cells.block == b)[0] for b in range(len(cells.parts))]

    def best(qp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        columns = ["q_id", "c_id", "score", *extra]
        if len(qp) == 0 or len(cp) == 0:
            return _empty(columns, {"score": "float64"})
        inside = members[int(qp["block"].iloc[0])]
        bits = np.frombuffer(b"".join(qp["open"]), dtype=np.uint8).reshape(len(qp), -1)
        shut = np.unpackbits(bits, axis=1, count=len(inside)) == 0
        cp = cp.sort_values("cell", kind="stable", ignore_index=True)         # a tile has few cells
        at = np.searchsorted(inside, cp["cell"].to_numpy())
        closed = (at, shut) if shut[:, np.unique(at)].any() else None
        qids, cids = qp["id"].to_numpy(), cp["id"].to_numpy()
        tie = cp["id"].rank(method="dense").to_numpy()
        rows, cols, score = k_best(_stack(qp["embedding"]), _stack(cp["embedding"]), qp["tau"].to_numpy(), k, tie,
                                   max(1, block_rows), _codes(qids, cids) if exclude_self else None, closed)
        out = pd.DataFrame({"q_id": qids[rows], "c_id": cids[cols], "score": score})
        for e in extra:
            out[e] = cp[e].to_numpy()[cols]
        return out

    found = _cogroup(spread("id", "embedding", "tau"), cells, load, best, schema)
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("c_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("q_id", "rank", "c_id", "score", *extra))
