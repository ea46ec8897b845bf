"""Exact all-pairs work by blocks: NumPy matrix products inside Spark tasks.

Top-k neighbours over *all* tickets and the all-pairs evaluation statistics
need every score, so no equi-key can prune them.  Emitting every pair as a
row would be quadratic in shuffle volume; instead both sides are cut into
hash blocks of about ``cfg.block_rows`` rows, the (query-block,
candidate-block) grid is formed by replicating each row once per block of the
other side, and each grid cell is a co-grouped task that multiplies the two
blocks with NumPy and returns only what the caller keeps (k best per row, or
a few partial sums).  Memory per task is bounded by ``block_rows^2``; the
shuffle carries ``n * n_blocks`` rows instead of ``n^2`` pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _n_blocks(df: DataFrame, block_rows: int) -> int:
    # one scalar through the driver: the row count
    return max(1, math.ceil(df.count() / max(1, block_rows)))


GRID_BLOCKS = 8             # blocks a side, before a block may hold several tiles


def _empty(columns: list[str], dtypes: dict[str, str]) -> pd.DataFrame:
    """A typed empty result (Arrow needs concrete column types)."""
    return pd.DataFrame({c: pd.Series([], dtype=dtypes.get(c, "object")) for c in columns})


def _stack(vecs: pd.Series) -> np.ndarray:
    if len(vecs) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in vecs.to_numpy()])


def _rough(qv: np.ndarray, cv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides in single precision, and per row of the first how far a product can be from the exact score."""
    qn, cn = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (qv, cv))
    longest = cn[np.isfinite(cn)].max(initial=0.0)
    unit = 2 * (qv.shape[1] + 4) * qn * longest
    if max(longest, qn[np.isfinite(qn)].max(initial=0.0)) > 1e15:         # a product might leave the range
        return qv, cv, unit * 2.0 ** -53
    return qv.astype(np.float32), cv.astype(np.float32), unit * 2.0 ** -24


def block_grid(left: DataFrame, right: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
               schema: str, block_rows: int, triangular: bool = False, tiles: int = 1) -> DataFrame:
    """Run ``fn(left_block, right_block)`` on every cell of the block grid.

    A row is shuffled once per block of the other side.  A ``fn`` that works tile by tile takes up to ``tiles`` x
    ``block_rows`` rows a side, as long as there are ``GRID_BLOCKS`` blocks.

    ``left``/``right`` need an ``id`` column.  With ``triangular`` (same set on
    both sides) only cells ``lb <= rb`` are formed; ``fn`` then receives
    a ``same_block`` flag column and must count i<j pairs itself.
    """
    def blocks(df: DataFrame) -> int:
        n = _n_blocks(df, block_rows)
        return max(min(n, GRID_BLOCKS), math.ceil(n / max(1, tiles)))

    nl = blocks(left)
    nr = nl if triangular else blocks(right)
    lb = F.pmod(F.xxhash64("id"), F.lit(nl)).cast("int")
    rb = F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")
    # fresh attribute ids per side so a self-grid (same DataFrame twice) resolves
    l = left.select(*[F.col(c).alias(c) for c in left.columns]).withColumn("lb", lb)
    r = right.select(*[F.col(c).alias(c) for c in right.columns]).withColumn("rb", rb)
    if triangular:
        l = l.withColumn("rb", F.explode(F.sequence(F.col("lb"), F.lit(nr - 1))))
        r = r.withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("rb"))))
    else:
        l = l.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
        r = r.withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(nl - 1))))
    return (l.groupBy("lb", "rb").cogroup(r.groupBy("lb", "rb"))
            .applyInPandas(fn, schema=schema))


def topk_neighbours(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int,
                    exclude_self: bool = True, candidate_cols: tuple[str, ...] = ()) -> DataFrame:
    """Exact k nearest candidates (cosine = dot on unit vectors) for every query.

    ``queries``: ``id``, ``embedding``; ``candidates``: ``id``, ``embedding``
    and ``candidate_cols``.  Order: score desc, candidate id asc.  Output:
    ``q_id, rank, c_id, score, <candidate_cols>``.
    """
    extra = list(candidate_cols)
    q = queries.select("id", "embedding")
    c = candidates.select("id", "embedding", *extra)
    cschema = candidates.select(*extra).schema if extra else None
    extra_ddl = "".join(f", {f.name} {f.dataType.simpleString()}" for f in (cschema.fields if cschema else []))
    schema = f"q_id string, c_id string, score double{extra_ddl}"

    def cell(qp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        if len(qp) == 0 or len(cp) == 0:
            return _empty(["q_id", "c_id", "score", *extra], {"score": "float64"})
        qv, cv = _stack(qp["embedding"]), _stack(cp["embedding"])
        s = qv @ cv.T
        qids, cids = qp["id"].to_numpy(), cp["id"].to_numpy()
        if exclude_self:
            pos = pd.Index(cids).get_indexer(qids)
            hit = pos >= 0
            s[np.nonzero(hit)[0], pos[hit]] = -np.inf
        kk = min(k, s.shape[1])
        # k-th best score per row; keep everything >= it (ties resolved below)
        kth = -np.partition(-s, kk - 1, axis=1)[:, kk - 1]
        rows, cols = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
        out = pd.DataFrame({"q_id": qids[rows], "c_id": cids[cols], "score": s[rows, cols]})
        for e in extra:
            out[e] = cp[e].to_numpy()[cols]
        out = out.sort_values(["q_id", "score", "c_id"], ascending=[True, False, True])
        return out.groupby("q_id", sort=False).head(k)

    cells = block_grid(q, c, cell, schema, block_rows)
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("c_id"))
    return (cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("q_id", "rank", "c_id", "score", *extra))
