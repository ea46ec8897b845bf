"""Neighbours over pivot cells against brute force, and how many cells are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from support_signals.operators import neighbours as NB

DDL = "id string, embedding array<float>, label int"


def _table(spark, vecs, first=0):
    return spark.createDataFrame([(f"T-{first + i:04d}", [float(x) for x in v], i % 3) for i, v in enumerate(vecs)], DDL)


def _brute(qs, cs, k, exclude_self, first=0):
    q, c = np.float32(qs).astype(float), np.float32(cs).astype(float)
    out = {}
    for i in range(len(q)):
        s = [(-float(np.cumsum(q[i] * c[j])[-1]), f"T-{j:04d}") for j in range(len(c))
             if not (exclude_self and i + first == j)]
        out[f"T-{i + first:04d}"] = [(x, -sc) for sc, x in sorted(s)[:k]]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r.q_id, []).append((r.c_id, r.score))
    return out


def _clusters(seed, n, dim, centres, spread):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("kind, exclude_self", [("random", True), ("clustered", True), ("copies", True), ("copies", False),
                                                ("scaled", False)])
def test_equal_to_brute_force(spark, kind, exclude_self):
    v = _clusters(5, 160, 6, 1 if kind == "random" else 9, 3.0 if kind == "random" else 0.05)
    if kind == "copies":            # a third of the rows is one vector, so ties go by id over several parts
        v[::3] = v[0]
    if kind == "scaled":            # no unit vectors, a zero among them
        v = v * np.linspace(0.2, 4, len(v))[:, None]
        v[7] = 0
    got = _got(NB.topk_neighbours(_table(spark, v), _table(spark, v), 4, 16, exclude_self, ("label",)))
    want = _brute(v, v, 4, exclude_self)
    assert got.keys() == want.keys()
    for q in want:
        assert [x for x, _ in got[q]] == [x for x, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_other_queries_fewer_candidates_than_k_and_empty(spark):
    v = _clusters(8, 40, 5, 4, 0.1)
    few = _table(spark, v[:3])
    got = _got(NB.topk_neighbours(_table(spark, v, first=500), few, 5, 8))
    assert {q: [x for x, _ in r] for q, r in got.items()} == \
        {q: [x for x, _ in r] for q, r in _brute(v, v[:3], 5, False, 500).items()}
    empty = few.where(F.lit(False))
    assert NB.topk_neighbours(few, empty, 5, 8).count() == 0
    assert NB.topk_neighbours(empty, few, 5, 8).count() == 0
    lone = _table(spark, v[:1])
    assert NB.topk_neighbours(lone, lone, 5, 8).count() == 0
    nulls = few.unionByName(few.select(F.lit("N").alias("id"), F.lit(None).cast("array<float>").alias("embedding"), "label"))
    assert "N" not in _got(NB.topk_neighbours(nulls, nulls, 2, 8))


def test_cells_are_left_out_where_vectors_have_clusters(spark):
    v = _clusters(3, 900, 16, 30, 0.03)
    t = _table(spark, v)
    q = t.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    cells = NB.build_cells(t, 64)
    todo = NB.visits(q, cells, NB.lower_bounds(q, cells, 5, 64, True))
    met = sum(bin(byte).count("1") for r in todo.select(F.explode("visits").alias("v")).select("v.open").collect()
              for byte in r.open)
    filled = int((cells.sizes > 0).sum())
    assert filled > 20 and met < 0.25 * 900 * filled
    assert int(cells.sizes.sum()) == 900


def test_bound_is_never_below_a_score(spark):
    v = _clusters(11, 300, 4, 6, 0.4) * np.linspace(0.5, 2, 300)[:, None]
    cells = NB.build_cells(_table(spark, v), 32)
    rows = cells.rows.toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    bound = NB.score_bounds(x, cells.pivots, cells.angles, cells.norms)
    assert (bound[:, rows["cell"].to_numpy()] >= x @ x.T).all()


def test_blocks_hold_no_more_than_their_rows():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(50, 8))
    p /= np.linalg.norm(p, axis=1)[:, None]
    sizes = rng.integers(0, 40, 50)
    sizes[9] = 1000
    block, parts = NB._pack(p, sizes, 64)
    for b, n in enumerate(parts):
        assert sizes[block == b].sum() / n <= 64


@pytest.mark.parametrize("kind", ["random", "copies"])
def test_several_blocks_of_many_tiles(spark, kind):
    """F1 to F8: blocks hold many tiles, so a row goes to few blocks; the results stay exact over blocks, parts and tiles."""
    v = _clusters(9, 300, 6, 12, 3.0 if kind == "random" else 0.05)
    if kind == "copies":
        v[::2] = v[0]
    t = _table(spark, v)
    cells = NB.build_cells(t, 3)
    assert 2 <= int(cells.parts.sum()) <= 3 * NB.MIN_BLOCKS        # 100 blocks of 3 rows or more before
    got = _got(NB.topk_neighbours(t, t, 4, 3, True, ("label",), cells=cells))
    want = _brute(v, v, 4, True)
    assert got.keys() == want.keys()
    for q in want:
        assert [x for x, _ in got[q]] == [x for x, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
