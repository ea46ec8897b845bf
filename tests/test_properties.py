"""Property tests: ARR text against Python, the window join against brute force."""

from datetime import datetime, timedelta

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from support_signals.config import TrendConfig
from support_signals.functions.formats import format_arr
from support_signals.operators import trend

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def python_arr(amount: int) -> str:
    """The reference's formatting rules written plainly in Python."""
    if amount >= 1_000_000:
        return f"${amount / 1_000_000:.1f}M"
    if amount >= 1_000:
        return f"${round(amount / 1_000)}K"
    return f"${amount:,}"


@SETTINGS
@given(st.lists(st.one_of(st.integers(0, 10**12), st.integers(0, 20_000).map(lambda k: k * 50_000),
                          st.integers(0, 2_000).map(lambda k: k * 500)), min_size=1, max_size=300))
def test_format_arr_matches_python(spark, amounts):
    df = spark.createDataFrame([(a,) for a in amounts], "a bigint")
    got = {r.a: r.f for r in df.select("a", format_arr("a").alias("f")).collect()}
    assert all(got[a] == python_arr(a) for a in amounts)


@SETTINGS
@given(seed=st.integers(0, 10**6), bucket_hours=st.sampled_from([1, 7, 24, 100]),
       target=st.sampled_from([3, 20, 20_000]), tile=st.sampled_from([1, 5, 2048]))
def test_window_join_matches_brute_force(spark, make_tickets, seed, bucket_hours, target, tile):
    rng = np.random.default_rng(seed)
    n = 40
    start = datetime(2026, 7, 1)
    rows = []
    for i in range(n):
        v = rng.normal(size=3)
        v /= np.linalg.norm(v)
        ts = start + timedelta(minutes=int(rng.integers(0, 60 * 24 * 12)))
        rows.append({"id": f"T-{i:03d}", "created_at": ts.isoformat(), "category": ("a", "b")[int(rng.integers(0, 2))],
                     "embedding": [float(x) for x in v]})
    cfg = TrendConfig(threshold=0.3, min_count=2, bucket_hours=bucket_hours, target_rows_per_group=target,
                      block_rows=tile)
    got = {r.id: r.similar_count for r in trend.trend_batch(make_tickets(rows), cfg).collect()}
    want = {}
    for r in rows:
        t = datetime.fromisoformat(r["created_at"])
        want[r["id"]] = sum(
            1 for c in rows
            if c["id"] != r["id"] and c["category"] == r["category"]
            and t - timedelta(days=7) <= datetime.fromisoformat(c["created_at"]) < t
            and float(np.dot(np.float32(r["embedding"]), np.float32(c["embedding"]))) >= 0.3)
    assert got == want


@SETTINGS
@given(seed=st.integers(0, 10**6), k=st.integers(1, 6), block_rows=st.sampled_from([1, 4, 9, 1000]),
       exclude_self=st.booleans())
def test_topk_block_grid_matches_brute_force(spark, make_tickets, seed, k, block_rows, exclude_self):
    from support_signals.operators.blocks import topk_neighbours
    rng = np.random.default_rng(seed)
    n = 25
    vecs = rng.normal(size=(n, 4))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = [{"id": f"T-{i:02d}", "created_at": "2026-07-01T10:00", "embedding": [float(x) for x in vecs[i]]}
            for i in range(n)]
    t = make_tickets(rows)
    got = {}
    for r in topk_neighbours(t, t, k, block_rows, exclude_self=exclude_self).collect():
        got.setdefault(r.q_id, []).append((r.rank, r.c_id))
    v32 = vecs.astype(np.float32).astype(np.float64)
    s = v32 @ v32.T
    for i in range(n):
        cands = [(-s[i, j], f"T-{j:02d}") for j in range(n) if not (exclude_self and j == i)]
        want = [c for _, c in sorted(cands)[:k]]
        assert [c for _, c in sorted(got[f"T-{i:02d}"])] == want
