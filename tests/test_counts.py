"""Counts folded in the tile, prefix counts of windows and vector sums, against brute force and under bursts."""

import itertools
import random
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import evaluate, trend
from support_signals.operators.pairs import PAIRS_OUT, matches_by_tile, tile_counts, window_counts, window_pairs
from support_signals.operators.windows import counts_before, trailing_counts

from .test_plans import plan


def burst(n, d=8):
    """Near-equal unit vectors: every pair matches."""
    v = np.random.default_rng(2).normal(size=(n, d)) * 0.01 + np.eye(d)[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def everything(v):
    return lambda rows, cols: np.ones((len(v[rows]), len(v[cols])), dtype=bool)


def test_a_burst_in_which_every_pair_matches_is_counted_in_bounded_memory():
    v = burst(20_000)
    tracemalloc.start()
    n = tile_counts(v, v, everything(v), (0.6, 0.9), 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and n.shape == (20_000, 2) and (n == 20_000).all()


def test_a_burst_is_listed_in_batches_of_bounded_size():
    v = burst(6_000)
    tracemalloc.start()
    sizes = [len(r) for r, _, _ in matches_by_tile(v, v, everything(v), 0.9, 2048)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 36_000_000 and max(sizes) <= PAIRS_OUT and peak < 400e6


def tickets(make_tickets, n=120, seed=9, hot=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = np.array([r.gauss(0, 1) for _ in range(5)])
        day = 9 if hot and i % 3 == 0 else 1 + r.randrange(24)
        rows.append({"id": f"T-{i:03d}", "created_at": f"2026-07-{day:02d}T{r.choice((0, 9, 9, 23)):02d}:00",
                     "category": "api" if hot and i % 3 == 0 else r.choice(("api", "billing", "sdk")), "topic_id": r.choice((0, 1, 2, None)),
                     "is_emerging_trend": i % 2 == 0, "embedding": list(v / np.linalg.norm(v))})
    return make_tickets(rows), rows


def in_window(t, c, days=7):
    a, b = (datetime.fromisoformat(x["created_at"]) for x in (t, c))
    return a - timedelta(days=days) <= b < a


@pytest.mark.parametrize("target,block", [(20_000, 2048), (6, 4)])
def test_counts_in_the_tile_equal_the_listed_pairs_at_every_cut(spark, make_tickets, target, block):
    t, _ = tickets(make_tickets)
    cfg = TrendConfig(threshold=0.3, target_rows_per_group=target, block_rows=block)
    every = [(r.t_id, r.score) for r in window_pairs(t, t, cfg).collect()]
    scores = sorted(s for _, s in every)
    cuts = (scores[len(scores) // 3], 0.2, scores[len(scores) // 2], 0.9)      # two of them are scores that pairs have
    got = {r.t_id: r.n for r in window_counts(t, t, cfg, cuts).collect()}
    want = {}
    for i, s in every:
        want.setdefault(i, [0] * len(cuts))
        want[i] = [n + (s >= c) for n, c in zip(want[i], cuts)]
    assert got == {i: n for i, n in want.items() if any(n)}


def test_trend_batch_has_no_pair_rows_in_its_plan(spark, make_tickets):
    t, _ = tickets(make_tickets)
    p = plan(trend.trend_batch(t, TrendConfig(threshold=0.3)))
    assert "FlatMapGroupsInArrow" in p and "c_id" not in p.split("FlatMapGroupsInArrow")[0]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_window_counts_by_prefix_equal_brute_force(spark, make_tickets, partitions):
    t, rows = tickets(make_tickets)
    t = t.unionByName(t.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("created_at", "category") else
                                          (F.lit("T-null") if f.name == "id" else F.col(f.name)).alias(f.name) for f in t.schema.fields]))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: r.window_count for r in trend.window_candidates(t, TrendConfig()).collect()}
        exp = {r.id: (r.earlier_same_topic, r.expected) for r in evaluate.expected_alerts(t, TrendConfig()).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {a["id"]: sum(in_window(a, b) and a["category"] == b["category"] for b in rows) for a in rows}
    same = {a["id"]: sum(in_window(a, b) and a["topic_id"] is not None and a["topic_id"] == b["topic_id"] for b in rows) for a in rows}
    assert got == want | {"T-null": 0}
    assert {i: exp[i] for i in same} == {a["id"]: (same[a["id"]], a["is_emerging_trend"] and same[a["id"]] >= 3) for a in rows}


def test_prefix_counts_split_a_hot_key_by_time(spark):
    """One key with nearly all rows: its time line is cut over the partitions, and equal times are one point."""
    e = spark.range(20_000).select(F.lit("hot").alias("k"), (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id") % 500)).alias("created_at"))
    got = {r.created_at: r.n for r in counts_before(e, e, ["k"]).collect()}
    assert len(got) == 500 and sorted(got.values()) == [40 * i for i in range(500)]
    assert trailing_counts(e.where("false"), ["k"], 7).count() == 0


def test_window_counts_list_no_pairs(spark, make_tickets):
    t, _ = tickets(make_tickets)
    p = plan(trend.window_candidates(t, TrendConfig()))
    assert "Generate" not in p and "salt_c" not in p


def test_pair_means_by_vector_sums(spark, make_tickets):
    t, rows = tickets(make_tickets, n=70)
    same, cross = [], []
    for a, b in itertools.combinations(rows, 2):
        s = float(np.dot(np.float32(a["embedding"]).astype(float), np.float32(b["embedding"]).astype(float)))
        (same if a["topic_id"] is not None and a["topic_id"] == b["topic_id"] else cross).append(s)
    r = evaluate.pair_means(t).collect()[0]
    assert (r.same_pairs, r.cross_pairs) == (len(same), len(cross))
    assert abs(r.same_mean - np.mean(same)) < 2e-6 and abs(r.cross_mean - np.mean(cross)) < 2e-6
    none = evaluate.pair_means(t.where("false")).collect()[0]
    assert (none.same_mean, none.cross_mean) == (None, None)
    assert "FlatMapCoGroups" not in plan(evaluate.pair_means(t))
