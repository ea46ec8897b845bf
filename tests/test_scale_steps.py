"""Steps that every ticket job shares: what they read, shuffle and hold does not grow faster than the tickets."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from support_signals.config import TrendConfig
from support_signals.operators import blocks
from support_signals.operators import evaluate as EV
from support_signals.operators import pairs
from support_signals.plans.analysis import Analysis
from support_signals.sources import views
from tests.test_plans import plan


def _tables(spark, d, n=24, vectors=5):
    spark.createDataFrame([(i, f"text {i} " * 30 if i % 4 else None, "en", "web") for i in range(n)],
                          "doc_id bigint, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    r = np.random.default_rng(4)
    v = np.float32(r.normal(size=(vectors, 3)))
    spark.createDataFrame([(i, [float(x) for x in v[i]], i % 2) for i in range(vectors)],
                          "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 7, "error" if i % 3 else "view") for i in range(50)],
                          "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").write.parquet(f"{d}/events.parquet")
    return v.astype(float)


def test_vectors_of_later_laps_are_normed_once(spark, tmp_path):
    v = _tables(spark, str(tmp_path))
    t = views.tickets(spark, str(tmp_path))
    for r in t.select("ticket_no", "embedding").collect():
        a, b = v[r.ticket_no % 5], v[(r.ticket_no + r.ticket_no // 5) % 5]
        m = (a + b) / np.linalg.norm(a + b) if r.ticket_no % 5 != (r.ticket_no + r.ticket_no // 5) % 5 else a
        assert np.allclose(r.embedding, m, atol=1e-6)
    p = t.select("embedding")._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("aggregate(") <= 1 and "transform(aggregate" not in p and "sqrt(aggregate(" not in p.lower()


def test_short_columns_shuffle_neither_texts_nor_vectors(spark, tmp_path):
    _tables(spark, str(tmp_path))
    a = Analysis(spark, str(tmp_path), TrendConfig())
    p = plan(a.ticket_rows.drop("subject"))
    assert "embedding#" not in p and "text#" not in p
    p = plan(a.ticket_rows)
    assert "embedding#" not in p and not [x for x in p.splitlines() if "Exchange" in x and "text#" in x]
    same = views.tickets(spark, str(tmp_path)).select(*a.ticket_rows.columns)
    assert a.ticket_rows.exceptAll(same).count() == 0 and a.ticket_rows.count() == same.count() == 24


def test_the_signal_of_all_tickets_lists_no_matches(make_tickets, spark):
    rows = [{"id": f"T-{i}", "created_at": f"2024-01-{1 + i % 9:02d}T00:00:00", "embedding": [1.0, 0.0]} for i in range(30)]
    a = Analysis(spark, "unused", TrendConfig(min_count=3))
    a.tickets = make_tickets(rows)
    got = {r.id: r.similar_count for r in a.trend.collect()}
    assert "matches" not in a.__dict__           # listed before
    for i in range(30):
        day = i % 9
        assert got[f"T-{i}"] == sum(day - 7 <= j % 9 < day for j in range(30))


@pytest.mark.parametrize("cuts", [(0.2,), (0.1, 0.3, 0.9)])
def test_counts_in_single_precision_are_those_of_exact_scores(cuts):
    r = np.random.default_rng(7)
    v = np.float32(r.normal(size=(90, 16)))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).astype(float)
    s = np.stack([pairs.exact_scores(np.repeat(v[i:i + 1], 90, 0), v) for i in range(90)])
    cuts = (*cuts, float(s[3, 8]), float(np.nextafter(s[3, 8], 2)))          # at a score and just above it
    early = lambda rows, cols: False if cols.start >= 60 else True if cols.stop <= 30 else np.arange(90)[None, cols] < 60
    keep = np.arange(90) // 7 * 7 < 60
    keep &= np.arange(90) < np.where(np.arange(90) // 7 * 7 + 7 <= 30, 90, 60)
    n = pairs.tile_counts(v, v, lambda a, b: np.broadcast_to(early(a, b), (a.stop - a.start, b.stop - b.start))
                          if isinstance(early(a, b), np.ndarray) else early(a, b), cuts, 7)
    assert (n == np.stack([(s[:, keep] >= c).sum(axis=1) for c in cuts], axis=1)).all()


def test_pair_statistics_over_tiles_of_a_block(spark, make_tickets):
    r = np.random.default_rng(3)
    v = np.float32(r.normal(size=(70, 4))).astype(float)
    topic = [int(x) if x < 3 else None for x in r.integers(0, 4, 70)]
    t = make_tickets([{"id": f"T-{i:02d}", "created_at": "2024-01-01T00:00:00", "embedding": list(v[i]), "topic_id": topic[i]}
                      for i in range(70)])
    grid = blocks.block_grid(t.select("id"), t.select("id"), lambda x, y: x[["lb", "rb"]].head(1), "lb int, rb int", 2,
                             triangular=True, tiles=4)
    assert 36 <= grid.select("lb", "rb").distinct().count() <= 45          # 35 blocks a side before
    cuts = (-0.5, 0.3)
    got = {x.cut: x for x in EV.pair_statistics(t, TrendConfig(block_rows=2), cuts).collect()}
    s = v @ v.T
    up = np.triu(np.ones((70, 70), bool), 1)
    same = up & np.array([[a is not None and a == b for b in topic] for a in topic])
    for c in cuts:
        assert got[c].same_pairs == same.sum() and got[c].cross_pairs == (up & ~same).sum()
        assert got[c].same_recall == pytest.approx((s[same] >= c).mean(), abs=1e-6)
        assert got[c].cross_fp_rate == pytest.approx((s[up & ~same] >= c).mean(), abs=1e-6)
        assert got[c].same_mean == pytest.approx(s[same].mean(), abs=1e-6)
