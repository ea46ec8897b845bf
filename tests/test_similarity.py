"""Similarity and trend rule on made-up timelines; expected values follow from the rule itself."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import trend
from support_signals.operators.blocks import topk_neighbours
from support_signals.operators.review import score_candidates

NOON = datetime(2031, 3, 20, 12)
ALIKE, APART = [0.6, 0.0, 0.8], [0.8, 0.0, -0.6]


def ticket(name, hours=0.0, vector=ALIKE, category="network", **more):
    """A ticket so many hours before noon."""
    return {"id": name, "created_at": (NOON - timedelta(hours=hours)).isoformat(), "category": category, "embedding": vector, **more}


def counts(tickets, cfg, triggers=None):
    return {r.id: (r.similar_count, r.is_potential_trend) for r in trend.trend_batch(tickets, cfg, triggers).collect()}


def test_scores_of_chosen_pairs_leave_out_self_and_unknown_ids(spark, make_tickets):
    t = make_tickets([ticket("K-5"), ticket("K-6", 1, APART), ticket("K-7", 2, [0.0, 1.0, 0.0]), ticket("K-8", 3, [0.36, 0.8, 0.48])])
    asked = [("K-5", "K-8"), ("K-5", "K-5"), ("K-6", "K-7"), ("K-5", "gone"), ("gone", "K-5")]
    got = {(r.trigger_id, r.ticket_id): round(r.score, 6) for r in score_candidates(spark.createDataFrame(asked, "trigger_id string, ticket_id string"), t).collect()}
    assert got == {("K-5", "K-8"): 0.6, ("K-6", "K-7"): 0.0}


def test_only_earlier_tickets_of_the_category_count(spark, make_tickets):
    t = make_tickets([ticket("n-3", 30), ticket("n-2", 20), ticket("n-1", 10), ticket("n-0", 0),
                      ticket("other", 15, category="storage"), ticket("unlike", 5, APART)])
    assert counts(t, TrendConfig(threshold=0.95, min_count=2)) == {
        "n-3": (0, False), "n-2": (1, False), "n-1": (2, True), "n-0": (3, True), "other": (0, False), "unlike": (0, False)}


@pytest.mark.parametrize("days", [1, 7, 10])
def test_window_is_closed_behind_and_open_ahead(spark, make_tickets, days):
    """A ticket exactly ``days`` back is in; a moment more, the same moment and any later one are out."""
    edge = 24.0 * days
    t = make_tickets([ticket("in", edge), ticket("in2", edge / 2), ticket("out", edge + 1 / 3600), ticket("twin"), ticket("later", -1), ticket("now")])
    cfg = TrendConfig(threshold=0.95, min_count=2, window_days=days)
    only = spark.createDataFrame([("now",)], "id string")
    assert counts(t, cfg, only) == {"now": (2, True)}
    assert counts(t, cfg.with_(min_count=3), only) == {"now": (2, False)}


def test_triggers_that_do_not_exist_are_skipped(spark, make_tickets):
    t = make_tickets([ticket("n-1", 1), ticket("n-0")])
    cfg = TrendConfig(threshold=0.95, min_count=1)
    assert counts(t, cfg, spark.createDataFrame([("n-0",), ("n-0",), ("nowhere",)], "id string")) == {"n-0": (1, True)}
    assert counts(t, cfg, spark.createDataFrame([], "id string")) == {}


def test_defaults_detail_and_warning_text(spark, make_tickets):
    n = 5
    t = make_tickets([ticket(f"n-{k}", 24 * k) for k in range(n + 1)])
    cfg = TrendConfig()
    detail = trend.trend_detail(t, cfg).where(F.col("trigger_id") == "n-0").collect()
    assert {r.similar_id for r in detail} == {f"n-{k}" for k in range(1, n + 1)} and {r.similar_count for r in detail} == {n}
    warned = {r.ticket_id: r for r in trend.incoming_warning(trend.trend_batch(t, cfg), cfg).collect()}
    for k in range(n + 1):
        assert (warned[f"n-{k}"].label is not None) == (n - k >= cfg.min_count)
    assert warned["n-0"].message == trend.WARNING_FMT % (n, cfg.window_days)


def test_salting_and_bucket_width_do_not_change_results(spark, make_tickets):
    import random
    random.seed(7)
    rows = []
    for i in range(120):
        v = [random.random() for _ in range(4)]
        n = sum(x * x for x in v) ** 0.5
        rows.append({"id": f"T-{i:03d}", "created_at": f"2026-07-{1 + i % 20:02d}T{i % 24:02d}:00",
                     "category": "api" if i % 3 else "billing", "embedding": [x / n for x in v]})
    t = make_tickets(rows)
    base = TrendConfig(threshold=0.8, min_count=2)
    want = sorted((r.id, r.similar_count) for r in trend.trend_batch(t, base).collect())
    for cfg in (base.with_(target_rows_per_group=1), base.with_(bucket_hours=5), base.with_(bucket_hours=24 * 9)):
        assert sorted((r.id, r.similar_count) for r in trend.trend_batch(t, cfg).collect()) == want


def test_topk_ties_and_blocks(spark, make_tickets):
    t = make_tickets([{"id": f"T-{i}", "created_at": "2026-07-01T10:00", "embedding": [1, 0]} for i in range(5)]
                     + [{"id": "T-9", "created_at": "2026-07-01T10:00", "embedding": [0, 1]}])
    for block in (1, 2, 100):
        r = topk_neighbours(t, t, 3, block).where(F.col("q_id") == "T-0").orderBy("rank").collect()
        assert [x.c_id for x in r] == ["T-1", "T-2", "T-3"]


def test_hot_category_day_is_salted_and_exact(spark, make_tickets):
    """A third of all tickets in one category-day: the group is split into
    salts and the counts equal a brute-force evaluation."""
    import itertools
    import random
    from datetime import datetime, timedelta

    import numpy as np

    from support_signals.functions.vectors import bucket_of
    from support_signals.operators.pairs import group_splits

    random.seed(11)
    rows = []
    for i in range(150):
        hot = i % 3 == 0
        day = 5 if hot else 1 + (i % 20)
        v = np.array([random.gauss(0, 1) for _ in range(5)])
        v /= np.linalg.norm(v)
        rows.append({"id": f"T-{i:03d}", "created_at": f"2026-07-{day:02d}T{(i * 5) % 24:02d}:{i % 60:02d}",
                     "category": "api" if hot else ("billing", "sdk")[i % 2], "embedding": list(v)})
    t = make_tickets(rows)
    cfg = TrendConfig(threshold=0.5, min_count=2, target_rows_per_group=10)
    b = t.select("category", bucket_of("created_at", cfg.bucket_seconds).alias("bkt"))
    hot = sorted(group_splits(b, b.withColumnRenamed("bkt", "t_bkt"), ["category"], cfg, 7).collect(), key=lambda h: -h.s_c)
    assert (hot[0].category, hot[0].s_c, hot[0].s_t) == ("api", 5, 5)
    assert all(h.s_c == 1 and h.s_t > 1 for h in hot[1:])   # cold days: triggers of 8 days reach them
    got = {r.id: r.similar_count for r in trend.trend_batch(t, cfg).collect()}
    want = {}
    for r in rows:
        tt = datetime.fromisoformat(r["created_at"])
        want[r["id"]] = sum(
            1 for c in rows
            if c["id"] != r["id"] and c["category"] == r["category"]
            and tt - timedelta(days=7) <= datetime.fromisoformat(c["created_at"]) < tt
            and float(np.dot(np.float32(r["embedding"]), np.float32(c["embedding"]))) >= 0.5)
    assert got == want
    assert max(want.values()) > 0


def test_preselected_matches_have_the_scores_of_a_plain_join(spark, make_tickets):
    """The tiled products and the join give the same pairs and the same numbers, also at the cut itself."""
    import random

    from support_signals.operators.pairs import window_pairs

    random.seed(5)
    rows = []
    for i in range(90):
        v = [random.gauss(0, 1) for _ in range(7)]
        n = sum(x * x for x in v) ** 0.5
        rows.append({"id": f"T-{i:03d}", "created_at": f"2026-07-{1 + i % 15:02d}T{(i * 3) % 24:02d}:{i % 60:02d}",
                     "category": ("api", "billing")[i % 2], "embedding": [x / n for x in v]})
    t = make_tickets(rows)
    cfg = TrendConfig(threshold=0.3, min_count=2, target_rows_per_group=4, block_rows=3)
    every = {(r.t_id, r.c_id): r.score for r in window_pairs(t, t, cfg).collect()}
    cut = sorted(s for s in every.values() if s > 0.3)[5]                  # a score that a pair has
    got = {(r.t_id, r.c_id): r.score for r in window_pairs(t, t, cfg, min_score=cut).collect()}
    assert got == {k: s for k, s in every.items() if s >= cut} and cut in got.values()


def test_hot_group_fits_in_tiles():
    """20,000 triggers against 20,000 candidates: the tiles hold a few products at a time."""
    import tracemalloc

    import numpy as np

    from support_signals.operators.pairs import tile_matches

    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    r, c, score = tile_matches(v, v, lambda rows, cols: np.ones((len(v[rows]), len(v[cols])), dtype=bool), 0.97, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and (score >= 0.97).all() and len(r) >= 20_000
    assert set(zip(r[r == c].tolist(), c[r == c].tolist())) == {(i, i) for i in range(20_000)}
