"""Drafts, free-text drafts and the boundary case take what they show of the matches and never list them all."""

import pytest
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import clusters as C
from support_signals.operators import drafts as D
from support_signals.operators import evaluate, impact, pairs, trend
from support_signals.operators.pairs import window_pairs
from support_signals.plans.analysis import Analysis
from tests.test_clusters import account_rows, odd_tickets, rows

CFG = TrendConfig(threshold=0.3)


@pytest.mark.parametrize("target,block", [(20_000, 2048), (5, 4)])
def test_first_ids_equal_those_of_the_listed_matches(spark, make_tickets, target, block):
    t = odd_tickets(make_tickets)                                  # 20 of the 120 ids have two tickets
    cfg = CFG.with_(target_rows_per_group=target, block_rows=block)
    m = window_pairs(t, t, CFG, min_score=CFG.threshold).cache()
    some = t.where("ticket_no % 3 = 1")
    for n in (3, 20):
        assert rows(D.first_ids(C.first_similar(t, cfg, n), n)) == rows(D.first_ids(m, n))
        of = D.first_ids(window_pairs(some, t, CFG, min_score=CFG.threshold), n)
        assert rows(D.first_ids(C.first_similar(t, cfg, n, some), n)) == rows(of)


def _burst(make_tickets, n=300):
    return make_tickets([{"id": f"T-{i * 7 % n:03d}", "created_at": f"2026-07-09T{i // 60:02d}:{i % 60:02d}", "account_id": i,
                          "embedding": [1.0, 0.0]} for i in range(n)])


def test_a_burst_lists_few_ids_and_compares_few_candidates(spark, make_tickets, monkeypatch):
    t, cfg = _burst(make_tickets), TrendConfig(block_rows=20)
    first = C.first_similar(t, cfg, 5)
    assert first.count() <= 300 * 5 < trend.trend_matches(t, cfg).count()
    import numpy as np
    import pyarrow as pa
    p = t.orderBy("created_at").toPandas()
    us = p["created_at"].astype("datetime64[us]").astype("int64").to_numpy()
    both = pa.table({"t_side": np.repeat([True, False], 300), "us": np.r_[us, us], "vec": pa.array([[1.0, 0.0]] * 600),
                     "t_id": pa.array([*p["id"], *[None] * 300], pa.string()), "c_id": pa.array([*[None] * 300, *p["id"]], pa.string())})
    g, seen = pairs._Group(iter(both.to_batches()), 7 * 86_400_000_000, False), []
    hits = C.tile_hits
    monkeypatch.setattr(C, "tile_hits", lambda a, b, *x: seen.append(len(a) * len(b)) or hits(a, b, *x))
    r, c = map(np.concatenate, zip(*C.first_hits(g, 5, 0.6, 20)))
    assert sorted(np.bincount(r, minlength=300)) == [0, 1, 2, 3, 4] + [5] * 295
    assert sum(seen) < 300 * 300 / 3


def test_drafts_list_no_matches(spark, make_tickets):
    t = make_tickets([{"id": f"T-{i:02d}", "created_at": f"2026-07-0{1 + i % 7}T{i % 24:02d}:00", "account_id": i % 5,
                       "embedding": [1.0, 0.1 * (i % 3)]} for i in range(40)])
    a = Analysis(spark, "unused", TrendConfig())
    a.tickets, a.accounts = t, account_rows(spark)
    m = window_pairs(t, t, a.cfg, min_score=a.cfg.threshold)
    want = {r.t_id: r.similar_ticket_ids for r in D.first_ids(m).collect()}
    for got in (a.drafts, a.drafts_for(t, only_flagged=False)):
        got = got.collect()
        assert got and all(r.similar_ticket_ids == want.get(r.trigger_ticket_id, "") for r in got)
    assert "matches" not in a.__dict__           # listed before


@pytest.mark.parametrize("target,block", [(20_000, 2048), (5, 4)])
def test_freetext_impact_equals_that_of_the_listed_matches(spark, make_tickets, target, block):
    t, acc = odd_tickets(make_tickets), account_rows(spark)
    cfg = CFG.with_(target_rows_per_group=target, block_rows=block)
    q = t.select(F.col("id").alias("query_id"), "embedding", "category")      # ids that come twice, too
    m = trend.freetext_matches(q, t, CFG)
    members = m.select(F.col("t_query_id").alias("trigger_id"), F.col("c_id").alias("ticket_id"),
                       F.col("c_account_id").alias("account_id"), F.lit(False).alias("is_trigger"))
    asked = trend.anchored(q, t)
    imp = C.cluster_impact(t, acc, cfg, queries=asked)
    assert rows(imp.withColumn("trigger_id", trend.query_of("trigger_id"))) == rows(impact.impact_summary(members, acc))
    ids = D.first_ids(C.first_similar(t, cfg, 4, triggers=asked, closed_end=True), 4)
    want = D.first_ids(m.select(F.col("t_query_id").alias("t_id"), "c_id"), 4)
    assert rows(ids.withColumn("t_id", trend.query_of("t_id"))) == rows(want)


def test_the_boundary_case_is_found_by_counts(spark, make_tickets):
    for seed in range(5, 7):
        t = odd_tickets(make_tickets, seed=seed)
        m = window_pairs(t, t, CFG, min_score=CFG.threshold).toPandas()
        n = m.groupby("t_id").size()
        at = t.toPandas().set_index("id")["created_at"]
        last = max((max(at.loc[[x]]), x) for x in n.index[n == CFG.min_count - 1])[1]
        e = m[m.t_id == last].sort_values(["score", "c_id"], ascending=[False, True])
        r = evaluate.boundary_case(t, CFG).first()
        assert (r.id, r.matches, r.evidence) == (last, 2, ", ".join(e.c_id))
    assert evaluate.boundary_case(_burst(make_tickets, 3).limit(2), CFG).count() == 0
