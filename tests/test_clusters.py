"""Clusters folded in the task against the listed matches: repeated ids, unknown accounts, hot groups; nothing quadratic leaves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import clusters as C
from support_signals.operators import impact as I
from support_signals.operators import queue, review, trend
from support_signals.operators.pairs import window_pairs


def odd_tickets(make_tickets, n=140, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = np.array([r.gauss(0, 1) for _ in range(5)])
        hot = i % 3 == 0
        rows.append({"id": f"T-{i % 120:03d}", "created_at": f"2026-07-{9 if hot else 1 + r.randrange(20):02d}T{r.choice((0, 9, 23)):02d}:30",
                     "category": "api" if hot else r.choice(("api", "billing")), "account_id": r.choice((None, 1, 2, 3, 4, 5, 6, 7, 8, 99)),
                     "embedding": list(v / np.linalg.norm(v))})
    return make_tickets(rows)


def account_rows(spark):
    return spark.createDataFrame([(i, f"A{i}", ("enterprise", "pro", "free", "other", None)[i % 5], (700, 700, 100, None)[i % 4])
                                  for i in range(1, 9)] + [(None, "none", "pro", 9)],
                                 "account_id bigint, account_name string, tier string, arr bigint")


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("target,block", [(20_000, 2048), (5, 4)])
def test_folded_clusters_equal_the_listed_ones(spark, make_tickets, target, block):
    t, acc = odd_tickets(make_tickets), account_rows(spark)
    cfg = TrendConfig(threshold=0.3, target_rows_per_group=target, block_rows=block)
    m = window_pairs(t, t, cfg, candidate_cols=("account_id",), min_score=cfg.threshold)
    members = I.cluster_members(m, t).cache()
    assert rows(C.cluster_impact(t, acc, cfg)) == rows(I.impact_summary(members, acc))
    first = C.largest_members(t, acc, cfg)
    assert rows(I.top_accounts(first, acc)) == rows(I.top_accounts(members, acc))
    assert rows(queue.timeline(C.member_times(t, cfg))) == rows(queue.timeline(members))
    # one row per id, as the rank of equal (time, id) rows is open
    e = C.earliest_members(t, cfg)
    single = t.groupBy("id").count().where("count = 1").select(F.col("id").alias("trigger_id"))
    decided = m.select(F.col("t_id").alias("trigger_id"))
    assert rows(review.cluster_events(e.join(single, "trigger_id"), t, decided)) \
        == rows(review.cluster_events(members.join(single, "trigger_id"), t, decided))
    assert rows(e.groupBy("trigger_id").agg(F.sum("n").alias("n"))) == rows(members.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("n")))


def test_a_burst_leaves_a_few_rows_per_trigger(spark, make_tickets):
    v = np.random.default_rng(3).normal(size=(300, 6)) * 0.01 + np.eye(6)[0]
    t = make_tickets([{"id": f"T-{i:03d}", "created_at": f"2026-07-09T{i // 60:02d}:{i % 60:02d}", "account_id": i, "category": "api",
                       "embedding": list(x / np.linalg.norm(x))} for i, x in enumerate(v)])
    acc = spark.createDataFrame([(i, f"A{i}", "pro", i) for i in range(300)], "account_id bigint, account_name string, tier string, arr bigint")
    cfg = TrendConfig(threshold=0.6)
    assert trend.trend_matches(t, cfg).count() == 300 * 299 // 2
    assert C.earliest_members(t, cfg).count() <= 300 * 5
    assert C.largest_members(t, acc, cfg).count() <= 300 * 6
    assert C.member_times(t, cfg).count() <= 300 * 6
    assert C.fold_clusters(C.with_accounts(t, acc)[0], cfg, C._Impact, "trigger_id string, n bigint, own_seen boolean, "
                           + ", ".join(f"{x}_{y} bigint" for y in ("accounts", "arr") for x in I.TIERS) + ", account_id bigint",
                           "account_id", ("account_id", "many"), ("account_id", "arr", "tier", "known")).count() <= 300
    last = C.cluster_impact(t, acc, cfg).where("trigger_id = 'T-299'").first()
    assert (last.total_tickets, last.unique_accounts, last.pro_arr) == (300, 300, 300 * 299 // 2)


def test_all_scores_of_a_window_come_from_tiles_and_gaps_stay_null(spark, make_tickets):
    from .test_plans import plan
    t = odd_tickets(make_tickets)
    gap = F.when(F.col("ticket_no") % 9 == 0, F.lit(None)).when(F.col("ticket_no") % 11 == 0, F.transform(
        "embedding", lambda x: F.when(x > 0, x))).otherwise(F.col("embedding"))
    t = t.withColumn("embedding", gap)
    cfg = TrendConfig()
    from support_signals.functions.vectors import dot
    a = t.select("category", F.col("id").alias("t_id"), F.col("created_at").alias("t_ts"), F.col("embedding").alias("tv"))
    b = t.select("category", F.col("id").alias("c_id"), F.col("created_at").alias("c_ts"), F.col("embedding").alias("cv"))
    want = (a.join(b, "category").where("c_ts < t_ts AND c_ts >= t_ts - INTERVAL 7 DAYS AND c_id <> t_id")
            .select("category", "t_id", "t_ts", "c_id", "c_ts", dot("tv", "cv").alias("score")))
    got = trend.pair_scores(t, cfg)
    assert rows(got.select(*want.columns)) == rows(want)
    assert "Arrow" in plan(got)


def test_evidence_of_false_alerts_is_not_shuffled(spark, make_tickets):
    from support_signals.operators import evaluate
    t = odd_tickets(make_tickets)
    cfg = TrendConfig(threshold=0.3)
    m = window_pairs(t, t, cfg, min_score=cfg.threshold)
    exp = evaluate.expected_alerts(t, cfg)
    n = m.groupBy(F.col("t_id").alias("id")).agg(F.count(F.lit(1)).alias("matches")).where("matches >= 3")
    want = (exp.where(~F.col("expected")).select("id").join(n, "id")
            .join(m.select(F.col("t_id").alias("id"), F.col("c_id").alias("evidence_id"), "score"), "id")
            .join(t.select("id", "topic_id"), "id").select("id", "topic_id", "matches", "evidence_id", F.round("score", 6).alias("score")))
    assert rows(evaluate.false_positives(t, cfg)) == rows(want)
