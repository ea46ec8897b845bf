"""Reviews of matches that are neither stored nor shuffled: decisions stay beside the match; equal to the plain joins, repeated
ids and accounts included."""

from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import clusters as C
from support_signals.operators import issues as IS
from support_signals.operators import review as RV
from support_signals.operators.pairs import window_pairs
from support_signals.plans.analysis import Analysis
from tests.test_clusters import odd_tickets, rows
from tests.test_plans import plan
from tests.test_review_layout import _tiers

CFG = TrendConfig(threshold=0.3)


def _analysis(spark, tickets, accounts, cfg):
    a = Analysis(spark, "", cfg)
    a.tickets, a.accounts = tickets, accounts
    return a


def test_reviews_beside_the_match_equal_joined_ones(spark, make_tickets):
    t = odd_tickets(make_tickets).withColumn("tags", F.expr("element_at(array('[\"a-b\",\"c\"]', '[\"c\",\"a-b\",\"d\",\"e\"]', 'no', null), 1 + cast(ticket_no % 4 as int))"))
    a = _analysis(spark, t, _tiers(spark), CFG.with_(target_rows_per_group=20, block_rows=16))
    cols = ("account_id", "subject")
    m = window_pairs(t, t, CFG, candidate_cols=cols, min_score=CFG.threshold).localCheckpoint()
    assert a.repeated and 0 < a.more().count() < m.count()
    log = a.decisions_log
    assert log.where("seq = 1").count() == m.count() < log.count()
    dec = RV.latest_decisions(log).localCheckpoint()
    assert rows(a.decisions) == rows(dec)
    shown = RV.with_inclusion(RV.review_candidates(m, t, a.tiers), dec).localCheckpoint()
    assert rows(a.candidates.select(*shown.columns)) == rows(shown)
    inc = RV.reviewed_members(m, dec).localCheckpoint()
    assert rows(RV.reviewed_trend(a.included_of("c_sig"), t, CFG)) == rows(RV.reviewed_trend(inc, t, CFG))
    links = IS.linked_tickets(a.more(), t, t, carried=a.one("c_subject"))
    assert rows(links) == rows(IS.linked_tickets(m, t, t))
    # facets in one pass
    cut = RV.filter_condition(min_score=45, tiers=("Pro", "Enterprise", ""))
    facets = RV.candidate_facets(shown, cut)
    n = shown.groupBy("trigger_id").agg(
        F.concat_ws("|", F.sort_array(F.collect_set("status"))).alias("statuses"), F.concat_ws("|", F.sort_array(F.collect_set("tier"))).alias("tiers"),
        F.count_if(cut).alias("shown"), F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))
    assert rows(facets) == rows(n)


def test_no_pair_is_stored_sorted_or_shuffled(spark, make_tickets):
    t = make_tickets([{"id": f"T-{i:03d}", "created_at": f"2026-07-0{1 + i % 7}T{i % 24:02d}:00", "account_id": i % 9,
                       "embedding": [1.0, 0.0]} for i in range(60)])
    a = _analysis(spark, t, _tiers(spark).limit(7), CFG)
    assert a.more() is None
    for df in (a.decisions, a.shown("explanation"), a.shown("score", "status", "tier", "included"), a.included_of("c_sig"), a.one("c_subject")):
        above = plan(df).split("FlatMapGroupsInArrow")[0]
        assert "Exchange" not in above and "Sort" not in above and "Window" not in above and "Join" not in above
    assert "matches" not in a.__dict__           # stored before
    from collections import Counter
    assert max(Counter((r.t_id, r.c_id) for r in a.one().collect()).values()) == 1
    assert "score" not in C.single_matches(a.review_tickets, CFG, ["c_subject"]).columns
