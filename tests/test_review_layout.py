"""Matches kept by the group that compares them: reviews of them shuffle no pair and equal the plain joins, repeated ids included."""

import pytest
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import clusters as C
from support_signals.operators import review as RV
from support_signals.operators import review_record as R
from support_signals.operators.pairs import window_pairs
from support_signals.plans.analysis import Analysis
from support_signals.session import write_buckets
from tests.test_clusters import odd_tickets, rows

CFG = TrendConfig(threshold=0.3)


def _analysis(spark, tickets, accounts, cfg, kept):
    a = Analysis(spark, "", cfg)
    a.tickets, a.accounts = tickets, accounts
    if kept:
        a.matches = write_buckets(C.listed_matches(tickets, a.tiers, cfg, 4), "matches", "grp", 4)
    return a


def _tiers(spark):
    return spark.createDataFrame([(i, ("enterprise", "pro", None)[i % 3], 10 * i) for i in range(1, 9)] + [(8, "free", 5)],
                                 "account_id bigint, tier string, arr bigint")


@pytest.mark.parametrize("target,block", [(20_000, 2048), (5, 4)])
def test_kept_matches_equal_joined_ones(spark, make_tickets, target, block):
    t = odd_tickets(make_tickets)                      # 20 of the 120 ids have two tickets, account 8 has two rows
    a = _analysis(spark, t, _tiers(spark), CFG.with_(target_rows_per_group=target, block_rows=block), True)
    cols = ("account_id", "subject")
    m = window_pairs(t, t, CFG, candidate_cols=cols, min_score=CFG.threshold)
    plain = ["t_id", "t_ts", "c_id", "c_ts", "c_account_id", "c_subject", "score"]
    assert rows(a.matches.select(*plain)) == rows(m.select(*plain))
    many = a.matches.where("many")
    assert 0 < many.count() < m.count()
    assert a.matches.groupBy("t_id", "c_id").agg(F.count_distinct("grp").alias("n")).where("n > 1").count() == 0

    log = a.decisions_log
    dec = RV.latest_decisions(log.drop("grp", "many"))
    assert rows(a.decisions.select(*dec.columns)) == rows(dec)
    want = RV.with_inclusion(RV.review_candidates(m, t, a.tiers), dec)
    assert rows(a.candidates.select(*want.columns)) == rows(want)
    assert rows(a.included.select(*plain)) == rows(RV.reviewed_members(m, dec).select(*plain))
    assert rows(R.excluded_members(a.matches, a.decisions)) == rows(R.excluded_members(m, dec))


def test_reviews_shuffle_no_pair(spark, make_tickets):
    """Only matches of repeated ids are joined with the tickets; the log and the inclusion stay where the match is."""
    t = make_tickets([{"id": f"T-{i:03d}", "created_at": f"2026-07-0{1 + i % 7}T{i % 24:02d}:00", "account_id": i % 9,
                       "embedding": [1.0, 0.0]} for i in range(90)])
    a = _analysis(spark, t, _tiers(spark).limit(7), CFG, True)
    n = a.matches.count()
    assert n > 1000 and not a.matches.where("many").count()

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]

    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not exchanges(a.decisions)
        one = RV.review_candidates(a.matches.where("not many"), t, a.tiers, carried=True)
        assert not exchanges(RV.with_inclusion(one, a.decisions.where("not many")))
        assert not exchanges(a.included)
        assert not exchanges(R.excluded_members(a.matches, a.decisions))
        plain = RV.latest_decisions(a.decisions_log.drop("grp", "many"))
        assert exchanges(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
