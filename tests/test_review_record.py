"""The stored review: deltas against a recomputation, shared accounts, confirmation, stale signatures."""

import itertools
import random

from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import impact as I
from support_signals.operators import review as RV
from support_signals.operators import review_record as R
from support_signals.operators.issues import hydrate

MATCH = "t_id string, c_id string, score double, c_subject string, c_account_id bigint, c_ts string"
ACC = "account_id bigint, account_name string, arr bigint, tier string"
LOG = "trigger_id string, ticket_id string, include boolean, decided_at int, seq int"
CFG = TrendConfig(min_count=2)


def _world(spark, make_tickets, seed=4):
    rnd = random.Random(seed)
    ids = [f"T-{i:02d}" for i in range(14)]
    acct = {x: rnd.choice([1, 2, 3, None, 99]) for x in ids}           # 99 is unknown, accounts are shared
    t = make_tickets([{"id": x, "created_at": "2026-07-01", "account_id": acct[x], "embedding": [1.0], "priority": "high"}
                      for x in ids])
    pairs = [(a, b, round(rnd.random(), 3), f"subject of {b}", acct[b], "2026-07-01")
             for a, b in itertools.permutations(ids, 2) if rnd.random() < 0.4]
    m = spark.createDataFrame(pairs, MATCH)
    acc = spark.createDataFrame([(1, "A", 100, "enterprise"), (2, "B", 2_000, "pro"), (3, "C", 30, "odd")], ACC)
    log = spark.createDataFrame([(a, b, rnd.random() < 0.4, 1, 1) for a, b, *_ in pairs if rnd.random() < 0.7]
                                + [("T-00", "T-77", False, 1, 1), ("T-00", "T-77", False, 1, 1)], LOG)
    return t, m, acc, log


def _state(t, m, acc):
    mem = I.cluster_members(m, t)
    return R.cluster_state(m, t, I.impact_summary(mem, acc).drop("arr_at_risk_formatted")), R.account_counts(mem, acc)


def test_deltas_equal_a_recomputation(spark, make_tickets):
    t, m, acc, log = _world(spark, make_tickets)
    state, counts = _state(t, m, acc)
    dec = RV.latest_decisions(log)
    got = R.exclude(state, counts, R.excluded_members(m, dec))
    inc = RV.reviewed_members(m, dec)
    mem = I.cluster_members(inc, t)
    want, _ = _state(t, inc, acc)
    want = want.join(I.impact_summary(mem, acc).select("trigger_id", "arr_at_risk_formatted"), "trigger_id")
    rows = lambda d: sorted(tuple(r) for r in d.select(*got.columns).collect())
    assert rows(got) == rows(want)
    assert inc.count() < m.count()
    none = R.exclude(state, counts, R.excluded_members(m, dec.where(F.lit(False))))
    assert rows(none.drop("arr_at_risk_formatted").withColumn("arr_at_risk_formatted", F.lit(""))) == \
        rows(state.withColumn("arr_at_risk_formatted", F.lit("")))


def test_an_account_leaves_with_its_last_ticket(spark, make_tickets):
    t = make_tickets([{"id": x, "created_at": "2026-07-01", "account_id": a, "embedding": [1.0]}
                      for x, a in (("T", 2), ("A", 1), ("B", 1), ("C", 2))])
    m = spark.createDataFrame([("T", x, 0.9, "s", a, "x") for x, a in (("A", 1), ("B", 1), ("C", 2))], MATCH)
    acc = spark.createDataFrame([(1, "A", 100, "enterprise"), (2, "B", 7, "free")], ACC)
    state, counts = _state(t, m, acc)

    def after(*out):
        dec = spark.createDataFrame([("T", x, False) for x in out], "trigger_id string, ticket_id string, include boolean")
        r = R.exclude(state, counts, R.excluded_members(m, dec)).where("trigger_id = 'T'").first()
        return r.similar_count, r.total_tickets, r.unique_accounts, r.enterprise_accounts, r.arr_at_risk

    assert after("A") == (2, 3, 2, 1, 107)
    assert after("A", "B") == (1, 2, 1, 0, 7)
    assert after("A", "B", "C") == (0, 1, 1, 0, 7)         # the trigger keeps its account


def test_confirmed_reviews_feed_later_views(spark, make_tickets):
    t, m, acc, log = _world(spark, make_tickets)
    state, counts = _state(t, m, acc)
    dec = RV.latest_decisions(log)
    now = R.exclude(state, counts, R.excluded_members(m, dec))
    inc = RV.reviewed_members(m, dec)
    conf = R.confirm(now, log, CFG)
    rec = R.review_records(conf, R.review_drafts(conf, inc, t, CFG))
    recs = {r.trigger_id: r for r in rec.collect()}
    members = {}
    for r in inc.collect():
        members.setdefault(r.t_id, []).append((-r.score, r.c_id))
    decided = {r.trigger_id for r in log.collect()}
    assert set(recs) == {x for x in decided if len(members.get(x, [])) >= 2}
    for x, r in recs.items():
        assert r.linked_tickets == len(members[x]) + 1 and f"({len(members[x])} similar tickets)" in r.title
        best = "\n".join(f"- subject of {c}" for _, c in sorted(members[x])[:3])
        assert f"Sample subjects:\n{best}\n" in r.summary
        assert r.similar_ticket_ids == ", ".join(sorted(c for _, c in members[x])[:20])
    links = {}
    for r in R.review_links(conf, inc, t).collect():
        links.setdefault(r.trigger_id, set()).add((r.ticket_id, r.relationship))
    assert links == {x: {(x, "Trigger")} | {(c, "Similar") for _, c in members[x]} for x in recs}

    some = sorted(recs)[0]
    issues = spark.createDataFrame([("ENG-1", some, "old", "Low"), ("ENG-2", "T-404", "stale", "Low"), ("ENG-3", None, "own", "Low")],
                                   "issue_key string, trigger_ticket_id string, summary string, priority string")
    live = spark.createDataFrame([(some, "live", "s", "low", 1, 1, "$0")],
                                 "trigger_ticket_id string, title string, summary string, priority string, "
                                 "similar_count bigint, total_tickets bigint, arr_at_risk_formatted string")
    shown = {r.issue_key: r for r in hydrate(issues, R.live_analysis(live, rec)).collect()}
    assert shown["ENG-1"].summary == recs[some].title and shown["ENG-1"].similar_ticket_count == recs[some].similar_count
    assert shown["ENG-2"].summary == "stale" and shown["ENG-3"].summary == "own"
    plain = {r.issue_key: r.summary for r in hydrate(issues, R.live_analysis(live, rec.where(F.lit(False)))).collect()}
    assert plain["ENG-1"] == "live"


def test_a_later_decision_makes_the_record_stale(spark, make_tickets):
    t, m, acc, log = _world(spark, make_tickets)
    state, counts = _state(t, m, acc)
    at = lambda l: R.exclude(state, counts, R.excluded_members(m, RV.latest_decisions(l)))
    conf = R.confirm(at(log), log, CFG)
    one = conf.orderBy("trigger_id").first().trigger_id
    gone = RV.reviewed_members(m, RV.latest_decisions(log)).where(F.col("t_id") == one).orderBy("c_id").first().c_id
    later = log.unionByName(spark.createDataFrame([(one, gone, False, 2, 2)], LOG))
    cur = {r.trigger_id: r.is_confirmed for r in R.review_is_current(conf, at(later)).collect()}
    assert cur.pop(one) is False and cur and all(cur.values())
