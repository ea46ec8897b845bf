"""Reviews of all clusters in one pass over their matches: equal to deltas and drafts from the listed ones; shared ids and accounts."""

from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators import impact as I
from support_signals.operators import review as RV
from support_signals.operators import review_record as R
from support_signals.operators.pairs import window_pairs
from support_signals.plans.analysis import Analysis
from tests.test_clusters import account_rows, odd_tickets, rows


def test_folded_reviews_equal_those_of_the_listed_matches(spark, make_tickets):
    t = odd_tickets(make_tickets).withColumn("subject", F.concat("subject", F.lit(" "), F.col("ticket_no").cast("string")))
    acc = account_rows(spark).unionByName(account_rows(spark).where("account_id = 3"))       # an account with two rows
    cfg = TrendConfig(threshold=0.3, target_rows_per_group=20, block_rows=16)
    a = Analysis(spark, "", cfg)
    a.tickets, a.accounts = t, acc
    a.impact = a.impact.localCheckpoint()
    a.cluster_state, a.reviews_folded = a.cluster_state.localCheckpoint(), a.reviews_folded.localCheckpoint()
    m = window_pairs(t, t, cfg, candidate_cols=("account_id", "subject"), min_score=cfg.threshold).localCheckpoint()
    log = a._log(m).localCheckpoint()
    assert rows(a.cluster_state) == rows(R.cluster_state(m, t, a.impact))
    counts = R.account_counts(I.cluster_members(m, t), acc)
    dec = RV.latest_decisions(log).localCheckpoint()
    want = R.exclude(a.cluster_state, counts, R.excluded_members(m, dec)).localCheckpoint()
    got, logged = a.reviewed(a.reviews_folded)
    assert rows(got) == rows(want) and want.where("similar_count = 0 and total_tickets > 1").count() == 0
    conf = R.confirm(want, log, cfg).localCheckpoint()
    assert conf.count() > 50 and rows(R.confirm(got, logged, cfg)) == rows(conf)
    # one ticket per id: the order of equal (score, id) pairs is open
    single = t.groupBy("id").count().where("count = 1").select("id")
    inc = RV.reviewed_members(m, dec)
    drafts = R.review_drafts(conf, inc, t, cfg).join(single.withColumnRenamed("id", "trigger_ticket_id"), "trigger_ticket_id")
    tidy = "T-(0[0-1][0-9]) [0-9]+"       # which of two tickets of one id and score comes first
    near = lambda d: rows(d.withColumn("summary", F.regexp_replace("summary", tidy, "T-$1")))
    assert near(a.review_drafts.join(single.withColumnRenamed("id", "trigger_ticket_id"), "trigger_ticket_id")) == near(drafts)
    a.review_records = conf
    assert rows(a.review_links) == rows(R.review_links(conf, inc, t))
    first = lambda e: e["seq"] == 1
    old = log.where("seq = 1")
    then = R.exclude(a.cluster_state, counts, R.excluded_members(m, RV.latest_decisions(old)))
    assert rows(a.reviewed(a.review_fold(first), first)[0]) == rows(then)


def test_a_review_is_one_row_a_trigger(spark, make_tickets):
    t = make_tickets([{"id": f"T-{i:03d}", "created_at": f"2026-07-0{1 + i % 7}T{i % 24:02d}:00", "account_id": i % 9,
                       "embedding": [1.0, 0.0]} for i in range(60)])
    a = Analysis(spark, "", TrendConfig(threshold=0.3))
    a.tickets, a.accounts = t, account_rows(spark)
    folded = a.reviews_folded.collect()
    assert len(folded) <= 60 and all(len(r.ids) <= 20 and len(r.best) <= 3 for r in folded)
    a.confirmed, a.review_drafts
    assert "matches" not in a.__dict__           # stored before
