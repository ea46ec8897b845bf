"""Raw dataset ingest and the data-quality rules on a 6-ticket hand fixture
(one ticket violating each rule family J2, J4-J7)."""

import os

import pytest
from pyspark.sql import functions as F

from support_signals.operators import dq
from support_signals.sources import raw as R

PATH = os.path.join(os.path.dirname(__file__), "fixtures", "raw_tickets.json")


@pytest.fixture(scope="module")
def doc(spark):
    return R.read_dataset(spark, PATH)


def test_gate(spark, doc):
    R.assert_gate(doc, 6)
    with pytest.raises(ValueError):
        R.assert_gate(doc, 1500)


def test_flatten_and_dimension(spark, doc):
    raw = R.explode_tickets(doc)
    flat = {r.id: r for r in R.flatten_tickets(raw).collect()}
    r = flat["T-20001"]
    assert r.tags == '["sso", "scim"]' and r.channel == "Email" and r.assignee == "Support Team"
    assert r.requester_email == "sarah.chen@example.invalid" and str(r.created_at) == "2026-07-01 10:00:00"
    acc = R.account_dimension(raw).where(F.col("account_id") == "ACC-3").collect()[0]
    assert (acc.account_name, acc.tier, acc.arr) == ("Acme 3", "pro", 3000)
    conv = R.conversation_rows(raw).where(F.col("ticket_id") == "T-20005").count()
    assert conv == 1


def test_raw_rules(spark, doc):
    raw = R.explode_tickets(doc)
    v = {(r.rule, r.ticket_id) for r in dq.raw_violations(raw, golden=True).collect()}
    assert ("unique_subject", "T-20001") in v and ("unique_subject", "T-20002") in v
    assert ("messages_in_time_order", "T-20003") in v
    assert ("last_author_customer_iff_resolved", "T-20004") in v
    assert ("enum_category", "T-20005") in v and ("min_two_messages", "T-20005") in v
    assert ("body_is_first_message", "T-20006") in v
    assert not any(t == "T-20001" for rule, t in v if rule not in ("unique_subject", "golden_message_count"))


def test_backfill_topic_and_cluster_sizes(spark, doc):
    raw = R.explode_tickets(doc)
    m = spark.createDataFrame([("T-20001", "audit_export"), ("T-20002", "sdk_migration")], "id string, topic_id string")
    r = {x.id: x.topic_id for x in dq.backfill_topic(raw, m).select("id", "topic_id").collect()}
    assert r["T-20001"] == "audit_export" and r["T-20002"] == "sdk_migration" and r["T-20003"] is None
    sizes = {x.cluster_id: x.n for x in dq.cluster_sizes(raw).collect()}
    assert sizes == {None: 6}
