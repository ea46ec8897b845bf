"""Issue upsert / hydrate / edits and the append-log stores."""

import os
import tempfile

from pyspark.sql import functions as F

from support_signals.operators import issues as I
from support_signals.sources import stores

FIELDS = ("trigger_ticket_id string, priority string, summary string, description string, labels array<string>, "
          "similar_ticket_count bigint, zendesk_ticket_count bigint, arr_at_risk string, assignee string, type string")


def _fields(spark, tid, summary, typ="Bug", labels=("api",)):
    return spark.createDataFrame([(tid, "High", summary, "d", list(labels), 3, 4, "$1K", "Unassigned", typ)], FIELDS)


def _seed(spark):
    return spark.createDataFrame([("ENG-150", "Open", "High", "seed", None, "Ann", "2025-01-01")],
                                 "issue_key string, status string, priority string, summary string, "
                                 "trigger_ticket_id string, assignee string, created string").withColumn(
        "created", F.col("created").cast("date"))


def test_upsert_creates_once_then_updates(spark):
    issues = I.conform_issues(_seed(spark))
    for s in ("first", "second", "third"):
        issues = I.upsert_issues(issues, _fields(spark, "T-20168", s), F.lit("2026-07-10"))
        issues = spark.createDataFrame(issues.collect(), issues.schema)      # cut lineage in the test
    rows = {r.issue_key: r for r in issues.collect()}
    assert set(rows) == {"ENG-150", "ENG-151"}
    assert rows["ENG-151"].summary == "third" and rows["ENG-151"].status == "Open"


def test_upsert_into_empty_backlog(spark):
    empty = spark.createDataFrame([], "issue_key string, status string, priority string, summary string, "
                                      "trigger_ticket_id string, assignee string, created date")
    f = _fields(spark, "T-20179", "s", typ="Task").withColumn(
        "labels", I.normalize_labels(F.lit("sso, scim , "), F.lit("identity")))
    r = I.upsert_issues(I.conform_issues(empty), f, F.lit("2026-07-10")).collect()
    assert [(x.issue_key, x.type, x.labels) for x in r] == [("ENG-101", "Task", ["sso", "scim"])]


def test_hydrate_linked_unlinked_stale(spark):
    issues = spark.createDataFrame([("ENG-1", "T-1", "old", "Low"), ("ENG-2", None, "keep", "Low"),
                                    ("ENG-3", "T-404", "stale", "Low")],
                                   "issue_key string, trigger_ticket_id string, summary string, priority string")
    live = spark.createDataFrame([("T-1", "new title", "sum", "high", 5, 6, "$2K")],
                                 "trigger_ticket_id string, title string, summary string, priority string, "
                                 "similar_count bigint, total_tickets bigint, arr_at_risk_formatted string")
    r = {x.issue_key: x for x in I.hydrate(issues, live).collect()}
    assert (r["ENG-1"].summary, r["ENG-1"].priority, r["ENG-1"].analysis_source) == ("new title", "High", "live")
    assert (r["ENG-2"].summary, r["ENG-2"].analysis_source) == ("keep", "stored")
    assert (r["ENG-3"].summary, r["ENG-3"].analysis_source) == ("stale", "stored")


def test_edit_merge(spark):
    d = spark.createDataFrame([("T-1", "t", "s", "high", "api", 3, "T-2", 4, "$1K", 2)],
                              "trigger_ticket_id string, title string, summary string, priority string, category string, "
                              "similar_count bigint, similar_ticket_ids string, total_tickets bigint, "
                              "arr_at_risk_formatted string, unique_accounts bigint")
    e = spark.createDataFrame([("T-1", "  ", "edited", "Urgent", "Task", " ", "a, b", "")],
                              "trigger_ticket_id string, summary string, description string, priority string, "
                              "issue_type string, category string, labels string, assignee string")
    r = I.merge_edits(d, e).collect()[0]
    assert (r.title, r.priority, r.category, r.assignee, r.similar_count) == (
        "Support trend investigation", "urgent", "api", "Unassigned", 3)


def test_review_store_round_trip(spark):
    root = tempfile.mkdtemp(prefix="ss-store-")
    log = os.path.join(root, "log")
    a = spark.createDataFrame([("T-3", "T-1", True, 1, 1), ("T-3", "T-2", True, 1, 2)],
                              "trigger_id string, ticket_id string, include boolean, written_at int, seq int")
    stores.append(a, log)
    stores.append(spark.createDataFrame([("T-3", "T-2", False, 2, 1)], a.schema), log)
    assert stores.read_state(spark, os.path.join(root, "state")) is None
    stores.compact(spark, log, os.path.join(root, "state"), ["trigger_id", "ticket_id"])
    st = {(r.trigger_id, r.ticket_id): r.include for r in stores.read_state(spark, os.path.join(root, "state")).collect()}
    assert st == {("T-3", "T-1"): True, ("T-3", "T-2"): False}


def test_global_rank(spark):
    from support_signals.operators.ordering import global_rank
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7)
    r = global_rank(df, F.desc("k")).collect()
    assert sorted((x.rank, x.k) for x in r) == [(i + 1, 999 - i) for i in range(1000)]


def test_sources_missing_and_last_duplicate(spark):
    root = tempfile.mkdtemp(prefix="ss-src-")
    schema = "account_id string, arr bigint"
    assert stores.load_json_or_empty(spark, os.path.join(root, "none.json"), schema).count() == 0
    p = os.path.join(root, "acc.json")
    with open(p, "w") as fh:
        fh.write('[{"account_id": "A", "arr": 1}, {"account_id": "B", "arr": 2}, {"account_id": "A", "arr": 3}]')
    d = {r.account_id: r.arr for r in stores.dedupe_last(stores.load_json_or_empty(spark, p, schema), "account_id").collect()}
    assert d == {"A": 3, "B": 2}
    seed = os.path.join(root, "seed.json")
    with open(seed, "w") as fh:
        fh.write('[{"issue_key": "ENG-150"}]')
    assert stores.load_issues(spark, os.path.join(root, "runtime.json"), seed, "issue_key string").count() == 1
    v = stores.publish(spark.createDataFrame([("ENG-151",)], "issue_key string"), os.path.join(root, "issues"))
    assert stores.read_state(spark, os.path.join(root, "issues")).collect()[0].issue_key == "ENG-151" and v
