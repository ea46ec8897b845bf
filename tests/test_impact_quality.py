"""Impact, formats, explanation, review, cluster events and the quality checklist."""

from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.functions.formats import format_arr
from support_signals.operators import impact as I
from support_signals.operators import quality as Q
from support_signals.operators import review as R


def test_format_arr_edges(spark):
    cases = {999: "$999", 1000: "$1K", 1500: "$2K", 2500: "$2K", 44500: "$44K", 45500: "$46K",
             999999: "$1000K", 1000000: "$1.0M", 1250000: "$1.2M", 1150000: "$1.1M", 1350000: "$1.4M", 0: "$0"}
    df = spark.createDataFrame([(k,) for k in cases], "a bigint")
    got = {r.a: r.f for r in df.select("a", format_arr("a").alias("f")).collect()}
    assert got == cases


def test_impact_counts_ids_and_known_accounts(spark):
    matches = spark.createDataFrame(
        [("T-9", "T-1", 1), ("T-9", "T-2", 1), ("T-9", "T-3", None), ("T-9", "T-4", 7)],
        "t_id string, c_id string, c_account_id int").withColumn("c_ts", F.lit(None).cast("timestamp_ntz"))
    trig = spark.createDataFrame([("T-9", 2)], "id string, account_id int").withColumn(
        "created_at", F.lit(None).cast("timestamp_ntz"))
    acc = spark.createDataFrame([(1, "A", "enterprise", 600000), (2, "B", "weird", 500)],
                                "account_id int, account_name string, tier string, arr bigint")
    m = I.cluster_members(matches, trig)
    r = I.impact_summary(m, acc).collect()[0]
    # 5 ids (trigger + 4), accounts 1 and 2 known (7 unknown, T-3 none), tier 'weird' -> free
    assert (r.total_tickets, r.unique_accounts, r.enterprise_accounts, r.free_accounts) == (5, 2, 1, 1)
    assert (r.arr_at_risk, r.arr_at_risk_formatted) == (600500, "$600K")
    top = [x.account_name for x in I.top_accounts(m, acc).orderBy("rank").collect()]
    assert top == ["A", "B"]


def test_explanation(spark):
    shared = ["quota-reset", "zone"]
    rows = [("storage", "storage", ["zone", "quota-reset", "disk"], ["quota-reset", "zone", "cpu"]), ("storage", "network", ["zone"], ["zone"]),
            ("storage", "network", ["disk"], ["cpu"]), ("storage", "storage", None, ["cpu"])]
    quoted = lambda tags: "broken [" if tags is None else "[" + ",".join(f'"{t}"' for t in tags) + "]"
    df = spark.createDataFrame([(a, b, quoted(x), quoted(y)) for a, b, x, y in rows], "tc string, cc string, tt string, ct string")
    both, tag, neither, category = (r[0] for r in df.select(R.explanation(F.col("tc"), F.col("cc"), F.col("tt"), F.col("ct"))).collect())
    assert "same storage category" in both and all(t.replace("-", " ").upper() in both for t in shared)
    assert "ZONE" in tag and "category" not in tag
    assert neither == "semantic language match"
    assert "same storage category" in category and "CPU" not in category


def test_reviewed_trend_keeps_two(spark):
    matches = spark.createDataFrame([("T-9", f"T-{i}") for i in range(1, 5)], "t_id string, c_id string")
    log = spark.createDataFrame([("T-9", "T-1", False, 1, 1), ("T-9", "T-2", False, 1, 1), ("T-9", "T-2", True, 2, 1),
                                 ("T-9", "T-3", False, 3, 1)],
                                "trigger_id string, ticket_id string, include boolean, decided_at int, seq int")
    dec = R.latest_decisions(log)
    trig = spark.createDataFrame([("T-9",)], "id string")
    r = R.reviewed_trend(R.reviewed_members(matches, dec), trig, TrendConfig(min_count=3)).collect()[0]
    assert (r.similar_count, r.is_potential_trend) == (2, False)


def test_cluster_events(spark, make_tickets):
    """Six reports at uneven times, the last of them the trigger; the event texts name the fourth earliest."""
    hours = {"K-31": 2, "K-32": 5, "K-33": 5.5, "K-34": 9, "K-35": 15, "K-36": 21}
    t = make_tickets([{"id": i, "created_at": f"2031-05-09T{int(h):02d}:{int(h % 1 * 60):02d}", "category": "identity", "embedding": [0, 1]} for i, h in hours.items()])
    members = t.select(F.lit("K-36").alias("trigger_id"), F.col("id").alias("ticket_id"), "account_id", F.col("created_at").alias("ts"),
                       (F.col("id") == "K-36").alias("is_trigger"))
    for confirmed in (["K-36"], []):
        ev = {r.seq: r for r in R.cluster_events(members, t, spark.createDataFrame([(x,) for x in confirmed], "trigger_id string")).collect()}
        assert any("K-34" in (r.detail or "") for r in ev.values())
        assert ("confirmed" in {r.kind for r in ev.values()}) == bool(confirmed)


def _draft(spark, n=31, **extra):
    ids = [f"K-{700 + 3 * i}" for i in range(n)]
    base = {"trigger_ticket_id": "K-699", "title": f"[Trend] Recurring Storage issues ({n} similar tickets)",
            "summary": f"Support trend detected: {n} tickets with similarity >= 55% to ticket K-699. "
                       f"Category: storage. Customer impact: {n // 2} accounts.",
            "priority": "urgent", "category": "storage", "similar_count": n,
            "similar_ticket_ids": ", ".join(ids[:20]), "unique_accounts": n // 2, "arr_at_risk_formatted": "$2.5M"}
    base.update(extra)
    cols = list(base)
    return spark.createDataFrame([tuple(base[c] for c in cols)],
                                 ", ".join(f"{c} {'bigint' if isinstance(base[c], int) else 'string'}" for c in cols))


def test_quality_needs_work_then_ready(spark):
    r = Q.quality_report(_draft(spark)).collect()[0]
    assert r.verdict == "needs_work" and r.check_count == len(Q.CHECKS)
    assert r.summary.startswith(f"Escalation quality: needs_work ({round(r.score * 100)}%, {len(Q.CHECKS) - len(r.gaps)}/{len(Q.CHECKS)} checks).")
    filled = {"expected_behavior": "Volumes stay mounted", "actual_behavior": "Volumes vanish", "reproduction_steps": "Reboot a node", "environment": "zone 4"}
    ready = Q.quality_report(_draft(spark, **filled)).collect()[0]
    assert ready.verdict == "ready" and ready.gaps == [] and ready.score == 1.0
    half = Q.quality_report(_draft(spark, **{k: filled[k] for k in ("expected_behavior", "actual_behavior")})).collect()[0]
    assert len(ready.gaps) < len(half.gaps) < len(r.gaps)


def test_quality_poor_and_generic(spark):
    r = Q.quality_report(_draft(spark, title="Bug", summary="short", similar_count=1, similar_ticket_ids="",
                                unique_accounts=0, arr_at_risk_formatted="$0", priority="p1")).collect()[0]
    assert r.verdict == "poor"
    assert r.recommendation.startswith("Draft is too thin")


def test_enrich_account_two_key_fallback(spark):
    from support_signals.operators.queue import enrich_account
    t = spark.createDataFrame([("T-1", 1, "x@a"), ("T-2", 99, "billing-2@x"), ("T-3", 98, "nobody@x")],
                              "id string, account_id int, requester_email string")
    acc = spark.createDataFrame([(1, "One", 1500, "EMEA", "pro", "billing-1@x"), (2, "Two", 2500000, "APAC", "enterprise", "billing-2@x")],
                                "account_id int, account_name string, arr bigint, region string, tier string, customer_email string")
    r = {x.id: x for x in enrich_account(t, acc).collect()}
    assert (r["T-1"].matched_by, r["T-1"].account_arr_formatted) == ("account_id", "$2K")
    assert (r["T-2"].matched_by, r["T-2"].account_name, r["T-2"].account_arr_formatted) == ("requester_email", "Two", "$2.5M")
    assert (r["T-3"].matched_by, r["T-3"].account_name, r["T-3"].account_arr, r["T-3"].account_arr_formatted) == (None, "", 0, "—")
