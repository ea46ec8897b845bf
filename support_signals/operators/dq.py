"""Data-quality rules job (J1-J13): every rule is a DataFrame of violations,
reported together as ``(rule, violations)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the reference schema --------------------------------
CATEGORIES = ("api", "webhooks", "billing", "identity", "exports", "sdk", "account")
PRIORITIES = ("low", "medium", "high", "urgent")
STATUSES = ("open", "pending", "resolved", "closed")
TIERS = ("free", "pro", "enterprise")
ID_PATTERN = r"^T-[0-9]{5}$"
MIN_SUBJECT, MIN_BODY, MIN_MESSAGES = 12, 30, 2


def _count(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def duplicated(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose key occurs more than once (counted per row)."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))


def dq_report(tickets: DataFrame, messages: DataFrame, accounts: DataFrame, issues: DataFrame,
              expected_rows: DataFrame) -> DataFrame:
    """Violations per rule.  ``expected_rows``: one row ``expected``."""
    t = tickets
    expected = expected_rows.select("expected").scalar()         # scalar subquery
    rows = [
        t.agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("row_count").alias("rule"), (F.col("n") != expected).cast("bigint").alias("violations")),
    ]
    for name, cols in (("unique_id", ["id"]), ("unique_subject", ["subject"]), ("unique_subject_body", ["subject", "body"])):
        rows.append(duplicated(t, cols).select(F.lit(name).alias("rule"), F.col("violations").cast("bigint")))
    checks = {
        "required_fields": F.col("id").isNull() | F.col("created_at").isNull() | F.col("subject").isNull()
        | F.col("body").isNull() | F.col("category").isNull() | F.col("priority").isNull() | F.col("status").isNull(),
        "enum_category": ~F.col("category").isin(*CATEGORIES),
        "enum_priority": ~F.col("priority").isin(*PRIORITIES),
        "enum_status": ~F.col("status").isin(*STATUSES),
        "id_pattern": ~F.col("id").rlike(ID_PATTERN),
        "subject_min_length": F.length("subject") < MIN_SUBJECT,
        "body_min_length": F.length("body") < MIN_BODY,
    }
    agg = t.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    stack = ", ".join(f"'{k}', {k}" for k in checks)
    rows.append(agg.selectExpr(f"stack({len(checks)}, {stack}) AS (rule, violations)"))
    # per-ticket message rules (J5, J6 min messages): partial aggregation per ticket
    per = messages.groupBy("ticket_no").agg(F.count(F.lit(1)).alias("n_msgs"),
                                            F.max_by("author", "pos").alias("last_author"))
    tm = t.select("ticket_no", "status").join(per, "ticket_no", "left")
    rows.append(tm.agg(F.count_if(F.coalesce("n_msgs", F.lit(0)) < MIN_MESSAGES).alias("violations"))
                .select(F.lit("min_two_messages").alias("rule"), "violations"))
    rows.append(tm.where(F.col("last_author").isNotNull())
                .agg(F.count_if((F.col("last_author") == "customer") != (F.col("status") == "resolved")).alias("violations"))
                .select(F.lit("last_author_customer_iff_resolved").alias("rule"), "violations"))
    rows.append(accounts.agg(F.count_if(F.col("arr") < 0).alias("violations"))
                .select(F.lit("arr_non_negative").alias("rule"), "violations"))
    # Issue trigger links that point to no ticket
    links = issues.where(F.col("trigger_ticket_id").isNotNull()).select(F.col("trigger_ticket_id").alias("id"))
    rows.append(_count(links.join(t.select("id"), "id", "left_anti"), "issue_links_resolve"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r.select("rule", F.col("violations").cast("bigint")))
    return out


def histograms(tickets: DataFrame) -> DataFrame:
    """Status histogram, emerging/normal totals, topic sizes."""
    s = tickets.groupBy(F.col("status").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("status"))
    e = (tickets.groupBy(F.when(F.col("is_emerging_trend"), "emerging").otherwise("normal").alias("value"))
         .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("label")))
    c = (tickets.groupBy(F.col("topic_id").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
         .withColumn("kind", F.lit("topic")))
    return s.unionByName(e).unionByName(c).select("kind", "value", "n")


def review_report(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """The conversation of each ticket as report lines (one row per message)."""
    return (messages.join(tickets.select("ticket_no", "id"), "ticket_no")
            .select(F.col("id").alias("ticket_id"), "pos",
                    F.format_string("%s (%s): %s", F.initcap("author"), F.col("type"), F.col("text")).alias("line")))


# ---- rules on the raw nested ticket format (J2, J4-J9, J12) -----------------
# Fixed values of the reference dataset checks.
CHANNELS = ("email", "chat", "api")
AUTHORS = ("customer", "agent")
MESSAGE_TYPES = ("public", "internal")
MIN_MESSAGE_TEXT = 12
GOLDEN_MESSAGES = (5, 6)
ACKNOWLEDGEMENTS = ("sorry", "you're right")
BANNED_SUPPORT_ACTIONS = ("we flushed", "we scaled", "we drained", "i am routing traffic", "i am invalidating",
                          "i am revoking", "i have cleared this user")


def raw_violations(raw: DataFrame, golden: bool = False) -> DataFrame:
    """(rule, ticket_id) for every per-ticket rule a raw ticket breaks.

    Each ticket carries its own messages array, so the message rules are
    array expressions on the row (no regrouping).
    """
    m = F.coalesce(F.col("messages"), F.array())
    n = F.size(m)
    pairs_out_of_order = F.exists(F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
                                  lambda i: (n >= 2) & (F.try_element_at(m, i)["timestamp"] < F.try_element_at(m, i - 1)["timestamp"]))
    last_author = F.try_element_at(m, F.lit(-1))["author"]
    rules = {
        "messages_in_time_order": pairs_out_of_order,
        "last_author_customer_iff_resolved": (n > 0) & ((last_author == "customer") != (F.col("status") == "resolved")),
        "required_fields": F.col("id").isNull() | F.col("created_at").isNull() | F.col("subject").isNull()
        | F.col("body").isNull() | F.col("account").isNull() | F.col("ground_truth").isNull(),
        "enum_category": ~F.col("category").isin(*CATEGORIES),
        "enum_priority": ~F.col("priority").isin(*PRIORITIES),
        "enum_status": ~F.col("status").isin(*STATUSES),
        "enum_tier": ~F.col("customer_tier").isin(*TIERS),
        "enum_channel": ~F.col("channel").isin(*CHANNELS),
        "id_pattern": ~F.col("id").rlike(ID_PATTERN),
        "subject_min_length": F.length("subject") < MIN_SUBJECT,
        "body_min_length": F.length("body") < MIN_BODY,
        "min_two_messages": n < MIN_MESSAGES,
        "message_fields": F.exists(m, lambda x: ~x["author"].isin(*AUTHORS) | ~x["type"].isin(*MESSAGE_TYPES)
                                   | (F.length(x["text"]) < MIN_MESSAGE_TEXT)),
        "arr_non_negative": F.col("account.arr") < 0,
    }
    if golden:
        internal = F.size(F.filter(m, lambda x: x["type"] == "internal"))
        clustered = F.col("ground_truth.cluster_id").isNotNull()
        second = F.lower(F.try_element_at(m, F.lit(2))["text"])
        rules.update({
            "body_is_first_message": F.col("body") != F.try_element_at(m, F.lit(1))["text"],
            "golden_message_count": ~n.between(*GOLDEN_MESSAGES),
            "one_internal_iff_clustered": internal != F.when(clustered, 1).otherwise(0),
            "acknowledgement": clustered & ~F.exists(F.array(*[F.lit(a) for a in ACKNOWLEDGEMENTS]),
                                                     lambda a: F.coalesce(second.contains(a), F.lit(False))),
            "banned_phrases": F.exists(F.filter(m, lambda x: (x["author"] == "agent") & (x["type"] == "public")),
                                       lambda x: F.exists(F.array(*[F.lit(b) for b in BANNED_SUPPORT_ACTIONS]),
                                                          lambda b: F.lower(x["text"]).contains(b))),
        })
    parts = [raw.where(F.coalesce(c, F.lit(False))).select(F.lit(k).alias("rule"), F.col("id").alias("ticket_id"))
             for k, c in rules.items()]
    for name, cols in (("unique_id", ["id"]), ("unique_subject", ["subject"]),
                       ("unique_subject_body", ["subject", "body"])):
        dup = raw.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
        parts.append(raw.join(dup, cols, "left_semi").select(F.lit(name).alias("rule"), F.col("id").alias("ticket_id")))
    if golden:
        first_sentence = F.split(F.try_element_at(F.coalesce(F.col("messages"), F.array()), F.lit(2))["text"], r"\.", 2)[0]
        k = raw.select("id", first_sentence.alias("s"))
        dup = k.groupBy("s").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
        parts.append(k.join(dup, "s", "left_semi").select(F.lit("unique_first_reply_sentence").alias("rule"),
                                                          F.col("id").alias("ticket_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_report(raw: DataFrame, golden: bool = False) -> DataFrame:
    """(rule, violations) over the raw tickets."""
    return raw_violations(raw, golden).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def cluster_sizes(raw: DataFrame) -> DataFrame:
    """Tickets per cluster id (NULL = unrelated)."""
    return raw.groupBy(F.col("ground_truth.cluster_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))


def backfill_topic(raw: DataFrame, topic_map: DataFrame) -> DataFrame:
    """topic_id from the cluster id, else from an (id -> topic) table."""
    return (raw.join(topic_map.select(F.col("id"), F.col("topic_id").alias("_mapped")), "id", "left")
            .withColumn("topic_id", F.coalesce(F.col("ground_truth.cluster_id"), F.col("_mapped"))).drop("_mapped"))
