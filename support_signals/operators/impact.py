"""Customer impact of a ticket cluster.

A cluster is the trigger plus its similar tickets.  total_tickets counts the
ids (tickets without an account still count); unique_accounts counts the
distinct accounts known to the account dimension; ARR is summed once per
account.  Unknown tiers count as ``free``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from support_signals.functions.formats import format_arr

TIERS = ("enterprise", "pro", "free")      # fixed tier order of the reference


def cluster_members(matches: DataFrame, triggers: DataFrame) -> DataFrame:
    """(trigger_id, ticket_id, account_id, ts, is_trigger) with the trigger added.

    ``matches`` needs t_id, c_id, c_ts, c_account_id; ``triggers`` id,
    created_at, account_id.
    """
    sim = matches.select(F.col("t_id").alias("trigger_id"), F.col("c_id").alias("ticket_id"),
                         F.col("c_account_id").alias("account_id"), F.col("c_ts").alias("ts"),
                         F.lit(False).alias("is_trigger"))
    own = triggers.select(F.col("id").alias("trigger_id"), F.col("id").alias("ticket_id"),
                          "account_id", F.col("created_at").alias("ts"), F.lit(True).alias("is_trigger"))
    return sim.unionByName(own)


def cluster_accounts(members: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct known accounts per trigger with their first-seen position
    (similar tickets in id order, then the trigger)."""
    acc = accounts.select("account_id", "account_name", "arr",
                          F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("free").alias("tier"))
    return (members.where(F.col("account_id").isNotNull())
            .join(acc, "account_id")
            .groupBy("trigger_id", "account_id")
            .agg(F.min(F.struct("is_trigger", "ticket_id")).alias("first_seen"),
                 F.first("account_name").alias("account_name"), F.first("arr").alias("arr"),
                 F.first("tier").alias("tier")))


def impact_summary(members: DataFrame, accounts: DataFrame) -> DataFrame:
    totals = members.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("total_tickets"))
    ca = cluster_accounts(members, accounts)
    arr = F.coalesce(F.col("arr"), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("unique_accounts")]
    for t in TIERS:
        aggs.append(F.count_if(F.col("tier") == t).alias(f"{t}_accounts"))
    for t in TIERS:
        aggs.append(F.sum(F.when(F.col("tier") == t, arr).otherwise(0)).alias(f"{t}_arr"))
    aggs.append(F.sum(arr).alias("arr_at_risk"))
    per = ca.groupBy("trigger_id").agg(*aggs)
    out = totals.join(per, "trigger_id", "left")
    cols = ["unique_accounts", *[f"{t}_accounts" for t in TIERS], *[f"{t}_arr" for t in TIERS], "arr_at_risk"]
    out = out.select("trigger_id", F.col("total_tickets").cast("bigint"),
                     *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])
    return out.withColumn("arr_at_risk_formatted", format_arr("arr_at_risk"))


def impact_tiers(summary: DataFrame) -> DataFrame:
    """C2 in long form: (trigger_id, tier, accounts, arr) for the three tiers."""
    stack = ", ".join(f"'{t}', {t}_accounts, {t}_arr" for t in TIERS)
    return summary.selectExpr("trigger_id", f"stack({len(TIERS)}, {stack}) AS (tier, accounts, arr)")


def top_accounts(members: DataFrame, accounts: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest accounts by ARR per trigger, ties in first-seen order."""
    ca = cluster_accounts(members, accounts)
    w = Window.partitionBy("trigger_id").orderBy(F.desc("arr"), F.asc("first_seen"))
    return (ca.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("trigger_id", "rank", "account_id", "account_name", "tier", "arr",
                    format_arr("arr").alias("arr_formatted")))
