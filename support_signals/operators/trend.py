"""Similarity and trend-detection operators.

The trend rule for a trigger ticket t: count tickets c with
``score(t, c) >= threshold``, the same category and
``t.created_at - window <= c.created_at < t.created_at``; the ticket is a
*potential trend* when the count reaches ``min_count``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.operators.pairs import window_counts, window_pairs
from support_signals.operators.windows import trailing_counts


def pair_scores(tickets: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Every same-category pair inside the trailing window with its cosine."""
    return window_pairs(tickets, tickets, cfg, keys=("category",))


def trend_matches(tickets: DataFrame, cfg: TrendConfig, triggers: DataFrame | None = None) -> DataFrame:
    """Matching (trigger, similar) pairs of the rule: window + category + score."""
    trig = tickets if triggers is None else triggers
    return window_pairs(trig, tickets, cfg, keys=("category",), min_score=cfg.threshold)


def _rule_columns(count: F.Column, cfg: TrendConfig) -> list:
    return [
        count.alias("similar_count"),
        (count >= F.lit(cfg.min_count)).alias("is_potential_trend"),
        F.lit(float(cfg.threshold)).alias("threshold"),
        F.lit(int(cfg.min_count)).alias("min_count"),
        F.lit(int(cfg.window_days)).alias("window_days"),
    ]


def trend_batch(tickets: DataFrame, cfg: TrendConfig, triggers: DataFrame | None = None) -> DataFrame:
    """B6 (flagship): the trend signal of every trigger in one job.

    ``triggers`` (default: all tickets) is a DataFrame with at least ``id``;
    ids absent from ``tickets`` are skipped (inner semantics, B10); triggers
    with no match keep a 0 count (left join).
    """
    trig = tickets if triggers is None else tickets.join(triggers.select("id").distinct(), "id", "left_semi")
    counts = window_counts(trig, tickets, cfg, (cfg.threshold,)).select(F.col("t_id").alias("id"), F.col("n")[0].alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return (trig.select("id", "category", "subject").join(counts, "id", "left")
            .select("id", "category", "subject", *_rule_columns(n, cfg)))


def trend_detail(tickets: DataFrame, cfg: TrendConfig, triggers: DataFrame | None = None) -> DataFrame:
    """The matched ids of each trigger, one row per (trigger, similar) pair,
    with the trigger's count and flag repeated.  Rows stay long so a trigger
    with a huge match set is never gathered into one array."""
    m = trend_matches(tickets, cfg, triggers)
    per = m.groupBy("t_id").agg(F.count(F.lit(1)).alias("n"))
    return (m.join(per, "t_id")
            .select(F.col("t_id").alias("trigger_id"), F.col("c_id").alias("similar_id"),
                    F.round("score", 6).alias("score"), "category",
                    *_rule_columns(F.col("n").cast("bigint"), cfg)))


def window_candidates(tickets: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Number of same-category tickets in each trigger's trailing window
    (before any score cut), 0 when none; by prefix counts, no pairs."""
    n = trailing_counts(tickets, ("category",), cfg.window_days)
    return (tickets.select("id", "category", "created_at").join(n, ["category", "created_at"], "left")
            .select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("window_count")))


def freetext_trend(queries: DataFrame, tickets: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Trend signal of free-text query vectors.

    ``queries``: ``query_id``, ``category`` (inferred, B8) and ``embedding``.
    The window is *closed* and anchored on the newest ticket:
    ``[max(created_at) - window, max(created_at)]``; nothing is excluded.
    The anchor is a one-row aggregate; the pairs reuse the bucketed,
    salted window join with every query placed at the anchor time.
    """
    counts = window_counts(anchored(queries, tickets), tickets, cfg, (cfg.threshold,), closed_end=True)
    n = counts.select(query_of("t_id").alias("query_id"), F.col("n")[0].alias("n"))
    cnt = F.coalesce("n", F.lit(0)).cast("bigint")
    return (queries.select("query_id", "category").join(n, "query_id", "left")
            .select("query_id", "category", *_rule_columns(cnt, cfg)))


QUERY_PREFIX = "\u0000q:"          # no ticket id begins like this, so a query excludes no ticket


def query_of(trigger_id: str) -> F.Column:
    """The query of an ``anchored`` trigger."""
    return F.expr(f"substring({trigger_id}, {len(QUERY_PREFIX) + 1})")


def anchored(queries: DataFrame, tickets: DataFrame) -> DataFrame:
    """The queries as triggers at the time of the newest ticket."""
    anchor = tickets.select(F.max("created_at")).scalar()      # scalar subquery, evaluated once
    return queries.select(F.concat(F.lit(QUERY_PREFIX), F.col("query_id")).alias("id"), "category",
                          anchor.alias("created_at"), "embedding", F.col("query_id"))


def freetext_matches(queries: DataFrame, tickets: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Matches of free-text queries: same (inferred) category, closed window
    anchored on the newest ticket, score at or above the threshold."""
    return window_pairs(anchored(queries, tickets), tickets, cfg, keys=("category",), trigger_cols=("query_id",),
                        candidate_cols=("account_id",), closed_end=True, min_score=cfg.threshold)


# Fixed values of the reference: texts of the incoming-ticket warning.
WARNING_EVENT = "ticket.trend_checked"
WARNING_LABEL = "Potential trend"
WARNING_FMT = "Potential trend: %d similar tickets found in the previous %d days."
NO_SIGNAL_TEXT = "No trend signal detected."


def incoming_warning(trend: DataFrame, cfg: TrendConfig) -> DataFrame:
    """The warning payload attached to an incoming ticket."""
    flag = F.col("is_potential_trend")
    msg = F.when(flag, F.format_string(WARNING_FMT, F.col("similar_count"), F.col("window_days"))) \
        .otherwise(F.lit(NO_SIGNAL_TEXT))
    return trend.select(
        F.col("id").alias("ticket_id"), F.lit(WARNING_EVENT).alias("event"), flag,
        F.when(flag, F.lit(WARNING_LABEL)).alias("label"), "similar_count", "threshold", "min_count",
        "window_days", msg.alias("message"))


# Fixed value: external ids of this form are looked up as tickets, anything
# else is analysed as free text.
TICKET_ID_PATTERN = r"(?i)^T-\d+$"


def route_incoming(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """Route by external id; id-routed requests report whether the
    ticket is known (unknown ids are the 404 / skipped case)."""
    is_id = F.col("external_id").rlike(TICKET_ID_PATTERN)
    known = tickets.select(F.upper("id").alias("_k"), F.lit(True).alias("known"))
    r = requests.withColumn("route", F.when(is_id, "ticket_id").otherwise("free_text"))
    by_id = r.where(F.col("route") == "ticket_id").join(known, F.upper("external_id") == F.col("_k"), "left")
    by_text = r.where(F.col("route") == "free_text").withColumns({"_k": F.lit(None).cast("string"), "known": F.lit(None).cast("boolean")})
    return (by_id.unionByName(by_text)        # free text joins with no ticket
            .select("request_id", "external_id", "route",
                    F.when(F.col("route") == "ticket_id", F.coalesce("known", F.lit(False))).alias("ticket_found")))
