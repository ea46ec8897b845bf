"""Engineering drafts (G1-G4) and the elevated priority rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.functions.formats import pct0, title_case

# Fixed values of the reference: ids listed on a draft, sample subjects,
# priority elevation cut-offs, display names of priorities, draft texts.
MAX_DRAFT_IDS = 20
SAMPLE_SUBJECTS = 3
URGENT_AT, HIGH_AT = 50, 20
PRIORITY_DISPLAY = {"low": "Low", "medium": "Medium", "high": "High", "urgent": "Urgent"}
TITLE_FMT = "[Trend] Recurring %s issues (%d similar tickets)"
SUMMARY_HEAD_FMT = "Support trend detected: %d tickets with similarity >= "
IMPACT_FMT = "\n\nCustomer impact:\n- %d tickets, %d unique accounts, %d enterprise\n"
ARR_LINE = "- Est. ARR at risk: "
ARR_SOURCE = " (Salesforce)"
RECOMMEND_TEXT = "\n\nRecommend engineering review for potential systemic "
FREE_TEXT_HEAD = "Support trend detected from free-text input ("
TEXT_IMPACT_FMT = "\nCustomer impact:\n- %d tickets, %d unique accounts, %d enterprise\n- Est. ARR at risk: %s (Salesforce)\n"
TEXT_IDS_FMT = "\n\nSimilar ticket IDs (%d total, showing up to 20):\n"


def elevated_priority(base, count) -> Column:
    """count >= 50 or urgent -> urgent; count >= 20 or high -> high; else base (lower case)."""
    b = F.lower(F.col(base) if isinstance(base, str) else base)
    n = F.col(count) if isinstance(count, str) else count
    return (F.when((n >= URGENT_AT) | (b == "urgent"), "urgent")
            .when((n >= HIGH_AT) | (b == "high"), "high").otherwise(b))


def priority_display(p) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    m = F.create_map(*[F.lit(x) for kv in PRIORITY_DISPLAY.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(p)), title_case(p))


def first_ids(matches: DataFrame, n: int = MAX_DRAFT_IDS) -> DataFrame:
    """First ``n`` similar ids per trigger in id order, as ', '-joined text
    (a bounded group: at most ``n`` rows reach the collect)."""
    w = Window.partitionBy("t_id").orderBy("c_id")
    return (matches.select("t_id", "c_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
            .groupBy("t_id").agg(F.array_join(F.array_sort(F.collect_list("c_id")), ", ").alias("similar_ticket_ids")))


def sample_subjects(topk: DataFrame, n: int = SAMPLE_SUBJECTS) -> DataFrame:
    """Subjects of the first ``n`` nearest neighbours as '- s' lines."""
    s = (topk.where(F.col("rank") <= n)
         .groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("subject")))).alias("s")))
    return s.select(F.col("q_id").alias("t_id"),
                    F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["subject"])), "\n")
                    .alias("sample_lines"))


def engineering_drafts(trend: DataFrame, tickets: DataFrame, impact: DataFrame, ids: DataFrame,
                       samples: DataFrame, cfg: TrendConfig, only_flagged: bool = True) -> DataFrame:
    """G1: one draft per (flagged) trigger.

    ``trend``: id, category, subject, similar_count, is_potential_trend;
    ``impact``: output of ``impact_summary``; ``ids``: ``first_ids``;
    ``samples``: ``sample_subjects``.
    """
    t = trend.where(F.col("is_potential_trend")) if only_flagged else trend
    t = t.join(tickets.select("id", "priority"), "id")
    j = (t.join(impact.withColumnRenamed("trigger_id", "id"), "id", "left")
         .join(ids.withColumnRenamed("t_id", "id"), "id", "left")
         .join(samples.withColumnRenamed("t_id", "id"), "id", "left"))
    n = F.col("similar_count")
    title = F.format_string(TITLE_FMT, title_case("category"), n)
    summary = F.concat(
        F.format_string(SUMMARY_HEAD_FMT, n), pct0(F.lit(cfg.threshold)),
        F.lit(" to ticket "), F.col("id"), F.lit(".\n\nCategory: "), F.col("category"),
        F.lit("\nTrigger ticket: "), F.col("subject"),
        F.format_string(IMPACT_FMT, "total_tickets", "unique_accounts", "enterprise_accounts"),
        F.lit(ARR_LINE), F.col("arr_at_risk_formatted"), F.lit(ARR_SOURCE + "\n\nSample subjects:\n"),
        F.coalesce(F.col("sample_lines"), F.lit("")),
        F.lit(RECOMMEND_TEXT), F.col("category"), F.lit(" issue."),
    )
    return j.select(
        F.col("id").alias("trigger_ticket_id"), title.alias("title"), summary.alias("summary"),
        elevated_priority("priority", n).alias("priority"), "category", n.alias("similar_count"),
        F.coalesce(F.col("similar_ticket_ids"), F.lit("")).alias("similar_ticket_ids"),
        "total_tickets", "unique_accounts", "enterprise_accounts", "arr_at_risk", "arr_at_risk_formatted",
    )


def draft_text(drafts: DataFrame) -> DataFrame:
    """The printable block of a draft."""
    impact_line = F.format_string(TEXT_IMPACT_FMT, "total_tickets", "unique_accounts", "enterprise_accounts",
                                  "arr_at_risk_formatted")
    text = F.concat(
        F.lit("Title: "), F.col("title"), F.lit("\n\nPriority: "), priority_display("priority"),
        F.lit("\nCategory: "), F.col("category"), F.lit("\n"), impact_line,
        F.lit("\nSummary:\n"), F.col("summary"),
        F.format_string(TEXT_IDS_FMT, "similar_count"),
        F.col("similar_ticket_ids"))
    return drafts.select("trigger_ticket_id", text.alias("draft_text"))


def analysis_record(trend: DataFrame, topk: DataFrame, impact: DataFrame, drafts_df: DataFrame) -> DataFrame:
    """Similar tickets, trend, impact and (only when flagged) the draft title,
    one flat row per analysed ticket.  The top-k list is bounded by k."""
    sim = (topk.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "c_id"))).alias("s"))
           .select(F.col("q_id").alias("id"),
                   F.array_join(F.transform("s", lambda x: x["c_id"]), ", ").alias("similar_ids")))
    return (trend.join(sim, "id", "left")
            .join(impact.withColumnRenamed("trigger_id", "id"), "id", "left")
            .join(drafts_df.select(F.col("trigger_ticket_id").alias("id"), F.col("title").alias("draft_title")),
                  "id", "left")
            .select("id", "similar_ids", "similar_count", "is_potential_trend", "total_tickets", "unique_accounts",
                    "arr_at_risk_formatted", "draft_title"))


def pick_draft(trend: DataFrame, drafts_df: DataFrame, records: DataFrame) -> DataFrame:
    """The draft of the stored review, else the analysis draft, else a below-threshold row.  ``records``:
    ``review_record.review_records``."""
    rv = records.select(F.col("trigger_id").alias("id"), F.struct("title", "priority", "similar_count").alias("r"))
    d = drafts_df.select(F.col("trigger_ticket_id").alias("id"), F.struct("title", "priority", "similar_count").alias("a"))
    j = trend.select("id").join(rv, "id", "left").join(d, "id", "left").withColumn("p", F.coalesce("r", "a"))
    return j.select(
        F.col("id").alias("trigger_id"),
        F.when(F.col("r").isNotNull(), "review").when(F.col("a").isNotNull(), "analysis").otherwise("none").alias("source"),
        F.coalesce("p.title", F.lit("No engineering draft: below the trend threshold.")).alias("title"),
        F.col("p.priority").alias("priority"), F.col("p.similar_count").alias("similar_count"))


FREE_TEXT_LABEL_CHARS = 60          # fixed value: label of a free-text trigger


def freetext_drafts(ft_trend: DataFrame, impact: DataFrame, ids: DataFrame, queries: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Draft for a flagged free-text query: shorter summary, priority
    medium from 20 matches else low, no trigger ticket, impact of the
    matched tickets only (``impact``: ``clusters.cluster_impact`` of the queries; ``ids``: ``first_ids``; both by query_id)."""
    f = (ft_trend.where(F.col("is_potential_trend"))
         .join(queries.select("query_id", "subject"), "query_id", "left")
         .join(impact, "query_id", "left").join(ids, "query_id", "left"))
    n = F.col("similar_count")
    label = F.substring(F.coalesce("subject", F.lit("")), 1, FREE_TEXT_LABEL_CHARS)
    return f.select(
        "query_id",
        F.format_string(TITLE_FMT, title_case("category"), n).alias("title"),
        F.concat(F.lit(FREE_TEXT_HEAD), label,
                 F.format_string("): %d tickets with similarity >= ", n), pct0(F.lit(cfg.threshold)), F.lit("."))
        .alias("summary"),
        F.when(n >= HIGH_AT, "medium").otherwise("low").alias("priority"), "category", n.alias("similar_count"),
        F.coalesce("similar_ticket_ids", F.lit("")).alias("similar_ticket_ids"),
        F.coalesce("total_tickets", F.lit(0).cast("bigint")).alias("total_tickets"),
        F.coalesce("unique_accounts", F.lit(0).cast("bigint")).alias("unique_accounts"),
        F.coalesce("arr_at_risk_formatted", F.lit("$0")).alias("arr_at_risk_formatted"))
