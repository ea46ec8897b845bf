"""Investigation and review of a trend cluster.

Decisions are an append-only log ``(trigger_id, ticket_id, include,
decided_at)``; the latest decision per (trigger, ticket) wins.  A trigger
without decisions keeps every detected ticket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.functions.formats import title_case
from support_signals.functions.labels import parse_tags
from support_signals.functions.vectors import dot

# Fixed values of the reference: marker names per category, default marker,
# texts of the cluster events, index of the "threshold reached" ticket.
OPERATIONAL_EVENT_LABELS = {
    "identity": "SCIM authorization worker release",
    "api": "API gateway release",
    "billing": "Billing rules deployment",
    "notifications": "Notification worker deployment",
}
DEFAULT_OPERATION = "Service deployment"
MARKER_DETAIL = "Synthetic operational marker for investigation correlation; not evidence of causation."
CONFIRMED_DETAIL = "Reviewed ticket set and recalculated impact saved to the Jira draft."
MARKER_FRACTION = 0.3


def explanation(t_category: Column, c_category: Column, t_tags: Column, c_tags: Column) -> Column:
    """Why two tickets look alike (category and up to 3 shared tags)."""
    return _or_language(_reasons(t_category, c_category, _shared_tags(parse_tags(t_tags), parse_tags(c_tags))))


def _shared_tags(t_tags: Column, c_tags: Column) -> Column:
    return F.slice(F.sort_array(F.array_intersect(t_tags, c_tags)), 1, 3)


def _reasons(t_category: Column, c_category: Column, shared: Column) -> Column:
    same = F.when(c_category == t_category,
                  F.concat(F.lit("same "), F.replace(c_category, F.lit("_"), F.lit(" ")), F.lit(" category")))
    sig = F.when(F.size(shared) > 0, F.concat(F.lit("shared signals: "),
                                              F.upper(F.replace(F.array_join(shared, ", "), F.lit("-"), F.lit(" ")))))
    return F.concat_ws("; ", same, sig)


def _or_language(reasons: Column) -> Column:
    return F.when(reasons == "", F.lit("semantic language match")).otherwise(reasons)


def latest_decisions(log: DataFrame) -> DataFrame:
    """Last write per (trigger, ticket) wins (partial aggregation).  A log that is kept by ``grp`` (``clusters.listed_matches``)
    is not shuffled, and the decisions are kept in the same way."""
    return (log.groupBy("trigger_id", "ticket_id", *placed(log))
            .agg(F.max_by("include", F.struct("decided_at", "seq")).alias("include")))


def latest_in(entries: Column) -> Column:
    """A19 where all decisions on a pair are kept beside it, as an array of (decided_at, seq, include): the last write's
    ``include``, null without a decision."""
    return F.array_max(entries).getField("include")


def placed(*tables: DataFrame) -> list[str]:
    """The columns, functions of the two ids, by which all of the tables keep a (trigger, ticket) pair."""
    return [c for c in ("grp", "many") if all(c in t.columns for t in tables)]


def score_candidates(pairs: DataFrame, tickets: DataFrame) -> DataFrame:
    """Exact score of (trigger_id, ticket_id) pairs; unknown ids and the
    trigger itself are dropped."""
    v = tickets.select("id", "embedding")
    p = pairs.select("trigger_id", "ticket_id").where(F.col("trigger_id") != F.col("ticket_id")).distinct()
    return (p.join(v.withColumnRenamed("id", "trigger_id").withColumnRenamed("embedding", "tv"), "trigger_id")
            .join(v.withColumnRenamed("id", "ticket_id").withColumnRenamed("embedding", "cv"), "ticket_id")
            .select("trigger_id", "ticket_id", dot("tv", "cv").alias("score")))


def review_candidates(matches: DataFrame, tickets: DataFrame, tiers: DataFrame, carried: bool = False) -> DataFrame:
    """Detected tickets of each trigger with score, explanation, status and tier.

    ``carried``: the matches have these columns of both tickets (``clusters.listed_matches``), and their ids and accounts have one
    row each, so nothing is joined."""
    if carried:
        return _shown(matches, F.col("category"), F.col("category"), F.col("t_tags"), F.col("c_tags"), F.col("c_subject"),
                      F.col("c_status"), F.col("c_tier"))
    t = tickets.select(F.col("id").alias("t_id"), F.col("category").alias("tc"), F.col("tags").alias("tt"))
    c = (tickets.select(F.col("id").alias("c_id"), F.col("category").alias("cc"), F.col("tags").alias("ct"),
                        "status", "subject", "account_id")
         .join(tiers, "account_id", "left"))
    j = matches.select("t_id", "c_id", "score", *placed(matches)).join(t, "t_id").join(c, "c_id")
    return _shown(j, F.col("tc"), F.col("cc"), F.col("tt"), F.col("ct"), F.col("subject"),
                  title_case(F.coalesce("status", F.lit(""))), title_case(F.coalesce("customer_tier", F.lit(""))))


def candidates_beside(matches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """G5 of ``clusters.single_matches`` with their decisions beside them (``entries``): the given columns of ``with_inclusion`` and
    ``review_candidates``.  Tags are lists."""
    if "explanation" in columns:               # step by step, so that nothing is computed twice
        matches = matches.withColumn("_shared", _shared_tags(F.col("t_tags"), F.col("c_tags")))
        matches = matches.withColumn("_reasons", _reasons(F.col("category"), F.col("category"), F.col("_shared")))
    shown = {"subject": F.col("c_subject"), "status": F.col("c_status"), "tier": F.col("c_tier"), "score": F.col("score"),
             "explanation": _or_language(F.col("_reasons")),
             "included": F.coalesce(latest_in(F.col("entries")), F.lit(True))}
    return matches.select(F.col("t_id").alias("trigger_id"), F.col("c_id").alias("candidate_id"),
                          *[shown[c].alias(c) for c in columns])


def _shown(j: DataFrame, t_category: Column, c_category: Column, t_tags: Column, c_tags: Column, subject: Column,
           status: Column, tier: Column) -> DataFrame:
    return j.select(
        F.col("t_id").alias("trigger_id"), F.col("c_id").alias("candidate_id"), *placed(j), "score", subject.alias("subject"),
        explanation(t_category, c_category, t_tags, c_tags).alias("explanation"), status.alias("status"), tier.alias("tier"))


def decided(pairs: DataFrame, decisions: DataFrame, trigger: str, ticket: str) -> DataFrame:
    """``pairs`` with the ``include`` of their decision (one per pair of ids), null without one.

    Pairs and decisions kept by ``grp`` meet where they are: as a join by several columns would shuffle both sides, a decision is
    a row beside its pair, and a window over the two ids hands it on."""
    at = placed(pairs, decisions)
    d = decisions.select(F.col("trigger_id").alias(trigger), F.col("ticket_id").alias(ticket), *at, "include")
    if "grp" not in at:
        return pairs.join(d, [trigger, ticket], "left")
    rest = [c for c in pairs.columns if c not in (trigger, ticket, *at)]
    keys = [trigger, ticket, *at]
    null = F.lit(None)
    rows = (pairs.select(*keys, F.lit(True).alias("_pair"), null.cast("boolean").alias("_include"), *rest)
            .union(d.select(*keys, F.lit(False), "include", *[null.cast(pairs.schema[c].dataType) for c in rest])))
    # a null id has no decision, as in a join
    known = F.col(trigger).isNotNull() & F.col(ticket).isNotNull()
    found = F.when(known, F.max("_include").over(Window.partitionBy(*keys)))
    return rows.withColumn("include", found).where("_pair").drop("_pair", "_include")


def with_inclusion(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attach ``included``: the stored decision, else True (default = all)."""
    return (decided(candidates, decisions, "trigger_id", "candidate_id")
            .withColumn("included", F.coalesce("include", F.lit(True))).drop("include"))


def candidate_filter(cands: DataFrame, search: str = "", statuses=(), tiers=(), min_score: int = 0,
                     review: str = "All") -> DataFrame:
    """the investigation table filter (all conditions conjunctive)."""
    return cands.where(filter_condition(search, statuses, tiers, min_score, review))


def filter_condition(search: str = "", statuses=(), tiers=(), min_score: int = 0, review: str = "All") -> Column:
    cond = F.lit(True)
    q = search.strip().lower()
    if q:
        cond &= F.lower(F.concat_ws(" ", "candidate_id", "subject")).contains(q)
    if statuses:
        cond &= F.col("status").isin(*statuses)
    if tiers:
        cond &= F.col("tier").isin(*tiers)
    cond &= ~(F.col("score") * 100 < F.lit(min_score))
    if review == "Included":
        cond &= F.col("included")
    elif review == "Excluded":
        cond &= ~F.col("included")
    return cond


def candidate_facets(cands: DataFrame, shown: Column) -> DataFrame:
    """distinct statuses / tiers (bounded domains) and shown / included / excluded counts; ``shown``: the condition of the
    table filter (``filter_condition``).

    One pass: candidates are counted by status and tier in the task that reads them, so the sets are of a few rows."""
    per = cands.groupBy("trigger_id", "status", "tier").agg(
        F.count_if(shown).alias("shown"), F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))
    return per.groupBy("trigger_id").agg(
        F.array_join(F.sort_array(F.collect_set("status")), "|").alias("statuses"),
        F.array_join(F.sort_array(F.collect_set("tier")), "|").alias("tiers"),
        *[F.sum(c).alias(c) for c in ("shown", "included", "excluded")])


def id_signature(ids: Column) -> Column:
    """Order-insensitive signature of an id set (aggregate): XOR of 60-bit md5 prefixes."""
    return F.bit_xor(id_hash(ids))


def id_hash(ids: Column) -> Column:
    return F.conv(F.substring(F.md5(ids), 1, 15), 16, 10).cast("bigint")


def reviewed_members(matches: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """F8: included (trigger, ticket) pairs: stored decision if any, else included.  Without ``decisions`` they are beside the
    matches (``entries``)."""
    if decisions is None:
        return matches.where(F.coalesce(latest_in(F.col("entries")), F.lit(True))).drop("entries")
    return decided(matches, decisions, "t_id", "c_id").where(F.coalesce("include", F.lit(True))).drop("include")


def reviewed_trend(included: DataFrame, triggers: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Count, flag and signature recomputed from the included ids (``c_sig``: their hashes, if at hand)."""
    signature = F.bit_xor("c_sig") if "c_sig" in included.columns else id_signature(F.col("c_id"))
    per = included.groupBy(F.col("t_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), signature.alias("signature"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return (triggers.select("id").join(per, "id", "left")
            .select(F.col("id").alias("trigger_id"), n.alias("similar_count"),
                    (n >= cfg.min_count).alias("is_potential_trend"),
                    F.coalesce("signature", F.lit(0).cast("bigint")).alias("signature")))


def cluster_events(members: DataFrame, tickets: DataFrame, confirmed: DataFrame) -> DataFrame:
    """First report, synthetic marker at first + 30 % of the span,
    threshold ticket (4th earliest, or the last one of a smaller cluster),
    trigger analysed, and a confirmed-review row without a time.

    Only the 4 earliest members per cluster are ranked (per-task top-k before
    the shuffle), the rest is partial aggregation.  Members may be given as
    their earliest ones alone, each with the number ``n`` of members that it
    stands for (``clusters.earliest_members``).
    """
    subj = tickets.select(F.col("id").alias("ticket_id"), "subject", F.col("category").alias("cat"))
    stands_for = F.col("n") if "n" in members.columns else F.lit(1)
    m = members.select("trigger_id", "ticket_id", "ts", "is_trigger", stands_for.alias("k"))
    n = m.groupBy("trigger_id").agg(F.sum("k").alias("n"),
                                    F.max_by(F.struct("ts", "ticket_id"), "is_trigger").alias("trig"))
    w = Window.partitionBy("trigger_id").orderBy("ts", "ticket_id")
    early = m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 4)
    j = early.join(n, "trigger_id")
    picked = j.groupBy("trigger_id").agg(
        F.max_by(F.struct("ts", "ticket_id"), F.when(F.col("r") == 1, 1).otherwise(0)).alias("first"),
        F.max_by(F.struct("ts", "ticket_id"), F.when(F.col("r") == F.least(F.lit(4), F.col("n")), 1).otherwise(0))
        .alias("thr"),
        F.first("trig").alias("trig"))
    span = F.greatest(F.timestamp_diff("MICROSECOND", F.col("first.ts"), F.col("trig.ts")), F.lit(1))
    op_at = F.timestamp_add("MICROSECOND", F.bround(span * MARKER_FRACTION, 0).cast("bigint"), F.col("first.ts"))
    cat = tickets.select(F.col("id").alias("trigger_id"), F.col("category"))
    names = F.create_map(*[F.lit(x) for kv in OPERATIONAL_EVENT_LABELS.items() for x in kv])
    p = (picked.join(cat, "trigger_id")
         .join(subj.select(F.col("ticket_id").alias("first_id"), F.col("subject").alias("first_subject")),
               F.col("first.ticket_id") == F.col("first_id"), "left")
         .join(confirmed.select(F.col("trigger_id").alias("cid")).distinct(), F.col("trigger_id") == F.col("cid"), "left"))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    def row(seq, at, title, detail, kind):
        return F.struct(F.lit(seq).alias("seq"), at.alias("at"), title.alias("title"), detail.alias("detail"),
                        F.lit(kind).alias("kind"))

    ev = F.array(
        row(1, F.date_format("first.ts", fmt), F.lit("First matching support report"),
            F.concat(F.col("first.ticket_id"), F.lit(" - "), F.col("first_subject")), ""),
        row(2, F.date_format(op_at, fmt),
            F.coalesce(F.element_at(names, F.col("category")), F.lit(DEFAULT_OPERATION)), F.lit(MARKER_DETAIL),
            "synthetic"),
        row(3, F.date_format("thr.ts", fmt), F.lit("Trend threshold reached"),
            F.concat(F.col("thr.ticket_id"), F.lit(" supplied the required earlier-match volume.")), ""),
        row(4, F.date_format("trig.ts", fmt), F.lit("Trigger ticket analyzed"),
            F.concat(F.col("trig.ticket_id"), F.lit(" opened the current investigation.")), ""),
        F.when(F.col("cid").isNotNull(), row(5, F.lit(None).cast("string"), F.lit("Support review confirmed"),
                                             F.lit(CONFIRMED_DETAIL), "confirmed")),
    )
    return (p.select("trigger_id", F.explode(F.filter(ev, lambda e: e.isNotNull())).alias("e"))
            .select("trigger_id", F.col("e.seq").alias("seq"), F.col("e.at").alias("at"),
                    F.col("e.title").alias("title"), F.col("e.detail").alias("detail"), F.col("e.kind").alias("kind")))
