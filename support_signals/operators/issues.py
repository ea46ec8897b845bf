"""Engineering issue backlog.

Issues are a DataFrame keyed by ``issue_key`` (``ENG-<n>``); at most one
issue per trigger ticket is updated by the upsert (the first by key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from support_signals.functions.formats import title_case
from support_signals.operators.ordering import global_rank

# ---- fixed values of the reference --------------------------------------
PROJECT_KEY = "ENG"
FIRST_KEY_NUMBER = 101                    # max(empty) defaults to 100
DEFAULT_LABELS = ("trend-warning", "support-escalation")
SKIP_LABELS = ("support-escalation", "trend-warning")
COMPONENT_PILLS = {
    "api": "API", "billing": "BILLING", "mobile": "MOBILE", "sso": "ACCOUNTS", "export": "EXPORT",
    "performance": "PERFORMANCE", "integrations": "INTEGRATIONS", "database": "DATABASE",
    "feature-flags": "FLAGS", "notifications": "NOTIFICATIONS", "feedback": "FEEDBACK",
}
ISSUE_TYPES = ("Bug", "Task", "Story")
FORM_TYPES = ("Bug", "Task")
FORM_PRIORITIES = ("Low", "Medium", "High", "Urgent")
STATUS_FILTERS = {"open": "Open", "in_progress": "In Progress", "done": "Done", "todo": "To Do"}
ENRICHMENT_FIELDS = (
    ("expected_behavior", "Expected behavior"),
    ("actual_behavior", "Actual behavior"),
    ("reproduction_steps", "Reproduction steps"),
    ("environment", "Environment / version"),
)
DEFAULT_SUMMARY = "Support trend investigation"
DEFAULT_ASSIGNEE = "Unassigned"
DEFAULT_REPORTER = "Support Operations"
SPRINT_SIZE = 8
ISSUE_PAGE_SIZE = 25
PREVIEW_IDS = 12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pystrip(x) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace (not only blanks)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def normalize_labels(labels_text, category) -> Column:
    """NULL -> the two default labels + category; text split on commas,
    trimmed, blanks dropped."""
    t = _c(labels_text)
    parts = F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), ","), lambda x: pystrip(x)), lambda x: x != "")
    return F.when(t.isNull(), F.array(*[F.lit(x) for x in DEFAULT_LABELS], _c(category))).otherwise(parts)


def component_label(labels) -> Column:
    """First label outside the skip set, mapped to its pill name, else upper case."""
    first = F.try_element_at(F.filter(_c(labels), lambda x: ~x.isin(*SKIP_LABELS)), F.lit(1))
    pills = F.create_map(*[F.lit(x) for kv in COMPONENT_PILLS.items() for x in kv])
    return F.coalesce(F.element_at(pills, first), F.upper(F.regexp_replace(first, "-", " ")))


def description_with_enrichment(description, prefix: str = "") -> Column:
    """Non-empty enrichment sections appended after the description."""
    secs = [F.when(pystrip(F.coalesce(F.col(prefix + k), F.lit(""))) != "",
                   F.concat(F.lit(f"{label}:\n"), pystrip(F.col(prefix + k))))
            for k, label in ENRICHMENT_FIELDS]
    any_sec = F.concat_ws("", *secs) != ""
    d = _c(description)
    return F.when(any_sec, F.concat_ws("\n\n", F.regexp_replace(d, r"\s+$", ""), *secs)).otherwise(d)


def key_number(key) -> Column:
    """The digits after ``ENG-`` (NULL when not of that form)."""
    return F.regexp_extract(_c(key), rf"^{PROJECT_KEY}-(\d+)$", 1).try_cast("bigint")


def issue_type(t) -> Column:
    """Unknown issue types fall back to Bug."""
    x = _c(t)
    return F.when(x.isin(*ISSUE_TYPES), x).otherwise("Bug")


def status_key(status) -> Column:
    """Lower case, blanks to underscores; unknown -> open."""
    k = F.regexp_replace(F.lower(_c(status)), " ", "_")
    return F.when(k.isin("done", "in_progress", "to_do"), k).otherwise("open")


def priority_key(priority) -> Column:
    k = F.lower(_c(priority))
    return F.when(k.isin("urgent", "high", "medium"), k).otherwise("low")


def issue_filter(issues: DataFrame, status_filter: str = "all", search: str = "") -> DataFrame:
    """status chip + substring search over key, summary, assignee, reporter, labels."""
    cond = F.lit(True)
    target = STATUS_FILTERS.get(status_filter) if status_filter != "all" else None
    if target:
        cond &= F.col("status") == target
    q = search.lower()
    if q:
        def has(c):
            return F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
        cond &= (has("issue_key") | has("summary") | has("assignee") | has("reporter")
                 | F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(x).contains(q)))
    return issues.where(cond)


def first_issue_per_trigger(issues: DataFrame) -> DataFrame:
    """the first issue (lowest key number) linked to each trigger ticket."""
    return (issues.where(F.col("trigger_ticket_id").isNotNull())
            .groupBy("trigger_ticket_id")
            .agg(F.min_by("issue_key", "key_no").alias("issue_key"), F.min("key_no").alias("key_no"),
                 F.count(F.lit(1)).alias("linked_issues")))


def issue_by_key(issues: DataFrame, keys: DataFrame) -> DataFrame:
    """of every requested ``issue_key`` whether there is such an issue, and the first one (lowest key number) if so.

    Requests are looked up with one join, repeated ones once; a null key finds nothing."""
    first = (issues.where(F.col("issue_key").isNotNull()).groupBy("issue_key")
             .agg(F.min_by(F.struct("status", "priority", "summary", "assignee", "trigger_ticket_id"), "key_no").alias("i")))
    return (keys.select("issue_key").distinct().join(first, "issue_key", "left")
            .select("issue_key", F.col("i").isNotNull().alias("found"), "i.*"))


def issue_links(issues: DataFrame, tickets: DataFrame) -> DataFrame:
    """per ticket whether an issue is linked to it, and the key of the first such issue."""
    first = first_issue_per_trigger(issues).select(F.col("trigger_ticket_id").alias("id"), "issue_key", "linked_issues")
    return (tickets.select("id").join(first, "id", "left")
            .select("id", F.col("issue_key").isNotNull().alias("linked"), "issue_key",
                    F.coalesce("linked_issues", F.lit(0)).cast("bigint").alias("linked_issues")))


def ticket_count(*counts: Column | str) -> Column:
    """The first of the counts that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in counts], F.lit(0))


def issue_page(issues: DataFrame, page: int = 0, size: int = ISSUE_PAGE_SIZE) -> DataFrame:
    """One page in key order with its 'Showing x-y of n' caption.

    Sort + offset + limit runs as a per-task top-(offset + size) and a merge;
    only the page rows reach the window that numbers them."""
    total = issues.select(F.count(F.lit(1))).scalar()            # scalar subquery
    start = page * size
    rows = (issues.orderBy("key_no").offset(start).limit(size)
            .withColumn("pos", (F.row_number().over(Window.orderBy("key_no")) + start).cast("bigint")))
    cap = F.when(F.col("n") > 0, F.format_string("Showing %d–%d of %d", F.lit(start + 1),
                                                 F.least(F.lit(start + size), F.col("n")), F.col("n"))) \
        .otherwise(F.lit("0 issues"))
    return rows.withColumn("n", total).select("issue_key", "pos", "status", cap.alias("caption"))


def sprint_split(issues: DataFrame, size: int = SPRINT_SIZE) -> DataFrame:
    """The first ``size`` issues in key order form the sprint; the rest is counted."""
    w = Window.orderBy("key_no")           # only the first `size` rows reach this window
    sprint = issues.orderBy("key_no").limit(size).withColumn("pos", F.row_number().over(w))
    backlog = issues.select(F.greatest(F.count(F.lit(1)) - size, F.lit(0))).scalar()     # scalar subquery
    return sprint.select("issue_key", F.col("pos").cast("bigint"), backlog.alias("backlog_count"))


def draft_issue_fields(drafts: DataFrame) -> DataFrame:
    """Issue fields from a draft (+ optional enrichment/edit columns)."""
    cols = set(drafts.columns)

    def opt(name, typ="string"):
        return F.col(name) if name in cols else F.lit(None).cast(typ)

    count = F.coalesce(opt("zendesk_ticket_count", "bigint"), opt("total_tickets", "bigint"), F.lit(0).cast("bigint"))
    arr = F.coalesce(F.nullif(opt("arr_at_risk_text"), F.lit("")), opt("arr_at_risk_formatted"), F.lit("$0"))
    category = F.coalesce(opt("category"), F.lit("support"))
    out = drafts.select(
        F.col("trigger_ticket_id"),
        title_case(F.coalesce(opt("priority"), F.lit("medium"))).alias("priority"),
        F.coalesce(opt("title"), F.lit(DEFAULT_SUMMARY)).alias("summary"),
        description_with_enrichment(F.coalesce(opt("summary"), F.lit("Support trend detected."))).alias("description"),
        normalize_labels(opt("labels"), category).alias("labels"),
        F.coalesce(opt("similar_count", "bigint"), F.lit(0).cast("bigint")).alias("similar_ticket_count"),
        count.alias("zendesk_ticket_count"), arr.alias("arr_at_risk"),
        F.coalesce(F.nullif(opt("assignee"), F.lit("")), F.lit(DEFAULT_ASSIGNEE)).alias("assignee"),
        issue_type(F.coalesce(opt("issue_type"), opt("type"), F.lit("Bug"))).alias("type"),
        *[pystrip(F.coalesce(opt(k), F.lit(""))).alias(k) for k, _ in ENRICHMENT_FIELDS],
    )
    return out


ISSUE_COLUMNS = ("issue_key", "key_no", "type", "status", "priority", "summary", "description", "labels",
                 "assignee", "reporter", "created", "trigger_ticket_id", "similar_ticket_count",
                 "zendesk_ticket_count", "arr_at_risk")


def conform_issues(issues: DataFrame) -> DataFrame:
    """Give a seed issue table every backlog column (missing ones NULL / defaults)."""
    cols = set(issues.columns)
    defaults = {"type": F.lit("Bug"), "description": F.lit(None).cast("string"),
                "labels": F.array().cast("array<string>"), "reporter": F.lit(DEFAULT_REPORTER),
                "similar_ticket_count": F.lit(None).cast("bigint"), "zendesk_ticket_count": F.lit(None).cast("bigint"),
                "arr_at_risk": F.lit(None).cast("string")}
    add = {k: v for k, v in defaults.items() if k not in cols}
    out = issues.withColumns(add) if add else issues
    if "key_no" not in cols:
        out = out.withColumn("key_no", key_number("issue_key"))
    return out.select(*ISSUE_COLUMNS)


def without_trigger(issues: DataFrame) -> DataFrame:
    """Issues that belong to no ticket: most of a backlog.  They join with nothing, so they stay out of the joins on the
    trigger, where their null keys would meet in one task."""
    return issues.where(F.col("trigger_ticket_id").isNull())


def upsert_issues(issues: DataFrame, fields: DataFrame, created) -> DataFrame:
    """One issue per trigger ticket.

    The first issue of a trigger takes the new fields and type and keeps its
    key, status, reporter and created date; triggers without an issue get new
    keys ``max + 1, max + 2, ...`` in trigger-id order, status Open.
    """
    base = conform_issues(issues)
    plain, linked = without_trigger(base), base.where(F.col("trigger_ticket_id").isNotNull())
    first = first_issue_per_trigger(base).select("trigger_ticket_id", F.col("key_no").alias("_first"))
    f = fields.select(F.col("trigger_ticket_id").alias("f_tid"),
                      *[F.col(c).alias("n_" + c) for c in fields.columns if c != "trigger_ticket_id"])
    upd = (linked.join(first, "trigger_ticket_id", "left")
           .join(f, (F.col("_first") == F.col("key_no")) & (F.col("trigger_ticket_id") == F.col("f_tid")), "left"))
    hit = F.col("n_summary").isNotNull()

    def pick(c):
        return F.when(hit, F.col("n_" + c)).otherwise(F.col(c)).alias(c)

    updated = upd.select("issue_key", "key_no", pick("type"), "status", pick("priority"), pick("summary"),
                         pick("description"), pick("labels"), pick("assignee"), "reporter", "created",
                         "trigger_ticket_id", pick("similar_ticket_count"), pick("zendesk_ticket_count"),
                         pick("arr_at_risk"))
    new = fields.join(first, "trigger_ticket_id", "left_anti")
    top = base.select(F.coalesce(F.max(key_number("issue_key")), F.lit(FIRST_KEY_NUMBER - 1))).scalar()
    ranked = global_rank(new, F.asc("trigger_ticket_id"), name="_r")
    fresh = (ranked.withColumn("_max", top)
             .select(F.concat(F.lit(f"{PROJECT_KEY}-"), (F.col("_max") + F.col("_r")).cast("string")).alias("issue_key"),
                     (F.col("_max") + F.col("_r")).alias("key_no"), "type", F.lit("Open").alias("status"),
                     "priority", "summary", "description", "labels", "assignee",
                     F.lit(DEFAULT_REPORTER).alias("reporter"), _c(created).cast("date").alias("created"),
                     "trigger_ticket_id", "similar_ticket_count", "zendesk_ticket_count", "arr_at_risk"))
    return updated.unionByName(plain.select(*updated.columns)).unionByName(fresh)


def merge_edits(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """Form edits over a draft; NULL edits keep the draft value, blank
    title/assignee/category fall back to their defaults."""
    e = edits.select("trigger_ticket_id", *[F.col(c).alias("e_" + c) for c in edits.columns if c != "trigger_ticket_id"])
    j = drafts.join(e, "trigger_ticket_id", "left")
    has = F.col("e_summary").isNotNull()
    out = j.select(
        "trigger_ticket_id",
        F.when(has, F.coalesce(F.nullif(pystrip("e_summary"), F.lit("")), F.lit(DEFAULT_SUMMARY))).otherwise(F.col("title")).alias("title"),
        F.when(has, F.col("e_description")).otherwise(F.col("summary")).alias("summary"),
        F.when(has, F.lower("e_priority")).otherwise(F.col("priority")).alias("priority"),
        F.when(has, F.col("e_issue_type")).otherwise(F.lit(None).cast("string")).alias("issue_type"),
        F.when(has, F.coalesce(F.nullif(pystrip("e_category"), F.lit("")), F.col("category"), F.lit("support")))
        .otherwise(F.col("category")).alias("category"),
        F.when(has, F.col("e_labels")).otherwise(F.lit(None).cast("string")).alias("labels"),
        F.when(F.col("e_assignee").isNotNull(),
               F.coalesce(F.nullif(pystrip("e_assignee"), F.lit("")), F.lit(DEFAULT_ASSIGNEE))).alias("assignee"),
        "similar_count", "similar_ticket_ids", "total_tickets", "arr_at_risk_formatted", "unique_accounts",
    )
    return out


def hydrate(issues: DataFrame, live: DataFrame) -> DataFrame:
    """Issues linked to a known trigger take the live analysis metrics;
    unlinked issues and stale triggers stay unchanged.  ``live``: per
    trigger_ticket_id title, summary, priority, similar_count, total_tickets,
    arr_at_risk_formatted."""
    lv = live.select("trigger_ticket_id", *[F.col(c).alias("l_" + c) for c in
                                            ("title", "summary", "priority", "similar_count", "total_tickets",
                                             "arr_at_risk_formatted")])
    absent = [F.lit(None).cast(lv.schema[c].dataType).alias(c) for c in lv.columns if c != "trigger_ticket_id"]
    j = (issues.where(F.col("trigger_ticket_id").isNotNull()).join(lv, "trigger_ticket_id", "left")
         .unionByName(without_trigger(issues).select("*", *absent)))
    hit = F.col("l_title").isNotNull()
    return j.select(
        "issue_key", "trigger_ticket_id",
        F.when(hit, F.col("l_title")).otherwise(F.col("summary")).alias("summary"),
        F.when(hit, F.initcap("l_priority")).otherwise(F.col("priority")).alias("priority"),
        F.when(hit, F.col("l_similar_count")).alias("similar_ticket_count"),
        F.when(hit, F.col("l_total_tickets")).alias("zendesk_ticket_count"),
        F.when(hit, F.col("l_arr_at_risk_formatted")).alias("arr_at_risk"),
        F.when(hit, F.lit("live")).otherwise(F.lit("stored")).alias("analysis_source"),
        F.when(hit, F.sha2(F.col("l_summary"), 256)).alias("description_sha"),
    )


def linked_tickets(matches: DataFrame | None, tickets: DataFrame, triggers: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """C11: the trigger (relationship 'Trigger') and its similar tickets ('Similar') with subjects.

    ``carried``: matches whose ids have one ticket each and that have its subject (``c_subject``), so they are joined with nothing."""
    subj = tickets.select(F.col("id").alias("ticket_id"), "subject")
    similar = [F.col("t_id").alias("trigger_id"), F.col("c_id").alias("ticket_id"), F.lit("Similar").alias("relationship")]
    rows = triggers.select(F.col("id").alias("trigger_id"), F.col("id").alias("ticket_id"),
                           F.lit("Trigger").alias("relationship"))
    if matches is not None:
        rows = matches.select(*similar).unionByName(rows)
    named = rows.join(subj, "ticket_id", "left")
    if carried is not None:
        named = named.unionByName(carried.select(*similar, F.col("c_subject").alias("subject")))
    return named.select("trigger_id", "ticket_id", F.coalesce("subject", "ticket_id").alias("subject"), "relationship")


def create_defaults(drafts: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Create-form defaults: stored enrichment over the draft, priority and
    type coerced to the form's lists, linked count, 12-id preview."""
    e = enrichment.withColumnRenamed("ticket_id", "trigger_ticket_id")
    d = drafts.join(e, "trigger_ticket_id", "left")
    ids = F.filter(F.split(F.coalesce("similar_ticket_ids", F.lit("")), r",\s*"), lambda x: x != "")
    pr = title_case(F.coalesce("priority", F.lit("medium")))
    return d.select(
        "trigger_ticket_id",
        F.when(pr.isin(*FORM_PRIORITIES), pr).otherwise("Medium").alias("priority"),
        F.lit("Bug").alias("issue_type"),
        F.array_join(normalize_labels(F.lit(None).cast("string"), F.coalesce("category", F.lit("support"))), ", ")
        .alias("labels"),
        F.coalesce(F.nullif(F.col("total_tickets"), F.lit(0)), (F.size(ids) + 1).cast("bigint")).alias("linked_count"),
        F.coalesce("arr_at_risk_formatted", F.lit("$0")).alias("arr_default"),
        F.concat(F.array_join(F.slice(ids, 1, PREVIEW_IDS), ", "),
                 F.when(F.size(ids) > PREVIEW_IDS, F.lit("…")).otherwise(F.lit(""))).alias("linked_preview"),
        *[F.coalesce(F.col(k), F.lit("")).alias(k) for k, _ in ENRICHMENT_FIELDS],
    )
