"""Helpdesk queue operators: counts, views, search, paging, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from support_signals.functions import labels as L

FACETS = ("unsolved", "unassigned", "All", "open")     # fixed facet order


def view_predicate(view: str) -> Column:
    """row filter of a queue view (a category name filters on category)."""
    status = F.col("status")
    if view == "All":
        return F.lit(True)
    if view == "unsolved":
        return status.isin("open", "pending")
    if view == "unassigned":
        return (status == "open") & L.is_unassigned("assignee")
    if view == "open":
        return status == "open"
    return F.col("category") == view


def search_predicate(term: str, fields: list[Column]) -> Column:
    """case-insensitive substring over any field; blank matches all."""
    q = term.strip().lower()
    if not q:
        return F.lit(True)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.coalesce(f.cast("string"), F.lit(""))).contains(q)
    return hit


def search_fields(tickets: DataFrame) -> list[Column]:
    cols = set(tickets.columns)
    email = F.col("requester_email") if "requester_email" in cols else F.lit(None).cast("string")
    given = F.col("requester_name") if "requester_name" in cols else None
    return [F.col("id"), F.col("subject"), F.col("body"), email, L.requester_name("id", given)]


def category_counts(tickets: DataFrame) -> DataFrame:
    """C5."""
    return tickets.groupBy("category").agg(F.count(F.lit(1)).alias("n_tickets"))


def queue_facets(tickets: DataFrame) -> DataFrame:
    """Four counts in one pass."""
    return tickets.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(view_predicate("unsolved")).alias("unsolved"),
        F.count_if(view_predicate("unassigned")).alias("unassigned"),
        F.count_if(view_predicate("open")).alias("open"),
    )


def view_counts(tickets: DataFrame, view_order: list[str] | None = None) -> DataFrame:
    """Facet counts, then the categories of ``view_order`` that occur."""
    order = view_order or L.VIEW_ORDER
    f = queue_facets(tickets)
    facets = f.selectExpr("stack(4, 'unsolved', unsolved, 0, 'unassigned', unassigned, 1, "
                          "'All', total, 2, 'open', open, 3) AS (view, n_tickets, ord)")
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i + len(FACETS))])
    cats = (category_counts(tickets).where(F.col("category").isin(*order))
            .select(F.col("category").alias("view"), "n_tickets", F.element_at(rank, F.col("category")).alias("ord")))
    return (facets.unionByName(cats)
            .select("view", L.view_label("view").alias("label"), F.col("n_tickets").cast("bigint"),
                    F.col("ord").cast("int")))


def view_filter(tickets: DataFrame, views: list[str]) -> DataFrame:
    """F1 for several views at once: (view, id) rows."""
    out = None
    for v in views:
        part = tickets.where(view_predicate(v)).select(F.lit(v).alias("view"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def ticket_page(tickets: DataFrame, view: str = "All", search: str = "", page: int = 0,
                page_size: int = L.PAGE_SIZE) -> DataFrame:
    """One page of a view, newest first, with the total and page count.

    Sort + offset + limit is a per-task top-(offset+limit) and a merge; the
    total is a separate one-row aggregate joined as a broadcast scalar.
    """
    rows = tickets.where(view_predicate(view) & search_predicate(search, search_fields(tickets)))
    page_rows = (rows.orderBy(F.desc("created_at"), F.asc("id")).offset(page * page_size).limit(page_size))
    w = Window.orderBy(F.desc("created_at"), F.asc("id"))   # <= page_size rows: single partition is fine
    total = rows.select(F.count(F.lit(1))).scalar()              # scalar subquery
    return (page_rows.withColumn("pos", F.row_number().over(w) + page * page_size)
            .withColumn("total", total)
            .select("id", F.col("pos").cast("bigint"), "status", "category",
                    L.assignee_display("id", "assignee").alias("assignee"),
                    L.requester_name("id").alias("requester_name"), L.channel("id").alias("channel"),
                    L.ticket_form("category").alias("ticket_form"), F.col("total").cast("bigint"),
                    F.ceil(F.col("total") / F.lit(page_size)).cast("bigint").alias("pages")))


def interaction_history(tickets: DataFrame, limit: int = 3) -> DataFrame:
    """The ``limit`` newest *other* tickets of the same account.

    The newest ``limit + 1`` tickets per account are kept first (a per-task
    top-k before the shuffle, so a hot account never gathers all its rows in
    one task); each ticket then picks ``limit`` of those that are not itself.
    """
    acc = tickets.where(F.col("account_id").isNotNull())
    w = Window.partitionBy("account_id").orderBy(F.desc("h_ts"), F.asc("history_id"))
    newest = (acc.select("account_id", F.col("id").alias("history_id"), F.col("created_at").alias("h_ts"),
                         F.col("status").alias("history_status"))
              .withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit + 1))
    j = acc.select("id", "account_id").join(newest, "account_id").where(F.col("history_id") != F.col("id"))
    w2 = Window.partitionBy("id").orderBy(F.desc("h_ts"), F.asc("history_id"))
    return (j.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= limit)
            .select("id", F.col("rank").cast("bigint"), "history_id", "history_status"))


def latest_comment(tickets: DataFrame, messages: DataFrame) -> DataFrame:
    """Last non-internal message, else the last message; a ticket without
    messages falls back to its body as a public customer message."""
    m = (messages.groupBy("ticket_no")
         .agg(F.max_by(F.struct("pos", "author", "type", "text"),
                       F.struct((F.col("type") != "internal").alias("pub"), F.col("pos"))).alias("m")))
    j = tickets.select("id", "ticket_no", "body").join(m, "ticket_no", "left")
    return j.select(
        "id",
        F.col("m.pos").alias("pos"),
        F.coalesce(F.col("m.author"), F.lit("customer")).alias("author"),
        F.coalesce(F.col("m.type"), F.lit("public")).alias("type"),
        F.coalesce(F.col("m.text"), F.col("body")).alias("text"),
    )


def timeline(members: DataFrame, newest: int = 12) -> DataFrame:
    """Ticket volume per hour (cluster spans < 2 days) or per day, the
    newest ``newest`` buckets of each cluster, bar height max(8, round(n/max*86)).

    ``members``: trigger_id and ts, or counted beforehand (``clusters.member_times``): trigger_id, ``n`` tickets of the
    hour or, in clusters of two days or more, day ``at``, and the first and last time of their part of the cluster."""
    if "ts" in members.columns:
        members = members.select("trigger_id", *[F.col("ts").alias(c) for c in ("at", "lo", "hi")], F.lit(1).alias("n"))
    span = members.groupBy("trigger_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hourly = F.timestamp_diff("DAY", F.col("lo"), F.col("hi")) < 2
    j = members.select("trigger_id", "at", "n").join(span, "trigger_id")
    b = (j.select("trigger_id", hourly.alias("hourly"), "n",
                  F.when(hourly, F.date_trunc("hour", "at")).otherwise(F.date_trunc("day", "at")).alias("bucket"))
         .groupBy("trigger_id", "hourly", "bucket").agg(F.sum("n").alias("n_tickets")))
    w = Window.partitionBy("trigger_id").orderBy(F.desc("bucket"))
    kept = b.withColumn("r", F.row_number().over(w)).where(F.col("r") <= newest)
    mx = F.max("n_tickets").over(Window.partitionBy("trigger_id"))
    return kept.select(
        "trigger_id",
        F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"),
        F.when(F.col("hourly"), F.date_format("bucket", "HH:00")).otherwise(F.date_format("bucket", "MMM dd")).alias("label"),
        F.col("n_tickets").cast("bigint"),
        F.greatest(F.lit(8), F.bround(F.col("n_tickets") / mx * 86, 0).cast("bigint")).alias("height"),
    )


def enrich_account(tickets: DataFrame, accounts: DataFrame) -> DataFrame:
    """2.3 two-key fallback: the account by id, otherwise by requester e-mail;
    not found -> empty defaults (name '', ARR 0 shown as an em dash, the
    ticket's own tier)."""
    from support_signals.functions.formats import format_arr

    acc = accounts.select("account_id", "account_name", "arr", "region", "tier", "customer_email")
    by_id = acc.select(F.col("account_id").alias("_aid"), F.struct("account_name", "arr", "region", "tier").alias("a_id"))
    by_mail = (acc.where(F.col("customer_email").isNotNull())
               .groupBy("customer_email").agg(F.max_by(F.struct("account_name", "arr", "region", "tier"), "account_id")
                                              .alias("a_mail"))
               .withColumnRenamed("customer_email", "_mail"))
    j = (tickets.join(by_id, tickets.account_id == by_id._aid, "left")
         .join(by_mail, tickets.requester_email == by_mail._mail, "left"))
    a = F.coalesce(F.col("a_id"), F.col("a_mail"))
    own_tier = F.col("customer_tier") if "customer_tier" in tickets.columns else F.lit("").cast("string")
    return j.select(
        "id",
        F.when(F.col("a_id").isNotNull(), "account_id").when(F.col("a_mail").isNotNull(), "requester_email")
        .alias("matched_by"),
        F.coalesce(a["account_name"], F.lit("")).alias("account_name"),
        F.coalesce(a["arr"], F.lit(0).cast("bigint")).alias("account_arr"),
        F.when(a.isNotNull(), format_arr(a["arr"])).otherwise(F.lit("—")).alias("account_arr_formatted"),
        F.coalesce(a["region"], F.lit("")).alias("account_region"),
        F.when(a.isNotNull(), F.coalesce(a["tier"], own_tier)).otherwise(own_tier).alias("account_tier"))
