"""Display labels, maps and synthetic defaults of the helpdesk queue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from support_signals.functions.formats import title_case, truncate

# ---- fixed values of the reference (names, labels, orders) -------------
REQUESTER_NAMES = [
    "Sarah Chen", "Peter Tailby", "Marcus Webb", "Elena Torres",
    "James Okonkwo", "Priya Sharma", "David Lindstrom", "Anna Kowalski",
    "Michael Reyes", "Sophie Laurent", "Chris Nakamura", "Rachel Bloom",
    "Tom Bradley", "Nina Patel", "Alex Ferguson", "Julia Mendez",
]
AGENT_NAMES = [
    "Lisa Kelly", "Support/John", "Maria Santos", "David Chen",
    "Support/Emma", "James Wright", "—", "Support/Priya",
]
CHANNELS = ["Email", "Chat", "API"]
FORM_LABELS = {
    "api": "API Support", "billing": "Billing", "technical": "Technical",
    "cancellation": "Cancellation", "complaint": "Complaints", "upgrade": "Upgrades",
}
DEFAULT_FORM = "Default Ticket Form"
VIEW_LABELS = {
    "api": "API Issues", "billing": "Billing", "technical": "Technical Support",
    "cancellation": "Cancellations", "complaint": "Complaints", "upgrade": "Upgrades",
    "unsolved": "Your unsolved tickets", "unassigned": "Unassigned tickets", "open": "All open tickets",
}
VIEW_ORDER = ["api", "billing", "technical", "cancellation", "complaint", "upgrade"]
ISSUE_CATEGORIES = {"technical", "api"}
REQUEST_CATEGORIES = {"billing", "upgrade", "cancellation", "complaint"}
PRIORITY_LABELS = {"low": "Low", "medium": "Medium", "high": "High", "urgent": "Urgent"}
UNASSIGNED_MARKS = ("", "—")
PAGE_SIZE = 40


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def stable_pick(key: Column, choices: list[str]) -> Column:
    """Deterministic choice from ``choices`` by the first 16 bits of md5(key).
    (The reference uses Python's per-process salted ``hash``; a stable hash
    keeps results reproducible across executors and runs.)"""
    idx = F.pmod(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("bigint"), F.lit(len(choices)))
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (idx + 1).cast("int"))


def requester_name(id_col, given=None) -> Column:
    pick = stable_pick(_c(id_col), REQUESTER_NAMES)
    return pick if given is None else F.coalesce(F.nullif(_c(given), F.lit("")), pick)


def channel(id_col, given=None) -> Column:
    pick = stable_pick(F.concat(_c(id_col), F.lit("_ch")), CHANNELS)
    return pick if given is None else F.coalesce(F.nullif(_c(given), F.lit("")), pick)


def assignee_display(id_col, given) -> Column:
    pick = stable_pick(F.concat(_c(id_col), F.lit("_ag")), AGENT_NAMES)
    return F.coalesce(F.nullif(_c(given), F.lit("")), pick)


def is_unassigned(assignee) -> Column:
    a = _c(assignee)
    return a.isNull() | a.isin(*UNASSIGNED_MARKS)


def parse_tags(tags) -> Column:
    """JSON list text -> array<string>; invalid JSON or non-list -> []."""
    parsed = F.from_json(_c(tags), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def ticket_form(category) -> Column:
    return F.coalesce(F.element_at(_map(FORM_LABELS), _c(category)), F.lit(DEFAULT_FORM))


def ticket_type(category) -> Column:
    c = F.lower(F.coalesce(_c(category), F.lit("")))
    return F.when(c.isin(*REQUEST_CATEGORIES), "Request").otherwise("Issue")


def priority_label(p) -> Column:
    p = _c(p)
    return F.coalesce(F.element_at(_map(PRIORITY_LABELS), F.lower(p)), title_case(p))


def view_label(key) -> Column:
    k = _c(key)
    return (F.when(k == "All", "All tickets")
            .otherwise(F.coalesce(F.element_at(_map(VIEW_LABELS), k), title_case(k))))


def channel_via(ch) -> Column:
    c = _c(ch)
    return F.when(c == "API", "Via API").otherwise(F.concat(F.lit("Via "), F.lower(c)))


def initials(name) -> Column:
    """First letters of the first and last word ('/' counts as a blank),
    else the first two characters, '?' for empty."""
    n = _c(name)
    parts = F.split(F.trim(F.regexp_replace(n, "/", " ")), r"\s+")
    many = F.size(F.filter(parts, lambda p: p != "")) >= 2
    two = F.concat(F.substring(F.element_at(parts, 1), 1, 1), F.substring(F.element_at(parts, -1), 1, 1))
    return (F.when(n.isNull() | (n == ""), "?").when(many, F.upper(two))
            .otherwise(F.upper(F.substring(n, 1, 2))))


def date_label(ts, fmt: str = "MMM dd") -> Column:
    """S3: ``%b %d`` style label; unparsable text falls back to its first 10 chars."""
    text = _c(ts).cast("string")
    naive = F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    return F.coalesce(F.date_format(F.try_to_timestamp(naive), fmt), F.substring(text, 1, 10), F.lit("—"))


def status_label(status) -> Column:
    s = _c(status)
    return F.when(s.isNull() | (s == ""), "—").otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30))))


__all__ = ["truncate"]


# ---- tier notes and reply templates (S7); fixed texts of the reference ----
def customer_note(tier, company) -> Column:
    t, c = F.lower(_c(tier)), _c(company)
    return (F.when(t == "enterprise", F.concat(F.lit("Valuable Customer since 2010 — "), c, F.lit(" enterprise account")))
            .when(t == "pro", F.concat(F.lit("Pro customer — "), c, F.lit(" since 2018")))
            .otherwise(F.concat(F.lit("Customer since 2022 — "), c)))


def internal_note(tier, name) -> Column:
    t, n = F.lower(_c(tier)), _c(name)
    return (F.when(t == "enterprise", F.concat(n, F.lit(" is on an enterprise account — prioritize response.")))
            .when(t == "pro", F.concat(n, F.lit(" is a pro customer. Give attentive support.")))
            .otherwise(F.concat(F.lit("Standard support tier for "), n, F.lit("."))))


def agent_reply(name, category, subject) -> Column:
    first = F.split(_c(name), r"\s+")[0]
    api = F.lower(F.coalesce(_c(category), F.lit(""))).contains("api")
    return (F.when(api, F.concat(F.lit("Hi "), first, F.lit(", thanks for reaching out. I can help with your API "
                                                              "question. Let me review your account setup.")))
            .otherwise(F.concat(F.lit("Hi "), first, F.lit(", how can I help you today? I see your request about: "),
                                truncate(_c(subject), 60))))
