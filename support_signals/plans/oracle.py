"""DuckDB oracle SQL for the registered queries.

Each statement runs on the raw driver tables; the ticket-domain views are
inlined as CTEs with the same text as ``sources.views``.  Scores are plain
joins without any bucketing, so they check the bucketed Spark join.
"""

from __future__ import annotations

from support_signals.sources.views import ACCOUNTS_SQL, ISSUES_SQL, MESSAGES_SQL, TICKETS_SQL

VIEW_SQL = {"tickets": TICKETS_SQL, "accounts": ACCOUNTS_SQL, "messages": MESSAGES_SQL, "issues": ISSUES_SQL}


def dot_sql(a: str, b: str) -> str:
    return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def window_pairs_sql(key: str = "category", closed: bool = False) -> str:
    upper = "<=" if closed else "<"
    return f"""
SELECT t.id AS t_id, c.id AS c_id, t.{key} AS {key}, t.created_at AS t_ts, c.created_at AS c_ts,
       {dot_sql('t.embedding', 'c.embedding')} AS score
FROM tickets t JOIN tickets c
  ON c.{key} = t.{key} AND c.created_at >= t.created_at - INTERVAL 7 DAY
 AND c.created_at {upper} t.created_at AND c.id <> t.id
"""


def with_views(body: str, *, views=("tickets",), ctes: dict[str, str] | None = None) -> str:
    parts = [f"{v} AS ({VIEW_SQL[v]})" for v in views]
    parts += [f"{k} AS ({v})" for k, v in (ctes or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


THR = 0.20          # TEST_CONFIG.threshold
MIN_COUNT = 3
RULE_COLS = "CAST(0.2 AS DOUBLE) AS threshold, 3 AS min_count, 7 AS window_days"

ORACLE: dict[str, str] = {}

MATCHES = {"pairs": window_pairs_sql(), "matches": f"SELECT * FROM pairs WHERE score >= {THR}"}

ORACLE["q_trend_batch"] = with_views(f"""
SELECT t.id, t.category, CAST(count(m.c_id) AS BIGINT) AS similar_count,
       count(m.c_id) >= {MIN_COUNT} AS is_potential_trend, {RULE_COLS}
FROM tickets t LEFT JOIN matches m ON m.t_id = t.id
GROUP BY t.id, t.category""", ctes=MATCHES)

ORACLE["q_pair_scores"] = with_views("""
SELECT t_id AS trigger_id, c_id AS candidate_id, category, round(score, 6) AS score FROM pairs""",
                                     ctes={"pairs": window_pairs_sql()})

ORACLE["q_window_candidates"] = with_views("""
SELECT t.id, CAST(count(p.c_id) AS BIGINT) AS window_count
FROM tickets t LEFT JOIN pairs p ON p.t_id = t.id GROUP BY t.id""", ctes={"pairs": window_pairs_sql()})

ORACLE["q_trend_detail"] = with_views(f"""
SELECT m.t_id AS trigger_id, m.c_id AS similar_id, round(m.score, 6) AS score, m.category,
       CAST(n.n AS BIGINT) AS similar_count, n.n >= {MIN_COUNT} AS is_potential_trend, {RULE_COLS}
FROM matches m JOIN (SELECT t_id, count(*) AS n FROM matches GROUP BY t_id) n ON n.t_id = m.t_id""",
                                      ctes=MATCHES)


def fmt_arr_sql(a: str) -> str:
    return (f"(CASE WHEN {a} >= 1000000 THEN '$' || printf('%.1f', CAST({a} AS DOUBLE) / 1000000.0) || 'M' "
            f"WHEN {a} >= 1000 THEN '$' || CAST(CAST(round_even({a} / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'K' "
            f"ELSE '$' || format('{{:,}}', {a}) END)")


def title_sql(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


ALL_SCORES = f"""
SELECT q.id AS q_id, c.id AS c_id, {dot_sql('q.embedding', 'c.embedding')} AS score,
       c.category, c.subject
FROM tickets q JOIN tickets c ON c.id <> q.id"""


def topk_sql(k: int = 5, exclude_self: bool = True) -> str:
    src = ALL_SCORES if exclude_self else ALL_SCORES.replace("ON c.id <> q.id", "ON TRUE")
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank
FROM ({src})) WHERE rank <= {k}"""


ORACLE["q_topk_similar"] = with_views("""
SELECT q_id AS id, rank, c_id AS similar_id, round(score, 6) AS score, category FROM topk""",
                                      ctes={"topk": topk_sql()})

ORACLE["q_topk_freetext"] = with_views("""
SELECT q_id AS query_id, rank, c_id AS similar_id, round(score, 6) AS score FROM topk""",
                                       ctes={"topk": topk_sql(exclude_self=False)})

ORACLE["q_infer_category"] = with_views("""
SELECT t.id, t.category, coalesce(n.category, 'unknown') AS inferred_category
FROM tickets t LEFT JOIN topk n ON n.q_id = t.id""", ctes={"topk": topk_sql(1)})

MEMBERS = {
    **MATCHES,
    "members": """
SELECT m.t_id AS trigger_id, m.c_id AS ticket_id, c.account_id, false AS is_trigger
FROM matches m JOIN tickets c ON c.id = m.c_id
UNION ALL SELECT id, id, account_id, true FROM tickets""",
    "ca": """
SELECT m.trigger_id, m.account_id,
       min(CASE WHEN m.is_trigger THEN 'Z' ELSE 'A' END || m.ticket_id) AS first_seen,
       any_value(a.account_name) AS account_name, any_value(a.arr) AS arr,
       any_value(CASE WHEN a.tier IN ('enterprise', 'pro', 'free') THEN a.tier ELSE 'free' END) AS tier
FROM members m JOIN accounts a ON a.account_id = m.account_id
GROUP BY m.trigger_id, m.account_id""",
}

IMPACT_CTES = {
    **MEMBERS,
    "impact": f"""
SELECT tot.trigger_id, CAST(tot.total_tickets AS BIGINT) AS total_tickets,
       CAST(coalesce(p.unique_accounts, 0) AS BIGINT) AS unique_accounts,
       CAST(coalesce(p.enterprise_accounts, 0) AS BIGINT) AS enterprise_accounts,
       CAST(coalesce(p.pro_accounts, 0) AS BIGINT) AS pro_accounts,
       CAST(coalesce(p.free_accounts, 0) AS BIGINT) AS free_accounts,
       CAST(coalesce(p.enterprise_arr, 0) AS BIGINT) AS enterprise_arr,
       CAST(coalesce(p.pro_arr, 0) AS BIGINT) AS pro_arr,
       CAST(coalesce(p.free_arr, 0) AS BIGINT) AS free_arr,
       CAST(coalesce(p.arr_at_risk, 0) AS BIGINT) AS arr_at_risk,
       {fmt_arr_sql('CAST(coalesce(p.arr_at_risk, 0) AS BIGINT)')} AS arr_at_risk_formatted
FROM (SELECT trigger_id, count(*) AS total_tickets FROM members GROUP BY trigger_id) tot
LEFT JOIN (SELECT trigger_id, count(*) AS unique_accounts,
                  count_if(tier = 'enterprise') AS enterprise_accounts, count_if(tier = 'pro') AS pro_accounts,
                  count_if(tier = 'free') AS free_accounts,
                  sum(CASE WHEN tier = 'enterprise' THEN arr ELSE 0 END) AS enterprise_arr,
                  sum(CASE WHEN tier = 'pro' THEN arr ELSE 0 END) AS pro_arr,
                  sum(CASE WHEN tier = 'free' THEN arr ELSE 0 END) AS free_arr,
                  sum(arr) AS arr_at_risk
           FROM ca GROUP BY trigger_id) p ON p.trigger_id = tot.trigger_id""",
}
ACC_VIEWS = ("tickets", "accounts")

ORACLE["q_impact"] = with_views("SELECT * FROM impact", views=ACC_VIEWS, ctes=IMPACT_CTES)

ORACLE["q_impact_tiers"] = with_views("""
SELECT trigger_id, 'enterprise' AS tier, enterprise_accounts AS accounts, enterprise_arr AS arr FROM impact
UNION ALL SELECT trigger_id, 'pro', pro_accounts, pro_arr FROM impact
UNION ALL SELECT trigger_id, 'free', free_accounts, free_arr FROM impact""", views=ACC_VIEWS, ctes=IMPACT_CTES)

ORACLE["q_top_accounts"] = with_views(f"""
SELECT trigger_id, rank, account_id, account_name, tier, arr, {fmt_arr_sql('arr')} AS arr_formatted
FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY arr DESC, first_seen) AS rank FROM ca)
WHERE rank <= 5""", views=ACC_VIEWS, ctes=MEMBERS)

ORACLE["q_format_arr"] = with_views(f"SELECT account_id, arr, {fmt_arr_sql('arr')} AS arr_formatted FROM accounts",
                                    views=("accounts",))

def draft_ctes(trigger_filter: str = f"n >= {MIN_COUNT}") -> dict[str, str]:
  return {
    **IMPACT_CTES,
    "trend": f"""
SELECT t.id, t.category, t.subject, t.priority, count(m.c_id) AS n
FROM tickets t LEFT JOIN matches m ON m.t_id = t.id GROUP BY t.id, t.category, t.subject, t.priority""",
    "flagged": f"SELECT * FROM trend WHERE {trigger_filter}",
    "samples": f"""
SELECT q_id, string_agg('- ' || subject, chr(10) ORDER BY rank) AS sample_lines
FROM ({topk_sql(3)}) WHERE q_id IN (SELECT id FROM flagged) GROUP BY q_id""",
    "ids": """
SELECT t_id, string_agg(c_id, ', ' ORDER BY c_id) AS similar_ticket_ids
FROM (SELECT t_id, c_id, row_number() OVER (PARTITION BY t_id ORDER BY c_id) AS r FROM matches) WHERE r <= 20
GROUP BY t_id""",
    "drafts": f"""
SELECT f.id AS trigger_ticket_id,
       '[Trend] Recurring ' || {title_sql('f.category')} || ' issues (' || CAST(f.n AS VARCHAR) || ' similar tickets)' AS title,
       'Support trend detected: ' || CAST(f.n AS VARCHAR) || ' tickets with similarity >= '
         || CAST(CAST(round_even(0.2 * 100, 0) AS BIGINT) AS VARCHAR) || '% to ticket ' || f.id || '.' || chr(10) || chr(10)
         || 'Category: ' || f.category || chr(10) || 'Trigger ticket: ' || f.subject || chr(10) || chr(10)
         || 'Customer impact:' || chr(10) || '- ' || CAST(i.total_tickets AS VARCHAR) || ' tickets, '
         || CAST(i.unique_accounts AS VARCHAR) || ' unique accounts, ' || CAST(i.enterprise_accounts AS VARCHAR)
         || ' enterprise' || chr(10) || '- Est. ARR at risk: ' || i.arr_at_risk_formatted || ' (Salesforce)'
         || chr(10) || chr(10) || 'Sample subjects:' || chr(10) || coalesce(s.sample_lines, '') || chr(10) || chr(10)
         || 'Recommend engineering review for potential systemic ' || f.category || ' issue.' AS summary,
       CASE WHEN f.n >= 50 OR lower(f.priority) = 'urgent' THEN 'urgent'
            WHEN f.n >= 20 OR lower(f.priority) = 'high' THEN 'high' ELSE lower(f.priority) END AS priority,
       f.category, CAST(f.n AS BIGINT) AS similar_count, coalesce(ids.similar_ticket_ids, '') AS similar_ticket_ids,
       i.total_tickets, i.unique_accounts, i.enterprise_accounts, i.arr_at_risk, i.arr_at_risk_formatted
FROM flagged f LEFT JOIN impact i ON i.trigger_id = f.id LEFT JOIN ids ON ids.t_id = f.id
LEFT JOIN samples s ON s.q_id = f.id""",
  }


DRAFT_CTES = draft_ctes()

ORACLE["q_draft"] = with_views("SELECT * FROM drafts", views=ACC_VIEWS, ctes=DRAFT_CTES)

ORACLE["q_draft_text"] = with_views("""
SELECT trigger_ticket_id,
       'Title: ' || title || chr(10) || chr(10) || 'Priority: ' || upper(substr(priority, 1, 1)) || substr(priority, 2)
       || chr(10) || 'Category: ' || category || chr(10) || chr(10) || 'Customer impact:' || chr(10) || '- '
       || CAST(total_tickets AS VARCHAR) || ' tickets, ' || CAST(unique_accounts AS VARCHAR) || ' unique accounts, '
       || CAST(enterprise_accounts AS VARCHAR) || ' enterprise' || chr(10) || '- Est. ARR at risk: '
       || arr_at_risk_formatted || ' (Salesforce)' || chr(10) || chr(10) || 'Summary:' || chr(10) || summary
       || chr(10) || chr(10) || 'Similar ticket IDs (' || CAST(similar_count AS VARCHAR)
       || ' total, showing up to 20):' || chr(10) || similar_ticket_ids AS draft_text
FROM drafts""", views=ACC_VIEWS, ctes=DRAFT_CTES)


# ---------------------------------------------------------------- queue
def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def pick_sql(key: str, choices) -> str:
    return (f"list_extract({_sql_list(choices)}, "
            f"CAST(CAST(('0x' || substr(md5({key}), 1, 4)) AS BIGINT) % {len(choices)} AS INTEGER) + 1)")


def _case_map(x: str, d: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items())
    return f"(CASE {x} {whens} ELSE {default} END)"


def initials_sql(n: str) -> str:
    parts = f"string_split_regex(trim(replace({n}, '/', ' ')), '\\s+')"
    return (f"(CASE WHEN {n} IS NULL OR {n} = '' THEN '?' "
            f"WHEN len(list_filter({parts}, lambda p: p <> '')) >= 2 "
            f"THEN upper(substr({parts}[1], 1, 1) || substr({parts}[-1], 1, 1)) "
            f"ELSE upper(substr({n}, 1, 2)) END)")


def _labels():
    from support_signals.functions import labels as L
    return L


def requester_sql(id_: str = "id") -> str:
    return pick_sql(id_, _labels().REQUESTER_NAMES)


def assignee_sql(id_: str = "id", a: str = "assignee") -> str:
    return f"coalesce(nullif({a}, ''), {pick_sql(id_ + " || '_ag'", _labels().AGENT_NAMES)})"


def channel_sql(id_: str = "id") -> str:
    return pick_sql(id_ + " || '_ch'", _labels().CHANNELS)


UNASSIGNED_SQL = "(assignee IS NULL OR assignee IN ('', '—'))"

ORACLE["q_category_counts"] = with_views(
    "SELECT category, CAST(count(*) AS BIGINT) AS n_tickets FROM tickets GROUP BY category")

ORACLE["q_queue_facets"] = with_views(f"""
SELECT count(*) AS total, CAST(count_if(status IN ('open', 'pending')) AS BIGINT) AS unsolved,
       CAST(count_if(status = 'open' AND {UNASSIGNED_SQL}) AS BIGINT) AS unassigned,
       CAST(count_if(status = 'open') AS BIGINT) AS open
FROM tickets""")

ORACLE["q_view_counts"] = with_views(f"""
SELECT view, label, CAST(n AS BIGINT) AS n_tickets, CAST(ord AS INTEGER) AS ord FROM (
  SELECT 'unsolved' AS view, 'Your unsolved tickets' AS label, count_if(status IN ('open', 'pending')) AS n, 0 AS ord FROM tickets
  UNION ALL SELECT 'unassigned', 'Unassigned tickets', count_if(status = 'open' AND {UNASSIGNED_SQL}), 1 FROM tickets
  UNION ALL SELECT 'All', 'All tickets', count(*), 2 FROM tickets
  UNION ALL SELECT 'open', 'All open tickets', count_if(status = 'open'), 3 FROM tickets
  UNION ALL SELECT category, {title_sql('category')}, count(*),
         CASE category WHEN 'error' THEN 4 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 6 WHEN 'click' THEN 7
                       WHEN 'view' THEN 8 WHEN 'api' THEN 9 END
  FROM tickets WHERE category IN ('error', 'purchase', 'signup', 'click', 'view', 'api') GROUP BY category)""")

ORACLE["q_view_filter"] = with_views(f"""
SELECT 'All' AS view, id FROM tickets
UNION ALL SELECT 'unsolved', id FROM tickets WHERE status IN ('open', 'pending')
UNION ALL SELECT 'unassigned', id FROM tickets WHERE status = 'open' AND {UNASSIGNED_SQL}
UNION ALL SELECT 'open', id FROM tickets WHERE status = 'open'
UNION ALL SELECT 'error', id FROM tickets WHERE category = 'error'""")

ORACLE["q_ticket_search"] = with_views(f"""
SELECT id FROM tickets
WHERE contains(lower(id), 'eau') OR contains(lower(subject), 'eau') OR contains(lower(body), 'eau')
   OR contains(lower({requester_sql()}), 'eau')""")

ORACLE["q_ticket_page"] = with_views(f"""
SELECT id, CAST(pos AS BIGINT) AS pos, status, category, {assignee_sql()} AS assignee,
       {requester_sql()} AS requester_name, {channel_sql()} AS channel,
       {_case_map('category', _labels().FORM_LABELS, "'Default Ticket Form'")} AS ticket_form,
       CAST(total AS BIGINT) AS total, CAST(ceil(total / 40.0) AS BIGINT) AS pages
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS pos, count(*) OVER () AS total
      FROM tickets WHERE status IN ('open', 'pending'))
WHERE pos > 40 AND pos <= 80""")

ORACLE["q_interaction_history"] = with_views("""
SELECT id, rank, history_id, history_status FROM (
  SELECT a.id, b.id AS history_id, b.status AS history_status,
         row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id) AS rank
  FROM tickets a JOIN tickets b ON a.account_id = b.account_id AND a.id <> b.id
  WHERE a.account_id IS NOT NULL) WHERE rank <= 3""")

ORACLE["q_latest_comment"] = with_views("""
SELECT t.id, m.pos, coalesce(m.author, 'customer') AS author, coalesce(m.type, 'public') AS type,
       coalesce(m.text, t.body) AS text
FROM tickets t LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_no ORDER BY (type <> 'internal') DESC, pos DESC) AS r
                 FROM messages) WHERE r = 1) m ON m.ticket_no = t.ticket_no""", views=("tickets", "messages"))

ORACLE["q_timeline"] = with_views("""
SELECT trigger_id, strftime(bucket, '%Y-%m-%d %H:%M') AS bucket,
       CASE WHEN hourly THEN strftime(bucket, '%H:00') ELSE strftime(bucket, '%b %d') END AS label,
       CAST(n AS BIGINT) AS n_tickets,
       CAST(greatest(8, round_even(n / max(n) OVER (PARTITION BY trigger_id) * 86, 0)) AS BIGINT) AS height
FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY bucket DESC) AS r FROM (
  SELECT m.trigger_id, s.hourly, CASE WHEN s.hourly THEN date_trunc('hour', m.ts) ELSE date_trunc('day', m.ts) END AS bucket,
         count(*) AS n
  FROM (SELECT m.t_id AS trigger_id, m.c_ts AS ts FROM matches m UNION ALL SELECT id, created_at FROM tickets) m
  JOIN (SELECT trigger_id, max(ts) - min(ts) < INTERVAL 2 DAY AS hourly FROM
          (SELECT m.t_id AS trigger_id, m.c_ts AS ts FROM matches m UNION ALL SELECT id, created_at FROM tickets)
        GROUP BY trigger_id) s ON s.trigger_id = m.trigger_id
  GROUP BY 1, 2, 3)) WHERE r <= 12""", ctes=MATCHES)


def _display_sql() -> str:
    L = _labels()
    name = requester_sql()
    asg = assignee_sql()
    prio = _case_map("lower(priority)", L.PRIORITY_LABELS, title_sql("priority"))
    view = _case_map("category", {k: v for k, v in L.VIEW_LABELS.items()}, title_sql("category"))
    req = ", ".join(f"'{c}'" for c in sorted(L.REQUEST_CATEGORIES))
    return f"""
SELECT id,
       array_to_string(CASE WHEN json_valid(tags) AND json_type(tags) = 'ARRAY' THEN CAST(tags AS VARCHAR[]) ELSE [] END, '|') AS tags,
       CAST(CASE WHEN json_valid('{{' || tags) AND json_type('{{' || tags) = 'ARRAY' THEN 1 ELSE 0 END AS INTEGER) AS bad_tags,
       strftime(created_at, '%b %d') AS created_label,
       strftime(created_at, '%b %d, %H:%M') AS created_time_label,
       strftime(created_at, '%a, %H:%M UTC') AS local_time,
       CASE WHEN length(subject) <= 52 THEN subject ELSE substr(subject, 1, 51) || '…' END AS subject_short,
       {prio} AS priority_label,
       CASE WHEN lower(coalesce(category, '')) IN ({req}) THEN 'Request' ELSE 'Issue' END AS ticket_type,
       {_case_map('category', L.FORM_LABELS, "'Default Ticket Form'")} AS ticket_form,
       CASE WHEN category = 'All' THEN 'All tickets' ELSE {view} END AS view_label,
       CASE WHEN status IS NULL OR status = '' THEN '—' ELSE upper(substr(status, 1, 1)) || lower(substr(status, 2)) END AS status_label,
       {name} AS requester_name, {initials_sql(name)} AS initials,
       CASE WHEN {channel_sql()} = 'API' THEN 'Via API' ELSE 'Via ' || lower({channel_sql()}) END AS via,
       {asg} AS assignee, {initials_sql(asg)} AS assignee_initials
FROM tickets"""


ORACLE["q_ticket_display"] = with_views(_display_sql())


# ---------------------------------------------------------------- review
NO_SQL = "CAST(substr(c_id, 3) AS BIGINT)"
REVIEW_CTES = {
    **MATCHES,
    "dlog": f"""
SELECT t_id AS trigger_id, c_id AS ticket_id, {NO_SQL} % 4 <> 0 AS include, t_ts AS decided_at, 1 AS seq FROM matches
UNION ALL
SELECT t_id, c_id, NOT ({NO_SQL} % 4 <> 0), t_ts + INTERVAL 1 HOUR, 2 FROM matches WHERE {NO_SQL} % 3 = 0""",
    "decisions": "SELECT trigger_id, ticket_id, arg_max(include, decided_at) AS include FROM dlog GROUP BY ALL",
}

TAGS_SQL = "(CASE WHEN json_valid({x}) AND json_type({x}) = 'ARRAY' THEN CAST({x} AS VARCHAR[]) ELSE [] END)"


def explain_sql(tc: str, cc: str, tt: str, ct: str) -> str:
    sh = f"list_slice(list_sort(list_intersect({TAGS_SQL.format(x=tt)}, {TAGS_SQL.format(x=ct)})), 1, 3)"
    txt = (f"concat_ws('; ', CASE WHEN {cc} = {tc} THEN 'same ' || replace({cc}, '_', ' ') || ' category' END, "
           f"CASE WHEN len({sh}) > 0 THEN 'shared signals: ' || "
           f"array_to_string(list_transform({sh}, lambda x: upper(replace(x, '-', ' '))), ', ') END)")
    return f"(CASE WHEN {txt} = '' THEN 'semantic language match' ELSE {txt} END)"


CAND_CTES = {
    **REVIEW_CTES,
    "cands": f"""
SELECT m.t_id AS trigger_id, m.c_id AS candidate_id, m.score, c.subject,
       {explain_sql('t.category', 'c.category', 't.tags', 'c.tags')} AS explanation,
       {title_sql("coalesce(c.status, '')")} AS status, {title_sql("coalesce(a.tier, '')")} AS tier,
       coalesce(d.include, true) AS included
FROM matches m JOIN tickets t ON t.id = m.t_id JOIN tickets c ON c.id = m.c_id
LEFT JOIN accounts a ON a.account_id = c.account_id
LEFT JOIN decisions d ON d.trigger_id = m.t_id AND d.ticket_id = m.c_id""",
}

ORACLE["q_review_upsert"] = with_views("SELECT trigger_id, ticket_id, include FROM decisions", ctes=REVIEW_CTES)

ORACLE["q_score_candidates"] = with_views(f"""
SELECT p.trigger_id, p.ticket_id, round({dot_sql('t.embedding', 'c.embedding')}, 6) AS score
FROM (SELECT DISTINCT trigger_id, ticket_id FROM (SELECT trigger_id, ticket_id FROM dlog UNION ALL SELECT id, id FROM tickets)
      WHERE trigger_id <> ticket_id) p
JOIN tickets t ON t.id = p.trigger_id JOIN tickets c ON c.id = p.ticket_id""", ctes=REVIEW_CTES)

ORACLE["q_explain"] = with_views("SELECT trigger_id, candidate_id, explanation FROM cands", views=ACC_VIEWS,
                                 ctes=CAND_CTES)

ORACLE["q_review_candidates"] = with_views(
    "SELECT trigger_id, candidate_id, round(score, 6) AS score, status, tier, included FROM cands",
    views=ACC_VIEWS, ctes=CAND_CTES)

ORACLE["q_candidate_filter"] = with_views("""
SELECT trigger_id, candidate_id FROM cands
WHERE status IN ('Open', 'Pending') AND NOT (score * 100 < 21) AND included""", views=ACC_VIEWS, ctes=CAND_CTES)

ORACLE["q_candidate_facets"] = with_views("""
SELECT trigger_id, string_agg(DISTINCT status, '|' ORDER BY status) AS statuses,
       string_agg(DISTINCT tier, '|' ORDER BY tier) AS tiers,
       CAST(count_if(NOT (score * 100 < 21)) AS BIGINT) AS shown,
       CAST(count_if(included) AS BIGINT) AS included, CAST(count_if(NOT included) AS BIGINT) AS excluded
FROM cands GROUP BY trigger_id""", views=ACC_VIEWS, ctes=CAND_CTES)

ORACLE["q_reviewed_trend"] = with_views(f"""
SELECT t.id AS trigger_id, CAST(coalesce(r.n, 0) AS BIGINT) AS similar_count, coalesce(r.n, 0) >= {MIN_COUNT} AS is_potential_trend,
       coalesce(r.signature, 0) AS signature
FROM tickets t LEFT JOIN (
  SELECT m.t_id, count(*) AS n, bit_xor(CAST(('0x' || substr(md5(m.c_id), 1, 15)) AS BIGINT)) AS signature
  FROM matches m LEFT JOIN decisions d ON d.trigger_id = m.t_id AND d.ticket_id = m.c_id
  WHERE coalesce(d.include, true) GROUP BY m.t_id) r ON r.t_id = t.id""", ctes=REVIEW_CTES)

TS_FMT = "'%Y-%m-%d %H:%M:%S.%f'"
ORACLE["q_cluster_events"] = with_views(f"""
SELECT * FROM (
  SELECT trigger_id, 1 AS seq, strftime(first_ts, {TS_FMT}) AS at, 'First matching support report' AS title,
         first_id || ' - ' || first_subject AS detail, '' AS kind FROM ev
  UNION ALL SELECT trigger_id, 2, strftime(first_ts + to_microseconds(CAST(round_even(
         greatest(epoch_us(trig_ts) - epoch_us(first_ts), 1) * 0.3, 0) AS BIGINT)), {TS_FMT}),
         CASE category WHEN 'identity' THEN 'SCIM authorization worker release' WHEN 'api' THEN 'API gateway release'
              WHEN 'billing' THEN 'Billing rules deployment' WHEN 'notifications' THEN 'Notification worker deployment'
              ELSE 'Service deployment' END,
         'Synthetic operational marker for investigation correlation; not evidence of causation.', 'synthetic' FROM ev
  UNION ALL SELECT trigger_id, 3, strftime(thr_ts, {TS_FMT}), 'Trend threshold reached',
         thr_id || ' supplied the required earlier-match volume.', '' FROM ev
  UNION ALL SELECT trigger_id, 4, strftime(trig_ts, {TS_FMT}), 'Trigger ticket analyzed',
         trig_id || ' opened the current investigation.', '' FROM ev
  UNION ALL SELECT trigger_id, 5, NULL, 'Support review confirmed',
         'Reviewed ticket set and recalculated impact saved to the Jira draft.', 'confirmed' FROM ev WHERE confirmed)""",
    ctes={**REVIEW_CTES, "mem": """
SELECT t_id AS trigger_id, c_id AS ticket_id, c_ts AS ts, false AS is_trigger FROM matches
UNION ALL SELECT id, id, created_at, true FROM tickets""", "rk": """
SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY ts, ticket_id) AS r,
       count(*) OVER (PARTITION BY trigger_id) AS n FROM mem""", "ev": """
SELECT f.trigger_id, f.ts AS first_ts, f.ticket_id AS first_id, s.subject AS first_subject,
       h.ts AS thr_ts, h.ticket_id AS thr_id, g.ts AS trig_ts, g.ticket_id AS trig_id, t.category,
       f.trigger_id IN (SELECT trigger_id FROM dlog) AS confirmed
FROM rk f JOIN rk h ON h.trigger_id = f.trigger_id AND h.r = least(4, h.n)
JOIN rk g ON g.trigger_id = f.trigger_id AND g.is_trigger
JOIN tickets t ON t.id = f.trigger_id LEFT JOIN tickets s ON s.id = f.ticket_id
WHERE f.r = 1"""})

# ---------------------------------------------------------------- quality
ENRICH_CTES = {
    "elog": """
SELECT trigger_ticket_id AS ticket_id, 'Expected: ' || summary AS expected_behavior,
       CASE WHEN status <> 'Done' THEN 'Actual: ' || status END AS actual_behavior,
       CASE WHEN priority IN ('Urgent', 'High') THEN 'Reported with priority ' || priority END AS reproduction_steps,
       CAST(NULL AS VARCHAR) AS environment, created AS written_at, key_no AS seq
FROM issues WHERE trigger_ticket_id IS NOT NULL""",
    "enrichment": """
SELECT ticket_id, expected_behavior, actual_behavior, reproduction_steps, environment FROM (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY written_at DESC, seq DESC) AS r FROM elog) WHERE r = 1""",
}

ORACLE["q_enrichment_upsert"] = with_views("SELECT * FROM enrichment", views=("issues",), ctes=ENRICH_CTES)


def _quality_ctes() -> dict[str, str]:
    from support_signals.operators import quality as Q

    def s(c):
        return f"coalesce(CAST({c} AS VARCHAR), '')"

    blob = "concat_ws(chr(10), " + ", ".join(s(f) for f in Q.DRAFT_FIELDS) + ")"
    ids = "list_filter(string_split_regex(similar_ticket_ids, ',\\s*'), lambda x: x <> '')"
    trig = "trigger_ticket_id"
    ev = (f"(CASE WHEN {trig} IS NOT NULL AND {trig} <> '' AND NOT list_contains({ids}, {trig}) "
          f"THEN list_prepend({trig}, {ids}) ELSE {ids} END)")
    only = f"len(list_filter({ev}, lambda x: x <> coalesce({trig}, '')))"
    cnt = f"coalesce(CAST(similar_count AS BIGINT), {only})"
    acc = "coalesce(CAST(unique_accounts AS BIGINT), 0)"
    arr = f"trim(coalesce(nullif({s('arr_at_risk_formatted')}, ''), {s('arr_at_risk_text')}))"
    has_arr = f"({arr} <> '' AND {arr} NOT IN ({', '.join(repr(x) for x in Q.EMPTY_ARR)}))"
    t = f"trim({s('title')})"
    summ = f"trim(coalesce(nullif({s('summary')}, ''), {s('description')}))"
    pr = f"lower(trim({s('priority')}))"

    def rx(p):
        return "'" + p.replace("U)", ")").replace("'", "''") + "'"

    blank = lambda c: f"(trim({s(c)}) = '')"
    rules = [
        (f"(length({t}) >= 12 AND lower({t}) NOT IN ({', '.join(repr(x) for x in Q.GENERIC_TITLES)}))",
         f"CASE WHEN length({t}) < 12 THEN 'Title is missing or too short for Engineering triage.' "
         f"WHEN lower({t}) IN ({', '.join(repr(x) for x in Q.GENERIC_TITLES)}) THEN 'Title is too generic.' "
         f"ELSE 'Title is present and specific enough to scan.' END"),
        (f"(length({summ}) >= 80)",
         f"CASE WHEN length({summ}) >= 80 THEN 'Summary has enough narrative context.' "
         f"ELSE 'Summary is under 80 characters — Engineering lacks context.' END"),
        (f"({s(trig)} <> '')",
         f"CASE WHEN {s(trig)} <> '' THEN 'Trigger ticket ' || {trig} || ' is linked.' "
         f"ELSE 'No trigger support ticket is linked.' END"),
        (f"(NOT ({cnt} < 3 AND {only} < 3))",
         f"CASE WHEN NOT ({cnt} < 3 AND {only} < 3) THEN CAST(greatest({cnt}, {only}) AS VARCHAR) || "
         f"' evidence tickets linked.' ELSE 'Fewer than 3 evidence tickets — weak pattern signal.' END"),
        (f"(NOT ({acc} <= 0 AND NOT {has_arr}))",
         f"CASE WHEN NOT ({acc} <= 0 AND NOT {has_arr}) THEN 'Customer impact noted: ' || concat_ws(', ', "
         f"CASE WHEN {acc} <> 0 THEN CAST({acc} AS VARCHAR) || ' accounts' END, CASE WHEN {has_arr} THEN 'ARR ' || {arr} END)"
         f" || '.' ELSE 'No customer impact (accounts or ARR) is stated.' END"),
        (f"((NOT {blank('expected_behavior')} AND NOT {blank('actual_behavior')}) OR regexp_matches({blob}, {rx(Q.EXPECTED_ACTUAL_RE)}))",
         f"CASE WHEN NOT {blank('expected_behavior')} AND NOT {blank('actual_behavior')} THEN 'Expected vs actual behavior are both present.' "
         f"WHEN regexp_matches({blob}, {rx(Q.EXPECTED_ACTUAL_RE)}) THEN 'Expected vs actual behavior is described in the draft text.' "
         f"ELSE 'Expected vs actual behavior is missing.' END"),
        (f"(NOT {blank('reproduction_steps')} OR NOT {blank('environment')} OR regexp_matches({blob}, {rx(Q.REPRO_OR_ENV_RE)}) "
         f"OR regexp_matches({blob}, {rx(Q.EXPLICIT_GAP_RE)}))",
         f"CASE WHEN NOT {blank('reproduction_steps')} THEN 'Reproduction steps are present.' "
         f"WHEN NOT {blank('environment')} THEN 'Environment / version context is present.' "
         f"WHEN regexp_matches({blob}, {rx(Q.REPRO_OR_ENV_RE)}) THEN 'Reproduction or environment details appear in the draft.' "
         f"WHEN regexp_matches({blob}, {rx(Q.EXPLICIT_GAP_RE)}) THEN 'Draft explicitly notes missing repro/environment as a follow-up.' "
         f"ELSE 'No reproduction steps, environment, or explicit evidence gap note.' END"),
        (f"({pr} IN ('low', 'medium', 'high', 'urgent'))",
         f"CASE WHEN {pr} IN ('low', 'medium', 'high', 'urgent') THEN 'Priority is set (' || {pr} || ').' "
         f"ELSE 'Priority is missing or not in Low/Medium/High/Urgent.' END"),
    ]
    cols = ", ".join(f"{p} AS p{i}, {d} AS d{i}" for i, (p, d) in enumerate(rules))
    earned = " + ".join(f"(CASE WHEN p{i} THEN {c.weight_pct} ELSE 0 END)" for i, c in enumerate(Q.CHECKS))
    allp = " AND ".join(f"p{i}" for i in range(len(rules)))
    gaps = lambda sep: "concat_ws('" + sep + "', " + ", ".join(
        f"CASE WHEN NOT p{i} THEN '{c.label}' END" for i, c in enumerate(Q.CHECKS)) + ")"
    npass = " + ".join(f"CAST(p{i} AS INTEGER)" for i in range(len(rules)))
    return {
        "qd": f"SELECT d.*, e.expected_behavior, e.actual_behavior, e.reproduction_steps, e.environment, "
              f"CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS arr_at_risk_text "
              f"FROM drafts d LEFT JOIN enrichment e ON e.ticket_id = d.trigger_ticket_id",
        "qc": f"SELECT trigger_ticket_id AS draft_id, title, {cols} FROM qd",
        "qs": f"SELECT *, round_even(CAST({earned} AS DOUBLE) / 100.0, 3) AS score, {allp} AS allp, "
              f"{gaps(', ')} AS gl, {gaps('; ')} AS gs, CAST({npass} AS INTEGER) AS passed_count FROM qc",
        "qv": "SELECT *, CASE WHEN score >= 0.75 AND allp THEN 'ready' WHEN score >= 0.5 THEN 'needs_work' "
              "ELSE 'poor' END AS verdict FROM qs",
        "report": f"""
SELECT draft_id, score, CAST(round_even(score * 100, 0) AS INTEGER) AS score_pct, verdict, passed_count,
       CAST({len(rules)} AS INTEGER) AS check_count,
       CASE WHEN verdict = 'ready' THEN '{Q.READY_TEXT}'
            WHEN verdict = 'needs_work' THEN '{Q.NEEDS_WORK_TEXT}' || CASE WHEN gl = '' THEN 'listed gaps' ELSE gl END || '.'
            ELSE '{Q.POOR_TEXT}' || CASE WHEN gl = '' THEN 'listed gaps' ELSE gl END || '.' END AS recommendation,
       'Escalation quality: ' || verdict || ' (' || CAST(CAST(round_even(score * 100, 0) AS INTEGER) AS VARCHAR) || '%, '
         || CAST(passed_count AS VARCHAR) || '/{len(rules)} checks). Gaps: ' || CASE WHEN gs = '' THEN 'none' ELSE gs END
         || '.' AS summary,
       {', '.join(f'p{i}, d{i}' for i in range(len(rules)))}
FROM qv""",
    }


QUALITY_CTES = {**DRAFT_CTES, **ENRICH_CTES, **_quality_ctes()}
QVIEWS = ("tickets", "accounts", "issues")
ORACLE["q_quality_score"] = with_views("""
SELECT draft_id, score, score_pct, verdict, passed_count, check_count, recommendation, summary FROM report""",
                                       views=QVIEWS, ctes=QUALITY_CTES)


def _checks_long() -> str:
    from support_signals.operators import quality as Q
    parts = [f"SELECT draft_id, {i + 1} AS pos, '{c.id}' AS check_id, '{c.label}' AS label, "
             f"CAST({c.weight_pct / 100} AS DOUBLE) AS weight, {str(c.required).lower()} AS required, "
             f"p{i} AS passed, d{i} AS detail FROM report" for i, c in enumerate(Q.CHECKS)]
    return "\nUNION ALL ".join(parts)


ORACLE["q_quality_checks"] = with_views(_checks_long(), views=QVIEWS, ctes=QUALITY_CTES)

ORACLE["q_quality_rank"] = with_views("""
SELECT draft_id, verdict, score, row_number() OVER (
  ORDER BY CASE verdict WHEN 'ready' THEN 2 WHEN 'needs_work' THEN 1 ELSE 0 END DESC, score DESC, draft_id DESC) AS rank
FROM report""", views=QVIEWS, ctes=QUALITY_CTES)


# ---------------------------------------------------------------- issues
def pystrip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def labels_sql(text: str, category: str) -> str:
    return (f"(CASE WHEN {text} IS NULL THEN ['trend-warning', 'support-escalation', {category}] ELSE "
            f"list_filter(list_transform(string_split({text}, ','), lambda x: {pystrip_sql('x')}), lambda x: x <> '') END)")


def _pills_case(x: str) -> str:
    from support_signals.operators.issues import COMPONENT_PILLS
    return _case_map(x, COMPONENT_PILLS, f"upper(replace({x}, '-', ' '))")


def enrich_desc_sql(desc: str) -> str:
    from support_signals.operators.issues import ENRICHMENT_FIELDS
    secs = [f"CASE WHEN {pystrip_sql(f'coalesce({k}, {chr(39)}{chr(39)})')} <> '' THEN '{label}:' || chr(10) || "
            f"{pystrip_sql(k)} END" for k, label in ENRICHMENT_FIELDS]
    anys = "concat_ws('', " + ", ".join(secs) + ")"
    return (f"(CASE WHEN {anys} <> '' THEN concat_ws(chr(10) || chr(10), regexp_replace({desc}, '\\s+$', ''), "
            + ", ".join(secs) + f") ELSE {desc} END)")


LBL_TEXT = "(CASE WHEN key_no % 3 = 0 THEN NULL ELSE lower(priority) || ', ,' || replace(lower(summary), 'escalation ', ' ') END)"
ORACLE["q_labels"] = with_views(f"""
SELECT issue_key, array_to_string(lb, '|') AS labels, {_pills_case("list_filter(lb, lambda x: x NOT IN ('support-escalation', 'trend-warning'))[1]")} AS component,
       CASE WHEN (CASE WHEN key_no % 2 = 0 THEN 'Task' ELSE status END) IN ('Bug', 'Task', 'Story')
            THEN (CASE WHEN key_no % 2 = 0 THEN 'Task' ELSE status END) ELSE 'Bug' END AS type,
       CASE WHEN replace(lower(status), ' ', '_') IN ('done', 'in_progress', 'to_do') THEN replace(lower(status), ' ', '_')
            ELSE 'open' END AS status_key,
       CASE WHEN lower(priority) IN ('urgent', 'high', 'medium') THEN lower(priority) ELSE 'low' END AS priority_key,
       TRY_CAST(regexp_extract(issue_key, '^ENG-(\\d+)$', 1) AS BIGINT) AS key_number
FROM (SELECT *, {labels_sql(LBL_TEXT, "'support'")} AS lb FROM issues)""", views=("issues",))

ISSUE_CTES = {
    **DRAFT_CTES, **ENRICH_CTES,
    "ed": "SELECT d.*, e.expected_behavior, e.actual_behavior, e.reproduction_steps, e.environment "
          "FROM drafts d LEFT JOIN enrichment e ON e.ticket_id = d.trigger_ticket_id",
    "fields": f"""
SELECT trigger_ticket_id, {title_sql("coalesce(priority, 'medium')")} AS priority,
       coalesce(title, 'Support trend investigation') AS summary,
       {enrich_desc_sql("coalesce(summary, 'Support trend detected.')")} AS description,
       {labels_sql('CAST(NULL AS VARCHAR)', "coalesce(category, 'support')")} AS labels,
       coalesce(CAST(similar_count AS BIGINT), 0) AS similar_ticket_count,
       coalesce(CAST(total_tickets AS BIGINT), 0) AS zendesk_ticket_count,
       coalesce(arr_at_risk_formatted, '$0') AS arr_at_risk, 'Unassigned' AS assignee, 'Bug' AS type,
       {pystrip_sql("coalesce(expected_behavior, '')")} AS expected_behavior,
       {pystrip_sql("coalesce(actual_behavior, '')")} AS actual_behavior,
       {pystrip_sql("coalesce(reproduction_steps, '')")} AS reproduction_steps,
       {pystrip_sql("coalesce(environment, '')")} AS environment
FROM ed""",
    "first": "SELECT trigger_ticket_id, min(key_no) AS fk FROM issues WHERE trigger_ticket_id IS NOT NULL GROUP BY 1",
    "upserted": """
SELECT i.issue_key, i.key_no, CASE WHEN f.summary IS NOT NULL THEN f.type ELSE 'Bug' END AS type, i.status,
       coalesce(f.priority, i.priority) AS priority, coalesce(f.summary, i.summary) AS summary,
       CASE WHEN f.summary IS NOT NULL THEN f.labels ELSE CAST([] AS VARCHAR[]) END AS labels,
       CASE WHEN f.summary IS NOT NULL THEN f.assignee ELSE i.assignee END AS assignee,
       'Support Operations' AS reporter, i.created, i.trigger_ticket_id,
       f.similar_ticket_count, f.zendesk_ticket_count, f.arr_at_risk
FROM issues i LEFT JOIN first ON first.trigger_ticket_id = i.trigger_ticket_id
LEFT JOIN fields f ON f.trigger_ticket_id = i.trigger_ticket_id AND first.fk = i.key_no
UNION ALL
SELECT 'ENG-' || CAST(m + r AS VARCHAR), m + r, type, 'Open', priority, summary, labels, assignee, 'Support Operations',
       DATE '2025-01-01', trigger_ticket_id, similar_ticket_count, zendesk_ticket_count, arr_at_risk
FROM (SELECT *, row_number() OVER (ORDER BY trigger_ticket_id) AS r FROM fields
      WHERE trigger_ticket_id NOT IN (SELECT trigger_ticket_id FROM first)) n,
     (SELECT coalesce(max(TRY_CAST(regexp_extract(issue_key, '^ENG-(\\d+)$', 1) AS BIGINT)), 100) AS m FROM issues) mx""",
}
IVIEWS = ("tickets", "accounts", "issues")

ORACLE["q_description"] = with_views(f"SELECT trigger_ticket_id, {enrich_desc_sql('summary')} AS description FROM ed",
                                     views=IVIEWS, ctes=ISSUE_CTES)

ORACLE["q_issue_fields"] = with_views("SELECT * REPLACE (array_to_string(labels, '|') AS labels) FROM fields",
                                      views=IVIEWS, ctes=ISSUE_CTES)

ORACLE["q_issue_upsert"] = with_views("SELECT * REPLACE (array_to_string(labels, '|') AS labels, "
                                      "strftime(created, '%Y-%m-%d') AS created) FROM upserted",
                                      views=IVIEWS, ctes=ISSUE_CTES)

ORACLE["q_issue_filter"] = with_views("""
SELECT issue_key FROM upserted
WHERE status = 'Open' AND (contains(lower(issue_key), 'machinery') OR contains(lower(summary), 'machinery')
   OR contains(lower(coalesce(assignee, '')), 'machinery') OR contains(lower(coalesce(reporter, '')), 'machinery')
   OR len(list_filter(labels, lambda x: contains(lower(x), 'machinery'))) > 0)""", views=IVIEWS, ctes=ISSUE_CTES)

ORACLE["q_issue_for_trigger"] = with_views("""
SELECT trigger_ticket_id, arg_min(issue_key, key_no) AS issue_key, min(key_no) AS key_no, count(*) AS linked_issues
FROM issues WHERE trigger_ticket_id IS NOT NULL GROUP BY trigger_ticket_id""", views=("issues",))

ORACLE["q_issue_by_key"] = with_views("""
SELECT k.issue_key, i.issue_key IS NOT NULL AS found, i.status, i.priority, i.summary, i.assignee, i.trigger_ticket_id
FROM (SELECT DISTINCT 'ENG-' || CAST(ticket_no AS VARCHAR) AS issue_key FROM tickets) k LEFT JOIN issues i ON i.issue_key = k.issue_key""",
                                      views=("tickets", "issues"))

ORACLE["q_issue_links"] = with_views("""
SELECT t.id, i.issue_key IS NOT NULL AS linked, i.issue_key, CAST(coalesce(i.n, 0) AS BIGINT) AS linked_issues
FROM tickets t LEFT JOIN (SELECT trigger_ticket_id, arg_min(issue_key, key_no) AS issue_key, count(*) AS n FROM issues GROUP BY 1) i
  ON i.trigger_ticket_id = t.id""", views=("tickets", "issues"))

ORACLE["q_ticket_accounts"] = with_views("SELECT id, account_id FROM tickets WHERE account_id IS NOT NULL", views=("tickets",))

ORACLE["q_issue_page"] = with_views("""
SELECT issue_key, pos, status, 'Showing 51–' || CAST(least(75, n) AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) AS caption
FROM (SELECT issue_key, status, row_number() OVER (ORDER BY key_no) AS pos, count(*) OVER () AS n FROM issues)
WHERE pos > 50 AND pos <= 75""", views=("issues",))

ORACLE["q_sprint_split"] = with_views("""
SELECT issue_key, pos, greatest(n - 8, 0) AS backlog_count
FROM (SELECT issue_key, row_number() OVER (ORDER BY key_no) AS pos, count(*) OVER () AS n FROM issues) WHERE pos <= 8""",
                                      views=("issues",))

LIVE_CTES = {
    **draft_ctes("id IN (SELECT trigger_ticket_id FROM issues WHERE trigger_ticket_id IS NOT NULL)"),
    "edits": """
SELECT i.trigger_ticket_id, i.summary, i.priority,
       CASE WHEN i.status = 'Done' THEN 'Task' ELSE 'Bug' END AS issue_type,
       CASE WHEN i.key_no % 2 = 0 THEN '' ELSE 'edited' END AS category,
       lower(i.priority) || ', support-escalation' AS labels,
       CASE WHEN i.key_no % 3 = 0 THEN ' ' ELSE i.assignee END AS assignee
FROM issues i JOIN (SELECT trigger_ticket_id, min(key_no) AS fk FROM issues WHERE trigger_ticket_id IS NOT NULL GROUP BY 1) f
  ON f.trigger_ticket_id = i.trigger_ticket_id AND f.fk = i.key_no""",
}

ORACLE["q_edit_merge"] = with_views(f"""
SELECT d.trigger_ticket_id,
       CASE WHEN e.summary IS NOT NULL THEN coalesce(nullif({pystrip_sql('e.summary')}, ''), 'Support trend investigation') ELSE d.title END AS title,
       CASE WHEN e.summary IS NOT NULL THEN lower(e.priority) ELSE d.priority END AS priority,
       CASE WHEN e.summary IS NOT NULL THEN e.issue_type END AS issue_type,
       CASE WHEN e.summary IS NOT NULL THEN coalesce(nullif({pystrip_sql('e.category')}, ''), d.category, 'support') ELSE d.category END AS category,
       CASE WHEN e.summary IS NOT NULL THEN e.labels END AS labels,
       CASE WHEN e.assignee IS NOT NULL THEN coalesce(nullif({pystrip_sql('e.assignee')}, ''), 'Unassigned') END AS assignee,
       d.similar_count
FROM drafts d LEFT JOIN edits e ON e.trigger_ticket_id = d.trigger_ticket_id""", views=IVIEWS, ctes=LIVE_CTES)

ORACLE["q_linked_tickets"] = with_views("""
SELECT l.trigger_id, l.ticket_id, coalesce(t.subject, l.ticket_id) AS subject, l.relationship
FROM (SELECT t_id AS trigger_id, c_id AS ticket_id, 'Similar' AS relationship FROM matches
      UNION ALL SELECT id, id, 'Trigger' FROM tickets) l LEFT JOIN tickets t ON t.id = l.ticket_id""", ctes=MATCHES)

ORACLE["q_create_defaults"] = with_views(f"""
SELECT d.trigger_ticket_id,
       CASE WHEN {title_sql("coalesce(d.priority, 'medium')")} IN ('Low', 'Medium', 'High', 'Urgent')
            THEN {title_sql("coalesce(d.priority, 'medium')")} ELSE 'Medium' END AS priority,
       'Bug' AS issue_type, 'trend-warning, support-escalation, ' || coalesce(d.category, 'support') AS labels,
       coalesce(nullif(d.total_tickets, 0), len(ids) + 1) AS linked_count,
       coalesce(d.arr_at_risk_formatted, '$0') AS arr_default,
       array_to_string(list_slice(ids, 1, 12), ', ') || CASE WHEN len(ids) > 12 THEN '…' ELSE '' END AS linked_preview,
       coalesce(e.expected_behavior, '') AS expected_behavior, coalesce(e.actual_behavior, '') AS actual_behavior,
       coalesce(e.reproduction_steps, '') AS reproduction_steps, coalesce(e.environment, '') AS environment
FROM (SELECT *, list_filter(string_split_regex(coalesce(similar_ticket_ids, ''), ',\\s*'), lambda x: x <> '') AS ids FROM drafts) d
LEFT JOIN enrichment e ON e.ticket_id = d.trigger_ticket_id""", views=IVIEWS, ctes=ISSUE_CTES)


# ---------------------------------------------------------------- evaluation
CUTS = (0.10, 0.125, 0.15, 0.175, 0.20, 0.25, 0.30)     # TEST_CONFIG.sweep
CUTS_SQL = "(VALUES " + ", ".join(f"({c})" for c in CUTS) + ") cuts(cut)"

ORACLE["q_nn_accuracy"] = with_views(f"""
SELECT count(*) AS n, CAST(count_if(t.topic_id = nn.topic_id) AS BIGINT) AS correct,
       round(count_if(t.topic_id = nn.topic_id) / count(*), 6) AS accuracy
FROM tickets t LEFT JOIN (
  SELECT q_id, topic_id FROM (
    SELECT q.id AS q_id, c.topic_id, row_number() OVER (PARTITION BY q.id ORDER BY {dot_sql('q.embedding', 'c.embedding')} DESC, c.id) AS r
    FROM tickets q JOIN tickets c ON c.id <> q.id) WHERE r = 1) nn ON nn.q_id = t.id""")

PAIR_STATS = {"ap": f"""
SELECT a.topic_id = b.topic_id AS same, {dot_sql('a.embedding', 'b.embedding')} AS s
FROM tickets a JOIN tickets b ON a.id < b.id""", "tot": """
SELECT count_if(same) AS same_pairs, sum(CASE WHEN same THEN s END) AS same_sum,
       count_if(NOT same) AS cross_pairs, sum(CASE WHEN NOT same THEN s END) AS cross_sum FROM ap"""}

ORACLE["q_pair_separation"] = with_views("""
SELECT CAST(same_pairs AS BIGINT) AS same_pairs, CAST(cross_pairs AS BIGINT) AS cross_pairs,
       round(same_sum / same_pairs, 6) AS same_mean, round(cross_sum / cross_pairs, 6) AS cross_mean FROM tot""",
                                         ctes=PAIR_STATS)

ORACLE["q_pair_thresholds"] = with_views(f"""
SELECT round(CAST(cut AS DOUBLE), 6) AS cut,
       round((SELECT count_if(same AND s >= cut) FROM ap) / (SELECT same_pairs FROM tot), 6) AS same_recall,
       round((SELECT count_if(NOT same AND s >= cut) FROM ap) / (SELECT cross_pairs FROM tot), 6) AS cross_fp_rate
FROM {CUTS_SQL}""", ctes=PAIR_STATS)

EXPECTED_CTES = {"tp": window_pairs_sql("topic_id").replace(
    f", {dot_sql('t.embedding', 'c.embedding')} AS score", ""), "exp": f"""
SELECT t.id, CAST(count(p.c_id) AS BIGINT) AS earlier_same_topic,
       t.is_emerging_trend AND count(p.c_id) >= {MIN_COUNT} AS expected
FROM tickets t LEFT JOIN tp p ON p.t_id = t.id GROUP BY t.id, t.is_emerging_trend"""}

ORACLE["q_expected_alerts"] = with_views("SELECT * FROM exp", ctes=EXPECTED_CTES)

ORACLE["q_threshold_sweep"] = with_views(f"""
SELECT round(CAST(cut AS DOUBLE), 6) AS cut, tp, fp, fn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) > 0
             THEN 2 * (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) * (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END)
                  / ((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END))
             ELSE 0.0 END, 6) AS f1
FROM (
  SELECT cuts.cut, CAST(count_if(e.expected AND coalesce(r.n, 0) >= {MIN_COUNT}) AS BIGINT) AS tp,
         CAST(count_if(NOT e.expected AND coalesce(r.n, 0) >= {MIN_COUNT}) AS BIGINT) AS fp,
         CAST(count_if(e.expected AND NOT coalesce(r.n, 0) >= {MIN_COUNT}) AS BIGINT) AS fn
  FROM exp e CROSS JOIN {CUTS_SQL}
  LEFT JOIN (SELECT p.t_id, c.cut, count(*) AS n FROM pairs p JOIN {CUTS_SQL.replace('cuts(cut)', 'c(cut)')} ON p.score >= c.cut
             GROUP BY p.t_id, c.cut) r ON r.t_id = e.id AND r.cut = cuts.cut
  GROUP BY cuts.cut)""", ctes={**EXPECTED_CTES, "pairs": window_pairs_sql()})

ORACLE["q_false_positives"] = with_views(f"""
SELECT e.id, t.topic_id, n.matches, m.c_id AS evidence_id, round(m.score, 6) AS score
FROM exp e JOIN (SELECT t_id, count(*) AS matches FROM matches GROUP BY t_id) n ON n.t_id = e.id
JOIN matches m ON m.t_id = e.id JOIN tickets t ON t.id = e.id
WHERE NOT e.expected AND n.matches >= {MIN_COUNT}""", ctes={**EXPECTED_CTES, **MATCHES})

ORACLE["q_boundary_case"] = with_views(f"""
SELECT b.t_id AS id, b.topic_id, CAST({MIN_COUNT - 1} AS BIGINT) AS matches,
       string_agg(m.c_id, ', ' ORDER BY m.score DESC, m.c_id) AS evidence
FROM (SELECT n.t_id, t.topic_id FROM (SELECT t_id, count(*) AS n FROM matches GROUP BY t_id) n
      JOIN tickets t ON t.id = n.t_id WHERE n.n = {MIN_COUNT - 1}
      ORDER BY t.created_at DESC, n.t_id DESC LIMIT 1) b
JOIN matches m ON m.t_id = b.t_id GROUP BY b.t_id, b.topic_id""", ctes=MATCHES)


# ---------------------------------------------------------------- incoming / analysis
ORACLE["q_trend_freetext"] = with_views(f"""
SELECT q.id AS query_id, coalesce(nn.category, 'unknown') AS category, CAST(count(c.id) AS BIGINT) AS similar_count,
       count(c.id) >= {MIN_COUNT} AS is_potential_trend, {RULE_COLS}
FROM tickets q
LEFT JOIN ({topk_sql(1, exclude_self=False)}) nn ON nn.q_id = q.id
LEFT JOIN tickets c ON c.category = coalesce(nn.category, 'unknown')
     AND c.created_at >= (SELECT max(created_at) FROM tickets) - INTERVAL 7 DAY
     AND c.created_at <= (SELECT max(created_at) FROM tickets)
     AND {dot_sql('q.embedding', 'c.embedding')} >= {THR}
GROUP BY q.id, coalesce(nn.category, 'unknown')""")

ORACLE["q_missing_triggers"] = with_views("""
SELECT DISTINCT trigger_ticket_id AS id FROM issues
WHERE trigger_ticket_id IS NOT NULL AND trigger_ticket_id NOT IN (SELECT id FROM tickets)""", views=("tickets", "issues"))

ORACLE["q_queue_with_trend"] = with_views(f"""
SELECT p.id, p.pos, tr.similar_count, tr.is_potential_trend
FROM (SELECT id, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS BIGINT) AS pos FROM tickets) p
JOIN (SELECT t.id, CAST(count(m.c_id) AS BIGINT) AS similar_count, count(m.c_id) >= {MIN_COUNT} AS is_potential_trend
      FROM tickets t LEFT JOIN matches m ON m.t_id = t.id GROUP BY t.id) tr ON tr.id = p.id
WHERE p.pos <= 40""", ctes=MATCHES)

ORACLE["q_incoming_warning"] = with_views(f"""
SELECT id AS ticket_id, 'ticket.trend_checked' AS event, n >= {MIN_COUNT} AS is_potential_trend,
       CASE WHEN n >= {MIN_COUNT} THEN 'Potential trend' END AS label, CAST(n AS BIGINT) AS similar_count, {RULE_COLS},
       CASE WHEN n >= {MIN_COUNT} THEN 'Potential trend: ' || CAST(n AS VARCHAR) || ' similar tickets found in the previous 7 days.'
            ELSE 'No trend signal detected.' END AS message
FROM (SELECT t.id, count(m.c_id) AS n FROM tickets t LEFT JOIN matches m ON m.t_id = t.id GROUP BY t.id)""", ctes=MATCHES)

ORACLE["q_route_incoming"] = with_views("""
SELECT r.request_id, r.external_id, CASE WHEN regexp_matches(r.external_id, '(?i)^T-\\d+$') THEN 'ticket_id' ELSE 'free_text' END AS route,
       CASE WHEN regexp_matches(r.external_id, '(?i)^T-\\d+$') THEN upper(r.external_id) IN (SELECT upper(id) FROM tickets) END AS ticket_found
FROM (SELECT issue_key AS request_id,
             CASE WHEN trigger_ticket_id IS NULL THEN issue_key WHEN key_no % 2 = 0 THEN lower(trigger_ticket_id)
                  ELSE trigger_ticket_id END AS external_id FROM issues) r""", views=("tickets", "issues"))

ORACLE["q_analysis"] = with_views(f"""
SELECT tr.id, s.similar_ids, CAST(tr.n AS BIGINT) AS similar_count, tr.n >= {MIN_COUNT} AS is_potential_trend,
       i.total_tickets, i.unique_accounts, i.arr_at_risk_formatted, d.title AS draft_title
FROM trend tr
LEFT JOIN (SELECT q_id, string_agg(c_id, ', ' ORDER BY rank) AS similar_ids FROM ({topk_sql()}) GROUP BY q_id) s ON s.q_id = tr.id
LEFT JOIN impact i ON i.trigger_id = tr.id LEFT JOIN drafts d ON d.trigger_ticket_id = tr.id""",
                                  views=ACC_VIEWS, ctes=DRAFT_CTES)

def review_ctes(decisions: str = "decisions", log: str = "dlog", p: str = "r") -> dict[str, str]:
    """CTEs of the clusters after the decisions, counted from the tickets that are left (names start with ``p``)."""
    sub = lambda x: (x.replace("matches m", f"{p}incl m").replace("members", f"{p}members")
                     .replace("FROM ca ", f"FROM {p}ca "))
    return {
        f"{p}incl": f"""SELECT m.* FROM matches m LEFT JOIN {decisions} d ON d.trigger_id = m.t_id AND d.ticket_id = m.c_id
WHERE coalesce(d.include, true)""",
        f"{p}members": sub(MEMBERS["members"]), f"{p}ca": sub(MEMBERS["ca"]), f"{p}impact": sub(IMPACT_CTES["impact"]),
        f"{p}state": f"""
SELECT i.*, CAST(coalesce(n.n, 0) AS BIGINT) AS similar_count, coalesce(n.signature, 0) AS signature
FROM {p}impact i LEFT JOIN (SELECT t_id, count(*) AS n, bit_xor(CAST(('0x' || substr(md5(c_id), 1, 15)) AS BIGINT)) AS signature
                            FROM {p}incl GROUP BY t_id) n ON n.t_id = i.trigger_id""",
        f"{p}confirmed": f"""
SELECT * FROM {p}state WHERE similar_count >= {MIN_COUNT} AND trigger_id IN (SELECT trigger_id FROM {log})""",
    }


def _record_ctes() -> dict[str, str]:
    d = DRAFT_CTES["drafts"].replace("FROM flagged f LEFT JOIN impact i", "FROM rflagged f LEFT JOIN rimpact i")
    d = d.replace("LEFT JOIN ids ON ids.t_id", "LEFT JOIN rids ids ON ids.t_id").replace("JOIN samples s", "JOIN rsamples s")
    return {
        **review_ctes(),
        "rflagged": """
SELECT t.id, t.category, t.subject, t.priority, c.similar_count AS n FROM rconfirmed c JOIN tickets t ON t.id = c.trigger_id""",
        "rsamples": """
SELECT t_id AS q_id, string_agg('- ' || subject, chr(10) ORDER BY r) AS sample_lines
FROM (SELECT m.t_id, c.subject, row_number() OVER (PARTITION BY m.t_id ORDER BY m.score DESC, m.c_id) AS r
      FROM rincl m JOIN tickets c ON c.id = m.c_id) WHERE r <= 3 GROUP BY t_id""",
        "rids": DRAFT_CTES["ids"].replace("FROM matches", "FROM rincl"),
        "rdrafts": d,
        "records": """
SELECT c.*, d.title, d.summary, d.priority, d.category, d.similar_ticket_ids, c.similar_count + 1 AS linked_tickets
FROM rconfirmed c JOIN rdrafts d ON d.trigger_ticket_id = c.trigger_id""",
    }


RECORD_CTES = {**IMPACT_CTES, **REVIEW_CTES, **_record_ctes()}

ORACLE["q_reviewed_impact"] = with_views("SELECT * FROM rstate", views=ACC_VIEWS,
                                         ctes={**IMPACT_CTES, **REVIEW_CTES, **review_ctes()})

ORACLE["q_confirm_review"] = with_views("SELECT * FROM records", views=ACC_VIEWS, ctes=RECORD_CTES)

ORACLE["q_reviewed_draft"] = with_views("SELECT * FROM rdrafts", views=ACC_VIEWS, ctes=RECORD_CTES)

ORACLE["q_review_links"] = with_views("""
SELECT l.trigger_id, l.ticket_id, t.subject, l.relationship
FROM (SELECT t_id AS trigger_id, c_id AS ticket_id, 'Similar' AS relationship FROM rincl
      WHERE t_id IN (SELECT trigger_id FROM rconfirmed)
      UNION ALL SELECT trigger_id, trigger_id, 'Trigger' FROM rconfirmed) l JOIN tickets t ON t.id = l.ticket_id""",
                                      views=ACC_VIEWS, ctes=RECORD_CTES)

ORACLE["q_review_current"] = with_views("""
SELECT f.trigger_id, f.similar_count AS included_then, n.similar_count AS included_now,
       f.signature = n.signature AND f.similar_count = n.similar_count AS is_confirmed
FROM fconfirmed f JOIN rstate n ON n.trigger_id = f.trigger_id""", views=ACC_VIEWS, ctes={
    **IMPACT_CTES, **REVIEW_CTES, **review_ctes(),
    "flog": "SELECT * FROM dlog WHERE seq = 1",
    "fdecisions": "SELECT trigger_id, ticket_id, arg_max(include, decided_at) AS include FROM flog GROUP BY ALL",
    **review_ctes("fdecisions", "flog", "f")})

ORACLE["q_pick_draft"] = with_views("""
SELECT t.id AS trigger_id,
       CASE WHEN r.title IS NOT NULL THEN 'review' WHEN d.title IS NOT NULL THEN 'analysis' ELSE 'none' END AS source,
       coalesce(r.title, d.title, 'No engineering draft: below the trend threshold.') AS title,
       coalesce(r.priority, d.priority) AS priority, coalesce(r.similar_count, d.similar_count) AS similar_count
FROM tickets t LEFT JOIN records r ON r.trigger_id = t.id LEFT JOIN drafts d ON d.trigger_ticket_id = t.id""",
                                    views=ACC_VIEWS, ctes={**DRAFT_CTES, **REVIEW_CTES, **_record_ctes()})

ORACLE["q_issue_hydrate"] = with_views(f"""
SELECT i.issue_key, i.trigger_ticket_id, coalesce(r.title, d.title, i.summary) AS summary,
       CASE WHEN d.title IS NOT NULL THEN {title_sql('coalesce(r.priority, d.priority)')} ELSE i.priority END AS priority,
       coalesce(r.similar_count, d.similar_count) AS similar_ticket_count,
       coalesce(r.total_tickets, d.total_tickets) AS zendesk_ticket_count,
       coalesce(r.arr_at_risk_formatted, d.arr_at_risk_formatted) AS arr_at_risk,
       CASE WHEN d.title IS NOT NULL THEN 'live' ELSE 'stored' END AS analysis_source,
       CASE WHEN d.title IS NOT NULL THEN sha256(coalesce(r.summary, d.summary)) END AS description_sha
FROM issues i LEFT JOIN drafts d ON d.trigger_ticket_id = i.trigger_ticket_id
LEFT JOIN records r ON r.trigger_id = i.trigger_ticket_id""", views=IVIEWS,
                                       ctes={**LIVE_CTES, **REVIEW_CTES, **_record_ctes()})


# ---------------------------------------------------------------- sources / ingest / dq
def _pyjson_tags_sql(t: str) -> str:
    arr = TAGS_SQL.format(x=t)
    return ("'[' || array_to_string(list_transform(" + arr + ", lambda x: '\"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"'), ', ') || ']'")


ORACLE["q_ingest_tickets"] = with_views(f"""
SELECT t.id, strftime(t.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, t.subject, t.body, t.category, t.priority,
       t.status, coalesce(a.tier, 'free') AS customer_tier, {_pyjson_tags_sql('t.tags')} AS tags,
       CAST(t.topic_id AS VARCHAR) AS cluster,
       replace(lower({requester_sql('t.id')}), ' ', '.') || '@example.invalid' AS requester_email,
       CAST(t.account_id AS VARCHAR) AS account_id, {requester_sql('t.id')} AS requester_name,
       {title_sql(channel_sql('t.id'))} AS channel, coalesce(nullif(t.assignee, ''), 'Support Team') AS assignee
FROM tickets t LEFT JOIN accounts a ON a.account_id = t.account_id""", views=ACC_VIEWS)

ORACLE["q_account_dim"] = with_views("""
SELECT CAST(t.account_id AS VARCHAR) AS account_id, 'billing-' || lower(CAST(t.account_id AS VARCHAR)) || '@example.invalid' AS customer_email,
       arg_min(a.account_name, (t.created_at, t.id)) AS account_name,
       arg_min(coalesce(a.tier, 'free'), (t.created_at, t.id)) AS tier,
       arg_min(a.arr, (t.created_at, t.id)) AS arr, arg_min(a.region, (t.created_at, t.id)) AS region
FROM tickets t LEFT JOIN accounts a ON a.account_id = t.account_id GROUP BY t.account_id""", views=ACC_VIEWS)

ORACLE["q_messages"] = with_views("""
SELECT t.id AS ticket_id, m.pos, m.author, m.type, length(m.text) AS text_chars
FROM messages m JOIN tickets t ON t.ticket_no = m.ticket_no""", views=("tickets", "messages"))

ORACLE["q_ticket_by_id"] = with_views("SELECT id, category, status, priority, subject FROM tickets WHERE id = 'T-00042'")

ORACLE["q_tickets_by_ids"] = with_views("""
SELECT id, category, status FROM tickets WHERE id IN (SELECT trigger_ticket_id FROM issues)""", views=("tickets", "issues"))

ORACLE["q_schema_align"] = with_views(f"""
SELECT id, account_id, CAST(NULL AS VARCHAR) AS requester_name, CAST(NULL AS VARCHAR) AS channel,
       {requester_sql()} AS requester_display, {channel_sql()} AS channel_display, {assignee_sql()} AS assignee_display
FROM tickets""")

ORACLE["q_fingerprint"] = with_views("""
SELECT count(*) AS n_tickets, bit_xor(CAST(('0x' || substr(md5(id), 1, 15)) AS BIGINT)) AS fingerprint FROM tickets""")

ORACLE["q_embed_incremental"] = with_views("""
SELECT id, 'new' AS reason FROM tickets WHERE created_at >= (SELECT max(created_at) FROM tickets) - INTERVAL 10 DAY""")

ORACLE["q_dq_report"] = with_views(f"""
SELECT 'row_count' AS rule, CAST((SELECT count(*) FROM tickets) <> (SELECT count(*) FROM embeddings) AS BIGINT) AS violations
UNION ALL SELECT 'unique_id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM tickets GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'unique_subject', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM tickets GROUP BY subject HAVING count(*) > 1)
UNION ALL SELECT 'unique_subject_body', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM tickets GROUP BY subject, body HAVING count(*) > 1)
UNION ALL SELECT 'required_fields', CAST(count_if(id IS NULL OR created_at IS NULL OR subject IS NULL OR body IS NULL OR category IS NULL OR priority IS NULL OR status IS NULL) AS BIGINT) FROM tickets
UNION ALL SELECT 'enum_category', CAST(count_if(category NOT IN ('api', 'webhooks', 'billing', 'identity', 'exports', 'sdk', 'account')) AS BIGINT) FROM tickets
UNION ALL SELECT 'enum_priority', CAST(count_if(priority NOT IN ('low', 'medium', 'high', 'urgent')) AS BIGINT) FROM tickets
UNION ALL SELECT 'enum_status', CAST(count_if(status NOT IN ('open', 'pending', 'resolved', 'closed')) AS BIGINT) FROM tickets
UNION ALL SELECT 'id_pattern', CAST(count_if(NOT regexp_matches(id, '^T-[0-9]{{5}}$')) AS BIGINT) FROM tickets
UNION ALL SELECT 'subject_min_length', CAST(count_if(length(subject) < 12) AS BIGINT) FROM tickets
UNION ALL SELECT 'body_min_length', CAST(count_if(length(body) < 30) AS BIGINT) FROM tickets
UNION ALL SELECT 'min_two_messages', CAST(count_if(coalesce(p.n, 0) < 2) AS BIGINT)
  FROM tickets t LEFT JOIN (SELECT ticket_no, count(*) AS n FROM messages GROUP BY ticket_no) p ON p.ticket_no = t.ticket_no
UNION ALL SELECT 'last_author_customer_iff_resolved', CAST(count_if((p.la = 'customer') <> (t.status = 'resolved')) AS BIGINT)
  FROM tickets t JOIN (SELECT ticket_no, arg_max(author, pos) AS la FROM messages GROUP BY ticket_no) p ON p.ticket_no = t.ticket_no
UNION ALL SELECT 'arr_non_negative', CAST(count_if(arr < 0) AS BIGINT) FROM accounts
UNION ALL SELECT 'issue_links_resolve', CAST(count(*) AS BIGINT) FROM issues
  WHERE trigger_ticket_id IS NOT NULL AND trigger_ticket_id NOT IN (SELECT id FROM tickets)""",
    views=("tickets", "messages", "accounts", "issues"))

ORACLE["q_dq_histogram"] = with_views("""
SELECT 'status' AS kind, status AS value, count(*) AS n FROM tickets GROUP BY status
UNION ALL SELECT 'label', CASE WHEN is_emerging_trend THEN 'emerging' ELSE 'normal' END, count(*) FROM tickets GROUP BY 2
UNION ALL SELECT 'topic', CAST(topic_id AS VARCHAR), count(*) FROM tickets GROUP BY 2""")

ORACLE["q_review_report"] = with_views("""
SELECT t.id AS ticket_id, m.pos,
       sha256(upper(substr(m.author, 1, 1)) || lower(substr(m.author, 2)) || ' (' || m.type || '): ' || m.text) AS line
FROM messages m JOIN tickets t ON t.ticket_no = m.ticket_no""", views=("tickets", "messages"))

ORACLE["q_stream_warnings"] = ORACLE["q_incoming_warning"]
ORACLE["q_stream_matches"] = with_views("SELECT t_id AS trigger_id, c_id AS similar_id, round(score, 6) AS score FROM matches",
                                        ctes=MATCHES)


# ---------------------------------------------------------------- text helpers
FT_CTES = {
    "nn": topk_sql(1, exclude_self=False),
    "q": "SELECT t.id AS query_id, t.subject, t.embedding, coalesce(nn.category, 'unknown') AS category "
         "FROM tickets t LEFT JOIN nn ON nn.q_id = t.id",
    "ftm": f"""
SELECT q.query_id, c.id AS c_id, c.account_id FROM q JOIN tickets c ON c.category = q.category
 AND c.created_at >= (SELECT max(created_at) FROM tickets) - INTERVAL 7 DAY AND c.created_at <= (SELECT max(created_at) FROM tickets)
 AND {dot_sql('q.embedding', 'c.embedding')} >= {THR}""",
    "ftn": "SELECT q.query_id, q.subject, q.category, count(m.c_id) AS n FROM q LEFT JOIN ftm m ON m.query_id = q.query_id "
           "GROUP BY q.query_id, q.subject, q.category",
    "ftca": """
SELECT m.query_id, m.account_id, any_value(a.arr) AS arr,
       any_value(CASE WHEN a.tier IN ('enterprise', 'pro', 'free') THEN a.tier ELSE 'free' END) AS tier
FROM ftm m JOIN accounts a ON a.account_id = m.account_id GROUP BY m.query_id, m.account_id""",
    "fti": f"""
SELECT t.query_id, CAST(t.total AS BIGINT) AS total_tickets, CAST(coalesce(p.ua, 0) AS BIGINT) AS unique_accounts,
       {fmt_arr_sql('CAST(coalesce(p.arr, 0) AS BIGINT)')} AS arr_at_risk_formatted
FROM (SELECT query_id, count(*) AS total FROM ftm GROUP BY query_id) t
LEFT JOIN (SELECT query_id, count(*) AS ua, sum(arr) AS arr FROM ftca GROUP BY query_id) p ON p.query_id = t.query_id""",
    "ftids": """
SELECT query_id, string_agg(c_id, ', ' ORDER BY c_id) AS ids FROM (
  SELECT query_id, c_id, row_number() OVER (PARTITION BY query_id ORDER BY c_id) AS r FROM ftm) WHERE r <= 20 GROUP BY query_id""",
}

ORACLE["q_draft_freetext"] = with_views(f"""
SELECT f.query_id,
       '[Trend] Recurring ' || {title_sql('f.category')} || ' issues (' || CAST(f.n AS VARCHAR) || ' similar tickets)' AS title,
       'Support trend detected from free-text input (' || substr(coalesce(f.subject, ''), 1, 60) || '): ' || CAST(f.n AS VARCHAR)
         || ' tickets with similarity >= 20%.' AS summary,
       CASE WHEN f.n >= 20 THEN 'medium' ELSE 'low' END AS priority, f.category, CAST(f.n AS BIGINT) AS similar_count,
       coalesce(ids.ids, '') AS similar_ticket_ids, coalesce(i.total_tickets, 0) AS total_tickets,
       coalesce(i.unique_accounts, 0) AS unique_accounts, coalesce(i.arr_at_risk_formatted, '$0') AS arr_at_risk_formatted
FROM ftn f LEFT JOIN fti i ON i.query_id = f.query_id LEFT JOIN ftids ids ON ids.query_id = f.query_id
WHERE f.n >= {MIN_COUNT}""", views=ACC_VIEWS, ctes=FT_CTES)


def _notes_sql() -> str:
    name = requester_sql("t.id")
    tier = "lower(coalesce(a.tier, 'free'))"
    comp = "coalesce(nullif(a.account_name, ''), 'this account')"
    first = f"string_split_regex({name}, '\\s+')[1]"
    return f"""
SELECT t.id,
       CASE WHEN {tier} = 'enterprise' THEN 'Valuable Customer since 2010 — ' || {comp} || ' enterprise account'
            WHEN {tier} = 'pro' THEN 'Pro customer — ' || {comp} || ' since 2018'
            ELSE 'Customer since 2022 — ' || {comp} END AS customer_note,
       CASE WHEN {tier} = 'enterprise' THEN {name} || ' is on an enterprise account — prioritize response.'
            WHEN {tier} = 'pro' THEN {name} || ' is a pro customer. Give attentive support.'
            ELSE 'Standard support tier for ' || {name} || '.' END AS internal_note,
       CASE WHEN contains(lower(coalesce(t.category, '')), 'api')
            THEN 'Hi ' || {first} || ', thanks for reaching out. I can help with your API question. Let me review your account setup.'
            ELSE 'Hi ' || {first} || ', how can I help you today? I see your request about: '
                 || CASE WHEN length(t.subject) <= 60 THEN t.subject ELSE substr(t.subject, 1, 59) || '…' END END AS agent_reply
FROM tickets t LEFT JOIN accounts a ON a.account_id = t.account_id"""


ORACLE["q_customer_notes"] = with_views(_notes_sql(), views=ACC_VIEWS)

ORACLE["q_report_lines"] = with_views(f"""
SELECT trigger_id, 'tier' AS kind, CAST(pos AS BIGINT) AS pos,
       {title_sql('tier')} || ' accounts: ' || CAST(accounts AS VARCHAR) || ' - $' || format('{{:,}}', arr) || ' ARR' AS line
FROM (SELECT trigger_id, 'enterprise' AS tier, 1 AS pos, enterprise_accounts AS accounts, enterprise_arr AS arr FROM impact
      UNION ALL SELECT trigger_id, 'pro', 2, pro_accounts, pro_arr FROM impact
      UNION ALL SELECT trigger_id, 'free', 3, free_accounts, free_arr FROM impact) WHERE accounts > 0 OR arr > 0
UNION ALL
SELECT trigger_id, 'account', rank, account_name || ' (' || {title_sql('tier')} || '): ' || {fmt_arr_sql('arr')}
FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY arr DESC, first_seen) AS rank FROM ca) WHERE rank <= 5
UNION ALL
SELECT t.id, 'badge', 0, CASE WHEN coalesce(r.n, 0) >= {MIN_COUNT} THEN 'Reviewed cluster meets trend threshold'
                              ELSE 'Reviewed cluster is below trend threshold' END
FROM tickets t LEFT JOIN (
  SELECT m.t_id, count(*) AS n FROM matches m LEFT JOIN decisions d ON d.trigger_id = m.t_id AND d.ticket_id = m.c_id
  WHERE coalesce(d.include, true) GROUP BY m.t_id) r ON r.t_id = t.id""", views=ACC_VIEWS,
                                     ctes={**IMPACT_CTES, **REVIEW_CTES})

# The hashed TF-IDF vector has 512 slots and unit norm whenever the text has
# a token (ASCII word characters, as the tokenizer splits on \W), else norm 0.
ORACLE["q_embed"] = with_views("""
SELECT id, 512 AS dims,
       CASE WHEN regexp_matches(coalesce(subject, '') || ' ' || coalesce(body, ''), '[A-Za-z0-9_]') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS norm
FROM tickets""")

ORACLE["q_component"] = with_views(f"""
SELECT issue_key, {_pills_case("list_filter(lb, lambda x: x NOT IN ('support-escalation', 'trend-warning'))[1]")} AS component
FROM (SELECT *, {labels_sql(LBL_TEXT, "'support'")} AS lb FROM issues)""", views=("issues",))

ORACLE["q_elevated_priority"] = with_views(f"""
SELECT t.id, t.priority, CAST(t.n AS BIGINT) AS similar_count, e.elevated,
       CASE e.elevated WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' WHEN 'high' THEN 'High' WHEN 'urgent' THEN 'Urgent'
            ELSE {title_sql('e.elevated')} END AS elevated_label
FROM trend t, LATERAL (SELECT CASE WHEN t.n >= 50 OR lower(t.priority) = 'urgent' THEN 'urgent'
                                   WHEN t.n >= 20 OR lower(t.priority) = 'high' THEN 'high' ELSE lower(t.priority) END AS elevated) e""",
                                        ctes=DRAFT_CTES, views=ACC_VIEWS)

ORACLE["q_quality_text"] = with_views("SELECT draft_id, recommendation, summary FROM report", views=QVIEWS,
                                      ctes=QUALITY_CTES)

ORACLE["q_enrich_account"] = with_views(f"""
SELECT t.id, CASE WHEN a.account_id IS NOT NULL THEN 'account_id' WHEN m.account_id IS NOT NULL THEN 'requester_email' END AS matched_by,
       coalesce(a.account_name, m.account_name, '') AS account_name, coalesce(a.arr, m.arr, 0) AS account_arr,
       CASE WHEN coalesce(a.account_id, m.account_id) IS NOT NULL THEN {fmt_arr_sql('coalesce(a.arr, m.arr)')} ELSE '—' END AS account_arr_formatted,
       coalesce(a.region, m.region, '') AS account_region,
       CASE WHEN coalesce(a.account_id, m.account_id) IS NOT NULL THEN coalesce(a.tier, m.tier, '') ELSE '' END AS account_tier
FROM tickets t LEFT JOIN accounts a ON a.account_id = t.account_id
LEFT JOIN (SELECT customer_email, arg_max(account_id, account_id) AS account_id, arg_max(account_name, account_id) AS account_name,
                  arg_max(arr, account_id) AS arr, arg_max(region, account_id) AS region, arg_max(tier, account_id) AS tier
           FROM accounts GROUP BY customer_email) m ON m.customer_email = 'billing-' || CAST(t.ticket_no AS VARCHAR) || '@example.invalid'""",
                                        views=ACC_VIEWS)

ORACLE["q_nn_accuracy_golden"] = with_views(f"""
SELECT count(*) AS n, CAST(count_if(g.golden = nn.golden) AS BIGINT) AS correct,
       round(count_if(g.golden = nn.golden) / count(*), 6) AS accuracy
FROM (SELECT t.id, l.quality AS golden FROM tickets t JOIN labels l ON l.doc_id = t.ticket_no) g
LEFT JOIN (
  SELECT q_id, golden FROM (
    SELECT q.id AS q_id, l.quality AS golden,
           row_number() OVER (PARTITION BY q.id ORDER BY {dot_sql('q.embedding', 'c.embedding')} DESC, c.id) AS r
    FROM tickets q JOIN tickets c ON c.id <> q.id LEFT JOIN labels l ON l.doc_id = c.ticket_no) WHERE r = 1) nn
  ON nn.q_id = g.id""")
