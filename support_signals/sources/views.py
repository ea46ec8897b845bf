"""Canonical ticket-domain views over the driver tables.

The driver tables carry no tickets, so the ticket domain is derived from
them (the same definitions are used as SQL text by the DuckDB oracle):

* ``tickets``  one row per number that a document or an embedding vector has.
  Text and vector are those of the number, counted round again in the shorter
  table; every event belongs to one ticket: the ticket's opening event gives
  time, category and account, and the errors among its events the priority;
* ``accounts`` from customer + nation + region;
* ``messages`` from conversations;
* ``issues``   from orders (+ customer for the assignee).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from support_signals.sources.tables import table


def ticket_id(no: Column) -> Column:
    """``T-`` and the number in five digits, or as many as it has."""
    digits = no.cast("string")
    return F.concat(F.lit("T-"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def _priority(errors: Column) -> Column:
    return F.when(errors >= 4, "urgent").when(errors == 3, "high").when(errors == 2, "medium").otherwise("low")


def _status(no: Column) -> Column:
    return F.when(no % 5 == 3, "open").when(no % 5 == 4, "pending").otherwise("resolved")


def _assignee(no: Column) -> Column:
    return (F.when(no % 6 == 0, F.lit(None).cast("string")).when(no % 11 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("agent"), (no % 8).cast("string"))))


def _rows(df: DataFrame) -> Column:
    """Row count as a scalar subquery, evaluated once."""
    return F.coalesce(df.select(F.count(F.lit(1))).scalar(), F.lit(0))


def ticket_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "documents").select(F.col("doc_id").alias("no"))
            .union(table(spark, sf_dir, "embeddings").select("vec_id")).distinct())


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ticket_numbers(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    # the subject is cut before the join, so that a job without the body does not shuffle the texts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source",
                                                    F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("head"))
    n_tickets, n_events, n_emb, n_docs = (_rows(x) for x in (numbers, ev, emb, docs))
    no = F.col("no")
    # the opening event of each ticket, and to which ticket each event belongs
    first_event = F.floor((no * n_events).cast("decimal(38,0)") / n_tickets).cast("bigint")
    errors = (ev.select(F.floor((F.col("event_id") * n_tickets).cast("decimal(38,0)") / n_events).cast("bigint").alias("owner"), "event_type")
              .groupBy("owner").agg(F.count_if(F.col("event_type") == "error").alias("errors")))
    lap = F.floor(no / n_emb).cast("bigint")
    other = emb.select(F.col("vec_id").alias("vec2"), F.col("embedding").alias("embedding2"))
    j = (numbers.withColumns({"event_key": first_event, "vec_key": no % n_emb, "vec2_key": (no + lap) % n_emb, "doc_key": no % n_docs})
         .join(ev, F.col("event_key") == ev.event_id, "left")
         .join(errors, no == F.col("owner"), "left")
         .join(emb, F.col("vec_key") == emb.vec_id, "left")
         .join(other, F.col("vec2_key") == F.col("vec2"), "left")
         .join(docs, F.col("doc_key") == docs.doc_id, "left"))
    text = F.coalesce(F.col("text"), F.lit(""))
    total = F.zip_with("embedding", "embedding2", lambda x, y: x.cast("double") + y.cast("double"))
    # later laps: the middle of two vectors.  The squares are summed once per ticket and not once per element.
    middle = F.aggregate(total, F.lit(0.0), lambda acc, x: acc + x * x,
                         lambda squares: F.transform(total, lambda x: (x / F.sqrt(squares)).cast("float")))
    vector = F.when(F.col("vec_key") == F.col("vec2_key"), F.col("embedding")).otherwise(middle)
    return j.select(
        no.alias("ticket_no"),
        ticket_id(no).alias("id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("category"),
        F.col("user_id").alias("account_id"),
        _priority(F.coalesce("errors", F.lit(0))).alias("priority"),
        _status(no).alias("status"),
        _assignee(no).alias("assignee"),
        F.coalesce("head", F.lit("")).alias("subject"),
        text.alias("body"),
        F.concat(F.lit('["'), F.col("event_type"), F.lit('","'), F.coalesce(F.col("lang"), F.lit("xx")),
                 F.lit('","'), F.coalesce(F.col("source"), F.lit("none")), F.lit('"]')).alias("tags"),
        F.col("label").alias("topic_id"),
        (F.col("label") < 5).alias("is_emerging_trend"),
        vector.alias("embedding"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation/region are fixed-size dimensions (25 / 5 rows): broadcast.
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    bal = F.col("c_acctbal")
    return j.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.concat(F.lit("billing-"), F.col("c_custkey").cast("string"), F.lit("@example.invalid")).alias("customer_email"),
        F.when(bal >= 6000, "enterprise").when(bal >= 2000, "pro").otherwise("free").alias("tier"),
        F.floor(F.greatest(bal, F.lit(0.0)) * 100).cast("bigint").alias("arr"),
        F.col("r_name").alias("region"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.select(
        F.col("conv_id").alias("ticket_no"),
        F.col("turn").alias("pos"),
        F.when(F.col("role") == "user", "customer").otherwise("agent").alias("author"),
        F.when(F.col("role") == "system", "internal").otherwise("public").alias("type"),
        F.col("text"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    key = F.col("o_orderkey")
    n_tickets = _rows(ticket_numbers(spark, sf_dir))
    return j.select(
        F.concat(F.lit("ENG-"), (key + 101).cast("string")).alias("issue_key"),
        key.alias("key_no"),
        F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "P", "In Progress")
        .otherwise("Done").alias("status"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "Urgent")
        .when(F.substring("o_orderpriority", 1, 1) == "2", "High")
        .when(F.substring("o_orderpriority", 1, 1) == "3", "Medium").otherwise("Low").alias("priority"),
        F.col("c_name").alias("assignee"),
        F.concat(F.lit("Escalation "), F.lower("c_mktsegment")).alias("summary"),
        F.col("o_orderdate").cast("date").alias("created"),
        F.when(key % 97 == 0, ticket_id(key % n_tickets)).alias("trigger_ticket_id"),
    )


# SQL text of the same views, shared with the DuckDB oracle (plans/oracle.py).
TICKETS_SQL = """
SELECT x.no AS ticket_no,
       'T-' || CASE WHEN x.no < 10000 THEN printf('%05d', x.no) ELSE CAST(x.no AS VARCHAR) END AS id,
       ev.ts AS created_at, ev.event_type AS category, ev.user_id AS account_id,
       CASE WHEN coalesce(g.errors, 0) >= 4 THEN 'urgent' WHEN g.errors = 3 THEN 'high'
            WHEN g.errors = 2 THEN 'medium' ELSE 'low' END AS priority,
       CASE WHEN x.no % 5 = 3 THEN 'open' WHEN x.no % 5 = 4 THEN 'pending' ELSE 'resolved' END AS status,
       CASE WHEN x.no % 6 = 0 THEN NULL WHEN x.no % 11 = 0 THEN ''
            ELSE concat('agent', CAST(x.no % 8 AS VARCHAR)) END AS assignee,
       substr(coalesce(d.text, ''), 1, 60) AS subject, coalesce(d.text, '') AS body,
       '["' || ev.event_type || '","' || coalesce(d.lang, 'xx') || '","' || coalesce(d.source, 'none') || '"]' AS tags,
       e.label AS topic_id, e.label < 5 AS is_emerging_trend,
       CASE WHEN e.vec_id = e2.vec_id THEN e.embedding ELSE list_transform(list_zip(e.embedding, e2.embedding),
         lambda p: CAST((CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / sqrt(list_sum(list_transform(list_zip(e.embedding, e2.embedding),
           lambda q: (CAST(q[1] AS DOUBLE) + CAST(q[2] AS DOUBLE)) * (CAST(q[1] AS DOUBLE) + CAST(q[2] AS DOUBLE))))) AS FLOAT)) END AS embedding
FROM (SELECT n.no, (n.no * s.n_events) // s.n_tickets AS event_key, n.no % s.n_emb AS vec_key,
             (n.no + n.no // s.n_emb) % s.n_emb AS vec2_key, n.no % s.n_docs AS doc_key
      FROM (SELECT doc_id AS no FROM documents UNION SELECT vec_id FROM embeddings) n,
           (SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)) AS n_tickets,
                   (SELECT count(*) FROM events) AS n_events, (SELECT count(*) FROM embeddings) AS n_emb,
                   (SELECT count(*) FROM documents) AS n_docs) s) x
LEFT JOIN events ev ON ev.event_id = x.event_key
LEFT JOIN (SELECT (event_id * t.n) // c.n AS owner, count_if(event_type = 'error') AS errors
           FROM events, (SELECT count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)) t,
                (SELECT count(*) AS n FROM events) c GROUP BY 1) g ON g.owner = x.no
LEFT JOIN embeddings e ON e.vec_id = x.vec_key
LEFT JOIN embeddings e2 ON e2.vec_id = x.vec2_key
LEFT JOIN documents d ON d.doc_id = x.doc_key
"""

ACCOUNTS_SQL = """
SELECT c.c_custkey AS account_id, c.c_name AS account_name,
       concat('billing-', CAST(c.c_custkey AS VARCHAR), '@example.invalid') AS customer_email,
       CASE WHEN c.c_acctbal >= 6000 THEN 'enterprise' WHEN c.c_acctbal >= 2000 THEN 'pro' ELSE 'free' END AS tier,
       CAST(FLOOR(GREATEST(c.c_acctbal, 0) * 100) AS BIGINT) AS arr, g.r_name AS region
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region g ON g.r_regionkey = n.n_regionkey
"""

MESSAGES_SQL = """
SELECT conv_id AS ticket_no, turn AS pos,
       CASE WHEN role = 'user' THEN 'customer' ELSE 'agent' END AS author,
       CASE WHEN role = 'system' THEN 'internal' ELSE 'public' END AS type, text
FROM conversations
"""

ISSUES_SQL = """
SELECT concat('ENG-', CAST(o.o_orderkey + 101 AS VARCHAR)) AS issue_key, o.o_orderkey AS key_no,
       CASE o.o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress' ELSE 'Done' END AS status,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High'
            WHEN '3' THEN 'Medium' ELSE 'Low' END AS priority,
       c.c_name AS assignee, concat('Escalation ', lower(c.c_mktsegment)) AS summary,
       CAST(o.o_orderdate AS DATE) AS created,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 'T-' || CASE WHEN o.o_orderkey % s.n < 10000 THEN printf('%05d', o.o_orderkey % s.n)
            ELSE CAST(o.o_orderkey % s.n AS VARCHAR) END END AS trigger_ticket_id
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey,
     (SELECT count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)) s
"""
