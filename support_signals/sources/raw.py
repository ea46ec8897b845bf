"""Raw ticket dataset: nested schema, ingest gate, flattening.

The reference ships one JSON document holding every ticket.  A single
multi-line JSON file is not splittable, so at scale tickets should arrive as
JSON lines (one ticket per line, ``read_ticket_lines``); both layouts give
the same nested ticket rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from support_signals.functions.labels import channel, parse_tags, requester_name

MESSAGE = T.StructType([
    T.StructField("author", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("type", T.StringType()),
])
ACCOUNT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("arr", T.LongType()), T.StructField("region", T.StringType()),
])
GROUND_TRUTH = T.StructType([
    T.StructField("cluster_id", T.StringType()), T.StructField("topic_id", T.StringType()),
    T.StructField("is_emerging_trend", T.BooleanType()), T.StructField("root_cause", T.StringType()),
    T.StructField("is_trend_seed", T.BooleanType()),
])
RAW_TICKET = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("priority", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("customer_tier", T.StringType()),
    T.StructField("account", ACCOUNT), T.StructField("requester", T.StringType()),
    T.StructField("assignee", T.StringType()), T.StructField("channel", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("ground_truth", GROUND_TRUTH),
])
RAW_DOCUMENT = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("synthetic", T.BooleanType()), T.StructField("ticket_count", T.LongType()),
    T.StructField("tickets", T.ArrayType(RAW_TICKET)),
])

DEFAULT_ASSIGNEE = "Support Team"          # fixed value: assignee of imported tickets without one
EMAIL_DOMAIN = "example.invalid"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A1: the one-document layout."""
    return spark.read.json(path, schema=RAW_DOCUMENT, multiLine=True)


def read_ticket_lines(spark: SparkSession, path: str) -> DataFrame:
    """Splittable layout: one raw ticket per JSON line."""
    return spark.read.json(path, schema=RAW_TICKET)


def gate(doc: DataFrame, expected_count: int | None) -> DataFrame:
    """One row per document with ``ok`` = the ticket count matches and
    the synthetic flag is set (callers fail fast on ``not ok``)."""
    n = F.size("tickets")
    ok = (F.col("synthetic") == F.lit(True))
    if expected_count is not None:
        ok = ok & (n == expected_count)
    return doc.select(n.cast("bigint").alias("tickets"), F.col("synthetic"), ok.alias("ok"))


def assert_gate(doc: DataFrame, expected_count: int | None) -> None:
    bad = gate(doc, expected_count).where(~F.col("ok")).limit(1).collect()
    if bad:
        raise ValueError(f"Expected the validated {expected_count}-ticket synthetic dataset")


def explode_tickets(doc: DataFrame) -> DataFrame:
    return doc.select(F.explode("tickets").alias("t")).select("t.*")


def iso_naive(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP_NTZ; a trailing 'Z' or offset is dropped
    (wall-clock kept, no conversion); other text is null."""
    stripped = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.try_to_timestamp(F.regexp_replace(stripped, "T", " ")).cast("timestamp_ntz")


def python_json_list(arr: Column) -> Column:
    """Tags as Python's ``json.dumps(list)`` writes them: ``["a", "b"]``."""
    quoted = F.transform(arr, lambda t: F.concat(
        F.lit('"'), F.regexp_replace(F.regexp_replace(t, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def requester_email(name: Column, domain: str = EMAIL_DOMAIN) -> Column:
    """A3: lower-case name, blanks to dots, fixed domain."""
    return F.concat(F.regexp_replace(F.lower(name), " ", "."), F.lit(f"@{domain}"))


def flatten_tickets(raw: DataFrame, domain: str = EMAIL_DOMAIN) -> DataFrame:
    """A2: nested tickets -> the 15-column flat ticket table."""
    return raw.select(
        "id", iso_naive(F.col("created_at")).alias("created_at"), "subject", "body", "category", "priority",
        "status", "customer_tier", python_json_list(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
        F.col("ground_truth.topic_id").alias("cluster"), requester_email(F.col("requester"), domain).alias("requester_email"),
        F.col("account.id").alias("account_id"), F.col("requester").alias("requester_name"),
        F.initcap("channel").alias("channel"), F.coalesce("assignee", F.lit(DEFAULT_ASSIGNEE)).alias("assignee"),
    )


def account_dimension(raw: DataFrame, domain: str = EMAIL_DOMAIN) -> DataFrame:
    """A4: one row per account taken from its first ticket (created, then id)."""
    first = (raw.groupBy(F.col("account.id").alias("account_id"))
             .agg(F.min_by(F.struct("account", "customer_tier"), F.struct(iso_naive(F.col("created_at")), F.col("id")))
                  .alias("f")))
    return first.select(
        "account_id",
        F.concat(F.lit("billing-"), F.lower("account_id"), F.lit(f"@{domain}")).alias("customer_email"),
        F.col("f.account.name").alias("account_name"), F.col("f.customer_tier").alias("tier"),
        F.col("f.account.arr").alias("arr"), F.col("f.account.region").alias("region"))


def conversation_rows(raw: DataFrame) -> DataFrame:
    """A5: (ticket_id, pos, message fields) from the nested messages."""
    return (raw.select("id", F.posexplode(F.coalesce("messages", F.array().cast(T.ArrayType(MESSAGE)))).alias("pos", "m"))
            .select(F.col("id").alias("ticket_id"), "pos", "m.*"))


def align_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing optional columns as typed NULLs (e.g. requester_name)."""
    add = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def nest_from_views(tickets: DataFrame, accounts: DataFrame) -> DataFrame:
    """Raw-shaped tickets built from the canonical views (for the ingest test
    query): account struct, tags array, ground truth; messages stay in their
    own table (no per-ticket gathering)."""
    acc = accounts.select(F.col("account_id"), F.struct(
        F.col("account_id").cast("string").alias("id"), F.col("account_name").alias("name"),
        F.col("arr").alias("arr"), F.col("region").alias("region")).alias("account"), F.col("tier"))
    j = tickets.join(acc, "account_id", "left")
    return j.select(
        "id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"), "subject", "body",
        "category", "priority", "status", F.coalesce("tier", F.lit("free")).alias("customer_tier"),
        F.coalesce("account", F.struct(F.col("account_id").cast("string").alias("id"),
                                       F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("arr"),
                                       F.lit(None).cast("string").alias("region"))).alias("account"),
        requester_name("id").alias("requester"), F.nullif(F.col("assignee"), F.lit("")).alias("assignee"),
        F.lower(channel("id")).alias("channel"), parse_tags("tags").alias("tags"),
        F.array().cast(T.ArrayType(MESSAGE)).alias("messages"),
        F.struct(F.lit(None).cast("string").alias("cluster_id"), F.col("topic_id").cast("string").alias("topic_id"),
                 F.col("is_emerging_trend").alias("is_emerging_trend"), F.lit(None).cast("string").alias("root_cause"),
                 F.lit(False).alias("is_trend_seed")).alias("ground_truth"),
    )


def ticket_accounts(tickets: DataFrame) -> DataFrame:
    """(id, account_id) of the tickets that have an account; empty where the source has no such column."""
    if "account_id" not in tickets.columns:
        return tickets.select("id", F.lit(None).cast("string").alias("account_id")).where(F.lit(False))
    return tickets.where(F.col("account_id").isNotNull()).select("id", "account_id")
