"""Issue lookups by key and by trigger, the ticket to account map and the count fallback."""

from pyspark.sql import functions as F

from support_signals.operators.issues import issue_by_key, issue_links, ticket_count
from support_signals.sources.raw import ticket_accounts

ISSUES = "issue_key string, key_no bigint, status string, priority string, summary string, assignee string, trigger_ticket_id string"


def backlog(spark):
    return spark.createDataFrame([("ENG-101", 101, "Open", "High", "a", "x", "T-1"), ("ENG-102", 102, "Done", "Low", "b", None, "T-1"),
                                  ("ENG-102", 99, "Open", "Low", "first", None, None), (None, 5, "Open", "Low", "no key", None, "T-2")], ISSUES)


def test_lookup_by_key(spark):
    keys = spark.createDataFrame([("ENG-102",), ("ENG-102",), ("ENG-7",), (None,)], "issue_key string")
    got = {r.issue_key: (r.found, r.summary) for r in issue_by_key(backlog(spark), keys).collect()}
    assert got == {"ENG-102": (True, "first"), "ENG-7": (False, None), None: (False, None)}


def test_links_of_tickets(spark):
    t = spark.createDataFrame([("T-1",), ("T-2",), ("T-3",)], "id string")
    got = {r.id: (r.linked, r.issue_key, r.linked_issues) for r in issue_links(backlog(spark), t).collect()}
    assert got["T-1"] == (True, "ENG-101", 2) and got["T-3"] == (False, None, 0)
    assert issue_links(backlog(spark).where("false"), t).where("linked").count() == 0


def test_accounts_without_the_column_or_a_value(spark):
    t = spark.createDataFrame([("T-1", 7), ("T-2", None)], "id string, account_id bigint")
    assert [tuple(r) for r in ticket_accounts(t).collect()] == [("T-1", 7)]
    none = ticket_accounts(t.drop("account_id"))
    assert none.columns == ["id", "account_id"] and none.collect() == []


def test_first_count_that_is_not_zero(spark):
    df = spark.createDataFrame([(0, 4), (3, 9), (None, None), (None, 2), (0, 0)], "a int, b int")
    assert [r.n for r in df.select(ticket_count("a", F.col("b")).alias("n")).collect()] == [4, 3, 0, 2, 0]
