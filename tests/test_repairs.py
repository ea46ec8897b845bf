"""Small rules that a single bad value or a large number must not break."""

import types

import pytest
from pyspark.sql import functions as F

from support_signals import session
from support_signals.functions.formats import title_case
from support_signals.functions.labels import date_label
from support_signals.operators.issues import hydrate, without_trigger
from support_signals.sources.raw import iso_naive
from support_signals.sources.views import ticket_id


def test_ids_keep_all_digits(spark):
    numbers = [0, 42, 99_999, 100_000, 100_011, 12_345_678_901]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n bigint").select(ticket_id(F.col("n"))).collect()]
    assert got == ["T-00000", "T-00042", "T-99999", "T-100000", "T-100011", "T-12345678901"]


def test_bad_dates_fall_back(spark):
    df = spark.createDataFrame([("2026-07-03T04:05:06Z",), ("2026-07-03 04:05:06+02:00",), ("not a date at all",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(date_label("t")).collect()] == ["Jul 03", "Jul 03", "not a date", "", "—"]
    naive = [r[0] for r in df.select(iso_naive(F.col("t"))).collect()]
    assert [str(x) for x in naive] == ["2026-07-03 04:05:06", "2026-07-03 04:05:06", "None", "None", "None"]


def test_title_case_as_python(spark):
    words = ["feature-flags", "data_export", "it's a-b c3po", "ÉTÉ là", "", "x"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(title_case("w")).collect()]
    assert got == [w.replace("_", " ").title() for w in words]


def test_no_local_folder_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        sc = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master)
        with pytest.raises(ValueError):
            session.ensure_checkpoint_dir(types.SimpleNamespace(sparkContext=sc))


def test_issues_without_a_trigger_stay_out_of_the_join(spark):
    issues = spark.createDataFrame([("ENG-1", None, "s", "Low"), ("ENG-2", "T-00001", "s", "Low"), ("ENG-3", "T-00009", "s", "Low")],
                                   "issue_key string, trigger_ticket_id string, summary string, priority string")
    live = spark.createDataFrame([("T-00001", "title", "sum", "high", 4, 5, "$1")],
                                 "trigger_ticket_id string, title string, summary string, priority string, similar_count bigint, total_tickets bigint, arr_at_risk_formatted string")
    out = hydrate(issues, live)
    assert {r.issue_key: (r.summary, r.analysis_source) for r in out.collect()} == {
        "ENG-1": ("s", "stored"), "ENG-2": ("title", "live"), "ENG-3": ("s", "stored")}
    assert without_trigger(issues).count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "isnull(trigger_ticket_id" in plan
