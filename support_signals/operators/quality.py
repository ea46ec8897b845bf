"""Escalation-draft quality checklist.

Eight weighted checks, all required for ``ready``.  Each check is a pair of
Columns (passed, detail) so the whole report is one projection; a caller can
append checks to ``CHECKS`` (the plug point of the reference).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the reference --------------------------------------
MIN_SUMMARY_CHARS = 80
MIN_EVIDENCE_TICKETS = 3
PASS_SCORE = 0.75
NEEDS_WORK_SCORE = 0.50
GENERIC_TITLES = ("trend", "issue", "bug", "escalation")
EMPTY_ARR = ("$0", "$0K", "0", "—", "-")
PRIORITIES = ("low", "medium", "high", "urgent")
VERDICT_RANK = {"poor": 0, "needs_work": 1, "ready": 2}
# Patterns (case-insensitive; the first and third also let '.' span lines).
# (?U) gives Java the Unicode word boundaries Python uses.
EXPECTED_ACTUAL_RE = (r"(?isU)\b(expected|actual|observed)\b.{0,80}\b(expected|actual|observed)\b"
                      r"|\bexpected\s*(behavior|result|outcome)\b"
                      r"|\bactual\s*(behavior|result|outcome)\b")
REPRO_OR_ENV_RE = (r"(?iU)\b(repro(duce|duction)?|steps?\s+to\s+reproduce|environment|version|"
                   r"build|region|tenant|staging|production)\b")
EXPLICIT_GAP_RE = (r"(?isU)\b(missing|not\s+yet|unknown|to\s+be\s+collected|needs?\s+follow[- ]?up)\b"
                   r".{0,40}\b(repro|environment|version|steps)\b")
READY_TEXT = ("Draft looks complete enough for Engineering review. "
              "A human should still confirm priority and impact.")
NEEDS_WORK_TEXT = "Strengthen before escalating, or proceed with an explicit caveat. Missing: "
POOR_TEXT = "Draft is too thin for a useful Engineering handoff. Add: "

DRAFT_FIELDS = ("title", "summary", "description", "expected_behavior", "actual_behavior",
                "reproduction_steps", "environment")


def _s(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _blank(name: str) -> Column:
    return F.trim(_s(name)) == ""


def _blob() -> Column:
    return F.concat_ws("\n", *[_s(f) for f in DRAFT_FIELDS])


@dataclass(frozen=True)
class Check:
    id: str
    label: str
    weight_pct: int            # weight in hundredths (exact sums)
    required: bool
    rule: Callable[[], tuple[Column, Column]]


def _title():
    t = F.trim(_s("title"))
    short = F.length(t) < 12
    generic = F.lower(t).isin(*GENERIC_TITLES)
    return (~short & ~generic,
            F.when(short, "Title is missing or too short for Engineering triage.")
            .when(generic, "Title is too generic.").otherwise("Title is present and specific enough to scan."))


def _summary():
    s = F.trim(F.coalesce(F.nullif(_s("summary"), F.lit("")), _s("description")))
    ok = F.length(s) >= MIN_SUMMARY_CHARS
    return ok, F.when(ok, "Summary has enough narrative context.").otherwise(
        f"Summary is under {MIN_SUMMARY_CHARS} characters — Engineering lacks context.")


def _trigger():
    ok = ~(_s("trigger_ticket_id") == "")
    return ok, F.when(ok, F.concat(F.lit("Trigger ticket "), F.col("trigger_ticket_id"), F.lit(" is linked."))) \
        .otherwise("No trigger support ticket is linked.")


def _evidence():
    ids = F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>"))
    only = F.size(F.filter(ids, lambda x: x != F.coalesce(F.col("trigger_ticket_id"), F.lit(""))))
    count = F.coalesce(F.col("similar_count").cast("bigint"), only.cast("bigint"))
    ok = ~((count < MIN_EVIDENCE_TICKETS) & (only < MIN_EVIDENCE_TICKETS))
    return ok, F.when(ok, F.concat(F.greatest(count, only.cast("bigint")).cast("string"),
                                   F.lit(" evidence tickets linked."))) \
        .otherwise(f"Fewer than {MIN_EVIDENCE_TICKETS} evidence tickets — weak pattern signal.")


def _impact():
    acc = F.coalesce(F.col("unique_accounts").cast("bigint"), F.lit(0))
    arr = F.trim(F.coalesce(F.nullif(_s("arr_at_risk_formatted"), F.lit("")), _s("arr_at_risk_text")))
    has_arr = (arr != "") & ~arr.isin(*EMPTY_ARR)
    ok = ~((acc <= 0) & ~has_arr)
    bits = F.concat_ws(", ", F.when(acc != 0, F.concat(acc.cast("string"), F.lit(" accounts"))),
                       F.when(has_arr, F.concat(F.lit("ARR "), arr)))
    return ok, F.when(ok, F.concat(F.lit("Customer impact noted: "), bits, F.lit("."))) \
        .otherwise("No customer impact (accounts or ARR) is stated.")


def _expected_actual():
    both = ~_blank("expected_behavior") & ~_blank("actual_behavior")
    text = _blob().rlike(EXPECTED_ACTUAL_RE)
    return both | text, (F.when(both, "Expected vs actual behavior are both present.")
                         .when(text, "Expected vs actual behavior is described in the draft text.")
                         .otherwise("Expected vs actual behavior is missing."))


def _repro():
    rep, env = ~_blank("reproduction_steps"), ~_blank("environment")
    rx, gap = _blob().rlike(REPRO_OR_ENV_RE), _blob().rlike(EXPLICIT_GAP_RE)
    return rep | env | rx | gap, (
        F.when(rep, "Reproduction steps are present.")
        .when(env, "Environment / version context is present.")
        .when(rx, "Reproduction or environment details appear in the draft.")
        .when(gap, "Draft explicitly notes missing repro/environment as a follow-up.")
        .otherwise("No reproduction steps, environment, or explicit evidence gap note."))


def _priority():
    p = F.lower(F.trim(_s("priority")))
    ok = p.isin(*PRIORITIES)
    return ok, F.when(ok, F.concat(F.lit("Priority is set ("), p, F.lit(")."))) \
        .otherwise("Priority is missing or not in Low/Medium/High/Urgent.")


# (id, label, weight, required) are fixed values of the reference checklist.
CHECKS: list[Check] = [
    Check("title", "Clear title", 10, True, _title),
    Check("summary", "Substantive summary", 15, True, _summary),
    Check("trigger", "Trigger ticket linked", 10, True, _trigger),
    Check("evidence", "Evidence tickets", 20, True, _evidence),
    Check("impact", "Customer impact", 15, True, _impact),
    Check("expected_vs_actual", "Expected vs actual", 15, True, _expected_actual),
    Check("repro_or_environment", "Repro / environment", 10, True, _repro),
    Check("priority", "Priority set", 5, True, _priority),
]


def prepare(drafts: DataFrame) -> DataFrame:
    """G9 inputs: missing optional fields become NULL, evidence ids get the trigger."""
    cols = set(drafts.columns)
    add = {c: F.lit(None).cast("string") for c in (*DRAFT_FIELDS, "arr_at_risk_text", "trigger_ticket_id",
                                                   "priority", "arr_at_risk_formatted") if c not in cols}
    if "unique_accounts" not in cols:
        add["unique_accounts"] = F.lit(None).cast("bigint")
    if "similar_count" not in cols:
        add["similar_count"] = F.lit(None).cast("bigint")
    d = drafts.withColumns(add) if add else drafts
    ids = (F.split(F.col("similar_ticket_ids"), r",\s*") if "similar_ticket_ids" in cols
           else F.array().cast("array<string>"))
    ids = F.filter(ids, lambda x: x != "")
    trig = F.col("trigger_ticket_id")
    return d.withColumn("evidence_ids", F.when(trig.isNotNull() & (trig != "") & ~F.array_contains(ids, trig),
                                               F.concat(F.array(trig), ids)).otherwise(ids))


def quality_report(drafts: DataFrame, checks: list[Check] = CHECKS, id_col: str = "trigger_ticket_id") -> DataFrame:
    """One row per draft with the checks array, score, verdict and texts."""
    d = prepare(drafts)
    structs = []
    for c in checks:
        passed, detail = c.rule()
        structs.append(F.struct(F.lit(c.id).alias("id"), F.lit(c.label).alias("label"),
                                F.lit(c.weight_pct / 100).alias("weight"), F.lit(c.required).alias("required"),
                                passed.alias("passed"), detail.alias("detail")))
    total = sum(c.weight_pct for c in checks)
    r = d.select(F.col(id_col).alias("draft_id"), "title", F.array(*structs).alias("checks"))
    earned = F.aggregate("checks", F.lit(0), lambda acc, x: acc + F.when(x["passed"], (x["weight"] * 100).cast("int"))
                         .otherwise(0))
    r = r.withColumn("earned", earned)
    score = F.bround(F.col("earned") / F.lit(float(total)), 3) if total else F.lit(0.0)
    gaps = F.filter("checks", lambda x: ~x["passed"])
    req_failed = F.exists("checks", lambda x: x["required"] & ~x["passed"])
    r = r.select("draft_id", "title", "checks", score.alias("score"), gaps.alias("gaps"), req_failed.alias("rf"))
    verdict = (F.when((F.col("score") >= PASS_SCORE) & ~F.col("rf"), "ready")
               .when(F.col("score") >= NEEDS_WORK_SCORE, "needs_work").otherwise("poor"))
    labels = F.array_join(F.transform("gaps", lambda g: g["label"]), ", ")
    gap_labels = F.when(labels == "", "listed gaps").otherwise(labels)
    r = r.withColumn("verdict", verdict)
    rec = (F.when(F.col("verdict") == "ready", READY_TEXT)
           .when(F.col("verdict") == "needs_work", F.concat(F.lit(NEEDS_WORK_TEXT), gap_labels, F.lit(".")))
           .otherwise(F.concat(F.lit(POOR_TEXT), gap_labels, F.lit("."))))
    passed_count = F.size(F.filter("checks", lambda x: x["passed"]))
    semi = F.array_join(F.transform("gaps", lambda g: g["label"]), "; ")
    summary = F.format_string("Escalation quality: %s (%d%%, %d/%d checks). Gaps: %s.",
                              F.col("verdict"), F.bround(F.col("score") * 100, 0).cast("int"), passed_count,
                              F.size("checks"), F.when(semi == "", "none").otherwise(semi))
    return r.select("draft_id", "title", "score", F.bround(F.col("score") * 100, 0).cast("int").alias("score_pct"),
                    "verdict", "checks", "gaps", passed_count.alias("passed_count"),
                    F.size("checks").alias("check_count"), rec.alias("recommendation"), summary.alias("summary"))


def quality_checks_long(report: DataFrame) -> DataFrame:
    """The checks array as rows (draft_id, check_id, label, weight, required, passed, detail)."""
    return (report.select("draft_id", F.posexplode("checks").alias("pos", "c"))
            .select("draft_id", (F.col("pos") + 1).alias("pos"), F.col("c.id").alias("check_id"),
                    F.col("c.label").alias("label"), F.col("c.weight").alias("weight"),
                    F.col("c.required").alias("required"), F.col("c.passed").alias("passed"),
                    F.col("c.detail").alias("detail")))


def quality_rank(report: DataFrame) -> DataFrame:
    """Verdict rank, score, draft id — all descending — as a global 1-based rank.

    The sort is range-partitioned; the ordinal comes from per-partition
    counts (``zipWithIndex``), so no single task sees all rows.
    """
    from support_signals.operators.ordering import global_rank

    rank = F.create_map(*[F.lit(x) for kv in VERDICT_RANK.items() for x in kv])
    s = report.select("draft_id", "verdict", "score", F.element_at(rank, F.col("verdict")).alias("vr"))
    return global_rank(s, F.desc("vr"), F.desc("score"), F.desc("draft_id")).drop("vr")
