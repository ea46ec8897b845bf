"""The stored review of a cluster: counts, impact, draft and linked tickets after the reviewer's decisions.

A cluster's analysis is kept as a state: per trigger the number and signature of its similar tickets and their impact,
and per (trigger, account) how many of the cluster's tickets the account has.  A decision that excludes a ticket is a
negative delta on that state: counts go down by one, the signature is combined with the ticket's own hash (an XOR undoes
itself), and an account leaves the impact when its number of tickets falls to zero.  So a review costs as much as the
tickets it excludes, whatever the size of the clusters; nothing else is computed again.

Rows with null ids take no part.  Decisions on tickets that are not in the cluster change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.functions.formats import format_arr
from support_signals.operators import drafts
from support_signals.operators.impact import TIERS
from support_signals.operators.issues import linked_tickets
from support_signals.operators.review import decided, id_hash, id_signature, placed

SUMS = ["unique_accounts", *[f"{t}_accounts" for t in TIERS], *[f"{t}_arr" for t in TIERS], "arr_at_risk"]


def cluster_state(matches: DataFrame, triggers: DataFrame, impact: DataFrame) -> DataFrame:
    """Per trigger: ``similar_count``, ``signature`` of the similar ids and the sums of ``impact_summary``."""
    return state_of(matches.groupBy(F.col("t_id").alias("trigger_id")).agg(
        F.count(F.lit(1)).alias("similar_count"), id_signature(F.col("c_id")).alias("signature")), triggers, impact)


def state_of(per: DataFrame, triggers: DataFrame, impact: DataFrame) -> DataFrame:
    """``cluster_state`` from ``similar_count`` and ``signature`` of the triggers with matches (``clusters.cluster_signatures``)."""
    zero = F.lit(0).cast("bigint")
    return (triggers.select(F.col("id").alias("trigger_id")).join(per, "trigger_id", "left").join(impact, "trigger_id", "left")
            .select("trigger_id", F.coalesce("similar_count", zero).alias("similar_count"),
                    F.coalesce("signature", zero).alias("signature"),
                    *[F.coalesce(c, zero).alias(c) for c in ["total_tickets", *SUMS]]))


def account_counts(members: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per (trigger, known account): the number ``n`` of cluster tickets, with tier and ARR of the account."""
    acc = accounts.select("account_id", F.coalesce("arr", F.lit(0)).cast("bigint").alias("arr"),
                          F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("free").alias("tier"))
    n = (members.where(F.col("account_id").isNotNull()).groupBy("trigger_id", "account_id")
         .agg(F.count(F.lit(1)).alias("n")))
    return n.join(acc, "account_id").select("trigger_id", "account_id", "n", "tier", "arr")


def excluded_members(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Similar tickets that the latest decision leaves out: trigger_id, ticket_id, account_id."""
    m = matches.select(F.col("t_id").alias("trigger_id"), F.col("c_id").alias("ticket_id"),
                       F.col("c_account_id").alias("account_id"), *placed(matches, decisions))
    if "grp" in m.columns:
        return decided(m, decisions, "trigger_id", "ticket_id").where(~F.col("include")).select("trigger_id", "ticket_id", "account_id")
    out = decisions.where(~F.col("include")).select("trigger_id", "ticket_id").distinct()
    return m.join(out, ["trigger_id", "ticket_id"], "left_semi")


def exclude(state: DataFrame, counts: DataFrame, excluded: DataFrame) -> DataFrame:
    """``state`` after the excluded tickets are taken out, with ``arr_at_risk_formatted``."""
    less = excluded.groupBy("trigger_id").agg(
        F.count(F.lit(1)).alias("d_n"), id_signature(F.col("ticket_id")).alias("d_signature"))
    off = (excluded.where(F.col("account_id").isNotNull()).groupBy("trigger_id", "account_id")
           .agg(F.count(F.lit(1)).alias("r")))
    gone = counts.join(off, ["trigger_id", "account_id"]).where(F.col("n") - F.col("r") <= 0)
    sums = [F.count(F.lit(1)).alias("d_unique_accounts"), F.sum("arr").alias("d_arr_at_risk")]
    for t in TIERS:
        sums += [F.count_if(F.col("tier") == t).alias(f"d_{t}_accounts"),
                 F.sum(F.when(F.col("tier") == t, F.col("arr")).otherwise(0)).alias(f"d_{t}_arr")]
    return without(state, less.join(gone.groupBy("trigger_id").agg(*sums), "trigger_id", "left"))


def without(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """``state`` less the ``deltas`` (d_n, d_signature and d_ of the sums) of its triggers, with ``arr_at_risk_formatted``."""
    j = state.join(deltas, "trigger_id", "left")
    zero = F.lit(0).cast("bigint")
    out = j.select(
        "trigger_id", (F.col("similar_count") - F.coalesce("d_n", zero)).alias("similar_count"),
        F.col("signature").bitwiseXOR(F.coalesce("d_signature", zero)).alias("signature"),
        (F.col("total_tickets") - F.coalesce("d_n", zero)).alias("total_tickets"),
        *[(F.col(c) - F.coalesce(f"d_{c}", zero)).cast("bigint").alias(c) for c in SUMS])
    return out.withColumn("arr_at_risk_formatted", format_arr("arr_at_risk"))


# ------------------------------------------------------------ all reviews in one pass
FIGURES = [*[f"{t}_accounts" for t in TIERS], *[f"{t}_arr" for t in TIERS]]


def with_account_figures(tickets: DataFrame, accounts: DataFrame) -> DataFrame:
    """Tickets with the hash of their id, whether others share the id (``shared``), and of a known account the place of its tier and
    its ARR, or all ``FIGURES`` where it has several rows (each counts, as in ``account_counts``)."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")), F.lit(0))
    a = accounts.where(F.col("account_id").isNotNull()).select(
        "account_id", F.coalesce("arr", F.lit(0)).cast("bigint").alias("arr"),
        F.when(place > 0, place - 1).otherwise(len(TIERS) - 1).cast("int").alias("place"))
    sums = [*[F.count_if(F.col("place") == i) for i in range(len(TIERS))],
            *[F.coalesce(F.sum(F.when(F.col("place") == i, F.col("arr"))), F.lit(0)) for i in range(len(TIERS))]]
    a = a.groupBy("account_id").agg(F.first("place").alias("place"), F.first("arr").alias("arr"),
                                    F.when(F.count(F.lit(1)) > 1, F.array(*sums)).alias("figures"))
    ids = tickets.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("id", F.lit(True).alias("shared"))
    t = tickets.select("id", "created_at", "category", "account_id", "subject", "embedding").join(a, "account_id", "left").join(ids, "id", "left")
    return (t.withColumn("shared", F.coalesce("shared", F.lit(False))).withColumn("sig", id_hash(F.col("id")))
            .withColumn("own_subject", F.when(F.col("shared") | F.col("id").isNull(), F.col("subject"))).drop("subject"))


MATCH_COLUMNS = ("account_id", "place", "arr", "figures", "sig", "shared", "own_subject")     # of the tickets, for ``fold_reviews``


def fold_reviews(rows: DataFrame) -> DataFrame:
    """All that a review takes of the matches of each trigger: one row per trigger with the deltas of the tickets that the latest
    decisions exclude (as in ``exclude``), the first included ``ids`` and the ``best`` of the included ones by score.

    ``rows``: ``clusters.nested_matches`` with ``MATCH_COLUMNS``, ``include`` (the latest decision on each match) and ``logged``
    (whether there is any); no trigger shares its id."""
    deltas = ["d_n", "d_signature", "d_unique_accounts", "d_arr_at_risk", *[f"d_{c}" for c in FIGURES]]
    best = "struct<score: double, c_id: string, shared: boolean, own_subject: string>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _folded(b, deltas)

    per = rows.mapInArrow(fold, f"trigger_id string, logged boolean, {', '.join(f'{c} bigint' for c in deltas)}, "
                                f"ids array<string>, best array<{best}>")
    # a trigger has a row per slice
    return per.groupBy("trigger_id").agg(
        F.bool_or("logged").alias("logged"), F.bit_xor("d_signature").alias("d_signature"),
        *[F.sum(c).alias(c) for c in deltas if c != "d_signature"],
        F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("best")).alias("best"))


def _heads(rows: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first ``k`` of their row, in sorted rows."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows) < k


def _numbers(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of every value in order, -1 for null; the values)."""
    coded = column.dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    rank[-1] = -1
    return rank[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy().astype(np.int64)], coded.dictionary


def _folded(b: pa.RecordBatch, deltas: list[str]) -> pa.RecordBatch:
    n = b.num_rows
    row = np.repeat(np.arange(n), pc.list_value_length(b.column("c_id")).to_numpy())
    flat = lambda k: b.column(k).flatten()
    keep = pc.fill_null(flat("include"), True).to_numpy(zero_copy_only=False)
    out = {c: np.zeros(n, np.int64) for c in deltas}
    out["d_n"] += np.bincount(row[~keep], minlength=n)
    np.bitwise_xor.at(out["d_signature"], row[~keep], pc.fill_null(flat("c_sig"), 0).to_numpy()[~keep])
    # accounts of which no ticket is left; the trigger keeps its own
    acc, accounts = _numbers(flat("c_account_id"))
    own = pc.fill_null(pc.index_in(b.column("t_account_id"), value_set=accounts), -1).to_numpy().astype(np.int64)
    order = np.full(len(accounts) + 1, -1, np.int64)
    order[pc.sort_indices(accounts).to_numpy()] = np.arange(len(accounts))
    own = order[own]
    place = pc.fill_null(flat("c_place"), -1).to_numpy()
    known = np.flatnonzero((acc >= 0) & (place >= 0))
    known = known[np.lexsort((acc[known], row[known]))]
    if len(known):
        r, a = row[known], acc[known]
        starts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (a[1:] != a[:-1])])
        gone = starts[~np.logical_or.reduceat(keep[known], starts) & (a[starts] != own[r[starts]])]
        at = known[gone]
        figures = np.zeros((len(at), len(FIGURES)), np.int64)
        figures[np.arange(len(at)), place[at]] = 1
        figures[np.arange(len(at)), place[at] + len(TIERS)] = pc.fill_null(flat("c_arr"), 0).to_numpy()[at]
        several = flat("c_figures").take(pa.array(at))
        for i in np.flatnonzero(several.is_valid().to_numpy(zero_copy_only=False)):
            figures[i] = several[i].as_py()
        for c, x in zip(FIGURES, figures.T):
            np.add.at(out[f"d_{c}"], row[at], x)
        np.add.at(out["d_unique_accounts"], row[at], figures[:, :len(TIERS)].sum(axis=1))
        np.add.at(out["d_arr_at_risk"], row[at], figures[:, len(TIERS):].sum(axis=1))
    kept = np.flatnonzero(keep)
    ids, score = flat("c_id"), flat("score").to_numpy()
    number, _ = _numbers(ids)

    def first(k: int, *order: np.ndarray) -> tuple[pa.Array, pa.Array]:
        o = kept[np.lexsort((*[x[kept] for x in order], row[kept]))]
        o = o[_heads(row[o], k)]
        return pa.array(np.r_[0, np.cumsum(np.bincount(row[o], minlength=n))], pa.int32()), pa.array(o)

    ends, o = first(drafts.MAX_DRAFT_IDS, number)
    first_ids = pa.ListArray.from_arrays(ends, ids.take(o))
    ends, o = first(drafts.SAMPLE_SUBJECTS, number, -score)
    shown = {"score": pa.array(score), "c_id": ids, "shared": flat("c_shared"), "own_subject": flat("c_own_subject")}
    best = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([x.take(o) for x in shown.values()], names=list(shown)))
    return pa.RecordBatch.from_arrays([b.column("t_id"), b.column("logged"), *[pa.array(out[c]) for c in deltas], first_ids, best],
                                      names=["trigger_id", "logged", *deltas, "ids", "best"])


def included_of(folded: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first included ids of every trigger, its best included tickets with score and subject), as ``review_drafts`` takes them."""
    ids = folded.select(F.col("trigger_id").alias("t_id"), F.explode("ids").alias("c_id"))
    best = folded.select(F.col("trigger_id").alias("t_id"), F.explode("best").alias("b")).select("t_id", "b.*")
    named = best.join(tickets.select(F.col("id").alias("c_id"), "subject").where(F.col("c_id").isNotNull()).groupBy("c_id")
                      .agg(F.first("subject").alias("subject")), "c_id", "left")
    own = F.col("shared") | F.col("c_id").isNull()
    return ids, named.select("t_id", "c_id", "score", F.when(own, F.col("own_subject")).otherwise(F.col("subject")).alias("c_subject"))


def confirm(reviewed: DataFrame, log: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Reviews that can be confirmed: triggers with a decision whose included tickets still make a trend."""
    return (reviewed.where(F.col("similar_count") >= cfg.min_count)
            .join(log.select("trigger_id").distinct(), "trigger_id", "left_semi"))


def review_drafts(confirmed: DataFrame, included: DataFrame, tickets: DataFrame, cfg: TrendConfig,
                  best: DataFrame | None = None) -> DataFrame:
    """The engineering draft of every confirmed review: counts and impact of the review, ids of the included tickets,
    subjects of the three most similar of them.  ``included``: t_id, c_id, score, c_subject.  With ``best`` (of these columns) it
    needs but the first ids of each trigger and ``best`` but the most similar ones."""
    of = confirmed.select(F.col("trigger_id").alias("t_id"))
    inc = included.join(of, "t_id", "left_semi")
    near = inc if best is None else best.join(of, "t_id", "left_semi")
    w = Window.partitionBy("t_id").orderBy(F.desc("score"), "c_id")
    top = (near.select(F.col("t_id").alias("q_id"), F.col("c_subject").alias("subject"),
                      F.row_number().over(w).alias("rank"))
           .where(F.col("rank") <= drafts.SAMPLE_SUBJECTS))
    trend = (tickets.select("id", "category", "subject")
             .join(confirmed.select(F.col("trigger_id").alias("id"), "similar_count"), "id")
             .withColumn("is_potential_trend", F.lit(True)))
    return drafts.engineering_drafts(trend, tickets, confirmed.drop("similar_count", "signature"),
                                     drafts.first_ids(inc), drafts.sample_subjects(top), cfg)


def review_links(confirmed: DataFrame, included: DataFrame | None, tickets: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Linked tickets of every confirmed review: the trigger and the included ones, one row each.  ``carried``: included matches
    of confirmed triggers that ``linked_tickets`` joins with nothing."""
    own = confirmed.select(F.col("trigger_id").alias("id"))
    inc = None if included is None else included.join(own.withColumnRenamed("id", "t_id"), "t_id", "left_semi")
    return linked_tickets(inc, tickets, own, carried)


def review_records(confirmed: DataFrame, review_drafts_df: DataFrame) -> DataFrame:
    """The record that later views read: one row per confirmed trigger with trend, impact, draft and signature."""
    d = review_drafts_df.select(F.col("trigger_ticket_id").alias("trigger_id"), "title", "summary", "priority", "category",
                                "similar_ticket_ids")
    return confirmed.join(d, "trigger_id").withColumn("linked_tickets", F.col("similar_count") + 1)


def review_is_current(records: DataFrame, reviewed: DataFrame) -> DataFrame:
    """F8: does the stored signature still equal the one of the tickets that are included now?"""
    now = reviewed.select("trigger_id", F.col("signature").alias("now"), F.col("similar_count").alias("included_now"))
    return (records.select("trigger_id", F.col("signature").alias("stored"), F.col("similar_count").alias("included_then"))
            .join(now, "trigger_id", "left")
            .select("trigger_id", "included_then", "included_now",
                    F.coalesce((F.col("stored") == F.col("now")) & (F.col("included_then") == F.col("included_now")),
                               F.lit(False)).alias("is_confirmed")))


def live_analysis(live_drafts: DataFrame, records: DataFrame) -> DataFrame:
    """The analysis that an issue shows: the stored review of its trigger where there is one, else the live draft."""
    cols = ("title", "summary", "priority", "similar_count", "total_tickets", "arr_at_risk_formatted")
    stored = records.select(F.col("trigger_id").alias("trigger_ticket_id"), *cols)
    live = live_drafts.select("trigger_ticket_id", *cols).join(stored.select("trigger_ticket_id"), "trigger_ticket_id", "left_anti")
    return live.unionByName(stored)
