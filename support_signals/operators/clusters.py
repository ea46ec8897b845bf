"""Clusters of all triggers, folded in the task that compares their tickets.

A cluster is a trigger with its similar tickets, and the similar tickets of all triggers are quadratic in the tickets of a
category-week.  Where only figures of each cluster are wanted (impact, largest accounts, timeline, events), the matches need
not be rows: here a group holds triggers of one time bucket with *every* candidate of their windows, so a cluster is complete
where it is compared and leaves the task as a few rows.

A ticket is shuffled once as a trigger and once per bucket that a window touches as a candidate.  Hot groups are cut: the
triggers of a bucket by hash of their id, the candidates of its windows by hash of ``slice_by``, a column whose equal values stay
together (the account, where accounts are counted), so the figures of the slices add up.  A slice keeps whole accounts; only an
account with more tickets in a category-week than a slice has rows makes it larger.

Several tickets may share an id.  Their clusters are one, but may lie in several groups; for these ids alone the accounts are
listed (once per account, trigger and slice) and made distinct outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from support_signals.config import TrendConfig
from support_signals.functions.formats import title_case
from support_signals.functions.vectors import bucket_of
from support_signals.operators.impact import TIERS
from support_signals.operators.pairs import PAIRS_OUT, _both_sides, _Group, matches_by_tile, paired_scores, tile_hits
from support_signals.operators.review import id_hash

# Candidates of a group, in ``target_rows_per_group``: triggers are copied once per slice, so slices are wide.
WIDE = 5
# Cells of a table of triggers x accounts that a task holds.
CELLS = 1 << 23
HOUR, DAY = 3_600_000_000, 86_400_000_000


def cluster_sides(tickets: DataFrame, cfg: TrendConfig, slice_by: str, trigger_cols: Sequence[str] = (),
                  candidate_cols: Sequence[str] = (), key: str = "category",
                  triggers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(triggers, candidates, group): every trigger (default: all tickets) meets all tickets of its window in the slices of one
    group.  With ``triggers``, tickets that are in the window of none of their buckets are left out."""
    span = -(-cfg.window_seconds // cfg.bucket_seconds)
    at = tickets.withColumn("bkt", bucket_of("created_at", cfg.bucket_seconds))
    asked = at if triggers is None else triggers.withColumn("bkt", bucket_of("created_at", cfg.bucket_seconds))

    def side(df: DataFrame, p: str, extra: Sequence[str]) -> DataFrame:
        return df.select(key, "bkt", F.col("id").alias(f"{p}_id"), F.col("created_at").alias(f"{p}_ts"),
                         F.col("embedding").alias(f"{p}_vec"), *[F.col(c).alias(f"{p}_{c}") for c in extra])

    def parts(n: str, rows: int) -> F.Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(rows))).cast("int")

    w = Window.partitionBy(key).orderBy("bkt").rangeBetween(-span, 0)       # rows per key = buckets, not data
    n = asked.groupBy(key, "bkt").agg(F.count(F.lit(1)).alias("n_t"))
    if triggers is None:
        n = n.withColumn("n_c", F.sum("n_t").over(w))
    else:
        own = at.groupBy(key, "bkt").agg(F.count(F.lit(1)).alias("n_own"))
        n = (n.join(own, [key, "bkt"], "full").withColumn("n_c", F.sum(F.coalesce("n_own", F.lit(0))).over(w))
             .where(F.col("n_t").isNotNull() & (F.col("n_c") > 0)))
    hot = n.select(key, "bkt", parts("n_t", cfg.target_rows_per_group).alias("s_t"),
                   parts("n_c", WIDE * cfg.target_rows_per_group).alias("s_c"))
    if triggers is None:
        hot = hot.where((F.col("s_t") > 1) | (F.col("s_c") > 1))
    kept = "left" if triggers is None else "inner"
    s_t, s_c = F.coalesce(F.col("s_t"), F.lit(1)), F.coalesce(F.col("s_c"), F.lit(1))
    trig = (side(asked, "t", trigger_cols).join(hot, [key, "bkt"], kept)
            .withColumn("salt", F.pmod(F.xxhash64("t_id"), s_t).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), s_c - 1))).drop("s_t", "s_c"))
    cand = (side(at, "c", candidate_cols).withColumn("bkt", F.explode(F.sequence(F.col("bkt"), F.col("bkt") + F.lit(span))))
            .join(hot, [key, "bkt"], kept)
            .withColumn("part", F.pmod(F.xxhash64(f"c_{slice_by}"), s_c).cast("int"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), s_t - 1))).drop("s_t", "s_c"))
    return trig, cand, [key, "bkt", "salt", "part"]


class _Fold:
    """What is kept of the matches of some trigger rows: ``begin``, ``add`` tile by tile, ``end``."""

    row_tile: int | None = None

    def __init__(self, g: _Group):
        self.g = g

    def begin(self, rows: slice) -> None:
        self.rows, self.n = rows, np.zeros(rows.stop - rows.start, np.int64)

    def add(self, cols: slice, hit: np.ndarray) -> None:
        self.n += np.count_nonzero(hit, axis=1)

    def end(self) -> dict[str, pa.Array]:
        raise NotImplementedError

    def trigger(self, r: np.ndarray, column: str = "t_id") -> pa.Array:
        return self.g.trig[column].take(pa.array(self.rows.start + r))

    def candidate(self, c: np.ndarray, column: str = "c_id") -> pa.Array:
        return self.g.cand[column].take(pa.array(c))


def fold_clusters(tickets: DataFrame, cfg: TrendConfig, fold: Callable[[_Group], _Fold], schema: str, slice_by: str = "id",
                  trigger_cols: Sequence[str] = (), candidate_cols: Sequence[str] = (),
                  triggers: DataFrame | None = None, closed_end: bool = False) -> DataFrame:
    """The rows that ``fold`` keeps of the matches of every trigger (rule of ``trend.trend_matches``).  ``triggers``: others than
    the tickets; ``closed_end``: their windows hold tickets of their own time."""
    trig, cand, cond = cluster_sides(tickets, cfg, slice_by, trigger_cols, candidate_cols, triggers=triggers)
    both = _both_sides(trig, cand, cond, [f"t_{c}" for c in trigger_cols], [f"c_{c}" for c in candidate_cols])
    w_us = int(cfg.window_seconds) * 1_000_000

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, w_us, closed_end)
        if not g:
            return
        f = fold(g)
        hits = tile_hits(g.tv, g.cv, g.in_window, cfg.threshold, cfg.block_rows, f.row_tile)
        for _, part in groupby(hits, key=lambda x: x[0].start):
            first = True
            for rows, cols, hit in part:
                if first:
                    f.begin(rows)
                    first = False
                f.add(cols, hit)
            yield from pa.table(f.end()).combine_chunks().to_batches()

    return both.groupBy(*cond).applyInArrow(group, schema=schema)


# ------------------------------------------------------------ first ids
def first_hits(g: _Group, keep: int, min_score: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(trigger row, candidate row) of the ``keep`` first matches of every trigger by candidate id (null first).

    Candidates are compared in order of their id, and a trigger that has its matches is compared no further."""
    order = pc.sort_indices(g.cand["c_id"], null_placement="at_start").to_numpy()
    cv = g.cv[order]
    for a in range(0, len(g.tv), tile):
        rows = np.arange(a, min(a + tile, len(g.tv)))
        got = np.zeros(len(rows), np.int64)
        for b in range(0, len(cv), tile):
            at = order[b:b + tile]
            for _, _, hit in tile_hits(g.tv[rows], cv[b:b + tile], lambda x, y: g.in_window(rows[x], at[y]), min_score, tile):
                r, c = np.nonzero(hit)
                kept = np.arange(len(r)) - np.searchsorted(r, r) + got[r] < keep
                yield rows[r[kept]], at[c[kept]]
                got += np.count_nonzero(hit, axis=1)
            rows, got = rows[got < keep], got[got < keep]
            if not len(rows):
                break


def first_similar(tickets: DataFrame, cfg: TrendConfig, keep: int, triggers: DataFrame | None = None,
                  closed_end: bool = False) -> DataFrame:
    """(t_id, c_id): of the matches of each trigger (default: all tickets) at least the ``keep`` first by id, and at most as many
    per ticket of the trigger and slice.  Enough for ``drafts.first_ids``; the other matches are neither listed nor all searched."""
    trig, cand, cond = cluster_sides(tickets, cfg, "id", triggers=triggers)
    both = _both_sides(trig, cand, cond, [], [])
    w_us = int(cfg.window_seconds) * 1_000_000

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, w_us, closed_end)
        if g:
            for r, c in first_hits(g, keep, cfg.threshold, cfg.block_rows):
                yield from pa.table({"t_id": g.trig["t_id"].take(pa.array(r)), "c_id": g.cand["c_id"].take(pa.array(c))}).combine_chunks().to_batches()

    return both.groupBy(*cond).applyInArrow(group, schema=f"t_id {both.schema['t_id'].dataType.simpleString()}, "
                                                          f"c_id {both.schema['c_id'].dataType.simpleString()}")


# ------------------------------------------------------------ events
class _Earliest(_Fold):
    """The ``KEEP`` earliest matches of a trigger (by time, then id), and the number of all on the first of them."""

    KEEP = 4

    def begin(self, rows: slice) -> None:
        super().begin(rows)
        self.first = np.full((len(self.n), self.KEEP), -1, np.int64)
        self.got = np.zeros(len(self.n), np.int64)

    def add(self, cols: slice, hit: np.ndarray) -> None:      # candidates are in order of (time, id)
        super().add(cols, hit)
        need = np.flatnonzero((self.got < self.KEEP) & hit.any(axis=1))
        left = hit[need]
        while len(need):
            k = left.argmax(axis=1)
            self.first[need, self.got[need]] = cols.start + k
            self.got[need] += 1
            left[np.arange(len(need)), k] = False
            more = (self.got[need] < self.KEEP) & left.any(axis=1)
            need, left = need[more], left[more]

    def end(self) -> dict[str, pa.Array]:
        r, slot = np.nonzero(self.first >= 0)
        c = self.first[r, slot]
        return {"trigger_id": self.trigger(r), "ticket_id": self.candidate(c), "ts": self.candidate(c, "c_ts"),
                "n": pa.array(np.where(slot == 0, self.n[r], 0))}


def earliest_members(tickets: DataFrame, cfg: TrendConfig) -> DataFrame:
    """The trigger and the earliest similar tickets of every cluster: trigger_id, ticket_id, ts, is_trigger and ``n``, the
    members that a row stands for.  Enough for ``review.cluster_events``."""
    sim = fold_clusters(tickets, cfg, _Earliest, "trigger_id string, ticket_id string, ts timestamp_ntz, n bigint")
    own = tickets.select(F.col("id").alias("trigger_id"), F.col("id").alias("ticket_id"), F.col("created_at").alias("ts"),
                         F.lit(True).alias("is_trigger"), F.lit(1).cast("bigint").alias("n"))
    return sim.withColumn("is_trigger", F.lit(False)).unionByName(own)


# ------------------------------------------------------------ timeline
class _Times(_Fold):
    """Matches per hour of a trigger, or per day if the earliest is two days or more before it."""

    def __init__(self, g: _Group):
        super().__init__(g)
        self.us, self.at = g.cand["us"].to_numpy(), g.trig["us"].to_numpy()
        self.hour = self.us // HOUR
        self.base = int(self.hour[0])

    def begin(self, rows: slice) -> None:
        super().begin(rows)
        self.per = np.zeros((len(self.n), int(self.hour[-1]) - self.base + 1), np.int64)
        self.lo, self.hi = np.full(len(self.n), -1, np.int64), np.full(len(self.n), -1, np.int64)

    def add(self, cols: slice, hit: np.ndarray) -> None:
        super().add(cols, hit)
        some = hit.any(axis=1)
        new = np.flatnonzero(some & (self.lo < 0))
        self.lo[new] = cols.start + hit[new].argmax(axis=1)
        some = np.flatnonzero(some)
        self.hi[some] = cols.stop - 1 - hit[some][:, ::-1].argmax(axis=1)
        hour = self.hour[cols]
        starts = np.flatnonzero(np.r_[True, hour[1:] != hour[:-1]])
        self.per[:, hour[starts] - self.base] += np.add.reduceat(hit.view(np.uint8), starts, axis=1, dtype=np.int64)

    def end(self) -> dict[str, pa.Array]:
        rows = np.flatnonzero(self.n)
        lo, hi = self.us[self.lo[rows]], self.us[self.hi[rows]]
        i, hour = np.nonzero(self.per[rows])
        unit = np.where(self.at[self.rows][rows] - lo < 2 * DAY, HOUR, DAY)
        p = pd.DataFrame({"i": i, "at": (self.base + hour) * HOUR // unit[i] * unit[i], "n": self.per[rows][i, hour]})
        p = p.groupby(["i", "at"], as_index=False, sort=False)["n"].sum()
        i = p["i"].to_numpy()
        time = lambda x: pa.array(x, pa.int64()).cast(pa.timestamp("us"))
        return {"trigger_id": self.trigger(rows[i]), "at": time(p["at"].to_numpy()), "lo": time(lo[i]), "hi": time(hi[i]),
                "n": pa.array(p["n"].to_numpy())}


def member_times(tickets: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Members per hour or day of every cluster, as ``queue.timeline`` takes them: trigger_id, at, lo, hi, n."""
    sim = fold_clusters(tickets, cfg, _Times,
                        "trigger_id string, at timestamp_ntz, lo timestamp_ntz, hi timestamp_ntz, n bigint")
    ts = F.col("created_at")
    own = tickets.select(F.col("id").alias("trigger_id"), ts.alias("at"), ts.alias("lo"), ts.alias("hi"),
                         F.lit(1).cast("bigint").alias("n"))
    return sim.unionByName(own)


# ------------------------------------------------------------ accounts
class _Accounts(_Fold):
    """The known accounts among the matches of a trigger; accounts are numbered by falling ARR (none last)."""

    def __init__(self, g: _Group):
        super().__init__(g)
        acc = g.cand["c_account_id"].combine_chunks()
        known = np.flatnonzero(g.cand["c_known"].to_numpy())
        _, row = np.unique(acc.take(pa.array(known)).dictionary_encode().indices.to_numpy(), return_index=True)
        row = known[row]                                     # one candidate of every known account
        arr = g.cand["c_arr"].take(pa.array(row))
        null_arr, arr = arr.is_null().to_numpy(), pc.fill_null(arr, 0).to_numpy()
        o = np.lexsort((-arr, null_arr))
        self.row, self.null_arr, self.arr = row[o], null_arr[o], arr[o]
        self.tier = np.array([TIERS.index(t) for t in g.cand["c_tier"].take(pa.array(self.row)).to_pylist()], np.int64)
        self.ids = acc.take(pa.array(self.row))
        self.code = self.number(acc)
        self.row_tile = int(np.clip(CELLS // max(1, len(self.ids)), 16, 2048))
        self.many = g.trig["t_many"].to_numpy()

    def number(self, accounts: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(accounts, value_set=self.ids), -1).to_numpy().astype(np.int64)

    def begin(self, rows: slice) -> None:
        super().begin(rows)
        self.seen = np.zeros((len(self.n), len(self.ids)), bool)

    def add(self, cols: slice, hit: np.ndarray) -> None:
        super().add(cols, hit)
        r, c = np.nonzero(hit)
        code = self.code[cols][c]
        known = code >= 0
        self.mark(r[known], code[known], cols.start + c[known])

    def mark(self, r: np.ndarray, code: np.ndarray, c: np.ndarray) -> None:
        self.seen[r, code] = True


class _Impact(_Accounts):
    """Number of matches, accounts and ARR per tier; of an id that several tickets have, every account instead."""

    def __init__(self, g: _Group):
        super().__init__(g)
        self.own = self.number(g.trig["t_account_id"].combine_chunks())

    def end(self) -> dict[str, pa.Array]:
        many, own = self.many[self.rows], self.own[self.rows]
        rows = np.flatnonzero(self.n)
        own_seen = (own >= 0) & self.seen[np.arange(len(own)), own] if len(self.ids) else own >= 0
        r, code = np.nonzero(self.seen)
        k = r * len(TIERS) + self.tier[code]
        count = np.bincount(k, minlength=len(self.n) * len(TIERS)).reshape(-1, len(TIERS))
        arr = np.zeros(count.size, np.int64)
        np.add.at(arr, k, self.arr[code])
        arr = arr.reshape(count.shape)
        listed = many[r]
        lr, lc = r[listed], self.row[code[listed]]
        out = {"trigger_id": self.trigger(np.r_[rows, lr]),
               "n": pa.array(np.r_[self.n[rows], np.zeros(len(lr), np.int64)]),
               "own_seen": pa.array(np.r_[own_seen[rows], np.zeros(len(lr), bool)])}
        once = ~many[rows]
        for i, t in enumerate(TIERS):
            out[f"{t}_accounts"] = pa.array(np.r_[count[rows, i] * once, np.zeros(len(lr), np.int64)])
        for i, t in enumerate(TIERS):
            out[f"{t}_arr"] = pa.array(np.r_[arr[rows, i] * once, np.zeros(len(lr), np.int64)])
        ids = self.candidate(lc, "c_account_id")
        out["account_id"] = pa.chunked_array([pa.nulls(len(rows), ids.type), *ids.chunks], ids.type)
        return out


class _Largest(_Accounts):
    """The ``keep`` first accounts of a trigger by ARR, then first ticket id; of an id that several tickets have, all."""

    keep = 5

    def __init__(self, g: _Group):
        super().__init__(g)
        order = np.argsort(g.cand["c_id"].to_numpy().astype(str), kind="stable")
        self.by_id = order
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order), dtype=np.int32)

    def begin(self, rows: slice) -> None:
        super().begin(rows)
        self.first = np.full(self.seen.shape, np.iinfo(np.int32).max, np.int32)

    def mark(self, r: np.ndarray, code: np.ndarray, c: np.ndarray) -> None:
        np.minimum.at(self.first.reshape(-1), r * len(self.ids) + code, self.place[c])

    def end(self) -> dict[str, pa.Array]:
        r, code = np.nonzero(self.first < np.iinfo(np.int32).max)
        first = self.first[r, code]
        # numbers follow the ARR, so only equal ARR needs an order by the first ticket
        o = np.lexsort((first, -self.arr[code], self.null_arr[code], r))
        r, code, first = r[o], code[o], first[o]
        at = np.arange(len(r)) - np.searchsorted(r, r)
        kept = (at < self.keep) | self.many[self.rows][r]
        r, code, first = r[kept], code[kept], first[kept]
        return {"trigger_id": self.trigger(r), "ticket_id": self.candidate(self.by_id[first]),
                "account_id": self.candidate(self.row[code], "c_account_id")}


def with_accounts(tickets: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tickets with the account's ARR and tier, whether it is known and whether the id has several tickets; one row per
    known account)."""
    acc = (accounts.where(F.col("account_id").isNotNull()).groupBy("account_id")
           .agg(F.first("account_name").alias("account_name"), F.first("arr").cast("bigint").alias("arr"),
                F.first(F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("free")).alias("tier")))
    many = tickets.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("id", F.lit(True).alias("many"))
    t = (tickets.select("id", "created_at", "category", "account_id", "embedding").join(many, "id", "left")
         .withColumn("many", F.coalesce("many", F.lit(False)))
         .join(acc.select("account_id", "arr", "tier", F.lit(True).alias("known")), "account_id", "left")
         .withColumn("known", F.coalesce("known", F.lit(False))))
    return t, acc


def cluster_impact(tickets: DataFrame, accounts: DataFrame, cfg: TrendConfig, queries: DataFrame | None = None) -> DataFrame:
    """``impact.impact_summary`` of the clusters of all tickets, or of the matches of ``queries`` (id, created_at, category,
    embedding) alone, which are no members and whose windows are closed."""
    from support_signals.functions.formats import format_arr

    t, acc = with_accounts(tickets, accounts)
    figures = [*[f"{x}_accounts" for x in TIERS], *[f"{x}_arr" for x in TIERS]]
    kind = t.schema["account_id"].dataType.simpleString()
    asked = None
    if queries is not None:
        twice = queries.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("id", F.lit(True).alias("many"))
        asked = (queries.select("id", "created_at", "category", F.lit(None).cast(kind).alias("account_id"), "embedding")
                 .join(twice, "id", "left").withColumn("many", F.coalesce("many", F.lit(False))))
    folds = fold_clusters(t, cfg, _Impact, "trigger_id string, n bigint, own_seen boolean, "
                          + ", ".join(f"{c} bigint" for c in figures) + f", account_id {kind}", slice_by="account_id",
                          trigger_cols=("account_id", "many"), candidate_cols=("account_id", "arr", "tier", "known"),
                          triggers=asked, closed_end=asked is not None)
    # the triggers themselves: one member each; the account counts unless a similar ticket has it
    own = t.select(F.col("id").alias("trigger_id"), F.lit(1).cast("bigint").alias("n"), "many", "known",
                   F.when(F.col("many") & F.col("known"), F.col("account_id")).alias("account_id"), "tier", "arr")
    if queries is not None:
        own = own.where(F.lit(False))
    rows = folds.unionByName(own, allowMissingColumns=True)
    single = ~F.col("many") & F.col("known")
    arr = F.coalesce("arr", F.lit(0))
    per = rows.groupBy("trigger_id").agg(
        F.sum("n").alias("total_tickets"), F.coalesce(F.bool_or("own_seen"), F.lit(False)).alias("own_seen"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in figures],
        F.max(F.when(single, F.struct("tier", arr.alias("arr")))).alias("own"))
    # ids with several tickets: their accounts, once each
    listed = (rows.where(F.col("account_id").isNotNull()).select("trigger_id", "account_id").distinct()
              .join(acc.select("account_id", "tier", arr.alias("arr")), "account_id").groupBy("trigger_id").agg(
                  *[F.count_if(F.col("tier") == x).alias(f"l_{x}_accounts") for x in TIERS],
                  *[F.sum(F.when(F.col("tier") == x, F.col("arr")).otherwise(0)).alias(f"l_{x}_arr") for x in TIERS]))
    adds = F.col("own").isNotNull() & ~F.col("own_seen")
    zero = F.lit(0)

    def figure(c: str) -> F.Column:
        tier, what = c.split("_")
        mine = F.when(adds & (F.col("own.tier") == tier), F.lit(1) if what == "accounts" else F.col("own.arr")).otherwise(0)
        return (F.col(c) + mine + F.coalesce(f"l_{c}", zero)).cast("bigint").alias(c)

    out = per.join(listed, "trigger_id", "left").select("trigger_id", "total_tickets", *[figure(c) for c in figures])
    total = lambda what: sum((F.col(f"{x}_{what}") for x in TIERS[1:]), F.col(f"{TIERS[0]}_{what}"))
    return (out.withColumn("unique_accounts", total("accounts")).withColumn("arr_at_risk", total("arr"))
            .select("trigger_id", "total_tickets", "unique_accounts", *figures, "arr_at_risk")
            .withColumn("arr_at_risk_formatted", format_arr("arr_at_risk")))


def largest_members(tickets: DataFrame, accounts: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Per cluster the trigger and the first ticket of each of its largest accounts: trigger_id, ticket_id, account_id,
    is_trigger.  Enough for ``impact.top_accounts`` with up to ``_Largest.keep`` accounts."""
    t, _ = with_accounts(tickets, accounts)
    kind = t.schema["account_id"].dataType.simpleString()
    sim = fold_clusters(t, cfg, _Largest, f"trigger_id string, ticket_id string, account_id {kind}", slice_by="account_id",
                        trigger_cols=("many",), candidate_cols=("account_id", "arr", "tier", "known"))
    own = t.select(F.col("id").alias("trigger_id"), F.col("id").alias("ticket_id"), "account_id", F.lit(True).alias("is_trigger"))
    return sim.withColumn("is_trigger", F.lit(False)).unionByName(own)


# ------------------------------------------------------------ signatures
class _Signature(_Fold):
    """Number and signature of the matches of a trigger."""

    def __init__(self, g: _Group):
        super().__init__(g)
        self.sig = pc.fill_null(g.cand["c_sig"], 0).to_numpy()

    def begin(self, rows: slice) -> None:
        super().begin(rows)
        self.signature = np.zeros(len(self.n), np.int64)

    def add(self, cols: slice, hit: np.ndarray) -> None:
        super().add(cols, hit)
        r, c = np.nonzero(hit)
        np.bitwise_xor.at(self.signature, r, self.sig[cols][c])

    def end(self) -> dict[str, pa.Array]:
        rows = np.flatnonzero(self.n)
        return {"trigger_id": self.trigger(rows), "n": pa.array(self.n[rows]), "signature": pa.array(self.signature[rows])}


def cluster_signatures(tickets: DataFrame, cfg: TrendConfig) -> DataFrame:
    """Per trigger with matches: ``similar_count`` and ``signature`` (``review.id_signature``) of the similar ids."""
    t = tickets.select("id", "created_at", "category", "embedding", id_hash(F.col("id")).alias("sig"))
    per = fold_clusters(t, cfg, _Signature, "trigger_id string, n bigint, signature bigint", candidate_cols=("sig",))
    return per.groupBy("trigger_id").agg(F.sum("n").alias("similar_count"), F.bit_xor("signature").alias("signature"))


# ------------------------------------------------------------ matches of a trigger as one row
LISTED_ROWS = 256           # triggers whose matches are held at once, as one boolean per candidate


def nullable(x: pa.Array) -> pa.Array:
    """A list column without promises on its elements, as the schema of a result has it."""
    return x.cast(pa.list_(x.type.value_type)) if pa.types.is_list(x.type) else x


def nested_matches(tickets: DataFrame, cfg: TrendConfig, columns: Sequence[str], triggers: DataFrame | None = None) -> DataFrame:
    """One row per trigger with matches, and per slice of its window: t_id, t_ts, t_account_id, and as lists of one length c_id, the
    given columns of the matches (``account_id`` among them) and the score.  A slice has whole accounts, so a list is no longer
    than a slice."""
    trig, cand, cond = cluster_sides(tickets, cfg, "account_id", ("account_id",), columns, triggers=triggers)
    t_out, c_out = ["t_id", "t_ts", "t_account_id"], ["c_id", *[f"c_{c}" for c in columns]]
    both = _both_sides(trig, cand, cond, t_out[2:], c_out[1:])
    kind = {f.name: f.dataType.simpleString() for f in both.schema.fields} | {"score": "double"}
    schema = ", ".join([*[f"{k} {kind[k]}" for k in t_out], *[f"{k} array<{kind[k]}>" for k in (*c_out, "score")]])
    w_us = int(cfg.window_seconds) * 1_000_000

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, w_us, False)
        if not g:
            return
        hits = tile_hits(g.tv, g.cv, g.in_window, cfg.threshold, cfg.block_rows, LISTED_ROWS)
        for start, part in groupby(hits, key=lambda x: x[0].start):
            part = [(cols, hit) for _, cols, hit in part]
            n = sum(np.count_nonzero(hit, axis=1) for _, hit in part)
            lo = 0
            while lo < len(n):                  # at most PAIRS_OUT matches leave at once, of one trigger at least
                hi = lo + max(1, int(np.searchsorted(np.cumsum(n[lo:]), PAIRS_OUT, side="right")))
                found = [(r, c + cols.start) for cols, hit in part for r, c in [np.nonzero(hit[lo:hi])]]
                r, c = (np.concatenate(x) for x in zip(*found))
                o = np.argsort(r, kind="stable")
                r, c = start + lo + r[o], c[o]
                some = np.flatnonzero(n[lo:hi])
                ends = pa.array(np.r_[0, np.cumsum(n[lo:hi][some])], pa.int32())
                lists = ({k: nullable(g.cand[k].take(pa.array(c)).combine_chunks()) for k in c_out}
                         | {"score": pa.array(paired_scores(g.tv, g.cv, r, c))})
                if len(some):
                    at = pa.array(start + lo + some)
                    yield from pa.table({k: g.trig[k].take(at) for k in t_out}
                                        | {k: pa.ListArray.from_arrays(ends, x) for k, x in lists.items()}).combine_chunks().to_batches()
                lo = hi

    return both.groupBy(*cond).applyInArrow(group, schema=schema)


# ------------------------------------------------------------ listed matches
def with_review_columns(tickets: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tickets with status and account tier as a review shows them, the hash of their id in a signature, and ``many``: whether the id
    or the account has several rows (or the id is null)."""
    shown = {"status": title_case(F.coalesce("status", F.lit(""))), "tier": title_case(F.coalesce("tier", F.lit("")))}
    tier = tiers.groupBy("account_id").agg(F.first("customer_tier").alias("tier"), F.count(F.lit(1)).alias("_accounts"))
    ids = tickets.groupBy("id").agg(F.count(F.lit(1)).alias("_ids")).where(F.col("_ids") > 1)
    return (tickets.select("id", "created_at", "category", "account_id", "subject", "status", "tags", "embedding")
            .join(tier, "account_id", "left").join(ids, "id", "left").withColumns(shown)
            .withColumn("sig", id_hash(F.col("id")))
            .withColumn("many", F.col("_ids").isNotNull() | F.col("id").isNull() | (F.coalesce("_accounts", F.lit(1)) > 1))
            .drop("_ids", "_accounts"))


def single_matches(tickets: DataFrame, cfg: TrendConfig, columns: Sequence[str], triggers: DataFrame | None = None) -> DataFrame:
    """The matches among tickets of which none shares its id: category, t_id, t_ts, c_id and the given columns (``t_``, ``c_`` and a
    column of the tickets, ``score``).  They leave the task that compares them and are neither stored nor shuffled."""
    t_cols, c_cols = ([c[2:] for c in columns if c.startswith(p) and c != f"{p}ts"] for p in ("t_", "c_"))
    trig, cand, cond = cluster_sides(tickets, cfg, "id", t_cols, c_cols, triggers=triggers)
    both = _both_sides(trig, cand, cond, [f"t_{c}" for c in t_cols], [f"c_{c}" for c in c_cols])
    t_out, c_out = ["category", "t_id", "t_ts", *[f"t_{c}" for c in t_cols]], ["c_id", *[c for c in columns if c.startswith("c_")]]
    out_cols = [*t_out, *c_out, *[c for c in columns if c == "score"]]
    fields = {f.name: f.dataType.simpleString() for f in both.schema.fields} | {"score": "double"}
    w_us = int(cfg.window_seconds) * 1_000_000

    def pairs(g: _Group) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        if "score" in out_cols:
            yield from matches_by_tile(g.tv, g.cv, g.in_window, cfg.threshold, cfg.block_rows)
            return
        for rows, cols, hit in tile_hits(g.tv, g.cv, g.in_window, cfg.threshold, cfg.block_rows):
            r, c = np.nonzero(hit)
            for lo in range(0, len(r), PAIRS_OUT):
                yield rows.start + r[lo:lo + PAIRS_OUT], cols.start + c[lo:lo + PAIRS_OUT], None

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, w_us, False)
        if not g:
            return
        for r, c, score in pairs(g):
            i, j = pa.array(r), pa.array(c)
            cols = {k: g.trig[k].take(i) for k in t_out} | {k: g.cand[k].take(j) for k in c_out} | {"score": score}
            yield from pa.table({k: cols[k] for k in out_cols}).combine_chunks().to_batches()

    return both.groupBy(*cond).applyInArrow(group, schema=", ".join(f"{c} {fields[c]}" for c in out_cols))


def listed_matches(tickets: DataFrame, tiers: DataFrame, cfg: TrendConfig, partitions: int) -> DataFrame:
    """``matches_by_group`` of all tickets."""
    return matches_by_group(with_review_columns(tickets, tiers), cfg, partitions)


def matches_by_group(tickets: DataFrame, cfg: TrendConfig, partitions: int, triggers: DataFrame | None = None) -> DataFrame:
    """The matches of ``trend.trend_matches`` with what a review shows of both tickets (``with_review_columns``), partitioned by ``grp``.

    ``grp`` is a function of the two ids, so all that is said on a (trigger, ticket) pair can be kept where the pair is: it is the
    group that compares them, or, where one of the ids has several rows (``many``), a hash of the ids."""
    t_cols, c_cols = ("tags", "many"), ("account_id", "subject", "tags", "status", "tier", "many")
    trig, cand, cond = cluster_sides(tickets, cfg, "id", t_cols, c_cols, triggers=triggers)
    t_out, c_out = ["t_id", "t_ts", *[f"t_{c}" for c in t_cols]], ["c_id", "c_ts", *[f"c_{c}" for c in c_cols]]
    both = _both_sides(trig, cand, cond, t_out[2:], c_out[2:]).withColumn("grp", F.xxhash64(*cond))
    out_cols = ["grp", "category", *t_out, *c_out, "score"]
    fields = {f.name: f.dataType.simpleString() for f in both.schema.fields} | {"score": "double"}
    w_us = int(cfg.window_seconds) * 1_000_000

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, w_us, False)
        if not g:
            return
        for r, c, score in matches_by_tile(g.tv, g.cv, g.in_window, cfg.threshold, cfg.block_rows):
            i, j = pa.array(r), pa.array(c)
            cols = ({k: g.trig[k].take(i) for k in ("grp", "category", *t_out)} | {k: g.cand[k].take(j) for k in c_out}
                    | {"score": pa.array(score)})
            yield from pa.table({k: cols[k] for k in out_cols}).combine_chunks().to_batches()

    found = (both.repartition(partitions, "grp").groupBy("grp", *cond)
             .applyInArrow(group, schema=", ".join(f"{c} {fields[c]}" for c in out_cols)))
    many = F.col("t_many") | F.col("c_many")
    return (found.withColumn("grp", F.when(many, F.xxhash64("t_id", "c_id")).otherwise(F.col("grp")))
            .withColumn("many", many).drop("t_many", "c_many"))
