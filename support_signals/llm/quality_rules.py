"""Operator 6: quality rules as a learned decision list.

Statistics of every whole text are computed in one pass (no shuffle).  A decision list is learned from labelled
statistics by sequential covering: each rule is a conjunction of at most ``max_terms`` thresholds, grown on two thirds
of the rows by FOIL gain and pruned on the other third, and the rows it covers leave before the next rule is grown.
Rules describe the rejected class; the list ends with "keep".  It is emitted as ordered Spark conditional expressions
(``when(...).when(...).otherwise(...)``), so the verdict is computed in generated code.

Fitting takes at most ``fit_rows`` labelled rows (those with the smallest hash of their id), a documented bound; the
statistics and the verdict cover all rows.

Defined results: null text has no words, so the base rule fails it; rows are independent (repeated rows, ties and extra
columns do not matter); an empty table gives an empty result; without labelled rows of both classes the list is empty
and every row that passes the base rule is kept.  Labels that are null are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .components import smallest_hashes
from .words import scan, slices, windows

FIT_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the learned rules may use; ratios are per word or character.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share",
            "pipe_share", "top_word_share", "distinct_share", "digit_share")


def _statistics(lo: int, hi: int, buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    w = scan(buf, at)
    n = np.diff(w.first)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[at[1:]] - total[at[:-1]]

    lead = (buf & 0xC0) != 0x80
    in_word = np.zeros(len(buf) + 1, dtype=np.int8)
    np.add.at(in_word, w.start, 1)
    np.add.at(in_word, w.end, -1)
    in_word = np.cumsum(in_word[:-1]).astype(bool)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS.encode())] = True
    upper = (buf >= 65) & (buf <= 90)
    out = {"n_words": n, "word_chars": per_text(lead & in_word), "n_symbols": per_text(symbol[buf]),
           "n_upper": per_text(upper), "n_bang": per_text(buf == 33), "n_pipe": per_text(buf == 124),
           "n_digit": per_text((buf >= 48) & (buf <= 57))}
    first3, hash3 = windows(w, 3)
    cut = np.searchsorted(first3, w.first)
    dup, rep, top, distinct = [], [], [], []
    for i in range(hi - lo):
        h, p = hash3[cut[i]:cut[i + 1]], first3[cut[i]:cut[i + 1]] - w.first[i]
        _, where, count = np.unique(h, return_inverse=True, return_counts=True)
        covered = np.zeros(n[i], dtype=bool)
        hit = p[count[where] > 1]
        for k in range(3):
            covered[hit + k] = True
        rep.append(int(covered.sum()))
        _, count = np.unique(w.hash[w.span(i)], return_counts=True)
        top.append(int(count.max()) if len(count) else 0)
        distinct.append(len(count))
        seen: set[bytes] = set()
        d = 0
        for line in buf[at[i]:at[i + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\x0b\x0c\r"):
                if line in seen:
                    d += 1
                else:
                    seen.add(line)
        dup.append(d)
    return out | {"n_dup_lines": np.array(dup), "n_repeat_words": np.array(rep), "top_word": np.array(top), "distinct": np.array(distinct)}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang", "n_pipe", "n_digit",
          "top_word", "distinct")


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the counts of every whole text."""
    chosen = docs.select(*keep, text)
    schema = ", ".join(f"`{c}` {chosen.schema[i].dataType.simpleString()}" for i, c in enumerate(keep))
    schema += "".join(f", {c} bigint" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, at in slices(batch.column(len(keep))):
                s = _statistics(lo, hi, buf, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))] + [pa.array(s[c], pa.int64()) for c in COUNTS],
                    names=[*keep, *COUNTS])

    return chosen.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """The statistics that rules compare with thresholds, as expressions over the counts."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    parts = {"n_words": F.col("n_words").cast("double"), "mean_word": F.col("word_chars") / words,
             "symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / words,
             "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("n_upper") / chars,
             "bang_share": F.col("n_bang") / chars, "pipe_share": F.col("n_pipe") / chars,
             "top_word_share": F.col("top_word") / words, "distinct_share": F.col("distinct") / words,
             "digit_share": F.col("n_digit") / chars}
    return {f: parts[f] for f in FEATURES}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, FEATURES.index(self.feature)] >= self.value if self.at_least else x[:, FEATURES.index(self.feature)] <= self.value

    def expression(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= F.lit(self.value) if self.at_least else columns[self.feature] <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:.6g}"


Rule = tuple[Term, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (t.holds(x) for t in rule), np.ones(len(x), dtype=bool))


def grow(x: np.ndarray, bad: np.ndarray, max_terms: int) -> Rule:
    """Adds the threshold of the highest FOIL gain until no bad-only rows are left to gain."""
    rule: Rule = ()
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < max_terms and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base = np.log2(p0 / (p0 + n0))
        best: tuple[float, Term | None] = (1e-9, None)
        for j, f in enumerate(FEATURES):
            v, b = x[inside, j], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            change = np.flatnonzero(v[1:] != v[:-1])
            if not len(change):
                continue
            p_low, n_all = np.cumsum(b)[change], change + 1
            middle = (v[change] + v[change + 1]) / 2
            for high in (True, False):
                p = p0 - p_low if high else p_low
                n = (len(v) - n_all if high else n_all) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Term(f, high, float(middle[k])))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (bad - good) / covered on rows it was not grown on; longest of equals."""
    def worth(r: Rule) -> float:
        c = covers(r, x)
        return (2.0 * bad[c].sum() - c.sum()) / max(1, c.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), len(r))) if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, max_terms: int = 3, max_rules: int = 12, precision: float = 0.9) -> list[Rule]:
    """Sequential covering: rules for the rejected class, each at least ``precision`` pure on the pruning rows."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3
    left = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules:
        g, p = left & (part != 0), left & (part == 0)
        if not bad[g].any() or bad[g].all():
            break
        rule = prune(grow(x[g], bad[g], max_terms), x[p], bad[p])
        c = covers(rule, x[p])
        if not rule or not c.any() or bad[p][c].mean() < precision:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from labelled rows that pass the base rule: at most ``fit_rows`` of them come to the driver."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    columns = features()
    passed = stats.where(~base_failed()).select("doc_id", *[c.alias(f) for f, c in columns.items()])
    rows = smallest_hashes(passed.join(marked, "doc_id"), "doc_id", fit_rows).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable")
    if rows.empty or rows["quality"].nunique() < 2:
        return []
    return learn(rows[list(FEATURES)].to_numpy(dtype=float), rows["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), 0 if none does, as ordered conditional expressions."""
    columns = features()
    out = None
    for k, rule in enumerate(rules, 1):
        hit = reduce(lambda a, b: a & b, (t.expression(columns) for t in rule))
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def apply(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, rule (0: none)."""
    stats = write_table(statistics(docs), "text-statistics")      # read twice; no texts
    rules = fit(stats, labels, fit_rows)
    failed = base_failed()
    return stats.select("doc_id", *BASE, failed.alias("base_failed"),
                        F.when(failed, F.lit(False)).otherwise(verdict(rules) == 0).alias("kept"),
                        F.when(failed, F.lit(0)).otherwise(verdict(rules)).alias("rule"))
