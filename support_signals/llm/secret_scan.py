"""Operator 8: secret scans with multipart credential linking.

One pass over the whole texts finds the strong spans (assigned secrets, access identifiers, long hex strings) and weak
parts: short access identifiers, endpoints (URLs, host names with a port) and bare tokens that look like secrets.  Weak
parts become rows (document, kind, interval) and are linked in Spark: within a scope -- a paragraph of the document --
a weak token is reported when an access identifier and an endpoint, or an access identifier and an assigned or hex secret,
lie within ``reach`` code points, and a short identifier when an assigned or hex secret does.  Endpoints are no secrets, and
an identifier beside a bare token alone is no set.  The interval join needs only the nearest part of each kind before and after a token, so
it is a window over the parts of a scope in order of position, not a join of pairs.

Defined results: null text is empty, without spans; a span never crosses a line break; rows are told apart by a hash of
the text besides their id, so repeated rows and ids give the same result for each row; extra columns are ignored; an
empty table gives an empty result; long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .words import texts as text_buffers

#: The strong kinds and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Weak parts.
SHORT_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{4,}(?![A-Za-z0-9])")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:https?://[A-Za-z0-9._~-]+(?::[0-9]+)?|[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5})(?![A-Za-z0-9])")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
REACH = 400

PART = "array<struct<kind:string,start:bigint,end:bigint,scope:bigint>>"


def strong_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strong spans in order of start, then kind."""
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def looks_secret(token: str) -> bool:
    """At least three of: lower case, capital, digit, sign; and at least ten different characters."""
    kinds = any(c.islower() for c in token) + any(c.isupper() for c in token) + any(c.isdigit() for c in token) + any(c in "+/_=-" for c in token)
    return kinds >= 3 and len(set(token)) >= 10


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers (``short`` outside strong spans, where they can be reported), endpoints and bare tokens, these only
    outside strong spans."""
    found = [m.span() for m in SHORT_ID.finditer(text)] if re.search("AKIA|ASIA|AROA|AIDA", text) else []
    out = [("id" if any(s < z and a < e for s, _, e in strong) else "short", a, z) for a, z in found]
    if ":" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    taken = [(s, e) for s, _, e in strong] + [(s, e) for _, s, e in out]
    for m in TOKEN.finditer(text):
        if looks_secret(m[0]) and not any(s < m.end() and m.start() < e for s, e in taken):
            out.append(("token", m.start(), m.end()))
    return out


def long_runs(buf: np.ndarray, at: np.ndarray, member: np.ndarray, least: int) -> np.ndarray:
    """Which texts have a run of at least ``least`` bytes of a class."""
    has = np.zeros(len(at) - 1, dtype=bool)
    if len(buf) < least:
        return has
    inside = member[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    for i in np.flatnonzero(end - start >= least):
        a, z = np.searchsorted(at, [start[i], end[i] - 1], side="right") - 1
        has[a:z + 1] = True
    return has


IS_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
IS_TOKEN = np.array([chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") for b in range(256)])


def parts(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``keep``, text_hash, counts, base_sha256, base (strong spans) and, where a bare token or a short
    identifier could be linked, its parts with their scopes."""
    chosen = docs.select(key, *keep, F.xxhash64(text).alias("text_hash"), text)
    fixed = [*range(len(keep) + 2)]
    fixed_names = chosen.columns[:-1]
    schema = ", ".join(f"`{n}` {chosen.schema[i].dataType.simpleString()}" for i, n in enumerate(fixed_names))
    schema += f", n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<string>, parts {PART}"
    part_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                column = batch.column(len(keep) + 2).slice(lo, 512)
                buf, at = text_buffers(column)
                buf, at = buf[at[0]:at[-1]], at - at[0]
                hexes, tokens = long_runs(buf, at, IS_HEX, 24), long_runs(buf, at, IS_TOKEN, 16)
                n, sha, base, found = ([], [], []), [], [], []
                for i, value in enumerate(column):
                    t = value.as_py() or ""
                    strong = strong_spans(t, t.lower())
                    if hexes[i]:
                        strong += [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
                    strong.sort()
                    spans = [f"{KINDS[k]}:{s}:{e}" for s, k, e in strong]
                    for k in range(3):
                        n[k].append(sum(x[1] == k for x in strong))
                    sha.append(hashlib.sha256(",".join(spans).encode()).hexdigest())
                    base.append(spans)
                    weak = weak_parts(t, strong) if tokens[i] or any(k != 1 for _, k, _ in strong) else []
                    if any(x[0] in ("token", "short") for x in weak):
                        rows = weak + [("id" if k == 1 else "secret", s, e) for s, k, e in strong]
                        breaks = np.array([m.start() for m in re.finditer(r"\n[ \t\r]*\n", t)], dtype=np.int64)
                        found.append([{"kind": k, "start": s, "end": e, "scope": int(np.searchsorted(breaks, s))} for k, s, e in rows])
                    else:
                        found.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(j).slice(lo, 512) for j in fixed] + [pa.array(x, pa.int64()) for x in n]
                    + [pa.array(sha, pa.string()), pa.array(base, pa.list_(pa.string())), pa.array(found, part_type)],
                    names=[*fixed_names, "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"])

    return chosen.mapInArrow(run, schema)


def link(found: DataFrame, key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """(key, text_hash, linked): bare tokens with an identifier and either an endpoint or a strong secret within
    ``reach`` in their scope, and short identifiers with a strong secret."""
    rows = (found.where("parts IS NOT NULL").select(key, "text_hash", "parts").dropDuplicates([key, "text_hash"])
            .select(key, "text_hash", F.explode("parts").alias("p")).select(key, "text_hash", "p.*"))
    order = Window.partitionBy(key, "text_hash", "scope").orderBy("start", "end", "kind")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)

    def near(*kinds: str):
        before = F.max(F.when(F.col("kind").isin(*kinds), F.col("end"))).over(back)
        after = F.min(F.when(F.col("kind").isin(*kinds), F.col("start"))).over(ahead)
        return F.coalesce(F.least(F.col("start") - before, after - F.col("end")) <= reach, F.lit(False))

    token = (F.col("kind") == "token") & near("id", "short") & (near("endpoint") | near("secret"))
    return (rows.withColumn("linked", token | ((F.col("kind") == "short") & near("secret"))).where("linked")
            .groupBy(key, "text_hash")
            .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("linked")))


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), reach: int = REACH) -> DataFrame:
    """Per row: key, ``keep``, n_assign, n_access, n_hex, base_sha256, spans (strong and linked, by start)."""
    found = write_table(parts(docs, text, key, keep), "secret-parts")      # read twice; without the texts
    linked = link(found, key, reach).withColumnsRenamed({key: "_key", "text_hash": "_hash"})
    out = found.drop("parts").join(linked, F.col(key).eqNullSafe(F.col("_key")) & F.col("text_hash").eqNullSafe(F.col("_hash")), "left")
    added = F.transform(F.coalesce("linked", F.expr("array()")), lambda x: F.concat(F.lit("linked:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    spans = F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(
        F.split(s, ":")[1].cast("bigint").alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "linked"))), F.split(s, ":")[0]).alias("kind"), s.alias("span"))))
    return out.select(key, *keep, "n_assign", "n_access", "n_hex", "base_sha256",
                      F.array_join(F.transform(spans, lambda x: x["span"]), ",").alias("spans"))


def redact(docs: DataFrame, columns: tuple[str, ...], text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """``columns`` of every row, its spans replaced by ``[kind]``; overlapping spans are one, named after the first.

    Strong spans are found again next to the text, so only linked tokens travel: documents meet them by id and hash."""
    linked = link(write_table(parts(docs, text, key).where("parts IS NOT NULL"), "secret-parts"), key, reach).withColumnsRenamed({key: "_key", "text_hash": "_hash"})
    same = docs[key].eqNullSafe(F.col("_key")) & F.xxhash64(docs[text]).eqNullSafe(F.col("_hash"))
    joined = docs.join(linked, same, "left").select(*columns, "linked")
    at, size = columns.index(text), columns.index("n_chars") if "n_chars" in columns else None
    schema = joined.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = [], []
            for value, more in zip(batch.column(at), batch.column(len(columns))):
                t = value.as_py()
                if t:
                    strong = strong_spans(t, t.lower()) + [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
                    spans = sorted([(s, e, KINDS[k]) for s, k, e in strong] + [(x["start"], x["end"], "linked") for x in more.as_py() or ()])
                    out, done = [], 0
                    for s, e, kind in spans:
                        if s >= done:
                            out += [t[done:s], f"[{kind}]"]
                        done = max(done, e)
                    if out:
                        t = "".join([*out, t[done:]])
                texts.append(t)
                lengths.append(None if t is None else len(t))
            new = list(batch.columns[:len(columns)])
            new[at] = pa.array(texts, pa.string())
            if size is not None:
                new[size] = pa.array(lengths, new[size].type)
            yield pa.RecordBatch.from_arrays(new, names=list(columns))

    return joined.mapInArrow(run, schema)
