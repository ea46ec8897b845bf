"""Ranked lexical search, whitening and suffix-array dedup, against brute force on awkward fixtures."""

import random

import numpy as np
import pytest
import xxhash

from support_signals.llm import bwt_merge, lexical_bpa, suffix_dedup, whitening_qd

from . import brute
from .test_text_operators import frame, passages, rows


# ---------------------------------------------------------------- 11

ITEMS = "item_id bigint, text string, score string"


def items(spark, values):
    return spark.createDataFrame([(i, t, "x") for i, t in values], ITEMS)


ASKED = [(1, "B1 b2 c,3 ß4 a5 A5"), (2, None), (3, "!!"), (4, "a1"), (None, "bé7 d8 ß9"), (4, "a1"), (6, "unknown words only"), (7, "w")]


@pytest.mark.parametrize("shard,block", [(32 << 20, 100_000), (300, 2)])
def test_search(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical_bpa, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical_bpa, "BLOCK_WORDS", block)
    docs = passages(seed=21, docs=90) + [(None, "a1 b2 ß4"), (7, "a1 a1 a1"), (500, "a1"), (501, "a1"), (502, "a1")]
    got = rows(lexical_bpa.search(frame(spark, docs).repartition(3), items(spark, ASKED)).select("item_id", "rank", "doc_id", "score"))
    assert got == brute.search(docs, ASKED)


def test_search_of_empty_tables(spark):
    assert rows(lexical_bpa.search(frame(spark, []), items(spark, ASKED))) == []
    assert rows(lexical_bpa.search(frame(spark, [(1, "a b")]), items(spark, []))) == []
    assert rows(lexical_bpa.search(frame(spark, [(1, None), (2, " ! ")]), items(spark, ASKED))) == []


def test_best_positions_stop_before_the_lists_end():
    """Documents that hold all terms with the highest impacts: the bound falls strictly below the k-th score early."""
    n = 4000
    doc = np.tile(np.arange(n), 3)
    tf = np.where(doc < 20, 50, 1)
    lists = lexical_bpa.impact_lists(np.full(n, 100), np.arange(3), np.full(3, n), doc, tf, n, 100 * n, 3)
    best = []
    scored = lexical_bpa.best_positions(lists, np.arange(n), np.ones(n, dtype=bool), np.arange(3), np.array([5, 6, 7]), best, 10)
    assert [d for _, d in best] == list(range(10))
    assert scored < n // 10


# ---------------------------------------------------------------- 12

def whitened_check(vectors, got, k):
    x = np.floor(1024 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    dev = ((n * x - s) ** 2).sum(axis=1)
    c = x - s / n
    v = c.T @ c / n
    e, z = np.linalg.eigh(v)
    e, z = e[::-1], z[:, ::-1]
    assert len(got) == n * k
    table = {(r.vec_id, r.component): r for r in got}
    for j in range(k):
        mine = np.array([table[i, j + 1].whitened for i in range(n)])
        want = c @ z[:, j] / np.sqrt(e[j])
        assert np.allclose(mine, want * np.sign(mine @ want), atol=1e-7)
        assert abs(table[0, j + 1].explained - e[j] / np.trace(v)) <= 1e-9
    assert all(table[i, 1].deviation == dev[i] and table[i, 1].n == n for i in range(n))
    assert max(r.identity_error for r in got) <= 1e-9


@pytest.mark.parametrize("d", [1, 3, 24])
def test_whitening(spark, monkeypatch, d):
    monkeypatch.setattr(whitening_qd, "FAN_IN", 2)
    r = np.random.default_rng(d)
    vectors = (r.standard_normal((200, d)) * np.linspace(0.2, 2, d)).astype(np.float32)
    vectors[50:120] = vectors[50]                                     # a hot vector
    table = spark.createDataFrame([(i, [float(v) for v in x], i) for i, x in enumerate(vectors)], "vec_id bigint, embedding array<float>, component int")
    whitened_check(vectors, whitening_qd.whiten(table.repartition(7)).collect(), min(d, 8))


def test_whitening_drops_bad_rows_and_constant_components(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 0.25, 0.0], [0.25, 0.5, 0.0], [-0.5, 0.75, 0.0], [0.1, 0.2, 0.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 0.0, 1.0], [inf, 0.0, 1.0], [1.0, 2.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)] + [(None, good[0])], "vec_id bigint, embedding array<double>")
    got = whitening_qd.whiten(table).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3, None} and {r.component for r in got} == {1, 2}      # the third entry is constant
    assert all(r.n == 5 for r in got) and max(r.identity_error for r in got) < 1e-9
    assert whitening_qd.whiten(table.where("vec_id = 0")).collect() == []                               # no variance
    assert whitening_qd.whiten(table.where("vec_id > 100")).collect() == []


@pytest.mark.parametrize("make", [
    lambda r: r.standard_normal((300, 40)),
    lambda r: np.eye(32)[np.arange(320) % 32] * 1000.0,                       # one eigenvalue many times over
    lambda r: np.hstack([r.standard_normal((100, 6))] * 2),                   # rank 6 of 12
    lambda r: r.standard_normal((200, 20)) * 10.0 ** -np.arange(20),          # values over 38 orders of magnitude
    lambda r: np.ones((5, 1)) * np.arange(5)[:, None]])
def test_qd_solver_against_eigenvalues(make):
    x = make(np.random.default_rng(3))
    c = x - x.mean(axis=0)
    values, vectors, trace = whitening_qd.components_of(np.linalg.qr(c, mode="r"), c.shape[1])
    want = np.linalg.svd(c, compute_uv=False)[:len(values)] ** 2
    assert np.allclose(values, want, rtol=1e-9)
    assert abs(trace / (c**2).sum() - 1) < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    assert np.abs(c.T @ (c @ vectors) - vectors * values).max() < 1e-9 * values[0]


# ---------------------------------------------------------------- 13

def order(doc_id, text):
    """Spark's xxhash64 of (doc_id, text): each value is hashed with the hash of the one before as the seed."""
    seed = xxhash.xxh64_intdigest((doc_id).to_bytes(8, "little", signed=True), 42)
    h = seed if text is None else xxhash.xxh64_intdigest(text.encode(), seed)
    return h - 2**64 if h >= 2**63 else h


def awkward(seed=5):
    r = random.Random(seed)
    docs = passages(seed=seed)
    long = "".join(r.choice("abcdé ") for _ in range(700))
    docs += [(200 + i, "".join(r.choice("xyz ") for _ in range(r.randrange(0, 60))) + long[r.randrange(0, 200):r.randrange(300, 700)] +
              "".join(r.choice("xyz ") for _ in range(r.randrange(0, 60)))) for i in range(40)]
    docs += [(300, "ab" * 400), (301, "ab" * 90), (302, "a" * 99), (303, "a" * 100), (304, "a" * 101), (305, "ß" * 51)]
    docs += [(310, long), (310, long), (311, long[:400]), (311, long[200:]), (None, long), (None, None)]
    return docs


@pytest.mark.parametrize("group,slice_bytes", [(3 << 19, 1 << 19), (2000, 1 << 19), (3 << 19, 1000)])
def test_suffix_dedup(spark, monkeypatch, group, slice_bytes):
    """Also with groups so small that every shared minimizer is cut, and with texts in overlapping stretches."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    docs = awkward()
    got = rows(suffix_dedup.suffix_dedup(frame(spark, docs).repartition(5), group=group))
    assert got == brute.bytes_removed(docs, order)


def test_suffix_dedup_keeps_the_rest_and_takes_empty_tables(spark):
    r = random.Random(4)
    a = "".join(r.choice("abcdefgh") for _ in range(300))
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(frame(spark, [(1, a), (2, "x" + a[50:250] + "y")]), with_text=True).collect()}
    assert got == {1: a.encode(), 2: b"xy"}
    assert rows(suffix_dedup.suffix_dedup(frame(spark, []))) == []


@pytest.mark.parametrize("shard", [50, 400, 1 << 18])
def test_merged_shards_have_the_repeated_intervals(shard):
    r = random.Random(shard)
    for _ in range(15):
        base = bytes(r.choice(b"ab") for _ in range(400))
        pieces = [base[a:a + r.randrange(90, 260)] for a in (r.randrange(300) for _ in range(8))] + [b"a" * r.randrange(80, 240)]
        lengths = np.array([len(p) for p in pieces])
        position, interval = bwt_merge.merged_intervals(np.frombuffer(b"".join(pieces), np.uint8), lengths, shard=shard)
        found = {}
        for p, i in zip(position.tolist(), interval.tolist()):
            found.setdefault(i, set()).add(p)
        want, at = {}, 0
        for p in pieces:
            for s in range(len(p) - 99):
                want.setdefault(p[s:s + 100], set()).add(at + s)
            at += len(p)
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
