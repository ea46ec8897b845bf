"""Operators whose results have a brute-force version, on small fixtures with awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from support_signals.llm import decontaminate, jaccard_join, quality_rules, secret_scan, substring_dedup, words

from . import brute

DOCS = "doc_id bigint, text string, lang string, hash string, key string, n string"     # some names the operators use inside


def frame(spark, rows, schema="doc_id bigint, text string"):
    if schema == "doc_id bigint, text string":
        return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS)
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def passages(seed=3, docs=60, vocabulary=40):
    """Documents made of shared and own passages, with near copies, odd blanks, nulls and empty texts."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "Bé", "c,", "D", "ß"]) + str(r.randrange(vocabulary))
    shared = [[word() for _ in range(r.randrange(3, 40))] for _ in range(12)]
    out = []
    for i in range(docs):
        w = []
        for _ in range(r.randrange(1, 5)):
            w += r.choice(shared) if r.random() < 0.6 else [word() for _ in range(r.randrange(1, 30))]
        if out and r.random() < 0.3:
            w = (out[r.randrange(len(out))][1] or "").split()
            for _ in range(r.randrange(0, 3)):
                if w:
                    w[r.randrange(len(w))] = word()
        out.append((i * 7 % 61, r.choice([" ", "\n", " \t", "\x0b"]).join(w)))
    return out + [(100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "one two"), (105, "w " * 30_000)]


def test_words_agree_with_the_patterns():
    texts = ["", "a b\tc\x0bd\x0ce\rf\ng", "é ß  x", None, "A-Z09 ü!", "\x1c\x7f"]
    column = pa.array(texts)
    for lo, hi, buf, at in words.slices(column, 5):
        w = words.scan(buf, at)
        for i in range(hi - lo):
            raw = buf[at[i]:at[i + 1]].tobytes()
            assert [buf[a:z].tobytes().decode() for a, z in zip(w.start[w.span(i)], w.end[w.span(i)])] == brute.SPACED.findall(raw.decode())
            w2 = words.scan(buf, at, words.ALNUM, words.LOWER)
            assert [bytes(words.LOWER[buf[a:z]]).decode() for a, z in zip(w2.start[w2.span(i)], w2.end[w2.span(i)])] == brute.ALNUM.findall(raw.decode().translate(brute.LOWER))


@pytest.mark.parametrize("streams", [2_000, 1])
def test_substring_dedup(spark, monkeypatch, streams):
    monkeypatch.setattr(substring_dedup, "STREAMS", streams)
    docs = passages() + [(None, " ".join(f"q{k}" for k in range(20))), (200, " ".join(f"q{k}" for k in range(20)))]
    assert rows(substring_dedup.substring_dedup(frame(spark, docs))) == brute.substring(docs)


def test_substring_dedup_repeated_ids_and_empty_table(spark):
    a, b = " ".join(f"x{k}" for k in range(30)), " ".join(f"x{k}" for k in range(10, 50))
    docs = [(1, a), (1, a), (1, b), (2, b)]
    assert rows(substring_dedup.substring_dedup(frame(spark, docs))) == brute.substring(docs)
    assert rows(substring_dedup.substring_dedup(frame(spark, []))) == []


def test_automaton_statistics_are_longest_matches():
    r = random.Random(5)
    for _ in range(30):
        parts = [[r.randrange(3) for _ in range(r.randrange(1, 15))] for _ in range(3)]
        auto = substring_dedup.Automaton()
        for p in parts:
            auto.add(p)
        known = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        text = [r.randrange(4) for _ in range(25)]
        expect = [max((n for n in range(1, k + 2) if tuple(text[k + 1 - n:k + 1]) in known), default=0) for k in range(len(text))]
        assert auto.statistics(text) == expect


@pytest.mark.parametrize("tile", [400_000, 300])
def test_jaccard_join(spark, tile):
    r = random.Random(11)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    docs = passages(seed=8)
    for k in range(40):                                  # copies that drift away: links form chains
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"u{r.randrange(9)}"
        docs.append((300 + k, " ".join(w)))
        base[r.randrange(len(base))] = f"t{k}"
    docs += [(400 + n, " ".join(f"s{j}" for j in range(n))) for n in range(1, 30)]      # boundary of the similarity at small sizes
    docs += [(500 + n, " ".join(f"S{j}" for j in range(n))) for n in range(1, 8)]            # equal when lower-cased
    assert rows(jaccard_join.near_duplicates(frame(spark, docs), tile=tile)) == sorted(brute.near(docs), key=str)


def test_jaccard_bounds_hold_for_every_pair_of_sizes():
    edges = jaccard_join.EDGES
    for x in range(1, 400):
        band = int(np.searchsorted(edges, x, side="right")) - 1
        for y in range(x, x * 5 // 4 + 1):
            other = int(np.searchsorted(edges, y, side="right")) - 1
            common = -(-80 * (x + y) // 180)
            assert other in (band, band + 1)
            assert x + y - 2 * common <= jaccard_join.most_different(band)
            if other == band + 1:
                assert y <= (int(edges[other]) - 1) * 100 // 80


def test_jaccard_keys_needed_are_shared_at_the_limit():
    for n in range(28, 46):                              # the smaller set; its partner has it whole and is as large as links allow
        for t in range(250):
            w = [f"n{n}t{t}w{k}" for k in range(n * 5 // 4 + 4)]
            column = pa.array([" ".join(w[:n + 4]), " ".join(w)])
            ((lo, hi, buf, at),) = words.slices(column)
            a, b = jaccard_join.shingle_sets(lo, hi, buf, at)
            assert 100 * len(a) >= 80 * len(b)
            shared = [(max(x, y), len(np.intersect1d(p, q))) for x, p in jaccard_join.block_keys(a) for y, q in jaccard_join.block_keys(b)]
            assert any(common >= needed for needed, common in shared), (n, t)


def test_jaccard_join_finds_pairs_of_thin_and_thinner_sets(spark):
    lost = [16, 591, 669, 678, 966, 977, 1276, 1352]     # texts whose pairs the join once left apart
    docs = []
    for t in lost:
        w = [f"l{t}w{k}" for k in range(45)]
        docs += [(2 * t, " ".join(w[:37])), (2 * t + 1, " ".join(w))]
    assert rows(jaccard_join.near_duplicates(frame(spark, docs))) == sorted(((i, 33 if i % 2 == 0 else 41, i - i % 2) for i, _ in docs), key=str)


def test_jaccard_null_ids_and_empty_table(spark):
    text = "a b c d e f"
    got = rows(jaccard_join.near_duplicates(frame(spark, [(None, text), (5, text), (5, text), (9, None)])))
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (9, 0, 9)], key=str)
    assert rows(jaccard_join.near_duplicates(frame(spark, []))) == []


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "short item"), (3, None), (4, "!!"),
         (5, "one two three four five six seven eight nine ten"), (2, "short item"), (None, "nameless words here")]


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(str(i) if i is not None else "null", t) for i, t in ITEMS]
    docs = [(1, "x THE quick, brown-fox jumps over the lazy dog again! y"), (2, "a short item, short; item short"), (3, None), (4, ""),
            (5, "one two three four five six seven eight nine"), (6, "0 one two three four five six seven eight nine ten 11"), (7, "ten " * 5000),
            (None, "nameless words here"), (6, "short item")]
    bench = spark.createDataFrame([(i, t, "q") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    assert rows(decontaminate.report(decontaminate.find(frame(spark, docs), bench))) == brute.contaminated(docs, items)


def test_decontamination_without_items_or_rows(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(decontaminate.report(decontaminate.find(frame(spark, [(1, "a b")]), bench))) == brute.contaminated([(1, "a b")], [])
    full = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert rows(decontaminate.report(decontaminate.find(frame(spark, []), full))) == []


def test_proximity_finds_what_phrases_miss(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string")
    docs = frame(spark, [(1, "alpha beta gamma xx delta epsilon zeta eta theta iota kappa"), (2, "kappa alpha nothing else"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa")])
    exact = {r.doc_id for r in decontaminate.find(docs, bench).where("size(items) > 0").collect()}
    near = {r.doc_id for r in decontaminate.find(docs, bench, slop=2, anchors=4).where("size(items) > 0").collect()}
    assert exact == {3} and near == {1, 3}


SECRETS = [None, "", 'password: "abc"', 'Api_Key="abcdef12" token=short1', "AKIA" + "A1" * 8 + " AKIAX", "deadbeef" * 3 + " " + "abc" * 7,
           "é" * 5 + 'SECRET = zzzzzz9 ' + "0123456789abcdef" * 2, "toKen = abcdefgh", "token=" + "a" * 40 + "f" * 30, "passwd" * 2000 + ":abcdefg"]


def test_secret_spans(spark):
    docs = list(enumerate(SECRETS)) + [(3, SECRETS[3]), (None, SECRETS[3])]
    got = rows(secret_scan.secret_scan(frame(spark, docs)))
    assert got == sorted(((i, *brute.secrets(t)) for i, t in docs), key=str)
    assert rows(secret_scan.secret_scan(frame(spark, []))) == []


def test_weak_secrets_need_their_complements(spark):
    token = "Zx9+kLm2/QwErTy8+uIoP3"
    linked = f"id ASIAABCD1234\nkey {token}\nat https://api.example.com:443 end"
    docs = [(1, linked), (2, f"key {token} alone"), (3, f"ASIAABCD1234 {token}"), (4, f"ASIAABCD1234\n\n{token}\n\nhttps://api.example.com"),
            (5, "ASIAABCD1234 " + "x " * 300 + token + " https://api.example.com"), (6, linked)]
    got = {r[0]: r[-1] for r in rows(secret_scan.secret_scan(frame(spark, docs)))}
    at = linked.index(token)
    assert got == {1: f"linked:{at}:{at + len(token)}", 2: "", 3: "", 4: "", 5: "", 6: f"linked:{at}:{at + len(token)}"}


def test_weak_secrets_with_strong_ones_and_long_tokens(spark):
    token, hexes = "Zx9+kLm2/QwErTy8+uIoP3", "0123456789abcdef" * 2
    long = token * 12                                    # 264 characters
    texts = [f"ASIAABCD1234 {token} token=abcdef123", f"ASIAABCD1234 {token} {hexes}", "ASIAABCD1234 secret: abcdef123", f"{token} token=abcdef123", f"{token} https://a.example.com {hexes}",
             f"ASIAABCD1234 {long} https://a.example.com", f"ASIAABCD1234\n\n{hexes}", "token=ASIAABCD1234 x", f"AKIA{'A1' * 8} {hexes}"]
    got = {r[0]: [x for x in r[-1].split(",") if x.startswith("linked")] for r in rows(secret_scan.secret_scan(frame(spark, list(enumerate(texts)))))}
    both = ["linked:0:12", f"linked:13:{13 + len(token)}"]
    assert got == {0: both, 1: both, 2: ["linked:0:12"], 3: [], 4: [], 5: [f"linked:13:{13 + len(long)}"], 6: [], 7: [], 8: []}


def test_redaction(spark):
    token = "Zx9+kLm2/QwErTy8+uIoP3"
    docs = spark.createDataFrame([(1, "x token=abcdef123 y", 19), (2, None, 0), (3, f"ASIAABCD1234 {token} https://a.example.com", 1)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact(docs, ("doc_id", "text", "n_chars")).collect()}
    assert got == {1: ("x [assign] y", 12), 2: (None, None), 3: ("ASIAABCD1234 [linked] https://a.example.com", 43)}


def test_statistics_and_base_rule(spark):
    docs = passages(seed=21) + [(300, "a b c\n\na b c\n \na b c"), (301, "### |x| <y>\n### |x| <y>"), (302, "é é é é")]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.apply(frame(spark, docs), labels).collect()}
    for i, t in docs:
        s = brute.statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert tuple(got[i][c] for c in quality_rules.BASE) == s, i
        assert (got[i].base_failed, got[i].kept) == (failed, not failed)
    assert rows(quality_rules.apply(frame(spark, []), labels)) == []


def test_rules_are_learned_and_emitted_in_order(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        docs.append((i, " ".join(f"w{r.randrange(5000)}" + ("***" if bad else "") for _ in range(80))))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (5, None, 0), (7, 1, 1)]
    out = quality_rules.apply(frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {x.doc_id: (x.base_failed, x.kept) for x in out.collect()}
    assert all(got[i] == (False, i % 4 != 0) for i in range(240))
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_clusters_of_prose_stay_small(spark):
    """Unrelated texts of few words, as prose has them: thin blocks must not chain them into one candidate cluster."""
    r = random.Random(17)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(12, 120)))) for i in range(1500)]
    docs += [(2000 + i, docs[i][1] + " end") for i in range(0, 1500, 50)]
    table = frame(spark, docs)
    clusters = jaccard_join.candidate_clusters(table, np.full((1 << jaccard_join.KEEP_BITS) // 8, 255, dtype=np.uint8), "text", "doc_id")
    largest = clusters.groupBy("cluster").count().agg({"count": "max"}).first()[0]
    assert 2 <= largest <= 20
    assert rows(jaccard_join.near_duplicates(table)) == sorted(brute.near(docs), key=str)
