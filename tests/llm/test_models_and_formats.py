"""Operators held against the public libraries, held-out rows or exact round trips, and the pipeline."""

import gzip
import hashlib
import os
import random
import zlib
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from support_signals.llm import bpe, components, license_scan, quality_nbsvm, queries, token_count, warc_derive

from . import brute

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [None, "", " ", "\n\n", "Hello, WORLD's 12 a1b2!", "<|startoftext|>a<|endoftext|>", "<s> </s> <unk>", "ΑΣ ΟΔΟΣ", "İstanbul ß ﬁ", "漢字かな 😀‍👩",
       "a\x1cb\x85c d　e", "é é", "▁▁ ▁a", "aaaa" * 40, "x " * 9000, "tab\tand\r\nline", "don't we'll I'd", "ᲉꟋ\U00010d50", "##a $$ %% ..."]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, ids string, n_tokens int")


@pytest.fixture(scope="module")
def encoder():
    raw = queries.vocabulary("word_bpe_49k.json")
    return bpe.Bpe(raw), Tokenizer.from_str(raw.decode())


def test_bpe_encodes_as_the_library(encoder):
    mine, theirs = encoder
    r = random.Random(4)
    alphabet = "aeinrstTHE é'.,!1 2\n\tß漢😀<|>_-ıſ́"
    texts = [t or "" for t in ODD] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(500)]
    expect = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert mine.encode(texts) == expect
    assert [mine.decode(x) for x in expect] == [theirs.decode(x, skip_special_tokens=False) for x in expect]


def test_bpe_query_columns(spark, encoder):
    docs = [*enumerate(ODD), (3, ODD[4]), (None, "null id")]
    got = sorted(map(tuple, bpe.encode(frame(spark, docs), queries.vocabulary("word_bpe_49k.json")).collect()), key=str)
    expect = []
    for i, t in docs:
        ids = encoder[1].encode(t or "", add_special_tokens=False).ids
        expect.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(encoder[1].decode(ids, skip_special_tokens=False))))
    assert got == sorted(expect, key=str)


def test_bpe_cache_is_emptied_without_changing_results(spark, monkeypatch, encoder):
    cache = bpe.Cache(encoder[0])
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 5)
    for t in ("a b c d", "e f g h", "a b x y"):
        chunks = encoder[0].chunks(t)
        cache.learn(set(chunks))
        assert cache.texts(chunks)[0] == " ".join(map(str, encoder[1].encode(t, add_special_tokens=False).ids))


def test_token_counts_agree_with_the_library(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(6)
    alphabet = " \n\t▁aeinrtsThé<s>漢😀‍=-_/\\\"'0123"
    docs = [*enumerate(ODD), *((100 + k, "".join(r.choice(alphabet) for _ in range(r.randrange(200)))) for k in range(300)), (None, "null id"), (3, "again")]
    got = sorted(map(tuple, token_count.count_tokens(frame(spark, docs), queries.vocabulary("piece_bpe_32k.model")).collect()), key=str)
    expect = []
    for i, t in docs:
        n = len(lib.encode(t or ""))
        expect.append((i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(expect, key=str)
    assert token_count.count_tokens(frame(spark, []), queries.vocabulary("piece_bpe_32k.model")).collect() == []


def test_whole_tokens_are_proved(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_count.Counter(queries.vocabulary("piece_bpe_32k.model"))
    for piece in random.Random(1).sample(sorted(counter.whole), 400):
        if piece.startswith("▁"):
            assert len(lib.encode(piece[1:].replace("▁", " "))) == 1
    assert all(counter.merge(p) == counter.merge_long(p) for p in ("▁" + "abc" * 50, "hello", "▁▁▁x"))


def test_dual_descent_separates_and_bounds_its_duals():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 40, 12)).astype(np.int32) for _ in range(200)]
    y = np.array([1.0 if (x < 8).sum() >= 2 else -1.0 for x in rows])
    w = quality_nbsvm.dual_descent(rows, y, np.ones(40), c=1.0, passes=200)
    assert np.mean([np.sign(w[x].sum()) == s for x, s in zip(rows, y)]) > 0.9


@needs_data
def test_quality_on_held_out_rows(spark):
    d, l = (spark.read.parquet(f"{SF[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_nbsvm.quality_scores(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() >= 0.95
    clean = got[got.quality == 1]
    assert (clean.predicted == 1).mean() >= 0.98


def test_quality_edge_cases(spark):
    docs = [(i, ("good words here and there " * 5) if i % 3 else ("BAD!! " * 30)) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (5, "good")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (7, None, 0), (8, 9, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_nbsvm.quality_scores(frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[100].score == by[101].score and not by[None].held_out
    assert by[3].predicted == 0 and by[4].predicted == 1
    none = quality_nbsvm.quality_scores(frame(spark, docs), labels.where("1 = 0")).collect()
    assert {r.score for r in none} == {0.5}
    one = quality_nbsvm.quality_scores(frame(spark, docs), labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert quality_nbsvm.quality_scores(frame(spark, []), labels).collect() == []


@pytest.fixture(scope="module")
def licences(spark):
    return license_scan.fit(spark)


def test_licences_of_templates_and_near_misses(spark, licences):
    cases = [(1, "a line\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."),
             (4, "Licensed under the Apache License, Version 2.0."), (5, "The dog license expired"), (6, None), (7, ""), (8, "\n\n"),
             (9, "Released under the MIT License.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (10, "words " * 20000), (None, "Released under the MIT License.")]
    out = license_scan.license_scan(frame(spark, cases), licences)
    got = sorted(((r.doc_id, r.paragraph, r.family, r.confirmed) for r in out.collect()), key=str)
    assert got == sorted([(1, 1, "MIT", True), (2, 0, "CC-BY-NC", True), (2, 0, "CC-BY-NC", True), (3, 0, "GPL", True), (4, 0, "Apache-2.0", True),
                          (9, 0, "MIT", True), (9, 1, "MIT", True), (None, 0, "MIT", True)], key=str)
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))
    assert license_scan.license_scan(frame(spark, []), licences).collect() == []


def test_licences_in_words_without_a_template(spark, licences):
    cases = [("GPL", "Distributed under GPLv3"), ("GPL", "GPL-2.0-only"), ("LGPL", "LGPLv3"), ("MPL", "MPL-2.0"), ("BSD", "BSD-3-Clause"), ("CC-BY-SA", "Text available under CC BY-SA 4.0"),
             ("MIT", "MIT-licensed"), ("Apache-2.0", "sublicensed under the Apache License"), ("BSD", "Redistributed under the terms of the BSD license"),
             ("MIT", "to any person obtaining a copy of this software and associated documentation files"), ("GPL", "You can use this package freely under the GPL v2"),
             ("GPL", "This module is free software: GNU GPL version 2 applies"), (None, "Students at MIT wrote"), (None, "Er kam mit dem Zug")]
    got = {r.doc_id: r.family for r in license_scan.license_scan(frame(spark, [(i, t) for i, (_, t) in enumerate(cases)]), licences).collect()}
    assert [got.get(i) for i in range(len(cases))] == [f for f, _ in cases]


def test_licences_in_long_and_wrapped_lines(spark, licences):
    prose = " ".join(f"word{k % 37} and some of the other things" for k in range(20))
    cases = [(1, f"{prose} Released under the MIT License. {prose}"), (2, "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files"),
             (3, "first\n\nThis package is under the Mozilla\nPublic License, v. 2.0\n \nlast"), (4, f"{prose}\nit is under CC\nBY-SA 4.0\n{prose}"),
             (5, f"{prose}\n{prose}\n\n{prose}"), (6, "a\n\n\nReleased under the MIT License.\nand\n\nLicensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in license_scan.license_scan(frame(spark, cases), licences).collect()}
    assert {(i, f) for i, _, f, c in got if c} == {(1, "MIT"), (2, "MIT"), (3, "MPL"), (4, "CC-BY-SA"), (6, "MIT"), (6, "CC-BY-NC")}
    assert {x[:3] for x in got if x[0] in (1, 4, 6)} == {(1, 0, "MIT"), (4, 2, "CC-BY-SA"), (6, 3, "MIT"), (6, 6, "CC-BY-NC")}


def test_licence_folds_hold_whole_sentences_and_the_background_lines_with_marker_words(spark):
    odd = ["The rooms are reserved for guests of the domain", "a plain line of the corpus without such words", "Distributed under the terms of GPLv3 for everyone"]
    lines = spark.createDataFrame([(x,) for x in odd], "line string")
    rows = license_scan.training_table(spark, lines).collect()
    fold = {}
    for r in rows:
        for x in license_scan.NEAR_MISSES:
            if x.rstrip(".") in r.line:
                fold.setdefault(x, set()).add(r.fold)
    assert all(len(f) == 1 for f in fold.values()) and {f for x in fold.values() for f in x} == {0, 1, 2}
    assert {x for x in odd if any(r.line == x and r.family == license_scan.UNKNOWN for r in rows)} == set(odd)
    model = license_scan.fit(spark, lines)              # there the line that a template resembles is left out
    got = {r.doc_id: r.family for r in license_scan.license_scan(frame(spark, list(enumerate(odd))), model).collect()}
    assert got == {2: "GPL"}


def test_licence_gate_keeps_every_finding(spark, licences):
    r = random.Random(8)
    lines = [x for f in license_scan.TEMPLATES for x in license_scan.TEMPLATES[f] + license_scan.NAMES[f]] + list(license_scan.NEAR_MISSES)
    vocabulary = [x.gram for x in licences.weights.select("gram").collect()]
    texts = ["; ".join(r.sample(vocabulary, r.randrange(1, 30))) for _ in range(300)]
    texts += [" ".join(x.split()[a:a + r.randrange(1, 9)]) for x in lines for a in (0, 2, 5)]
    docs = frame(spark, list(enumerate(texts)))
    every = replace(licences, gate=tuple(sorted({w for g in vocabulary for w in g.split()})))
    found = [sorted(map(tuple, license_scan.license_scan(docs, m).collect())) for m in (licences, every)]
    assert found[0] == found[1] and len(found[0]) > 100 and len(licences.gate) < len(every.gate)


def test_licence_balance_keeps_every_finding_with_fewer_units(spark, licences):
    r = random.Random(9)
    vocabulary = [x.gram for x in licences.weights.select("gram").collect()]
    texts = ["; ".join(r.sample(vocabulary, r.randrange(1, 30))) for _ in range(200)]
    texts += [f"{license_scan.PROSE}\n{a}\n{license_scan.PROSE}\n{b}" for a in license_scan.NEAR_MISSES for b in ("Er kam mit dem Zug", "Released under the MIT License.")]
    docs = frame(spark, list(enumerate(texts)))
    loose = replace(licences, balance=licences.lifts)
    found = [sorted(map(tuple, license_scan.license_scan(docs, m).collect())) for m in (licences, loose)]
    assert found[0] == found[1] and len(found[0]) > 50
    places = [{tuple(x) for x in license_scan.units(license_scan.blocks(docs), m).select("doc_id", "paragraph", "kind").collect()} for m in (licences, loose)]
    assert places[0] < places[1]
    # the whole paragraph comes with every part of it
    assert {x[0] for x in places[0] if x[0] >= 200 and x[2] < license_scan.WHOLE} <= {x[0] for x in places[0] if x[2] == license_scan.WHOLE}


def test_fit_rows_are_views_of_the_collected_table_in_the_order_of_the_hash():
    rows = [(7, 1, np.array([1, 5], np.int32)), (7, 1, np.array([1, 4], np.int32)), (3, 0, np.array([], np.int32)), (12, 0, np.array([9], np.int32))]
    parts = [pa.table({"doc_id": [i for i, _, _ in x], "quality": [q for _, q, _ in x], "row": pa.array([v.tobytes() for _, _, v in x], pa.binary())}) for x in (rows[:2], rows[2:], [])]
    got, quality = quality_nbsvm.fit_table(pa.concat_tables([t.cast(parts[0].schema) for t in parts]))
    want = sorted(rows, key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0], x[2].tobytes()))
    assert [g.tolist() for g in got] == [v.tolist() for _, _, v in want] and quality.tolist() == [q for _, q, _ in want]
    assert all(g.base is not None for g in got)
    assert quality_nbsvm.fit_table(parts[0].slice(0, 0))[0] == []


def test_warc_records_read_back(spark, tmp_path):
    page = "<html lang='en'><head><meta charset=utf-8><title>A &amp; B</title><script>x()</script></head><body><p>one<br>two</p><!-- c --><a href='/l?a=1&amp;b=2'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/x", page, "e"), (2, None, None, "e"), (1, "http://a.example/x", page, "e"), (None, "http://b.example/\r\nEvil: 1", "<p>z", "e"),
                                   (3, "u", "<p>" + "long " * 50000, "e")], "page_id bigint, url string, html string, record_id string")
    rows = warc_derive.derivatives(pages, with_block=True).collect()
    assert len(rows) == 15
    for r in rows:
        ((head, block),) = warc_derive.parse(bytes(r.warc))
        assert block == bytes(r.block) and head["WARC-Record-ID"] == r.record_id and len(r.warc) == r.record_bytes
        assert head["WARC-Block-Digest"] == warc_derive.digest(block) == r.block_digest and head.get("WARC-Refers-To") == r.refers_to
        assert "Evil" not in head
    ids = {(r.page_id, r.record_type): r for r in rows}
    response, meta, text = (ids[1, k] for k in ("response", "metadata", "conversion"))
    assert meta.refers_to == text.refers_to == response.record_id and response.payload_digest == warc_derive.digest(page.encode())
    assert bytes(text.block).decode() == "one\ntwo\nl"
    fields = bytes(meta.block).decode()
    assert "title: A & B\r\n" in fields and "outlink: /l?a=1&b=2\r\n" in fields and f"source-payload-digest: {response.payload_digest}\r\n" in fields
    assert "source-header: Content-Type: text/html\r\n" in fields and ids[2, "conversion"].content_length == 0
    written = warc_derive.write_files(pages, str(tmp_path / "w")).collect()
    assert sum(len(list(warc_derive.parse(gzip.decompress(bytes(r.data))))) for r in written) == 15
    assert warc_derive.derivatives(pages.limit(0)).collect() == []


def test_fit_rows_are_bounded_for_a_repeated_id(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text number {i}") for i in ids] + [(ids[0], f"other words {k}") for k in range(300)]
                                 + [(ids[1], "the same words")] * 300, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    rows, y = quality_nbsvm.training_rows(docs, labels, 50)
    assert len(rows) == len(y) == 50
    few, _ = quality_nbsvm.training_rows(docs.where(f"doc_id <> {ids[0]}"), labels, 1000)
    assert len(few) == len(ids)             # one row per id, and the second text of one of them once


def test_warc_keeps_the_headers_ids_and_digests_of_its_source(spark):
    head = "HTTP/1.1 404 Not Found\r\nServer: x/1\nSet-Cookie: a=b: c\r\n\r\n"
    rows = [(1, "http://a.example/", "<p>gone", head, "<urn:uuid:1>", "sha1:GIVEN"), (2, "http://b.example/", "<p>b", None, " ", None),
            (3, None, None, "", None, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string, warc string, source_0 string")
    got = {(r.page_id, r.record_type): r for r in warc_derive.derivatives(pages, True, "block", "warc", "source_0").collect()}
    assert len(got) == 9
    own = got[1, "response"]
    assert (own.record_id, own.payload_digest) == ("<urn:uuid:1>", "sha1:GIVEN")
    assert bytes(own.block) == b"HTTP/1.1 404 Not Found\r\nServer: x/1\r\nSet-Cookie: a=b: c\r\n\r\n<p>gone"
    fields = bytes(got[1, "metadata"].block).decode().split("\r\n")
    assert [x for x in fields if x.startswith("source-")] == [
        f"source-block-digest: {own.block_digest}", "source-payload-digest: sha1:GIVEN", "source-header: HTTP/1.1 404 Not Found",
        "source-header: Server: x/1", "source-header: Set-Cookie: a=b: c"]
    assert got[1, "conversion"].refers_to == got[1, "metadata"].refers_to == "<urn:uuid:1>"
    plain = {(r.page_id, r.record_type): r for r in warc_derive.derivatives(pages, True).collect()}
    for k in ((2, t) for t in warc_derive.TYPES):
        assert plain[k] == got[k]                   # unknown is the same as not given
    assert plain[3, "metadata"] == got[3, "metadata"] and plain[1, "response"].record_id != "<urn:uuid:1>"


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(1000, k) for k in range(500, 540)] + [(k, k + 1) for k in range(2000, 2040)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_bitmap_has_every_value(spark):
    flags = components.exact_bitmap(spark.createDataFrame([(0,), (5,), (32767,), (32768,), (65535,)], "at bigint"), 16)
    assert np.flatnonzero(components.has_bit(flags, np.arange(1 << 16))).tolist() == [0, 5, 32767, 32768, 65535]
    values = spark.range(2000)
    flags = components.bitmap(values, "id", 14)
    at = [r[0] for r in values.select(components.bit_of(values.id, 14)).collect()]
    assert components.has_bit(flags, np.array(at)).all()


@needs_data
def test_pipeline_against_brute_force(spark):
    """Every stage on its own input: the classifier's verdicts are the operator's, the rest is brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality_nbsvm.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted == 1}
    first = {i for i, _, c in brute.near([(i, rows[i].text) for i in sorted(good)]) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [x[0] for x in brute.contaminated([(i, rows[i].text) for i in sorted(first)], items) if not x[-1]]
    assert good != set(rows) and len(first) < len(good)
    expect = []
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in clean:
        t, out, done = rows[i].text, [], 0
        for kind, s, e in sorted((x.split(":") for x in brute.secrets(t)[-1].split(",") if x), key=lambda x: int(x[1])):
            if int(s) >= done:
                out += [t[done:int(s)], f"[{kind}]"]
            done = max(done, int(e))
        ids = lib.encode("".join([*out, t[done:]]), add_special_tokens=False).ids
        expect.append((i, rows[i].lang, rows[i].source, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(expect)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "decontamination", "secret_scans", "bpe_encoding"]


@needs_data
def test_pipeline_stages_take_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "good text here", "en", "s", 14), (3, "same words " * 20, "en", "s", 220), (3, "same words " * 20, "en", "s", 220)]
    for table in (spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            n = out.count()
            if name != "bpe_encoding":
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert n <= table.count()
