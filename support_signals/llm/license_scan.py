"""Operator 3: license scans with a trained paragraph classifier, in DataFrame and SQL functions only.

Lines are joined to paragraphs up to a blank line.  Each line of a paragraph, each two lines in a row and the whole
paragraph are classified, so that neither a statement wrapped over lines nor one among others is missed; two lines or the
whole count only where no smaller part states the same family.  Features are the distinct word n-grams (one to three
words, lower case) that are in the model's vocabulary.  A multinomial logistic regression on these sparse indicators gives the probability of each
licence family and of *unknown*; a family counts when its probability reaches a bound that is calibrated on paragraphs
the fit has not seen (the smallest bound at which no unknown one passes).  The best matching template of that family then
confirms the prediction: of the template's own n-grams the paragraph must have a share of ``CONFIRM``, however long it is.

Only lines, pairs and paragraphs that can be a finding are scored: a family reaches the bound only if the weights of its
n-grams, each less that of unknown, make up for unknown's larger intercept.  So they need a *gate* word (all n-grams made of
other words stay below that for every family, see ``gate_words``), and their words must be able to reach it (every n-gram
stands under its rarest word, see ``word_lifts``; for a line, a pair or a whole paragraph, words that speak for unknown count
against it, see ``word_balance``).  These tests are in the row, before any n-gram is built, and only n-grams of the vocabulary
leave the row.
Training takes the templates, cut and framed in a few fixed ways, and as unknown fixed near misses next to corpus lines
that no template resembles: at most ``BACKGROUND`` with a word on licences and as many of any kind.  A fold holds whole
sentences, with all their frames.  Their n-grams (some two thousand short rows, whatever the corpus holds) come to the driver,
where the regression is fitted.  Scoring covers all lines and paragraphs of all rows: the weights are a small table (vocabulary
times families, independent of the data) that is broadcast, and only paragraphs with a gate word are shuffled.

Defined results: null and empty texts and empty lines have no finding; ``paragraph`` is the number of the
line, or of the first of the lines, from 0; a line repeated in a text is reported at each place; rows are told apart by their position, so repeated rows give repeated findings; ties go to the family first in
order of name; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
CONFIRM = 0.5
BACKGROUND = 400
FOLDS = 3
FIRST_BITS = 1 << 14
LEAST_ROWS = 3          # training rows that an n-gram of the vocabulary is in
AGAINST = 100           # words that speak for unknown only, of those that the test in the row counts

#: Statements and opening paragraphs of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD License",
        "Licensed under the 3-clause BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC0": (
        "Released under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal",
        "Dedicated to the public domain",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "For more information, please refer to unlicense.org",
    ),
    "proprietary": (
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this work may be reproduced without the prior written permission of the copyright holder.",
    ),
}

#: Sentences with marker words that state no licence.
NEAR_MISSES = (
    "She renewed her driving license at the town office", "The license plate of the car was missing",
    "The restaurant lost its license to serve alcohol", "A fishing license is needed at the lake",
    "The photographer kept the copyright of the pictures", "Copyright law protects books and music",
    "The warranty of the washing machine ends in May", "The software was released in spring",
    "The public library is open to the general public", "The version of the story differs from the first",
    "He was given permission to leave", "Distribution of the leaflets starts on Monday",
    "The apache helicopter landed", "Students at MIT wrote the paper", "The creative class and the commons",
    "The terms of the agreement were kept secret", "Source and binary stars are far away", "The licence fee for the radio was raised",
    "Er kam mit dem Zug aus der Stadt", "Wir gehen mit den Kindern in die Schule", "Das Haus mit dem Garten", "mit der Bahn", "Please send a cc of the mail to the office",
)

#: Short statements as people write them, by family.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache-2.0", "Apache 2.0 licensed", "Distributed under Apache License 2.0", "Available under the Apache 2 license", "Sublicensed under Apache-2.0"),
    "MIT": ("MIT-licensed", "MIT licensed code", "Distributed under the MIT license", "Available under MIT", "Redistributed under the MIT terms", "Sublicensed under MIT"),
    "GPL": ("GPLv3", "GPLv2", "GPL-2.0-only", "GPL-3.0-only", "Distributed under GPLv3", "Available under the GPL, version 2", "GPL licensed", "Redistributed under the GPL"),
    "LGPL": ("LGPLv3", "LGPL-2.1-only", "LGPL-3.0-only", "Distributed under LGPLv3", "Available under the LGPL", "LGPL licensed"),
    "AGPL": ("AGPLv3", "AGPL-3.0-only", "Distributed under AGPLv3", "Available under the AGPL", "AGPL licensed"),
    "BSD": ("BSD-3-Clause", "BSD-2-Clause", "BSD licensed", "Distributed under the BSD license", "Available under BSD-3-Clause", "Redistributed under BSD-2-Clause"),
    "MPL": ("MPL-2.0", "MPLv2", "Distributed under MPL-2.0", "Available under the MPL", "Subject to the Mozilla Public License", "MPL licensed"),
    "ISC": ("ISC licensed", "Distributed under the ISC license", "Available under ISC"),
    "CC-BY": ("CC BY 4.0", "CC-BY-4.0", "Text available under CC BY 4.0", "Distributed under CC BY 3.0", "Creative Commons Attribution"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Text available under CC BY-SA 4.0", "Distributed under CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Text available under CC BY-NC 4.0", "Distributed under CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial"),
    "CC0": ("CC0-1.0", "CC0 1.0 Universal", "Text available under CC0", "Distributed under CC0"),
    "Unlicense": ("The Unlicense", "Released under the Unlicense", "Distributed under The Unlicense"),
    "proprietary": ("Proprietary and confidential", "Proprietary software"),
}

PROSE = ("It was a long day and the people of the town had come to see what there was to see, for many of them had not been here in years, "
         "and some said that they would stay until the end of the week")
FRAMES = ("{}", "{}.", "Note: {}", "{} - see below", "This file: {}.", "the text {} and more of it", PROSE + ". {}. " + PROSE)
#: Half of the corpus background are lines with one of these words; the scan does not use them.
ABOUT = tuple("license licensed licence licenced licensing licenses unlicense spdx copyright copyrighted redistribution redistributions redistribute "
              "permission apache gnu gpl lgpl agpl domain reserved reproduced confidential".split())
#: Every such word holds one of these.
STEMS = ("licen", "spdx", "copyright", "redistribut", "permission", "apache", "gnu", "gpl", "domain", "reserved", "reproduced", "confidential")
#: Lower-case words: letters, or numbers with their dots; a version sign before a digit is a word of its own ("gplv3").
WORD = r"[a-z][a-uw-z]*+(?:v(?![0-9])[a-uw-z]*+)*+|[0-9]++(?:\.[0-9]++)*+"


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def constant(value: object, kind: str) -> Column:
    """A foldable value of many parts as one small expression: plans with thousands of literals take long to build."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def has_any(words: Column, some: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, constant(some, "array<string>")) if some else F.lit(False)


def may_be_about(line: Column) -> Column:
    low = F.lower(line)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in STEMS))


def grams(words: Column) -> Column:
    """Distinct n-grams of one to three words."""
    def of(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, found).otherwise(F.expr("CAST(array() AS array<string>)"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def grams_near(words: Column, bits: tuple[int, ...]) -> Column:
    """Distinct n-grams that begin with a word whose hash has its bit set (64 bits a number); those of the vocabulary do."""
    flags, size = F.array(*map(F.lit, bits)), F.size(words)

    def set_at(i: Column) -> Column:
        h = F.pmod(F.xxhash64(F.element_at(words, i)), F.lit(64 * len(bits)))
        return F.getbit(F.element_at(flags, F.floor(h / 64).cast("int") + 1), F.pmod(h, F.lit(64)).cast("int")) == 1

    at = F.when(size > 0, F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), set_at)).otherwise(F.expr("CAST(array() AS array<int>)"))

    def of(n: int) -> Column:
        return F.transform(F.filter(at, lambda i: i + (n - 1) <= size), lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]      # by class number
    intercepts: tuple[float, ...]
    weights: DataFrame             # gram, w (one weight per class)
    templates: DataFrame           # gram, ids of the templates that have it
    sizes: DataFrame               # family, its templates as (id, number of n-grams)
    bound: float
    gate: tuple[str, ...]          # every paragraph that can be a finding has one of these words
    lifts: dict[str, tuple[float, ...]]     # per word the most that the n-grams standing under it speak for each class
    balance: dict[str, tuple[float, ...]]   # the same, less what the words themselves speak against each class
    need: tuple[float, ...]        # what a class has to reach
    vocabulary: tuple[str, ...]    # the n-grams that have weights
    first: tuple[int, ...]         # bits of the hashes of the words that those begin with


def training_table(spark: SparkSession, paragraphs: DataFrame | None, background: int = BACKGROUND) -> DataFrame:
    """(family, line, fold, corpus): framed and cut templates, near misses and corpus lines, with a word on licences and any.

    All frames and cuts of a sentence are in one fold, so a fold left out holds sentences that the fit has not seen."""
    rows = []
    for family, lines in TEMPLATES.items():
        for j, line in enumerate(lines + NAMES[family]):
            w = line.split()
            cuts = [line] + ([" ".join(w[:len(w) * 2 // 3]), " ".join(w[len(w) // 4:])] if len(w) > 12 else [])
            rows += [(family, f.format(c.rstrip(".")), j % FOLDS, False) for c in cuts for f in FRAMES]
    rows += [(UNKNOWN, f.format(line), j % FOLDS, False) for j, line in enumerate(NEAR_MISSES) for f in FRAMES]
    out = spark.createDataFrame(rows, "family string, line string, fold int, corpus boolean")
    if paragraphs is not None:
        lines = paragraphs.select("line").where(F.length("line") > 20)
        about = has_any(words_of(F.col("line")), ABOUT)
        for some in (lines.where(may_be_about(F.col("line"))).where(about), lines):
            some = some.orderBy(F.xxhash64("line"), "line").limit(background)
            out = out.unionByName(some.select(F.lit(UNKNOWN).alias("family"), "line", F.pmod(F.xxhash64("line"), F.lit(FOLDS)).cast("int").alias("fold"), F.lit(True).alias("corpus")))
    return out


def regression(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1e-3, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts of a softmax regression, by full-batch Adam steps."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        p = probabilities(x, w, b) - target
        for value, grad, k in ((w, x.T @ p / len(y) + penalty * w, 0), (b, p.mean(axis=0), 2)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * grad * grad
            value -= rate * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 1] / (1 - 0.99**t)) + 1e-8)
    return w, b


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = x @ w + b
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gate_words(vocabulary: list[str], w: np.ndarray, b: np.ndarray, unknown: int, bound: float, common: Counter) -> tuple[str, ...]:
    """Words of which a paragraph needs one to reach the bound.

    A family's probability reaches it only if its score exceeds that of unknown by log(bound / (1 - bound)).  Words leave
    the gate, those that corpus lines have most often first, as long as the n-grams of the words outside cannot
    lift any family that far, even if a paragraph had all that favour it and none that speak against it."""
    need = b[unknown] - b + np.log(bound / (1 - bound)) - 1e-6
    lift = np.maximum(w - w[:, [unknown]], 0)
    need[unknown] = np.inf
    words = [g.split() for g in vocabulary]
    at: dict[str, list[int]] = {}
    for k, ws in enumerate(words):
        for x in set(ws):
            at.setdefault(x, []).append(k)
    left, total, gate = np.array([len(set(ws)) for ws in words]), np.zeros(len(b)), []
    for x in sorted(at, key=lambda x: (-common[x], x)):
        rows = np.array(at[x])
        more = total + lift[rows[left[rows] == 1]].sum(axis=0)
        if (more < need).all():
            total = more
            left[rows] -= 1
        else:
            gate.append(x)
    return tuple(sorted(gate))


def word_lifts(vocabulary: list[str], w: np.ndarray, b: np.ndarray, unknown: int, bound: float, common: Counter) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]]:
    """(lifts, need): a paragraph can be a finding only if the lifts of its distinct words add up to ``need`` for a class.

    Every n-gram stands under its word that the corpus lines have least often.  A paragraph with the n-gram has that word,
    so the sum over words is at least the sum over n-grams of what speaks for the class more than for unknown."""
    need = b[unknown] - b + np.log(bound / (1 - bound)) - 1e-6
    need[unknown] = np.inf
    lift = np.maximum(w - w[:, [unknown]], 0)
    out: dict[str, np.ndarray] = {}
    for k, g in enumerate(vocabulary):
        word = min(g.split(), key=lambda x: (common[x], x))
        out[word] = out.get(word, 0) + lift[k]
    return {x: tuple(v.tolist()) for x, v in out.items() if v.any()}, tuple(need.tolist())


def word_balance(vocabulary: list[str], w: np.ndarray, unknown: int, lifts: dict[str, tuple[float, ...]], against: int = AGAINST) -> dict[str, tuple[float, ...]]:
    """Lifts in which a word of the vocabulary counts with its own weight less that of unknown, also where that is negative.

    The words of a text are known, so this is still at least what its n-grams speak for a class.  Words without a lift are
    all against every class: ``against`` of them are listed, those that are so most, as leaving some out only raises the sum.
    A part of a text can reach more than the whole."""
    own = {g: w[k] - w[k, unknown] for k, g in enumerate(vocabulary) if " " not in g}
    out = {x: tuple((np.array(v) + np.minimum(own.get(x, 0), 0)).tolist()) for x, v in lifts.items()}
    rest = sorted((np.delete(v, unknown).max(), g) for g, v in own.items() if g not in lifts)
    return out | {g: tuple(own[g].tolist()) for _, g in rest[:against]}


def first_bits(spark: SparkSession, vocabulary: list[str]) -> tuple[int, ...]:
    words = spark.createDataFrame([(x,) for x in sorted({g.split()[0] for g in vocabulary})], "word string")
    bits = [0] * (FIRST_BITS // 64)
    for row in words.select(F.pmod(F.xxhash64("word"), F.lit(FIRST_BITS)).alias("h")).collect():
        bits[row["h"] // 64] |= 1 << row["h"] % 64
    return tuple(b - 2**64 if b >= 2**63 else b for b in bits)


def can_reach(words: Column, lifts: dict[str, tuple[float, ...]], need: tuple[float, ...]) -> Column:
    """Whether the words' lifts reach what some class needs."""
    table = constant(lifts, "map<string,array<double>>")
    least = constant([min(x, 1e300) for x in need], "array<double>")     # JSON has no infinity
    zero = F.array_repeat(F.lit(0.0), len(need))
    total = F.aggregate(F.array_intersect(words, F.map_keys(table)), zero, lambda a, x: F.zip_with(a, table[x], lambda p, q: p + q))
    return F.exists(F.zip_with(total, least, lambda p, q: p >= q), lambda x: x)


def fit(spark: SparkSession, background: DataFrame | None = None) -> Model:
    """Trains on all folds after calibrating the bound on each fold left out."""
    rows = training_table(spark, background).select("family", "fold", "corpus", grams(words_of(F.col("line"))).alias("grams")).collect()
    listed = [set(r["grams"]) for r in spark.createDataFrame([(x,) for f in TEMPLATES for x in TEMPLATES[f] + NAMES[f]], "line string")
              .select(grams(words_of(F.col("line"))).alias("grams")).collect()]
    # a corpus line that a template resembles may state a licence
    rows = [r for r in rows if not r["corpus"] or all(len(t.intersection(r["grams"])) < CONFIRM * len(t) for t in listed)]
    families = tuple(sorted([*TEMPLATES, UNKNOWN]))
    seen = Counter(g for r in rows for g in r["grams"])
    vocabulary = sorted(g for g, n in seen.items() if n >= LEAST_ROWS)
    number = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, r in enumerate(rows):
        x[i, [number[g] for g in r["grams"] if g in number]] = 1
    y = np.array([families.index(r["family"]) for r in rows])
    unknown, fold, bound = families.index(UNKNOWN), np.array([r["fold"] for r in rows]), 0.5
    for f in range(FOLDS):
        out = fold == f
        p = probabilities(x[out], *regression(x[~out], y[~out], len(families)))
        wrong = (y[out] == unknown) & (p.argmax(axis=1) != unknown)
        bound = max([bound, *(p[wrong].max(axis=1) + 1e-6)])
    w, b = regression(x, y, len(families))
    if b.argmax() != unknown:
        b[unknown] = b.max() + 1e-9           # a paragraph without a known n-gram is unknown
    common = Counter(g for r in rows if r["corpus"] for g in r["grams"])
    if not common:
        common = Counter(g for r in rows if r["family"] == UNKNOWN for g in r["grams"])
    lifts, need = word_lifts(vocabulary, w, b, unknown, bound, common)
    balance = word_balance(vocabulary, w, unknown, lifts)
    gate = gate_words(vocabulary, w, b, unknown, bound, common)
    weights = spark.createDataFrame([(g, w[k].tolist()) for k, g in enumerate(vocabulary)], "gram string, w array<double>")
    lines = [(f, line) for f in families if f != UNKNOWN for line in TEMPLATES[f] + NAMES[f]]
    listed = (spark.createDataFrame([(i, f, line) for i, (f, line) in enumerate(lines)], "id int, family string, line string")
              .select("id", "family", grams(words_of(F.col("line"))).alias("grams")))
    templates = listed.select("id", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sizes = listed.groupBy("family").agg(F.collect_list(F.struct("id", F.size("grams").alias("n"))).alias("its"))
    return Model(families, tuple(b.tolist()), weights, templates, sizes, float(bound), gate, lifts, balance, need, tuple(vocabulary), first_bits(spark, vocabulary))


def paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, row, paragraph, line): the lines of every text, counted from 0; ``row`` tells rows apart."""
    return (docs.select(F.col(key), F.monotonically_increasing_id().alias("row"), F.col(text).alias("_text"))
            .select(key, "row", F.posexplode(F.split("_text", "\n")).alias("paragraph", "line")))


def blocks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, row, start, lines): the words of the lines between blank lines, and the number of the first of them."""
    texts = (docs.select(F.col(key), F.monotonically_increasing_id().alias("row"), F.col(text).alias("_text"))
             .select(key, "row", F.split("_text", "\n").alias("_lines")))
    blank = F.filter(F.transform("_lines", lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) == "", i)), lambda i: i.isNotNull())
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(blank, lambda i: i + 1)).alias("a"), F.concat(blank, F.array(F.size("_lines"))).alias("z"))
    found = F.transform(F.filter(spans, lambda s: s["z"] > s["a"]), lambda s: F.struct(
        s["a"].alias("start"), F.transform(F.slice("_lines", s["a"] + 1, s["z"] - s["a"]), words_of).alias("lines")))
    return texts.select(key, "row", F.explode(found).alias("b")).select(key, "row", "b.*")


LINE, PAIR, WHOLE = 0, 1, 2


def units(found: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, row, start, paragraph, kind, whole, words): the lines, pairs of lines and whole paragraphs with a gate word whose
    words can reach the bound; with a part of a paragraph the whole is among them."""
    n, none = F.size("lines"), F.expr("CAST(NULL AS array<array<string>>)")

    def unit(at: Column, kind: int, whole: Column, words: Column, parts: Column = none) -> Column:
        return F.struct((F.col("start") + at).alias("paragraph"), F.lit(kind).alias("kind"), whole.alias("whole"), words.alias("words"), parts.alias("parts"))

    def may_be(words: Column) -> Column:
        return has_any(words, model.gate) & can_reach(words, model.balance, model.need)

    every = F.concat(
        F.transform("lines", lambda w, i: unit(i, LINE, n == 1, w)),
        F.when(n > 2, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: unit(i, PAIR, F.lit(False), F.flatten(F.slice("lines", i + 1, 2)))))
        .otherwise(F.array()),
        F.when(n > 1, F.array(unit(F.lit(0), WHOLE, F.lit(True), F.flatten("lines"), F.col("lines")))).otherwise(F.array()))
    # what the whole paragraph cannot reach by its lifts, no part of it can
    whole = F.flatten("lines")
    pairs = F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))
    part = F.exists("parts", may_be) | F.exists(pairs, lambda i: may_be(F.flatten(F.slice("parts", i, 2))))
    return (found.where(has_any(whole, model.gate)).where(can_reach(whole, model.lifts, model.need)).select(key, "row", "start", F.explode(every).alias("u"))
            .select(key, "row", "start", "u.*").where(may_be(F.col("words")) | ((F.col("kind") == WHOLE) & part)).drop("parts"))


def license_scan(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id", confirm: float = CONFIRM) -> DataFrame:
    """Findings: key, paragraph, family, probability, template_share, confirmed."""
    spark = docs.sparkSession
    model = model or fit(spark, paragraphs(docs, text, key))
    block, place = [key, "row", "start"], ["paragraph", "kind", "whole"]
    # the join keeps the n-grams of the vocabulary, in the task
    known = grams_near(F.col("words"), model.first)
    hit = (units(blocks(docs, text, key), model, key).select(*block, *place, F.explode(known).alias("gram"))
           .join(F.broadcast(model.weights), "gram").join(F.broadcast(model.templates), "gram", "left"))
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.families))]
    scored = hit.groupBy(*block, *place).agg(*sums, F.flatten(F.collect_list(F.when(F.col("whole"), F.col("ids")))).alias("ids"))
    logits = F.array(*[F.col(f"s{i}") + F.lit(v) for i, v in enumerate(model.intercepts)])
    top = F.array_max("logits")
    scored = scored.withColumn("logits", logits).withColumn("best", (F.array_position("logits", top) - 1).cast("int"))
    scored = scored.withColumn("probability", 1 / F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logits"))))
    family = F.array(*map(F.lit, model.families))
    found = (scored.withColumn("family", family[F.col("best")])
             .withColumn("ids", F.max(F.when(F.col("whole"), F.col("ids"))).over(Window.partitionBy(*block)))
             .where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.bound)))
    same = Window.partitionBy(*block, "family")
    near = same.orderBy("paragraph")

    def count(kinds: Column, over) -> Column:
        return F.coalesce(F.sum(F.when(kinds, 1).otherwise(0)).over(over), F.lit(0))     # none in an empty frame

    kind = F.col("kind")
    found = (found.withColumn("smaller", F.when(kind == PAIR, count(kind == LINE, near.rangeBetween(0, 1)) + count(kind == PAIR, near.rangeBetween(-1, -1)))
                              .when(kind == WHOLE, count(kind < WHOLE, same)))
             .where((kind == LINE) | (F.coalesce("smaller", F.lit(0)) == 0))
             .join(F.broadcast(model.sizes), "family"))
    share = F.array_max(F.transform("its", lambda t: F.size(F.filter("ids", lambda i: i == t["id"])) / t["n"]))
    found = found.withColumn("template_share", share)
    return found.select(key, "paragraph", "family", F.round("probability", 6).alias("probability"),
                        F.round("template_share", 6).alias("template_share"), (F.col("template_share") >= confirm).alias("confirmed"))
