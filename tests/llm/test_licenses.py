"""License rules: the prefilter loses nothing, suppression equals its definition, and the query equals brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import arrowtext as at
from tessera.llm import licenses, queries
from tessera.llm.license_rules import BASE, KINDS

DOCS = "doc_id long, text string, labels string, score int, found string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(doc_id, text):
    words = WORD.findall((text or "").translate(LOWER))
    joined = " ".join(words)
    at_char, places = {}, 0
    for k, w in enumerate(words):
        at_char[places] = k
        places += len(w) + 1
    base = sorted((i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    hits = []
    for number, rule in enumerate(licenses.rules()):  # every rule on every text, without keywords
        for m in re.finditer(r"(?<![^ ])(?:" + rule.source + r")(?![^ ])", joined):
            first = at_char[m.start()]
            hits.append((first, first + m.group().count(" "), rule.priority, number))

    def inside(a, b):  # a is suppressed by b
        longer, same = b[1] - b[0] > a[1] - a[0], b[:2] == a[:2]
        return b[0] <= a[0] and a[1] <= b[1] and (b[2] > a[2] or b[2] == a[2] and (longer or same and b[3] < a[3]))

    kept = [a for a in hits if not any(inside(a, b) for b in hits)]
    sure = {}
    for h in kept:
        rule = licenses.rules()[h[3]]
        sure[rule.label] = max(sure.get(rule.label, 0), KINDS[rule.kind][1])
    score = 1.0
    for label in sorted(sure):
        score *= 1 - sure[label]
    labels = {label for _, label in base}
    return (doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | set(sure))), round(1 - score, 9))


def texts():
    rng = random.Random(12)
    lines = [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT license.", "All rights reserved.",
        "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: MIT", "GNU Lesser General Public License v2.1", "https://www.apache.org/licenses/LICENSE-2.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Redistribution and use in source and binary forms, with or without modification, are permitted", "acc by cc bye", "cc-by", "CC_BY", "cc by cc by", "tous droits réservés",
        "distributed under the terms of the GNU General Public License v2 or any later version", "(c) 2020 Someone. All  Rights\nReserved", "mit dem Rad", "general public", "under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ]
    words = ["license", "the", "of", "Straße", "2", "0", "mit", "under", "version", "ünder", "a\x00b", "İ"]
    out = [" ".join(rng.choice([rng.choice(lines), *rng.choices(words, k=3)]) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    return [*lines, *out, None, "", " \n.", "all rights", "all rights reserved " * 900, "x" * 5000 + " cc by", "filler words here " * 4000 + "cc by"]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(texts())] + [(None, "cc by"), (None, None), (3, "cc by"), (3, "cc by")]


def test_query_equals_brute_force(spark, tmp_path, rows, monkeypatch):
    spark.createDataFrame([(i, t, "l", 1, "f") for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_licenses(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted([(*r[:7], round(r[7], 9)) for r in got.collect()], key=str) == sorted([brute(i, t) for i, t in rows], key=str)


def test_slices_change_nothing(monkeypatch, rows):
    buf, off = at.raw(pa.array([t for _, t in rows if t is not None][:60]))
    whole = licenses.normalised(buf, off)
    gates = licenses.gated(whole[0], whole[1])
    monkeypatch.setattr(licenses, "SLICE", 17)
    again = licenses.normalised(buf, off)
    assert again[0] == whole[0] and (again[1] == whole[1]).all() and (again[2] == whole[2]).all()
    monkeypatch.setattr(licenses, "SLICE", 97)
    assert licenses.gated(whole[0], whole[1]) == gates


@pytest.mark.parametrize("kind", KINDS)
def test_any_match_holds_the_keywords(kind):
    for rule in (r for r in licenses.rules() if r.kind == kind):

        @settings(max_examples=12, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(rule.source.replace("[^ ]+", "[a-z]{1,4}"), re.ASCII), fullmatch=True))
        def holds(text):
            text = text.rstrip("\n").encode()
            assert rule.pattern.fullmatch(text) and all(k in text for k in rule.keywords), (rule.label, text)  # noqa: B023

        holds()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), st.integers(1, 3), st.integers(0, 5)), unique=True, max_size=25))
def test_suppression_is_its_definition(spans):
    d = [(a, a + n, p, r) for a, n, p, r in spans]
    d = list(dict.fromkeys(d))

    def inside(x, y):
        return y[0] <= x[0] and x[1] <= y[1] and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[:2] == x[:2] and y[3] < x[3]))

    cols = [np.array([x[k] for x in d], np.int64) for k in range(4)]
    assert sorted(licenses.unsuppressed(*cols).tolist()) == [k for k, x in enumerate(d) if not any(inside(x, y) for y in d)]


def test_rules_are_many_and_ordered():
    book = licenses.rules()
    assert len(book) > 250 and {r.kind for r in book} == set(KINDS) and [r.label for r in book[-3:]] == list(BASE.values())


def test_operator_gives_detections_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "So: licensed under the GNU General Public License, version 3, ok", "l", 1, "f")], DOCS)
    row = licenses.license_scan(docs).first()
    assert [tuple(f) for f in row.found] == [("gpl-3.0", "notice", 1, 9)] and row.base_labels == ["gpl"] and row.labels == ["gpl", "gpl-3.0"] and row.score == pytest.approx(0.9)
    assert licenses.license_scan(docs.limit(0)).count() == 0
