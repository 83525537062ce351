"""Periodic runs against brute force, on texts with planted periods and on the awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import arrowtext as at
from tessera.llm import periods, queries

DOCS = "doc_id long, text string, runs long, start string, period int"


def least_period(words):
    return next(p for p in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[p:], strict=False)))


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and least_period(words[i : i + size]) == q:
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def texts():
    rng = random.Random(13)
    out = []
    for _ in range(260):
        words = rng.choices("abcdefgh" if rng.random() < 0.5 else [f"w{i}é" for i in range(60)], k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            unit = rng.choices(["a", "b", "c", "dd"], k=rng.randint(1, 9))
            i = rng.randint(0, len(words))
            words[i:i] = (unit * rng.randint(2, 9))[: rng.randint(3, 60)]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    nested = ("a b " * 4 + "c ") * 6
    return [*out, nested, "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", None, "", " \n ", "one", "ab a b " * 4, out[3], "x y z " * 700, "a " * 3000 + "b " * 3000]


@pytest.fixture(scope="module")
def rows():
    return [(i * 7, t) for i, t in enumerate(texts())] + [(None, "q r " * 9), (None, None), (7, "q r " * 9), (7, "q r " * 9)]


def test_query_equals_brute_force(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([brute(i, t) for i, t in rows], key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10  # some are looped


def test_operator_gives_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "so a b a b a b a b end", 1, "s", 2), (2, "x y", 1, "s", 2)], DOCS)
    one, two = periods.periodic_runs(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(1, 8, 2)] and one.collapsed == "so a b end" and (one.start, one.length, one.period) == (1, 8, 2)
    assert two.runs == [] and two.collapsed == "x y" and two.start is None


def test_empty_table(spark):
    assert periods.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_and_passing_over_change_nothing(monkeypatch):
    rng = random.Random(5)
    words = ["a"] * 900 + rng.choices("ab", k=300) + ["a", "b", "b"] * 200 + rng.choices("abc", k=200) + ["c"] * 40
    expected = brute_runs(words)

    def found():
        code = np.array([zlib.crc32(w.encode()) * 7919 for w in words], np.uint64)
        return [(int(s), int(e - s), int(q)) for s, e, q in periods.find_runs(code, np.array([0, len(words)]), lambda i, j: code[i] == code[j])]

    assert found() == expected
    monkeypatch.setattr(periods, "PAIRS", 500)
    monkeypatch.setattr(periods, "LONG_RUN", 16)
    assert found() == expected


def test_equal_hashes_of_unequal_words_change_nothing():
    words = list("abcabcabcabcdabcabcabcabcaaaaaaab")
    code = np.full(len(words), 3, np.uint64)  # every word collides
    text = np.array([ord(w) for w in words])
    got = [(int(s), int(e - s), int(q)) for s, e, q in periods.find_runs(code, np.array([0, len(words)]), lambda i, j: text[i] == text[j])]
    assert got == brute_runs(words) and len(got) == 3


def test_hashes_of_pieces_equal_those_of_whole_texts(monkeypatch):
    rng = random.Random(2)
    rows = [" ".join("x" * rng.randint(1, 9) + rng.choice("ABc") for _ in range(rng.randint(0, 80))) for _ in range(30)] + ["y" * 3000, "", "Z" * 999 + " " + "q" * 2000, " " * 700]
    buf, off = at.raw(pa.array(rows))
    for lower in (False, True):
        whole = at.word_hashes(buf, off, lower)
        monkeypatch.setattr(at, "BLOCK", 64)
        for a, b in zip(whole, at.word_hashes(buf, off, lower), strict=True):
            assert (a == b).all()
        monkeypatch.setattr(at, "BLOCK", 1 << 20)
