"""Hard negatives against brute force and SQL, on clustered, flat and awkward vectors."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import negatives, queries
from tessera.llm.sql import SQL

ROWS = "vec_id long, label int, embedding array<float>, key long, score string, slot int"


def made(seed=3, n=900, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(9)] + rng.normal(size=dim) * 0.3
        out.append([i, int(rng.integers(4)), [float(np.float32(x)) for x in v]])
    for i in range(30, 60):
        out[i][2] = out[2][2]  # one vector thirty times
    return [tuple(r) for r in out]


def awkward():
    return [
        (None, 1, [0.5] * 12), (100, None, [0.1] * 12), (200, 2, None), (300, 2, [0.1] * 11 + [None]), (400, 1, [float("nan")] * 12), (500, 1, [float("inf")] * 12),
        (700, 1, [0.4] * 12), (700, 1, [0.4] * 12), (700, 2, [0.2] * 12), (10_000, 0, [0.0] * 12), (10_100, 1, [-3.0] * 12), (20_000, 3, [0.3] * 3), (30_000, 3, []), (40_000, 77, [0.5] * 12), (-100, 2, [0.7] * 12),
    ]


def brute(rows, size=5, top=10):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for b, (j, other, w) in enumerate(good) if b != a]
        for ps, pid, _ in sorted((r for r in scored if r[2] == label), key=order)[:size]:
            found = sorted((r for r in scored if r[2] != label and 30 * ps <= 100 * r[0] <= 90 * ps), key=order)[:top]
            out += [(i, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(found)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS).repartition(3)


def mined(df):
    return sorted(map(tuple, negatives.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    rows = made() + awkward()
    if small:  # many groups, rounds, anchor groups and tiles
        monkeypatch.setattr(negatives, "CELLS", 64 * 12)
        monkeypatch.setattr(negatives, "GROWTH", 3)
        monkeypatch.setattr(negatives, "TILE", 256)
    expected = brute(rows)
    assert len(expected) > 200 and mined(frame(spark, rows)) == expected


def test_query_equals_sql(spark, tmp_path):
    rows = made(seed=5, n=450, dim=8) + [r for r in awkward() if r[2] is None or len(r[2]) == 12]
    frame(spark, rows).select("vec_id", "label", "embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = queries.op11_negatives(spark, str(tmp_path))
    expected = db.execute(SQL["op11_negatives"])
    assert got.columns == [c[0] for c in expected.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_empty_table_and_no_anchor(spark):
    assert mined(frame(spark, [])) == [] and mined(frame(spark, [(1, 1, [0.5]), (2, 2, [0.25])])) == []


def test_large_components(spark):
    rng = random.Random(4)
    rows = [(i * 20, i % 3, [rng.uniform(-1e6, 1e6) for _ in range(6)]) for i in range(60)]
    rows = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert mined(frame(spark, [*rows, (5, 1, [1e30] * 6)])) == brute(rows) != []


def test_leading_components_discard_most_pairs():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(3000, 32)) * 300 * 0.7 ** np.arange(32) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]).astype(np.int32)
    energy, axes = np.linalg.eigh(x.T.astype(float) @ x)
    a, b = negatives.Side(x[:40], axes[:, ::-1], [3, 8, 32]), negatives.Side(x, axes[:, ::-1], [3, 8, 32])
    exact = x[:40].astype(np.int64) @ x.T.astype(np.int64)
    low = np.sort(exact, axis=1)[:, -20]
    i, j, score = negatives.survivors(a, b, low, np.full(40, negatives.MOST), np.ones(exact.shape, bool), [3, 8, 32])
    assert (score == exact[i, j]).all() and len(i) == (exact >= low[:, None]).sum()
    first = a.turned[:, :3] @ b.turned[:, :3].T + np.outer(a.rest[0], b.rest[0])
    assert (first >= low[:, None]).mean() < 0.2  # most go after three of 32 components
