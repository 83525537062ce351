"""Nearest references against all pairs, and how few of the pairs are compared."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import novelty

SCHEMA = "id long, z array<double>"


def clustered(n, dim=6, seed=1, clusters=30):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(0, 20, (clusters, dim))
    return centres[rng.integers(clusters, size=n)] + rng.normal(0, 0.3, (n, dim))


def frame(spark, z, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(z)], SCHEMA).repartition(4)


def truth(x, y, same=False):
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    if same:
        np.fill_diagonal(d, np.inf)
    return d.min(axis=1)


@pytest.mark.parametrize("side", [2048, 32])
def test_equals_all_pairs(spark, monkeypatch, side):
    monkeypatch.setattr(novelty, "SIDE", side)
    refs = np.concatenate([clustered(500), np.random.default_rng(5).normal(0, 30, (40, 6)), clustered(1).repeat(30, axis=0)])
    queries = np.concatenate([clustered(150, seed=2), np.random.default_rng(6).normal(0, 60, (30, 6))])
    r = frame(spark, refs)
    got = {x.id: x.distance for x in novelty.nearest(frame(spark, queries, 10_000), r).collect()}
    assert np.allclose([got[10_000 + i] for i in range(len(queries))], truth(queries, refs), rtol=1e-12, atol=1e-12)
    own = {x.id: x.distance for x in novelty.nearest(r, r, skip_same_id=True).collect()}
    assert np.allclose([own[i] for i in range(len(refs))], truth(refs, refs, True), rtol=1e-12, atol=1e-12)


def test_few_pairs_are_compared_on_clusters(spark):
    refs, queries = clustered(3000), clustered(600, seed=3)
    cells = novelty.Cells(frame(spark, refs))
    assert cells.compared(frame(spark, queries, 10_000)) < 0.1 * 3000 * 600


def test_one_reference_and_none(spark):
    q, one = frame(spark, np.array([[0.0, 3.0], [4.0, 0.0]]), 5), frame(spark, np.array([[0.0, 0.0]]))
    assert sorted(map(tuple, novelty.nearest(q, one).collect())) == [(5, 3.0), (6, 4.0)]
    assert novelty.nearest(one, one, skip_same_id=True).first().distance == float("inf")
    assert novelty.nearest(q, one.limit(0)).first().distance == float("inf")
    assert novelty.nearest(q.limit(0), one).count() == 0


def test_a_query_travels_once_for_a_bundle_of_cells(spark):
    """Vectors without structure reach all cells; their queries were sent to each of them, which filled the executors."""
    rng = np.random.default_rng(7)
    refs, queries = rng.normal(0, 1, (800, 24)), rng.normal(0, 1, (100, 24))
    cells, asking = novelty.Cells(frame(spark, refs)), frame(spark, queries, 10_000)
    assert cells.compared(asking) > 0.5 * 800 * 100
    _, asked = cells.reached(asking)
    assert asked.count() <= 100 * (cells.bundle.max() + 1) <= 200


def test_copies_equal_all_pairs(spark):
    refs = np.concatenate([clustered(5).repeat(60, axis=0), clustered(40, seed=4)])
    r = frame(spark, refs)
    own = {x.id: x.distance for x in novelty.nearest(r, r, skip_same_id=True).collect()}
    assert np.allclose([own[i] for i in range(len(refs))], truth(refs, refs, True), rtol=1e-12, atol=1e-12)
