"""Stacking against a local solve, on flat, boundary and impossible cases."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import stacking


def local(p, w=None, rounds=200_000):
    w = np.ones(len(p)) if w is None else w
    s = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        new = (w[:, None] * s * p / (p @ s)[:, None]).sum(axis=0) / w.sum()
        if np.abs(new - s).max() < 1e-14:
            break
        s = new
    return s


def solved(spark, logs, w=None, **more):
    names = [f"f{i}" for i in range(logs.shape[1])]
    rows = [(*map(float, r), float(x)) for r, x in zip(logs, np.ones(len(logs)) if w is None else w, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "w"])).repartition(3)
    return stacking.stack(df, names, "w", **more).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_local_solve(spark, seed):
    rng = np.random.default_rng(seed)
    logs = rng.normal(0, 1, (400, 3 + seed))
    w = rng.integers(1, 4, 400).astype(float)
    got = solved(spark, logs, w)
    expected = local(np.exp(logs), w)
    assert np.allclose([r.weight for r in got], expected, atol=1e-6) and all(r.converged for r in got) and got[0].rounds < 30
    assert got[0].mean_log_density >= got[0].equal_log_density
    mean = (w * np.log(np.exp(logs) @ [r.weight for r in got])).sum() / w.sum()
    assert abs(got[0].mean_log_density - mean) < 1e-10


def test_boundary_weights_get_there(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(0, 0.1, 300)
    got = solved(spark, np.stack([good, good - 3, good - 5 + rng.normal(0, 0.1, 300)], axis=1))
    assert [r.weight for r in got] == [1.0, 0.0, 0.0] and got[0].converged and got[0].rounds < 20


def test_nearly_equal_models_are_flat_but_end(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 300)
    logs = np.stack([base, base + rng.normal(0, 1e-3, 300)], axis=1)
    got = solved(spark, logs)
    n = [np.log(np.exp(logs) @ [a, 1 - a]).mean() for a in np.linspace(0, 1, 1001)]
    assert got[0].converged and got[0].mean_log_density >= max(n) - 1e-13
    same = solved(spark, np.stack([base, base], axis=1))
    assert [r.weight for r in same] == [0.5, 0.5] and same[0].converged


def test_a_cap_that_is_hit_is_reported(spark):
    rng = np.random.default_rng(5)
    got = solved(spark, rng.normal(0, 1, (100, 3)), rounds=1)
    assert not got[0].converged and got[0].rounds == 1


def test_impossible_rows_zero_weights_and_no_rows(spark):
    inf = float("-inf")
    logs = np.array([[0.0, -1.0], [inf, -0.5], [-0.2, inf], [inf, inf], [0.0, inf]])
    got = solved(spark, logs, [1, 1, 1, 1, 0])
    p = np.exp(logs[:3])
    assert np.allclose([r.weight for r in got], local(p), atol=1e-7) and got[0].converged and got[0].mean_log_density == inf
    empty = solved(spark, np.zeros((0, 2)))
    assert [r.weight for r in empty] == [0.5, 0.5] and empty[0].converged and empty[0].mean_log_density is None
