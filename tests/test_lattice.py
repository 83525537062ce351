"""Certified lattices on known values: failed edges, unavailable cells, tolerance, paths and order averages."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from tessera.operators import lattice


def rows_of(effects, groups=3, blocks=10, seed=1, noise=0.02, k=2):
    """A row for each group and block; the score of a subset is the sum of its blocks' effects, plus noise."""
    rng = random.Random(seed)
    out = []
    for g, b in itertools.product(range(groups), range(blocks)):
        scores = [sum(effects[i][g] for i in range(k) if mask >> i & 1) + rng.gauss(0, noise) for mask in range(1 << k)]
        out.append((g, b, 1.0 + b % 3, *scores))
    return out


def sums(spark, rows, k=2):
    names = [f"n{m}" for m in range(1 << k)]
    return lattice.node_sums(spark.createDataFrame(rows, "g int, b int, w double, " + ", ".join(f"{n} double" for n in names)), "g", "b", "w", names)


def test_positive_and_failed_blocks(spark):
    cells = lattice.certified_cells(sums(spark, rows_of([[0.5] * 3, [-0.4] * 3])), 2, 500, 1).cache()
    edges = {(r.subset_mask, r.added): r for r in lattice.certified_edges(cells).collect()}
    assert {k: r.category for k, r in edges.items()} == {(0, 0): "robust_generalizing", (2, 0): "robust_generalizing", (0, 1): "robust_non_generalizing", (1, 1): "robust_non_generalizing"}
    assert edges[0, 0].n_robust_positive == 3 and edges[0, 1].n_robust_nonpositive == 3
    assert {r.added: r.category for r in lattice.certified_blocks(lattice.certified_edges(cells)).collect()} == {0: "order_robust_generalizing", 1: "order_robust_non_generalizing"}
    row = lattice.certified_paths(cells, 2).first()
    assert (row.full_paths, row.paths, row.status, row.n_cells, row.n_estimable) == (0, 2, "no_full_transfer", 12, 12)


def test_one_failed_group_makes_an_edge_mixed(spark):
    cells = lattice.certified_cells(sums(spark, rows_of([[0.5, 0.5, -0.5], [0.3] * 3])), 2, 500, 1)
    edges = {(r.subset_mask, r.added): r.category for r in lattice.certified_edges(cells).collect()}
    assert edges[0, 0] == edges[2, 0] == "mixed" and edges[0, 1] == "robust_generalizing"


def test_order_sensitive_paths(spark):
    rows = [(g, b, w, 0.0, -0.2 + 0.001 * b, 0.3 + 0.001 * b, 0.6 + 0.001 * b) for g, b, w, *_ in rows_of([[0] * 3, [0] * 3])]
    cells = lattice.certified_cells(sums(spark, rows), 2, 500, 1)
    row = lattice.certified_paths(cells, 2).first()  # block 1 first, then 0, is good; 0 first is not
    assert (row.full_paths, row.status, row.share) == (1, "order_sensitive_full_transfer", 0.5)


@pytest.mark.parametrize("mask", [0, 3])
def test_minus_infinity_makes_its_edges_unavailable_only(spark, mask):
    rows = rows_of([[0.5] * 3, [0.3] * 3])
    rows[4] = (*rows[4][: 3 + mask], float("-inf"), *rows[4][4 + mask :])
    free = (*rows[5][:2], 0.0, *rows[5][3:])
    rows.append((*free[: 3 + 1], float("-inf"), *free[5:]))  # without weight: ignored
    cells = {(r.subset_mask, r.added, r.grp): r for r in lattice.certified_cells(sums(spark, rows), 2, 500, 1).collect()}
    for (low, added, grp), r in cells.items():
        bad = grp == 0 and mask in (low, low | 1 << added)
        assert (r.status == "unavailable") == bad and r.estimable != bad
        assert (r.mean_gain == -math.inf) == bad and (r.lower is None) == bad
    shapley = lattice.shapley_by_group(lattice.point_cells(sums(spark, rows), 2), 2).collect()
    assert all(r.category == "unavailable" and r.shapley is None and r.additivity_error is None for r in shapley)


def test_too_few_blocks_and_tolerance(spark):
    few = lattice.certified_cells(sums(spark, rows_of([[0.5] * 3, [0.3] * 3], blocks=7)), 2, 500, 1)
    assert {r.status for r in few.collect()} == {"unavailable"} and lattice.certified_paths(few, 2).first().full_paths == 0
    strict = lattice.certified_cells(sums(spark, rows_of([[0.5] * 3, [0.3] * 3])), 2, 500, 1, tolerance=0.4)
    assert {r.category for r in lattice.certified_edges(strict).filter("added = 1").collect()} == {"robust_non_generalizing"}


def test_shapley_adds_up_and_paths_of_three_blocks(spark):
    rows = rows_of([[0.5] * 3, [0.3] * 3, [0.1, 0.2, 0.3]], k=3, noise=0.0)
    s = sums(spark, rows, 3)
    found = lattice.shapley_by_group(lattice.point_cells(s, 3), 3).collect()
    assert all(abs(r.additivity_error) < 1e-12 and r.category == "generalizing" for r in found)
    assert {(r.added, r.grp): round(r.shapley, 9) for r in found}[2, 1] == 0.2
    row = lattice.certified_paths(lattice.certified_cells(s, 3, 500, 2), 3).first()
    assert (row.full_paths, row.status, row.n_cells) == (6, "universal_full_transfer", 36)


def test_constant_gain_has_no_spread(spark):
    cells = lattice.certified_cells(sums(spark, rows_of([[0.25] * 3, [0.5] * 3], noise=0.0)), 2, 500, 3).collect()
    assert all(abs(r.lower - r.mean_gain) < 1e-9 and r.status == "robust_positive" for r in cells)
