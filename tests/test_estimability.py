"""Gains of minus infinity, zero weights, few blocks: such groups are unavailable and leave the others alone."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import population, process, refits, resample, robust
from tessera.sources import tables

BLOCKS = "grp string, block int, gain double, w double"
INF = float("-inf")


def _blocks(spark, rows):
    return resample.block_table(spark.createDataFrame(rows, BLOCKS), "grp", "block", "gain", "w")


def test_minus_infinity_certifies_nothing(spark):
    good = [("a", b, 1.0 + 0.1 * (b % 3), 1.0) for b in range(10)]
    poisoned = _blocks(spark, [*good, *[("z", b, INF if b == 4 else 1.0, 1.0) for b in range(10)], ("a", 3, INF, 0.0)])
    alone = _blocks(spark, good)
    for run in (lambda b: resample.bootstrap_t(b, 200, 1), lambda b: resample.bootstrap_t(b, 200, 1, one_sided=True), lambda b: resample.familywise(b, 200, 1), lambda b: resample.percentile_interval(b, 200, 1)):
        got = {r.grp: r for r in run(poisoned).collect()}
        assert got["z"].status == "unavailable" and got["z"]["mean"] == INF and got["z"].lower is None
        want = run(alone).first()
        assert got["a"].status == want.status == "robust_positive" and math.isclose(got["a"].lower, want.lower)
    assert {r.status for r in resample.bootstrap_t(_blocks(spark, [("z", b, INF, 1.0) for b in range(9)]), 50, 1).collect()} == {"unavailable"}


def test_groups_of_few_blocks_leave_the_family(spark):
    good = [("a", b, 1.0 + 0.1 * (b % 3), 1.0) for b in range(10)]
    got = {r.grp: r for r in resample.bootstrap_t(_blocks(spark, [*good, *[("few", b, float(b), 1.0) for b in range(3)]]), 200, 1).collect()}
    want = resample.bootstrap_t(_blocks(spark, good), 200, 1).first()
    assert got["few"].status == "unavailable" and got["few"].critical is None
    assert got["a"].status == "robust_positive" and got["a"].critical == want.critical


def test_training_processes_with_minus_infinity(spark):
    cells = [(r, g, b, 1.0 + 0.01 * ((r * 7 + b * 3) % 5) if (g, r, b) != ("z", 2, 5) else INF, 1.0) for g in "az" for r in range(8) for b in range(9)] + [(0, "a", 0, INF, 0.0)]
    cells = [(r, g, b, x * w if w else float("nan"), w) for r, g, b, x, w in cells]
    frame = spark.createDataFrame(cells, "refit int, grp string, block int, num double, w double")
    runs = [process.jackknife_bounds, lambda c: process.jackknife_bounds(c, rule="max"), process.crossed_bounds, lambda c: process.component_bounds(c, 100, 1), lambda c: process.pigeonhole_bounds(c, 100, 1)]
    for run in runs:
        got = {r.grp: r for r in run(frame).collect()}
        assert got["z"]["mean"] == INF and got["z"].status == "unavailable" and got["a"].status == "robust_positive"
    few = process.pigeonhole_bounds(frame.filter("refit < 3"), 50, 1).collect()
    assert {r.status for r in few} == {"unavailable"}
    assert refits.all_refits_pass(frame, 50, 1).first().category == "unavailable"


ROWS = "grp string, block int, gain double, w double"


def gains(spark, *extra, mean=1.0, blocks=10, sd=0.4):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([*[(g, b, float(rng.normal(mean, sd)), 1.0) for g in "ab" for b in range(blocks) for _ in range(3)], *extra], ROWS)


@pytest.mark.parametrize("bad", [float("-inf"), float("nan")])
def test_reweighting_of_endless_gains_is_unavailable(spark, bad):
    rows = gains(spark, ("a", 0, bad, 1.0))
    least = {r.grp: r for r in robust.extremes(rows, 2.0).collect()}
    assert least["a"].mean == float("-inf") and least["a"].least is None and least["a"].greatest is None and least["b"].least > 0
    joint = {r.grp: r for r in robust.joint_extremes(rows, 2.0, 50, 1).collect()}
    assert joint["a"].lower is None and joint["a"].upper is None and joint["a"].n_draws == 0 and joint["b"].n_draws == 50
    critical = {r.grp: r for r in robust.critical_gamma(rows).collect()}
    assert critical["a"].status == "unavailable" and critical["a"].critical_gamma is None and critical["b"].status in ("finite", "beyond_limit")
    row = robust.robustness_radius(rows, 50, 1, steps=20).first()
    assert (row.category, row.radius, row.limiting_groups) == ("unavailable", None, "a")


def test_endless_gains_without_weight_are_ignored(spark):
    plain, extra = gains(spark), gains(spark, ("a", 0, float("-inf"), 0.0), ("c", 0, float("-inf"), 0.0))
    for f in (lambda r: robust.extremes(r, 2.0), lambda r: robust.joint_extremes(r, 2.0, 50, 1), lambda r: robust.critical_gamma(r), lambda r: robust.robustness_radius(r, 50, 1, steps=20)):
        assert sorted(map(tuple, f(extra).collect())) == sorted(map(tuple, f(plain).collect()))
    means = {r.grp: r for r in resample.weight_sensitivity(gains(spark, ("a", 0, float("-inf"), 0.0)), "grp", "block", "gain", {"w": F.col("w"), "twice": 2 * F.col("w")}).collect()}
    assert means["a"].stable and means["a"].mean > 0
    means = {(r.weighting, r.grp): r for r in resample.weight_sensitivity(gains(spark, ("a", 0, float("-inf"), 0.0)), "grp", "block", "gain", {"w": F.col("w"), "one": F.lit(1.0)}).collect()}
    assert means["one", "a"].mean == float("-inf") and not means["w", "a"].stable and means["w", "b"].stable


def test_radius_of_both_targets_and_of_none(spark):
    up = robust.robustness_radius(gains(spark, sd=1.2), 50, 1).first()
    assert (up.category, up.target) == ("finite_radius", "joint_robust_generalizing") and 1 < up.radius < up.break_gamma < up.radius + 1e-12 and up.limiting_groups in ("a", "b", "a,b")
    down = robust.robustness_radius(gains(spark, mean=-1.0, sd=1.2), 50, 1).first()
    assert (down.category, down.target) == ("finite_radius", "joint_robust_non_generalizing") and down.radius > 1
    flat = robust.robustness_radius(gains(spark, mean=0.0, sd=1.2), 50, 1).first()
    assert (flat.category, flat.radius, flat.target) == ("not_certified_at_baseline", None, None)
    sure = robust.robustness_radius(gains(spark, mean=9.0), 50, 1).first()
    assert (sure.category, sure.radius, sure.weight_ratio) == ("robust_through_search_upper", 10.0, 100.0)
    few = robust.robustness_radius(gains(spark, blocks=7), 50, 1).first()
    assert (few.category, few.limiting_groups) == ("unavailable", "a,b")


def test_one_refit_or_one_block_is_unavailable_beside_sound_groups(spark):
    rng = np.random.default_rng(9)
    cells = [(r, g, b, float(rng.normal(1, 0.1)), 1.0) for g in "abc" for r in range(4) for b in range(5) if (g != "a" or r == 0) and (g != "b" or b == 0)]
    df = spark.createDataFrame(cells, "refit int, grp string, block int, num double, w double")
    for f in (process.jackknife_bounds, process.crossed_bounds, lambda d: process.jackknife_bounds(d, rule="max")):
        found = {r.grp: r for r in f(df).collect()}
        assert {g: r.status for g, r in found.items()} == {"a": "unavailable", "b": "unavailable", "c": "robust_positive"}
        assert all(found[g][c] is None for g in "ab" for c in ("v_refit", "v_block", "variance", "lower")) and found["a"].df == 0


def test_population_with_endless_gains_and_one_cluster(spark):
    row = population.population_summary(spark.createDataFrame([(g, g % 12, float("-inf") if g == 3 else 1.0 + g) for g in range(24)], "grp int, cluster int, gain double"), 50, 1).first()
    assert row.status == "unavailable" and row.lower is None and row.new_group_lower is None and row.mean == float("-inf")
    row = population.population_summary(spark.createDataFrame([(g, 1, 1.0 + g) for g in range(5)], "grp int, cluster int, gain double"), 50, 1).first()
    assert row.status == "uncertain" and (row.lower, row.upper) == (float("-inf"), float("inf"))


def test_quoted_line_breaks_stay_in_their_field(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"a\nb"\n2,"say ""x"", y"\n3,plain\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(tmp_path / "t.csv"), ["id", "text"]).collect()
    assert [tuple(r) for r in rows] == [("1", "a\nb"), ("2", 'say "x", y'), ("3", "plain")]


def test_three_intervals_of_the_same_draws(spark):
    rng = np.random.default_rng(2)
    rows = [(g, b, float(rng.normal(m, 0.4)), 1.0) for g, m in (("a", 0.2), ("b", 1.0), ("c", -1.0)) for b in range(12) for _ in range(2)] + [("d", b, 1.0, 1.0) for b in range(5)]
    found = {r.grp: r for r in resample.group_intervals(_blocks(spark, rows), 500, 3).collect()}
    for g in "abc":
        r = found[g]
        assert r.bonferroni_lower <= r.marginal_lower < r.mean < r.marginal_upper <= r.bonferroni_upper and r.max_t_lower <= r.mean <= r.max_t_upper
    draws = sorted(r.d_mean for r in resample.drawn(_blocks(spark, rows), 500, 3).filter("grp = 'a'").collect())
    assert math.isclose(found["a"].bonferroni_lower, np.quantile(draws, 0.05 / 8)) and math.isclose(found["a"].bonferroni_upper, np.quantile(draws, 1 - 0.05 / 8))
    assert {found["d"][f"{k}_status"] for k in ("marginal", "bonferroni", "max_t")} == {"unavailable"} and found["d"].marginal_lower is None
    assert {r.category for r in resample.interval_categories(resample.group_intervals(_blocks(spark, rows), 500, 3)).collect()} == {"unavailable"}
    sound = [r for r in rows if r[0] == "b"]
    assert {(r.category, r.admissible) for r in resample.interval_categories(resample.group_intervals(_blocks(spark, sound), 500, 3)).collect()} == {("robust_generalizing", True)}


@pytest.mark.parametrize("gamma", [1.0, 1.7, 6.0])
def test_extremes_from_bins_equal_those_from_all_gains(spark, monkeypatch, gamma):
    rng = np.random.default_rng(12)
    rows = [(g, b, float(rng.normal(0.3, 1) * (50 if rng.random() < 0.02 else 1)), float(rng.integers(1, 4))) for g in "ab" for b in range(9) for _ in range(25)]
    rows += [("e", b, 0.5 if k % 3 else float(rng.normal(0, 1)), 1.0) for b in range(9) for k in range(25)]
    rows += [("c", b, 2.0, 1.0) for b in range(9)] + [("d", 0, -1.0, 1.0), ("d", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ROWS)
    plain = {(r.grp, r.draw): r for r in robust._extremes(robust._drawn_prefixes(df, 40, 5), gamma, ["grp", "draw"]).collect()}
    monkeypatch.setattr(robust, "DISTINCT", 5)
    monkeypatch.setattr(robust, "BINS", 6)
    found = {(r.grp, r.draw): r for r in robust._binned_extremes(df, 40, 5, gamma).collect()}
    assert set(found) == set(plain) and len(found) == 200
    for k, r in found.items():
        assert math.isclose(r.least, plain[k].least, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r.greatest, plain[k].greatest, rel_tol=1e-9, abs_tol=1e-12), k
