import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.algebra import normal_quantile, t_quantile, weighted_mean
from tessera.operators import conformal, density, population, process, resample, robust, selection, stacking


def test_block_point_and_error(spark):
    rows = spark.createDataFrame([("g", b, v, 1.0) for b, v in enumerate((1.0, 2.0, 4.0, 5.0))], "grp string, block int, gain double, w double")
    got = resample.point(resample.block_table(rows, "grp", "block", "gain", "w")).first()
    assert got["mean"] == 3 and math.isclose(got.se, np.std([1, 2, 4, 5], ddof=1) / 2)


def test_error_is_scale_free(spark):
    def t(scale):
        rows = spark.createDataFrame([("g", b, v, w * scale) for b, (v, w) in enumerate(((2.0, 1.0), (3.0, 2.0), (2.0, 1.5), (3.0, 3.0)))], "grp string, block int, gain double, w double")
        r = resample.point(resample.block_table(rows, "grp", "block", "gain", "w")).first()
        return r["mean"], r.se

    assert np.allclose(t(1.0), t(1e7))


def test_constant_blocks_give_exact_bounds(spark):
    rows = spark.createDataFrame([(g, b, v, 1.0) for g, v in (("p", 0.5), ("n", -0.5)) for b in range(9)], "grp string, block int, gain double, w double")
    got = {r.grp: r.status for r in resample.bootstrap_t(resample.block_table(rows, "grp", "block", "gain", "w"), 100, 1).collect()}
    assert got == {"p": "robust_positive", "n": "robust_nonpositive"}
    few = resample.bootstrap_t(resample.block_table(rows.filter("block < 3"), "grp", "block", "gain", "w"), 100, 1)
    assert {r.status for r in few.collect()} == {"unavailable"} and resample.family_category(few).first().category == "unavailable"


def test_shared_draws_move_groups_together(spark):
    rows = spark.createDataFrame([(g, b, float(b), 1.0) for g in "ab" for b in range(10)], "grp string, block int, gain double, w double")
    d = resample.drawn(resample.block_table(rows, "grp", "block", "gain", "w"), 30, 1, shared=True)
    assert d.groupBy("draw").agg(F.countDistinct("d_mean").alias("n")).filter("n > 1").count() == 0


def test_minus_infinity_poisons_only_with_weight(spark):
    rows = spark.createDataFrame([("a", float("-inf"), 0.0), ("a", 1.0, 2.0), ("b", float("-inf"), 1.0), ("b", 1.0, 1.0)], "g string, s double, w double")
    got = {r.g: r.m for r in rows.groupBy("g").agg(weighted_mean(F.col("s"), F.col("w")).alias("m")).collect()}
    assert got == {"a": 1.0, "b": float("-inf")}


def test_critical_gamma_is_root_three(spark):
    rows = spark.createDataFrame([("g", 1.0, 3.0), ("g", -1.0, 1.0)], "grp string, gain double, w double")
    assert math.isclose(robust.critical_gamma(rows).first().critical_gamma, math.sqrt(3))
    least = robust.extremes(rows, math.sqrt(3)).first()
    assert abs(least.least) < 1e-12 and least["mean"] == 0.5


def test_extremes_match_a_search(spark):
    rng = np.random.default_rng(1)
    g, w = rng.normal(size=12), rng.random(12)
    got = robust.extremes(spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(g, w, strict=True)], "grp string, gain double, w double"), 2.0).first()
    order = np.argsort(g)
    best = [sum(w[i] * g[i] * (2 if k < n else 0.5) for k, i in enumerate(order)) / sum(w[i] * (2 if k < n else 0.5) for k, i in enumerate(order)) for n in range(13)]
    assert math.isclose(got.least, min(best))


def test_jackknife_and_crossed_variance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1, 0.1, (4, 6))
    cells = spark.createDataFrame([(r, "g", b, float(x[r, b]), 1.0) for r in range(4) for b in range(6)], "refit int, grp string, block int, num double, w double")
    m = x.mean()
    leave = lambda a: sum((np.delete(x, i, axis=a).mean() - m) ** 2 for i in range(x.shape[a])) * (x.shape[a] - 1) / x.shape[a]
    got = process.jackknife_bounds(cells).first()
    assert math.isclose(got.variance, leave(0) + leave(1)) and got.df == 3 and got.status == "robust_positive"
    assert math.isclose(got.lower, m - t_quantile(0.95, 3) * math.sqrt(leave(0) + leave(1)))
    crossed = process.crossed_bounds(cells).first()
    assert crossed.variance >= max(crossed.v_refit, crossed.v_block)


def test_quantile_functions():
    assert abs(normal_quantile(0.975) - 1.959963984540054) < 1e-9
    for df, expected in ((1, 12.7062047), (3, 3.1824463), (8, 2.3060041), (30, 2.0422725)):
        assert abs(t_quantile(0.975, df) - expected) < 1e-6


def test_conformal_ranks(spark):
    cal = spark.createDataFrame([(float(i),) for i in range(1, 10)], "score double")
    assert conformal.threshold(cal, 0.2, clip=False).first().threshold == 8
    assert conformal.threshold(cal, 0.05, clip=False).first().threshold == float("inf") and conformal.threshold(cal, 0.05, clip=True).first().threshold == 9
    field = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.8), (2, "a", 0.5), (2, "b", 0.5)], "row_id int, state string, p double")
    got = {r.row_id: list(r.states) for r in conformal.prediction_sets(spark.createDataFrame([(0.1,)] * 20, "score double"), field, 0.1).collect()}
    assert got == {1: ["b"], 2: ["a"]}  # none qualifies: the likeliest, least label among equals
    gains = spark.createDataFrame([("s", i, float(i)) for i in range(9)] + [("t", 1, 1.0)], "stratum string, grp int, gain double")
    assert {r.stratum: r.bound for r in conformal.group_envelope(gains, 0.2).collect()} == {"s": 1.0, "t": float("-inf")}


def test_circular_distance_wraps(spark):
    got = spark.range(1).select(conformal.circular_distance(F.lit(23.5), F.lit(0.5), 24.0)).first()[0]
    assert math.isclose(got, 1.0)


def test_densities_gain_from_real_structure(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=800)
    h = (6 + 3 * np.tanh(x) + rng.normal(0, 1, 800)) % 24
    y = 2 * x + 0.5 * np.cos(h / 24 * 2 * np.pi) + rng.normal(0, 0.5, 800)
    rows = spark.createDataFrame([(float(a), float(b), float(c), i % 2) for i, (a, b, c) in enumerate(zip(x, h, y, strict=True))], "x double, h double, y double, k int")
    got = density.joint_gain(rows.filter("k = 0"), rows.filter("k = 1"), F.col("h"), F.col("y"), [F.col("x")], "k").first()
    assert got.joint_gain > 0
    m = density.VonMisesModel(rows, F.lit(3.0), [F.col("x")])
    grid = spark.range(2400).select((F.col("id") / 100.0).alias("h"))
    total = grid.select(F.exp(m._density(F.col("h"), F.lit(0.3), 2.0)).alias("p")).agg(F.sum("p") * 0.01).first()[0]
    assert abs(total - 1) < 1e-6


def test_stacking_finds_the_better_model(spark):
    scores = spark.createDataFrame([(-1.0, -5.0)] * 30 + [(-5.0, -1.0)] * 10, "a double, b double")
    got = {r.model: r.weight for r in stacking.stack(scores, ["a", "b"]).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and 0.7 < got["a"] < 0.8


def test_pareto_and_trust(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.1, 5.0, True), ("b", 0.9, 0.2, 6.0, True), ("c", 0.5, 0.05, 5.0, True), ("d", 9.0, 0.0, 0.0, False), ("e", 1.0, 0.1, 5.0, True)], "candidate string, gain double, coverage_error double, region_size double, admissible boolean")
    got = {r.candidate: r.recommended for r in selection.pareto_front(rows).collect()}
    assert got == {"a": True, "c": False, "e": False}


def test_population_summary_for_few_and_many_clusters(spark):
    for clusters in (4, 20):
        gains = spark.createDataFrame([(i, i % clusters, 0.5 + 0.01 * (i % 7)) for i in range(60)], "grp int, cluster int, gain double")
        got = population.population_summary(gains, 200, 1).first()
        assert got.status == "positive" and got.clusters == clusters and got.lower <= got["mean"] <= got.upper and got.positive_share == 1
