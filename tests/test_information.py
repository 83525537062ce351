import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import cube, information, ladder, state, transfer, workflow


def tensor(spark, cells):
    return spark.createDataFrame(cells, "x int, y int, z int, t int, mass double")


def test_uniform_tensor_has_full_thickness(spark):
    c = tensor(spark, [(x, y, z, 0, 1.0) for x in range(2) for y in range(3) for z in range(4)])
    r = information.thickness_profile(c, ["x", "y"], "z", "t").first()
    assert math.isclose(r.z_given_base, math.log(4)) and math.isclose(r.z_effective, 4) and r.t_given_base == 0


def test_thin_layered_and_empty_cells(spark):
    c = tensor(spark, [(0, 0, 0, 0, 4.0), *[(0, 1, z, 0, 1.0) for z in range(4)]])
    domain = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "x int, y int")
    got = {r.y: r for r in information.thickness_map(c, ["x", "y"], ["z"], domain).collect()}
    assert math.isclose(got[0].effective, 1) and math.isclose(got[1].effective, 4) and got[2].effective is None and got[2].mass == 0


def test_support_cube_drops_nulls_and_zero_mass(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 1.0), ("b", 0.0)], "s string, w double")
    assert [tuple(r) for r in cube.support_cube(rows, {"s": F.col("s")}, F.col("w")).collect()] == [("a", 3.0)]


def test_overlap_of_equal_and_disjoint(spark):
    a, b = tensor(spark, [(0, 0, 0, 0, 1.0), (1, 0, 0, 0, 3.0)]), tensor(spark, [(0, 0, 0, 0, 2.0), (1, 0, 0, 0, 6.0)])
    assert math.isclose(information.overlap(a, b, ["x"]).first()[0], 1)
    assert information.overlap(a, tensor(spark, [(7, 0, 0, 0, 1.0)]), ["x"]).first()[0] == 0


def test_strict_gain_refuses_unseen_states_and_fails_on_zero_probability(spark):
    train = spark.createDataFrame([("a", "p", 1.0), ("b", "q", 1.0)], "b string, a string, mass double")
    crossed = spark.createDataFrame([("a", "q", 1.0)], "b string, a string, mass double")
    assert transfer.strict_gain(train, crossed, ["b"], ["a"]).first().conditional_score == float("-inf")
    with pytest.raises(transfer.UnseenState):
        transfer.strict_gain(train, spark.createDataFrame([("z", "q", 1.0)], "b string, a string, mass double"), ["b"], ["a"])
    weightless = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 0.0)], "b string, a string, mass double")
    assert math.isclose(transfer.strict_gain(train, weightless, ["b"], ["a"]).first().gain, math.log(2))


def test_dirichlet_rows_sum_to_one_and_follow_the_policy(spark):
    train = spark.createDataFrame([("a", "p", 3.0), ("a", "q", 1.0)], "b string, s string, mass double")
    domain = spark.createDataFrame([("a",), ("new",)], "b string")
    for policy, expected in (("marginal", 3.5 / 5), ("uniform", 0.5)):
        field = state.dirichlet_field(train, ["b"], "s", 0.5, policy, domain)
        assert {round(r[1], 12) for r in field.groupBy("b").agg(F.sum("p")).collect()} == {1.0}
        assert math.isclose(field.filter("b = 'new' and s = 'p'").first().p, expected)
    with pytest.raises(ValueError):
        state.dirichlet_field(train, ["b"], "s", 0.5, "error", domain)


def test_gains_add_up_over_an_event_table(spark):
    rows = [("low" if i < (8 if s == "species-a" else 2) else "high", -1.0 if s == "species-a" else 1.0, g, s, k % 2) for s, gs in (("species-a", ["A0", "A1"]), ("species-b", ["B0", "B1"])) for k, g in enumerate(gs) for i in range(10)]
    frame = spark.createDataFrame(rows, "state string, x double, individual string, species string, fold int")
    got = workflow.cross_validated(frame, workflow.EventTable("state", "individual", "species", "fold", ("x",))).collect()
    assert len(got) == 4 and all(abs(r.pooled_gain - r.stratum_gain - r.context_gain) < 1e-9 and r.pooled_gain > 0 for r in got)
    with pytest.raises(ValueError):
        workflow.cross_validated(frame.withColumn("x", F.lit(float("nan"))), workflow.EventTable("state", "individual", "species", "fold", ("x",)))


def test_hierarchical_weights_sum_to_one(spark):
    rows = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "c")], "st string, g string")
    got = sorted(r.training_weight for r in workflow.hierarchical_weights(rows, "st", "g").collect())
    assert got == [0.125, 0.125, 0.25, 0.5]


def test_ladder_stops_at_the_first_failure(spark):
    rows = spark.createDataFrame([("a", 1.0, -3.0, -2.0, -2.5, -1.0), ("b", 1.0, -3.0, -1.0, -2.0, -0.5)], "g string, w double, s0 double, s1 double, s2 double, s3 double")
    gains = ladder.adjacent_gains(rows, "g", "w", ["s0", "s1", "s2", "s3"])
    assert ladder.ceiling(gains).first().ceiling == 1


def test_shapley_values_add_up(spark):
    value = {0: 0.0, 1: 1.0, 2: 2.0, 3: 4.0, 4: 0.5, 5: 2.0, 6: 2.0, 7: 5.0}
    nodes = spark.createDataFrame([(m, "g", v) for m, v in value.items()], "subset_mask int, group string, score double")
    edges = ladder.lattice_edges(nodes, 3)
    assert edges.count() == 12 and math.isclose(sum(r.shapley for r in ladder.shapley(edges, 3).collect()), 5.0)
    assert tuple(ladder.monotone_paths(edges, 3).first()) == (5, 6) or ladder.monotone_paths(edges, 3).first().paths == 6


def test_policies_and_estimators_of_the_caller(spark):
    from pyspark.ml.classification import NaiveBayes, LinearSVC

    rows = [("low" if i < (8 if s == "a" else 2) else "high", 0.0 if s == "a" else 1.0, s + g, s, k) for s in "ab" for k, g in enumerate("01") for i in range(10)]
    frame = spark.createDataFrame(rows, "state string, x double, ind string, sp string, fold int")
    roles = workflow.EventTable("state", "ind", "sp", "fold", ("x",))
    even = lambda train, _: train.withColumn("training_weight", F.lit(1.0))
    plain, same = ({r.ind: r for r in workflow.cross_validated(frame, roles, NaiveBayes(), policy=p).collect()} for p in (None, even))
    assert all(abs(plain[k].stratum_gain - same[k].stratum_gain) < 1e-9 and abs(same[k].pooled_gain - same[k].stratum_gain - same[k].context_gain) < 1e-9 for k in plain)
    only_a = lambda train, r: train.withColumn("training_weight", (F.col(r.stratum) == "a").cast("double"))
    tilted = {r.ind: r for r in workflow.cross_validated(frame, roles, NaiveBayes(), policy=only_a).collect()}
    assert abs(tilted["a0"].stratum_gain) < 1e-9 < abs(tilted["b0"].stratum_gain)
    for wrong in (lambda train, _: train.withColumn("training_weight", F.lit(-1.0)), lambda train, _: train.limit(3).withColumn("training_weight", F.lit(1.0))):
        with pytest.raises(ValueError):
            workflow.cross_validated(frame, roles, "logit", policy=wrong)
    for model in ("other", LinearSVC()):
        with pytest.raises((ValueError, KeyError, TypeError)):
            workflow._learner(model, {"featuresCol": "f", "labelCol": "l", "weightCol": "w", "noneSuch": "n"} if model != "other" else {}, 1.0, 1, 0)


def test_overlaps_of_all_subsets_are_those_of_each(spark):
    a = tensor(spark, [(1, 0, 0, 0, 2.0), (1, 1, 0, 1, 1.0), (2, 0, 1, 0, 3.0)])
    b = tensor(spark, [(1, 0, 0, 1, 1.0), (2, 0, 1, 0, 1.0), (3, 1, 1, 1, 4.0)])
    subsets = [list(a.columns[:1]), list(a.columns[:3]), list(a.columns[1:4])]
    got = {r.subset_no: r.overlap for r in information.overlaps(a, b, subsets).collect()}
    assert [got[n] for n in range(3)] == [pytest.approx(information.overlap(a, b, s).first()[0]) for s in subsets]
    none = a.filter("mass < 0")
    assert set(information.overlap_profile(none, none, subsets[0], a.columns[1], a.columns[2]).first()) == {None}
