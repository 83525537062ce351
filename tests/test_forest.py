"""Forests are grown on counted cells: the same bags and splits as row by row, and no more work for more rows of a cell."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest, workflow

ROLES = workflow.EventTable("state", "ind", "sp", "fold", ("x", "y"))


def events(spark, copies=1, n=3000):
    """States that follow x with some noise; y means nothing."""
    rows = spark.range(n * copies).select((F.col("id") % n).alias("i"))
    u = lambda salt: F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(1000)) / 1000
    rows = rows.select("i", u(1).alias("x"), u(2).alias("y"), u(3).alias("z"), (F.col("i") % 12).cast("int").alias("g"))
    state = F.when(F.col("z") < 0.1, "c").when(F.col("x") < 0.4, "a").otherwise("b")
    return rows.select(state.alias("state"), F.col("g").alias("ind"), (F.col("g") % 2).alias("sp"), (F.col("g") % 3).alias("fold"), (F.floor(F.col("x") * 20) / 20).alias("x"), (F.floor(F.col("y") * 20) / 20).alias("y"))


def gains(found):
    return {r["ind"]: tuple(r) for r in found.collect()}


@pytest.fixture(scope="module")
def found(spark):
    return gains(workflow.cross_validated(events(spark), ROLES, "forest"))


def small(monkeypatch):
    monkeypatch.setattr(forest, "TREES", 6)
    monkeypatch.setattr(forest, "DEPTH", 2)


def test_trees_are_grown_on_as_many_cells_however_often_rows_recur(spark, monkeypatch):
    seen = []

    def stump(cells, n_forests, d, n_labels, seed):
        seen.append((cells.count(), cells.agg(F.sum("__n")).first()[0]))
        return forest.Forests(np.full((n_forests, 1, 1), -1), np.zeros((n_forests, 1, 1), int), np.full((n_forests, 1, 1, n_labels), 1 / n_labels))

    monkeypatch.setattr(forest, "grown", stump)
    for copies in (1, 4):
        workflow.cross_validated(events(spark, copies), ROLES, "forest")
    (few, once), (many, often) = seen
    assert few == many < once == 6000 and often == 4 * once  # each of three forests learns from two thirds


def test_gains_follow_the_features_and_not_the_partitions(spark, found):
    other = gains(workflow.cross_validated(events(spark).repartition(7), ROLES, "forest"))
    assert len(found) == 12 and all(other[k] == pytest.approx(v) for k, v in found.items())
    assert all(v[2] > 0.35 and v[2] == pytest.approx(v[3] + v[4]) for v in found.values())


def test_gains_are_those_of_the_forest_of_spark(spark, found):
    """Held-out scores of the forest that takes rows one by one, up to the draws."""
    from pyspark.ml.classification import RandomForestClassifier

    theirs = gains(workflow.cross_validated(events(spark), ROLES, RandomForestClassifier(numTrees=forest.TREES, maxDepth=forest.DEPTH, seed=0)))
    assert all(v[3] == pytest.approx(theirs[k][3]) and v[4] == pytest.approx(theirs[k][4], abs=0.04) for k, v in found.items())
    assert np.mean([v[4] for v in found.values()]) == pytest.approx(np.mean([v[4] for v in theirs.values()]), abs=0.02)


def test_a_bag_of_a_cell_is_that_of_its_rows(spark):
    """n draws of a Poisson(1) sum to one of a Poisson(n): mean and variance n, each cell's and tree's its own."""
    cells = spark.range(2000).select(F.lit(0).alias("__of"), F.lit(0).alias("__label"), F.lit(0.5).alias("training_weight"), (F.col("id") % 100).cast("byte").alias("__b0"), F.floor(F.col("id") / 100).cast("byte").alias("__b1"), F.when(F.col("id") % 2 == 0, 1).otherwise(40).alias("__n"))
    bags = forest._bagged(cells, 2, 3).toPandas().sort_values(["__b0", "__b1"])
    assert len(bags) == 2000 and bags.drop_duplicates([f"t{t}" for t in range(forest.TREES)]).shape[0] == 2000
    for odd, n in ((0, 1), (1, 40)):
        drawn = bags[bags["__b0"] % 2 == odd][[f"t{t}" for t in range(forest.TREES)]].to_numpy() / 0.5
        assert drawn.mean() == pytest.approx(n, rel=0.03) and drawn.var() == pytest.approx(n, rel=0.05) and (drawn % 1 == 0).all()
    again = forest._bagged(cells.repartition(9), 2, 3).toPandas().sort_values(["__b0", "__b1"])
    assert (again.to_numpy() == bags.to_numpy()).all()


def brute(rows, chosen, node, depth):
    """Leaves' shares of labels of one tree, from (bins, label, weight): all splits tried one by one."""
    whole = defaultdict(float)
    for _, label, w in rows:
        whole[label] += w
    total = sum(whole.values())
    best, split = 1e-12 * total, None
    purity = lambda part: sum(sum(w for _, k, w in part if k == label) ** 2 for label in whole) / sum(w for *_, w in part)
    for f in chosen[node] if depth else ():
        for last in range(forest.BINS - 1):
            left, right = [r for r in rows if r[0][f] <= last], [r for r in rows if r[0][f] > last]
            if left and right and purity(left) + purity(right) - purity(rows) > best + 1e-9:
                best, split = purity(left) + purity(right) - purity(rows), (f, last, left, right)
    if split is None:
        return lambda bins: {k: w / total for k, w in whole.items()}
    f, last, left, right = split
    low, high = brute(left, chosen, 2 * node + 1, depth - 1), brute(right, chosen, 2 * node + 2, depth - 1)
    return lambda bins: (low if bins[f] <= last else high)(bins)


@pytest.mark.parametrize("room", [forest.ROOM, 1])
def test_trees_are_those_of_brute_force(spark, monkeypatch, room):
    """All trees of two forests, grown by levels over a table, against recursion over the same bags; with little room, tree by tree."""
    monkeypatch.setattr(forest, "TREES", 4)
    monkeypatch.setattr(forest, "DEPTH", 3)
    monkeypatch.setattr(forest, "ROOM", room)
    draw, d, labels = np.random.default_rng(1), 3, 3
    made = {(of, label, *b): (int(n), float(w)) for of in range(2) for label, n, w, *b in zip(draw.integers(0, labels, 60), draw.integers(1, 9, 60), draw.random(60), *draw.integers(0, 6, (d, 60)))}
    cells = spark.createDataFrame([(int(k[0]), int(k[1]), w, *map(int, k[2:]), n) for k, (n, w) in made.items()], "__of int, __label int, training_weight double, __b0 byte, __b1 byte, __b2 byte, __n long").repartition(5)
    forests = forest.grown(cells, 2, d, labels, 11)
    bags = forest._bagged(cells, d, 11).collect()
    chosen = np.random.default_rng(11).random((2, 4, 15, d)).argsort(axis=-1)[..., :2]
    splits = 0
    for of in range(2):
        reached = None
        for t in range(4):
            rows = [((r["__b0"], r["__b1"], r["__b2"]), r["__label"], r[f"t{t}"]) for r in bags if r["__of"] == of and r[f"t{t}"] > 0]
            tree = brute(rows, chosen[of, t], 0, 3)
            bins = np.array(sorted({b for b, *_ in rows}))
            reached = forests.reached(of, slice(t, t + 1), bins)[:, 0]
            splits += (forests.feature[of, t] >= 0).sum()
            for b, at in zip(bins, reached):
                want = tree(tuple(b))
                assert forests.share[of, t, at] == pytest.approx([want.get(k, 0) for k in range(labels)])
    assert splits > 20


def test_bins_end_between_all_values_if_they_are_few_and_else_at_quantiles_by_weight(spark):
    rows = spark.range(20_000).select(F.lit(0).alias("fold"), F.when(F.col("id") < 10_000, 3.0).otherwise(1.0).alias("training_weight"), F.col("id").cast("double").alias("x"), F.when(F.col("id") == 77, 5.0).otherwise(F.col("id") % 3).alias("y"), F.lit(2.5).alias("z"))
    features = ("x", "y", "z")
    few = forest.few_valued(rows, features)
    assert few == {"y", "z"}
    cuts = forest.cut_points(forest.sketched(rows, "fold", features, few), features, few)
    assert cuts[1:] == [[0.5, 1.5, 3.5], []] and len(cuts[0]) == forest.BINS - 1
    assert cuts[0][15] == pytest.approx(6667, abs=120) and cuts[0][23] == pytest.approx(10_000, abs=120)  # half and three quarters of the weight
    bins = forest.binned(rows, features, cuts)
    assert {tuple(r) for r in bins.select("y", "__b1", "__b2").distinct().collect()} == {(0, 0, 0), (1, 1, 0), (2, 2, 0), (5, 3, 0)}
    edge = cuts[0][15]
    assert {r["x"] <= edge for r in bins.filter("__b0 <= 15").collect()} == {True} and {r["x"] > edge for r in bins.filter("__b0 > 15").collect()} == {True}


def test_policies_weigh_forests_and_unseen_labels_fail(spark, monkeypatch):
    small(monkeypatch)
    rows = events(spark, n=600)
    only = lambda train, r: train.withColumn("training_weight", (F.col("state") != "c").cast("int"))
    got = workflow.cross_validated(rows, ROLES, "forest", policy=only).collect()
    assert len(got) == 12 and all(r.context_gain == -math.inf for r in got)  # c is in the test rows, but weighs nothing in training
    with pytest.raises(ValueError):
        workflow.cross_validated(rows.filter("fold = 0"), ROLES, "forest")


def test_columns_of_the_caller_may_have_any_name(spark, monkeypatch):
    small(monkeypatch)
    rows = events(spark, n=600).withColumn("state", F.when((F.col("ind") == 0) & (F.col("x") < 0.2), "new").otherwise(F.col("state")))
    named = rows.select(F.col("state").alias("label"), F.col("ind").alias("n"), F.col("sp").alias("of"), F.col("fold").alias("tree"), F.col("x").alias("t0"), F.col("y").alias("b0"))
    got = {r["n"]: r for r in workflow.cross_validated(named, workflow.EventTable("label", "n", "of", "tree", ("t0", "b0")), "forest").collect()}
    assert got[0].context_gain == -math.inf and all(r.context_gain > 0.1 for k, r in got.items() if k)  # no other fold has the new label
