"""Order statistics against sorted lists, on sizes below and above the point where the bracket closes."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import conformal, events, order


@pytest.mark.parametrize("n", [1, 7, 9000, 60000])
def test_ranks_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, 1.5, rng.expovariate(1.0), 10 ** rng.uniform(-9, 9)]) for _ in range(n)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "s double").repartition(7)
    for share in (0.05, 0.5, 0.95):
        rank = int(share * n) + 1
        got = order.order_statistic(frame, "s", (), share, lambda c, share=share: F.floor(c * share) + 1).first()
        assert (got.n, got.value) == (n, sorted(values)[rank - 1] if rank <= n else None)


def test_ranks_by_key(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randint(0, 500 * (i + 1)))) for i, k in enumerate(("a", None, "c")) for _ in range(15000 if k == "a" else 40)]
    frame = spark.createDataFrame([*rows, ("empty", None)], "k string, s double")
    got = {r.k: (r.n, r.value) for r in order.order_statistic(frame, "s", ("k",), 0.9, lambda n: F.ceil(n * 0.9)).collect()}
    for key in ("a", None, "c"):
        own = sorted(s for k, s in rows if k == key)
        assert got.pop(key) == (len(own), own[-(-len(own) * 9 // 10) - 1])
    assert not got


def test_thresholds_of_nothing(spark):
    none = spark.createDataFrame([], "score double")
    assert tuple(conformal.threshold(none, 0.1, clip=True).first()) == (float("inf"), 0)
    assert conformal.group_envelope(spark.createDataFrame([], "stratum string, grp string, gain double"), 0.1).count() == 0


def test_no_window_without_a_key_orders_the_scores(spark):
    """What a task without a key gets to order is the bracket, not the table."""
    frame = spark.range(200000).select((F.hash("id") / 1e6).alias("s")).cache()
    plan = order.order_statistic(frame, "s", (), 0.9, lambda n: F.ceil(n * 0.9))
    assert plan.first().value == sorted(r.s for r in frame.collect())[179999]
    bounds = frame.agg(F.percentile_approx("s", 0.9 - order.MARGIN, order.ACCURACY), F.percentile_approx("s", 0.9 + order.MARGIN, order.ACCURACY)).first()
    assert frame.filter(F.col("s").between(bounds[0], bounds[1])).count() < 1000


def test_rolling_thinning_of_a_long_chain(spark):
    """One chain of 20,000 events: every gap is shorter than the rule's."""
    rng, at, made = random.Random(5), 0, []
    for i in range(20000):
        at += rng.randint(0, 59)
        made.append((1, i, at))
    rows = spark.createDataFrame([*made, (2, 1, None)], "user_id long, event_id long, at long").select("user_id", "event_id", F.timestamp_seconds("at").alias("ts")).repartition(9)
    last, expected = None, []
    for _, i, t in sorted(made, key=lambda r: (r[2], r[1])):
        if last is None or t - last >= 60:
            last = t
            expected.append(i)
    got = events.rolling_thin(rows, "user_id", "ts", "event_id", 60)
    assert got.columns == ["user_id", "event_id", "ts"]
    assert [r.event_id for r in got.orderBy("ts", "event_id").collect()] == expected


@pytest.mark.parametrize("small", [10_000, 8])
def test_weighted_quantiles_equal_their_definition(spark, monkeypatch, small):
    monkeypatch.setattr(order, "SMALL", small)
    monkeypatch.setattr(order, "BINS", 16)
    rng = random.Random(7)
    inf = float("inf")
    rows = [(g, rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3)), rng.lognormvariate(0, 8)]), float(rng.randint(0, 4))) for g in ("a", "b", None) for _ in range(400)]
    rows += [("a", None, 1.0), ("a", float("nan"), 5.0), ("a", 1.0, None), ("a", 2.0, -1.0), ("a", inf, 3.0), ("b", -inf, 2.0), ("c", 5.0, 0.0), ("d", 5.0, 2.0), ("e", inf, 1.0), ("e", -inf, 1.0)]
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = order.weighted_quantiles(spark.createDataFrame(rows, "k string, v double, w double").repartition(4), "v", "w", ("k",), shares)
    expected = {}
    for g in {r[0] for r in rows}:
        mine = sorted((v, w) for k, v, w in rows if k == g and v is not None and v == v and w is not None and w > 0)
        total = sum(w for _, w in mine)
        for s in shares:
            through, found = 0.0, None
            for v in sorted({v for v, _ in mine}):
                through += sum(w for x, w in mine if x == v)
                if found is None and through >= s * total * (1 - 1e-12):
                    found = v
            if mine:
                expected[g, s] = (found, len(mine), total)
    assert {(r.k, r.share): (r.value, r.n, r.weight) for r in got.collect()} == expected
    one = order.weighted_quantiles(spark.createDataFrame(rows, "k string, v double, w double").filter("k = 'd'"), "v", "w", (), (0.5,)).first()
    assert (one.value, one.n, one.weight) == (5.0, 1, 2.0)
    assert order.weighted_quantiles(spark.createDataFrame([], "k string, v double, w double"), "v", "w", ("k",), (0.5,)).count() == 0
