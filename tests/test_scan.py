"""Running values by ranges against windows and by definition, and a key that holds all rows in many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import events, scan


def made(n=3000):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(400)]), i, rng.choice([None, float(rng.randint(-5, 9))])) for i in range(n)]
    return [*rows, ("solo", 1, n, 2.0)]


VALUES = {"s": ("sum", F.col), "c": ("count", F.col), "lo": ("min", F.col), "hi": ("max", F.col), "prev": ("lag", F.col)}


def by_definition(rows, inclusive):
    out = {}
    for key in {r[0] for r in rows}:
        seen = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            part = [x for x in [*seen, r[3]][: len(seen) + inclusive] if x is not None]
            out[r[2]] = (sum(part) if part else None, len(part), min(part, default=None), max(part, default=None), seen[-1] if seen else None)
            seen.append(r[3])
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("hot", [10**9, 50])
def test_equals_the_definition(spark, inclusive, hot):
    rows = made()
    df = spark.createDataFrame(rows, "k string, t int, id int, v double").repartition(5)
    values = {name: (kind, F.col("v")) for name, (kind, _) in VALUES.items()}
    got = scan.running(df, ["k"], ["t", "id"], values, inclusive, hot, 16)
    assert got.columns == ["k", "t", "id", "v", *VALUES]
    assert {r.id: (r.s, r.c, r.lo, r.hi, r.prev) for r in got.collect()} == by_definition(rows, inclusive)


def test_one_key_runs_in_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_000).alias("t"), F.lit(1.0).alias("v"))
    got = scan.running(df, ["k"], ["t"], {"s": ("sum", F.col("v"))}, hot_rows=1000, ranges=32)
    assert got.filter("s != t + 1").count() == 0
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 20_000 / 2


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 4.0)], "t int, v double")
    for hot in (100, 1):
        got = scan.running(df, [], ["t"], {"s": ("sum", F.col("v")), "p": ("lag", F.col("t"))}, hot_rows=hot, ranges=3)
        assert sorted((r.t, r.s, r.p) for r in got.collect()) == [(1, 2.0, None), (2, 6.0, 1), (3, 7.0, 2)]
    assert scan.running(df.limit(0), [], ["t"], {"s": ("sum", F.col("v"))}).count() == 0
    with pytest.raises(ValueError):
        scan.running(df, [], ["t"], {"s": ("avg", F.col("v"))})


def test_preparation_is_the_same_by_ranges(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.8 else 2, i, 1_700_000_000 + rng.randint(0, 40_000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, id int, s long").select("k", "id", F.timestamp_seconds("s").alias("ts"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s") % 700).cast("int")).alias("d0")).withColumn("d1", F.date_add("d0", 2)).cache()

    def all_of():
        return [sorted(map(tuple, x.collect()), key=str) for x in (events.rolling_thin(df, "k", "ts", "id", 60.0), events.gap_bins(df, "k", "ts", [10.0, 60.0]), events.coalesced(df, "k", "d0", "d1"))]

    plain = all_of()
    monkeypatch.setattr(scan.running, "__defaults__", (True, 100, 8))
    assert all_of() == plain and all(plain)
