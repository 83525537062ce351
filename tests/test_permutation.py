"""Permutation in place: the same counts as by definition, for small and large sites, nulls and ties."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest

from tessera.operators import events

SCHEMA = "id long, site string, identity string, state int"


def made():
    rng = random.Random(5)
    rows = [(i, rng.choice(["p", "q", "r", None]), rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 2, None])) for i in range(300)]
    return [*rows, (900, "solo", "a", 1)]


def counted(rows, draws, label):
    out = Counter((-1, r[2], r[3]) for r in rows)
    for site in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == site), key=lambda r: r[0])
        for d in range(draws):
            mixed = sorted(mine, key=lambda r: (hashlib.md5(f"{label}|{d}|{r[0]}".encode()).hexdigest(), r[0]))
            out.update((d, m[2], r[3]) for r, m in zip(mine, mixed, strict=True))
    return out


def information(counts, draw):
    n = {(a, b): v for (d, a, b), v in counts.items() if d == draw}
    total = sum(n.values())
    by = [Counter(), Counter()]
    for (a, b), v in n.items():
        by[0][a] += v
        by[1][b] += v
    return sum(v / total * math.log(v * total / (by[0][a] * by[1][b])) for (a, b), v in n.items())


@pytest.mark.parametrize("site_rows", [1_000_000, 70, 0])
def test_counts_equal_the_definition(spark, site_rows):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.draw, r.identity, r.state): r.n for r in events.permutation_counts(df, "site", "identity", "state", 30, "t", site_rows).collect()}
    expected = counted(rows, 30, "t")
    assert got == dict(expected)
    row = events.permutation_null(df, "site", "identity", "state", 30, "t", site_rows).first()
    null = [information(expected, d) for d in range(30)]
    seen = information(expected, -1)
    assert math.isclose(row.observed, seen) and math.isclose(row.null_mean, sum(null) / 30) and row.p_value == (1 + sum(x >= seen - 1e-12 for x in null)) / 31


def test_rows_are_shuffled_once_whatever_the_draws(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    plans = [events.permutation_counts(df, "site", "identity", "state", draws, "t")._jdf.queryExecution().executedPlan().toString().count("Exchange hash") for draws in (2, 60)]
    assert plans[0] == plans[1]


def test_empty(spark):
    row = events.permutation_null(spark.createDataFrame([], SCHEMA), "site", "identity", "state", 3, "t").first()
    assert row.observed is None and row.p_value is None


def test_one_site_is_many_tasks_and_is_permuted_once(spark):
    df = spark.createDataFrame([(i, "p", "ab"[i % 2], i % 3) for i in range(60)], SCHEMA)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan(events.permutation_counts(df, "site", "identity", "state", 60, "t")).splitlines() if "Exchange hash" in line]
    assert any("__first" in line and "REPARTITION_BY_NUM" in line for line in exchanges)
    assert "FlatMapGroups" not in plan(events.permutation_null(df, "site", "identity", "state", 60, "t"))
