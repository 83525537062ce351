"""The registered sizes of jobs, and whole results where a smaller job was once done."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import events, robust
from tessera.plans import certification, preparation

SF = "/root/testdata/sf0.001"


def _information(pairs):
    n, joint = len(pairs), Counter(pairs)
    a, b = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    return sum(k / n * math.log(k * n / (a[x] * b[y])) for (x, y), k in joint.items())


def test_permutations_in_batches_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), "abc"[int(rng.integers(3))], int(rng.integers(4))) for i in range(90)]
    null = []
    for draw in range(23):
        pairs = []
        for site in range(3):
            own = [r for r in rows if r[1] == site]
            mixed = sorted(own, key=lambda r: (hashlib.md5(f"t|{draw}|{r[0]}".encode()).hexdigest(), r[0]))
            pairs += [(m[2], r[3]) for m, r in zip(mixed, own, strict=True)]
        null.append(_information(pairs))
    seen = _information([(r[2], r[3]) for r in rows])
    got = events.permutation_null(spark.createDataFrame(rows, "id long, site int, identity string, state int"), "site", "identity", "state", 23, "t", batch=10).first()
    assert math.isclose(got.observed, seen) and math.isclose(got.null_mean, sum(null) / 23)
    assert got.p_value == (1 + sum(x >= seen - 1e-12 for x in null)) / 24


def test_permutation_null_is_registered_with_all_permutations(spark):
    rows = spark.createDataFrame([(i, i % 2, "a" if i % 4 < 2 else "b", i % 4 // 2) for i in range(80)], "id long, site int, identity string, state int")
    assert events.permutation_null(rows, "site", "identity", "state", preparation.PERMUTATIONS, "t").first().p_value == 0.005
    assert "generate_series(0, 198)" in preparation.SQL["permutation_null"]


def test_bootstraps_are_registered_with_the_draws_of_the_reference(spark):
    for name in ("familywise_v1", "bootstrap_t_v2", "one_sided_t", "shared_block_t", "ladder_certification"):
        assert "generate_series(0, 3999)" in certification.SQL[name]
    assert {r.n_draws for r in certification.joint_reweight(spark, SF).collect()} == {1000}
    assert {r.worlds for r in certification.null_panel(spark, SF).collect()} == {1000}


def test_radius_is_bisected_to_the_end(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([("g", b, float(rng.normal(1, 1)), 1.0) for b in range(10) for _ in range(4)], "grp string, block int, gain double, w double").cache()
    radius = robust.robustness_radius(rows, 100, 1, steps=certification.BISECTIONS).first().radius
    lower = lambda gamma: robust.joint_extremes(rows, gamma, 100, 1).agg(F.min("lower")).first()[0]
    assert lower(radius) > 0 >= lower(radius * (1 + 1e-9))
