import hashlib
import math

import numpy as np
import pytest

from tessera.operators import refits, resample

INF = float("-inf")
CELLS = "refit int, grp string, level int, block int, num double, w double"
ROWS = "refit int, grp string, block int, num double, w double"


def frame(spark, gain, n_refits=3, groups="ab", levels=(1, 2), blocks=9):
    rng = np.random.default_rng(3)
    noise = rng.uniform(-1, 1, (n_refits, len(groups), len(levels) + 1, blocks))
    rows = []
    for r in range(n_refits):
        for i, g in enumerate(groups):
            for n in levels:
                for b in range(blocks):
                    x, w = gain(r, g, n, b), 1.0 + b % 3
                    rows.append((r, g, n, b, float(w * (x + 0.05 * noise[r, i, n - levels[0], b])), w))
    return rows, spark.createDataFrame(rows, CELLS)


def pick(size, *parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:12], 16) % size


def error(num, w, t):
    n = len(num)
    mean = np.sum(t * num) / np.sum(t * w)
    return mean, math.sqrt(max(0.0, np.sum(t * (num - mean * w) ** 2) * n / (n - 1))) / np.sum(t * w)


@pytest.mark.parametrize("shared", [False, True])
def test_bounds_equal_brute_force(spark, shared):
    draws, seed = 60, 5
    rows, table = frame(spark, lambda r, g, n, b: 0.3 - 0.2 * (n - 1) - 0.03 * r)
    got = {(r.refit, r.grp, r.level): r for r in refits.refit_bounds(table, draws, seed, 0.1, shared=shared).collect()}
    cells = {}
    for r, g, n, b, num, w in rows:
        cells.setdefault((r, g, n), []).append((b, num, w))
    assert len(got) == len(cells) == 12
    for refit in range(3):
        highest = []
        for d in range(draws):
            stats = []
            for (r, g, n), held in cells.items():
                if r == refit:
                    _, num, w = (np.array(x) for x in zip(*sorted(held), strict=True))
                    taken = np.bincount([pick(len(num), *([seed] if shared else [seed, g]), d, k) for k in range(len(num))], minlength=len(num))
                    mean, _ = error(num, w, np.ones(len(num)))
                    m, se = error(num, w, taken)
                    stats.append((m - mean) / se)
            highest.append(max(stats))
        critical = max(0.0, sorted(highest)[math.ceil(0.9 * (draws - 1))])
        for (r, g, n), held in cells.items():
            if r == refit:
                _, num, w = (np.array(x) for x in zip(*sorted(held), strict=True))
                mean, se = error(num, w, np.ones(len(num)))
                row = got[r, g, n]
                assert np.allclose([row["mean"], row.se, row.critical, row.lower], [mean, se, critical, mean - critical * se])


def test_all_refits_must_pass(spark):
    _, table = frame(spark, lambda r, g, n, b: 0.5 if n == 1 or r < 2 else -0.5)
    cells = refits.refit_bounds(table, 100, 1).cache()
    steps = {r.level: r for r in refits.across_refits(refits.refit_steps(cells)).collect()}
    assert steps[1].category == "robust_across_refits" and (steps[2].robust_refits, steps[2].not_robust_refits, steps[2].category) == (2, 1, "not_robust_across_refits")
    got = {r.refit: r for r in refits.refit_ceilings(cells).collect()}
    assert [(got[r].certified_ceiling, got[r].point_ceiling) for r in range(3)] == [(2, 2), (2, 2), (1, 1)]
    assert {(r.all_refit_ceiling, r.stability) for r in got.values()} == {(1, "refit_sensitive")}
    few = refits.refit_ceilings(cells, min_refits=4).collect()
    assert {(r.all_refit_ceiling, r.certified_ceiling) for r in few} == {(0, 2), (0, 1)}
    assert {r.category for r in refits.across_refits(refits.refit_steps(cells), 4).collect()} == {"unavailable"}
    lacking = refits.refit_steps(cells.filter("refit < 2 or level = 1"))
    assert {r.level: r.category for r in refits.across_refits(lacking).collect()} == {1: "robust_across_refits", 2: "unavailable"}
    assert {r.all_refit_ceiling for r in refits.refit_ceilings(cells.filter("refit < 2 or level = 1")).collect()} == {1}


def test_a_later_step_lifts_nothing_past_a_failed_one(spark):
    _, table = frame(spark, lambda r, g, n, b: -0.5 if n == 1 else 0.5)
    got = refits.refit_ceilings(refits.refit_bounds(table, 60, 1)).collect()
    assert {(r.certified_ceiling, r.point_ceiling, r.all_refit_ceiling, r.stability) for r in got} == {(0, 0, 0, "stable")}


def test_unavailable_cells_leave_the_others_as_they_are(spark):
    gain = lambda r, g, n, b: 0.5
    rows, table = frame(spark, gain)
    sound = {(r.refit, r.grp, r.level): r.lower for r in refits.refit_bounds(table.filter("refit != 1 or grp != 'a' or level != 2"), 80, 2).collect()}
    for broken in (table.filter("refit != 1 or grp != 'a' or level != 2 or block != 4"), spark.createDataFrame([(r, g, n, b, INF if (r, g, n, b) == (1, "a", 2, 0) else x, w) for r, g, n, b, x, w in rows], CELLS)):
        got = {(r.refit, r.grp, r.level): r for r in refits.refit_bounds(broken, 80, 2).collect()}
        out = got.pop((1, "a", 2))
        assert out.status == "unavailable" and out.lower is None and out.critical is None
        assert {k: r.lower for k, r in got.items()} == pytest.approx(sound)
    assert refits.refit_steps(refits.refit_bounds(broken, 80, 2)).filter("category = 'unavailable'").count() == 1
    assert {r.status for r in refits.refit_bounds(table.filter("block < 5"), 80, 2).collect()} == {"unavailable"}


def test_shared_blocks_must_be_the_same_in_all_groups(spark):
    _, table = frame(spark, lambda r, g, n, b: 0.5)
    other = table.selectExpr("refit", "grp", "level", "block + if(grp = 'b', 100, 0) as block", "num", "w")
    assert {r.status for r in refits.refit_bounds(other, 50, 1, shared=True).collect()} == {"unavailable"}
    assert {r.status for r in refits.refit_bounds(table, 50, 1, shared=True).collect()} == {"robust_positive"}
    assert refits.refit_bounds(table.filter("w < 0"), 50, 1).count() == 0


def test_constant_blocks_are_their_own_bound(spark):
    rows = spark.createDataFrame([(r, g, 1, b, x, 1.0) for r in range(2) for g, x in (("p", 0.5), ("n", 0.0)) for b in range(8)], CELLS)
    got = {(r.refit, r.grp): (r.lower, r.status) for r in refits.refit_bounds(rows, 50, 1).collect()}
    assert got == {(r, g): v for r in range(2) for g, v in (("p", (0.5, "robust_positive")), ("n", (0.0, "not_robust_positive")))}


def test_sign_stability(spark):
    def told(signs):
        rows = [(r, g, b, float(s[r]), 1.0) for g, s in signs.items() for r in range(len(s)) for b in range(2)]
        got = refits.sign_stability(spark.createDataFrame(rows, ROWS)).collect()
        assert len({r.stability for r in got}) == 1
        return got[0].stability, {r.grp: (r.positive_refits, r.other_refits) for r in got}

    assert told({"a": (1, 1), "b": (2, 1)}) == ("stable_generalizing", {"a": (2, 0), "b": (2, 0)})
    assert told({"a": (-1, 0)})[0] == "stable_non_generalizing"
    assert told({"a": (1, 1), "b": (-1, INF)})[0] == "stable_mixed"
    assert told({"a": (1, 1), "b": (-1, 1)})[0] == "refit_sensitive"


def test_schemes_agree_or_not(spark):
    def scheme(gain, n_refits=3):
        return frame(spark, lambda r, g, n, b: gain, n_refits, levels=(1,))[1].drop("level")

    run = lambda **s: {r.scheme: r for r in refits.scheme_sensitivity(s, 100, 1, min_refits=3).collect()}
    got = run(x=scheme(0.5), y=scheme(0.7))
    assert {r.sensitivity for r in got.values()} == {"scheme_robust_generalizing"} and got["y"].min_lower > got["x"].min_lower and got["x"].n_refits == 3
    nested = resample.nested_refits(scheme(0.5), 100, 1, min_blocks=8).collect()
    assert got["x"].min_lower == pytest.approx(min(r.lower for r in nested)) and got["x"].max_upper == pytest.approx(max(r.upper for r in nested))
    assert {r.sensitivity for r in run(x=scheme(0.5), y=scheme(-0.5)).values()} == {"scheme_sensitive"}
    assert {r.sensitivity for r in run(x=scheme(-0.4), y=scheme(-0.5)).values()} == {"scheme_robust_non_generalizing"}
    assert {r.sensitivity for r in run(x=scheme(0.0), y=scheme(0.0)).values()} == {"stable_uncertain"}
    few = run(x=scheme(0.5), y=scheme(0.5, 2))
    assert few["y"].category == "unavailable" and few["y"].min_lower is None and {r.sensitivity for r in few.values()} == {"unavailable"}


def test_schemes_are_audited_on_the_same_rows_only(spark):
    rows = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "row_id string, position int")
    status = lambda **s: {r.scheme: (r.alignment, r.status) for r in refits.scheme_alignment(rows("abc"), {k: rows(v) for k, v in s.items()}).collect()}
    assert status(x="abc", y="abc") == {"x": ("exact", "audited_exact_alignment"), "y": ("exact", "audited_exact_alignment")}
    assert status(x="abc", y="bac")["x"] == ("exact", "audited_reordered_alignment")
    assert status(x="bac", y="abd") == {"x": ("reorderable", "row_mismatch"), "y": ("mismatch", "row_mismatch")}
    assert status(x="abcc")["x"] == ("mismatch", "row_mismatch")
