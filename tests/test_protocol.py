"""Frozen plans and identities: digests add up, every drift is refused, chains of aliases are followed, gates hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import identity, protocol

ROWS = "role string, row_id string, grp string, stratum string, conditional array<double>, reference array<double>, weight double"
ARTIFACTS = {"model": b"model", "reference": b"reference"}


def forecast_rows(n=9, strata=("a", "b")):
    out = []
    for role, s, g in ((r, s, g) for r in protocol.ROLES[1:] for s in strata for g in range(n)):
        for k in range(3):
            p = 0.5 + 0.01 * g + 0.05 * k
            out.append((role, f"{role[0]}{s}{g}-{k}", f"{role[0]}{s}{g}", s, [p, 1 - p], [0.5, 0.5], 1.0 + k))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(forecast_rows(), ROWS).cache(), spark.createDataFrame([("t1", "a"), ("t2", "b")], "grp string, stratum string").cache()


@pytest.fixture(scope="module")
def plan(tables):
    return protocol.freeze(*tables, 2, 0.1, **ARTIFACTS).cache()


def outcomes(rows, role, state=0):
    return rows.filter(F.col("role") == role).select("row_id", F.lit(state).alias("state"))


def test_digests_add_up_in_any_order(spark, tables):
    rows, _ = tables
    whole = protocol.digest_sums(rows, protocol.forecast_fields(), "role").collect()
    a, b = rows.filter("weight > 1"), rows.filter("weight <= 1").repartition(7)
    parts = [protocol.digest_sums(x, protocol.forecast_fields(), "role") for x in (a, b)]
    assert sorted(map(tuple, protocol.merged(parts[0].unionByName(parts[1]), "role").collect())) == sorted(map(tuple, whole))
    texts = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "~"), ("~", None)], "x string, y string")
    assert texts.select(protocol.encoded([F.col("x"), F.col("y")])).distinct().count() == 4


def test_pipeline_and_coverage(tables, plan):
    rows, learnt = tables
    gains = protocol.scored(plan, rows, learnt, outcomes(rows, "calibration"), "calibration", **ARTIFACTS).cache()
    assert gains.count() == 18 and gains.filter("n_rows = 3").count() == 18
    digest = protocol.gains_digest(gains).first()["digest"]
    found = {r.stratum: r for r in protocol.validated(plan, gains, digest, rows, learnt, outcomes(rows, "validation"), **ARTIFACTS).collect()}
    assert {s: (r.n_calibration, r.n_validation, r["rank"], r.vacuous, r.coverage, r.n_positive) for s, r in found.items()} == {s: (9, 9, 1, False, 1.0, 9) for s in "ab"}
    shifted = protocol.validated(plan, gains, digest, rows, learnt, outcomes(rows, "validation", 1), **ARTIFACTS)
    assert {r.coverage for r in shifted.collect()} == {0.0}  # a loss is seen, nothing is fitted again
    with pytest.raises(ValueError, match="calibration gains differ"):
        protocol.validated(plan, gains.withColumn("gain", F.col("gain") + 1e-6), digest, rows, learnt, outcomes(rows, "validation"), **ARTIFACTS)
    other = gains.filter("grp != 'ca0'")
    with pytest.raises(ValueError, match="not those of the plan"):
        protocol.validated(plan, other, protocol.gains_digest(other).first()["digest"], rows, learnt, outcomes(rows, "validation"), **ARTIFACTS)


def test_changed_missing_and_doubled_rows_are_refused(tables, plan):
    rows, learnt = tables
    hit = F.col("row_id") == "ca0-1"
    cases = {
        "calibration changed": rows.withColumn("weight", F.when(hit, 9.0).otherwise(F.col("weight"))), "calibration rows_missing": rows.filter(~hit), "calibration rows_added": rows.unionByName(rows.filter(hit)),
        "calibration rows_missing, validation rows_added": rows.withColumn("role", F.when(hit, "validation").otherwise(F.col("role"))),
    }
    for said, drifted in cases.items():
        with pytest.raises(ValueError, match=said):
            protocol.scored(plan, drifted, learnt, outcomes(rows, "calibration"), "calibration", **ARTIFACTS)
    swapped = rows.filter("row_id not in ('ca0-1', 'ca0-2')").unionByName(rows.filter("row_id = 'ca0-1'")).unionByName(rows.filter("row_id = 'ca0-1'"))
    assert {r.role: r.status for r in protocol.role_audit(plan, swapped, learnt).collect()} == {"training": "unchanged", "calibration": "changed", "validation": "unchanged"}
    with pytest.raises(ValueError, match="training changed"):
        protocol.assert_unchanged(plan, rows, learnt.withColumn("stratum", F.lit("a")), **ARTIFACTS)
    with pytest.raises(ValueError, match="model differs"):
        protocol.assert_unchanged(plan, rows, learnt, b"other", b"reference")
    with pytest.raises(ValueError, match="plan itself"):
        protocol.assert_unchanged(plan.withColumn("alpha", F.lit(0.2)), rows, learnt, **ARTIFACTS)


def test_outcomes_must_fit_their_role(tables, plan):
    rows, learnt = tables
    mine = outcomes(rows, "calibration")
    cases = {
        "missing": mine.limit(3), "of_another_role": mine.unionByName(outcomes(rows, "validation")), "doubled": mine.unionByName(mine.limit(1)), "unknown_state": outcomes(rows, "calibration", 2),
    }
    for said, given in cases.items():
        with pytest.raises(ValueError, match=said):
            protocol.scored(plan, rows, learnt, given, "calibration", **ARTIFACTS)


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"row_id": "ca0-0"}, "repeated_row"), ({"grp": "va1"}, "crossing_group"), ({"grp": "t1"}, "training_overlap"), ({"stratum": "b"}, "crossing_group"), ({"grp": " x"}, "bad_name"), ({"role": "training"}, "unknown_role"),
        ({"conditional": [0.5, 0.6]}, "bad_probabilities"), ({"conditional": [1.0, 0.0]}, "bad_probabilities"), ({"reference": [0.5]}, "bad_probabilities"), ({"conditional": None}, "bad_probabilities"),
        ({"weight": 0.0}, "bad_weight"), ({"weight": float("nan")}, "bad_weight"), ({"weight": None}, "bad_weight"), ({"role": "validation", "grp": "new", "stratum": "z"}, "stratum_without_calibration"),
    ],
)
def test_freeze_refuses(spark, tables, change, problem):
    names = ["role", "row_id", "grp", "stratum", "conditional", "reference", "weight"]
    rows = forecast_rows()
    rows[1] = tuple((dict(zip(names, rows[1], strict=True)) | change)[n] for n in names)
    assert problem in {r.problem for r in protocol.plan_problems(spark.createDataFrame(rows, ROWS), tables[1], 2).collect()}


def test_thin_stratum_is_vacuous_and_groups_weigh_equally(spark, tables):
    rows = spark.createDataFrame(forecast_rows(n=8), ROWS)
    plan = protocol.freeze(rows, tables[1], 2, 0.1, **ARTIFACTS)
    gains = protocol.scored(plan, rows, tables[1], outcomes(rows, "calibration"), "calibration", **ARTIFACTS)
    out = protocol.coverage(gains, gains, 0.1).first()
    assert out.vacuous and out.bound == float("-inf") and out.coverage == 1.0


UNITS = "role string, unit string, grp string, stratum string, source string, cluster string, ring string, tag string"


def unit_rows(n=9):
    return [(role, f"{role[0]}{i}", f"{role[0]}{i}", "a", "s", f"c{i % 3}", f"r{role}{i}", None) for role in protocol.ROLES for i in range(n)]


def test_entities_equal_union_find(spark):
    rng = random.Random(6)
    rows = [(f"u{i:03d}", f"k{rng.randrange(150)}" if rng.random() < 0.8 else None, f"k{rng.randrange(170)}" if rng.random() < 0.7 else None) for i in range(200)]
    rows += [(f"z{i:03d}", f"c{i}", f"c{i + 1}") for i in range(90)]  # one long chain, over values of two keys
    rows += [(f"y{i:03d}", f"d{i // 2}", f"e{(i + 1) // 2}") for i in range(90)]
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in (1, 2):
        seen = {}
        for r in rows:
            if r[k] is not None:
                a, b = sorted((top(r[0]), top(seen.setdefault(r[k], r[0]))))
                up[b] = a
    got = identity.entities(spark.createDataFrame(rows, "unit string, a string, b string"), "unit", ["a", "b"])
    assert {r.unit: r.entity for r in got.collect()} == {r[0]: top(r[0]) for r in rows}


def test_alias_chain_between_roles_is_caught(spark, tables):
    rows = unit_rows()
    rows.append(("training", "t0b", "t0", "a", "s", "c0", "rtraining0", "tag1"))  # a second name of t0, by its ring
    rows.append(("validation", "v0b", "v0", "a", "s", "c0", "other", "tag1"))  # and of v0, by the tag of that name
    rows.append(("validation", "v0c", "v0", "a", "s", "c0", "rvalidation0", "tag1"))
    met = identity.crossings(spark.createDataFrame(rows, UNITS), "unit", ["ring", "tag"]).filter("crosses").collect()
    assert [(r.n_units, r.n_groups, r.roles, r.reused) for r in met] == [(5, 2, "training,validation", True)]


def test_admission(spark):
    rows = unit_rows()
    groups = [(r[0], f"{r[1]}-0", r[2], "a", [0.5, 0.5], [0.5, 0.5], 1.0) for r in rows if r[0] != "training"]
    forecasts = spark.createDataFrame(groups, ROWS)
    learnt = spark.createDataFrame([(r[2], "a") for r in rows if r[0] == "training"], "grp string, stratum string")
    sources = {r: "s" for r in protocol.ROLES}

    def admitted(rows, attested=True):
        return identity.admit(spark.createDataFrame(rows, UNITS), "unit", ["ring", "tag"], forecasts, learnt, sources, 0.1, attested).first()

    gate = admitted(rows)
    assert (gate.n_training, gate.n_calibration, gate.n_validation, gate["rank"], gate.shared_clusters, gate.status) == (9, 9, 9, 1, 3, identity.PASSED)
    change = lambda i, **new: [tuple((dict(zip(UNITS.replace(" string", "").split(", "), r, strict=True)) | (new if k == i else {})).values()) for k, r in enumerate(rows)]
    for said, bad in {
        "entity_crossing_roles": change(0, ring="rvalidation3"), "entity_reused": change(0, ring="rtraining3"), "group_not_in_plan": [*rows, ("training", "x", "x", "a", "s", "c", "q", None)], "group_without_identity": rows[1:],
        "stratum_conflict": change(12, stratum="b"), "undeclared_source": change(3, source=None), "group_in_several_roles": [*rows, ("validation", "t0x", "t0", "a", "s", "c", None, None)],
    }.items():
        with pytest.raises(ValueError, match=said):
            admitted(bad)
    with pytest.raises(ValueError, match=identity.UNVERIFIED):
        admitted(rows, attested=False)
    few = [r for r in rows if r[1] != "c8"]
    forecasts = forecasts.filter("grp != 'c8'")
    with pytest.raises(ValueError, match=identity.VACUOUS):
        admitted(few)


def test_queries_stage_what_a_plan_binds(spark):
    """Orders met their customers anew, by a broadcast each time, in every check and digest."""
    from tessera.plans import protocols

    made = protocols._calibrated(spark, "/root/testdata/sf0.001")
    assert all("FileScan parquet" not in df._jdf.queryExecution().executedPlan().toString() for df in made)


def test_digest_sums_are_those_of_single_numbers(spark):
    import hashlib

    rows = spark.createDataFrame([(i,) for i in range(40)], "a long")
    got = protocol.digest_sums(rows, [rows.a]).first()
    hexes = [hashlib.sha256(f"{len(str(i))}:{i}".encode()).hexdigest() for i in range(40)]
    assert list(got.sums) == [sum(int(h[4 * k : 4 * k + 4], 16) for h in hexes) for k in range(16)] and got.n_rows == 40
    # sixteen conversions a row were much of a digest's work
    plan = protocol.digest_sums(rows, [rows.a])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == 6
