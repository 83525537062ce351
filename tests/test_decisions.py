"""Decision tables, the handoff decision over all its inputs, and dossiers below failed audits."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import decisions

INPUTS = "scope string, semantics string, declared boolean, frozen boolean, estimable boolean, transfer string"


def decided(spark, *rows):
    return decisions.handoff(spark.createDataFrame(rows, INPUTS)).collect()


@pytest.mark.parametrize(
    ("given", "category", "allowed", "reasons"),
    [
        (("empirical", "species_support", True, True, True, "generalizing"), "empirical_axis_resolved_supported", (True, False, True), []),
        (("empirical", "species_support", True, True, True, "non_generalizing"), "descriptive_projection_only", (True, False, False), ["independent_axis_resolved_organization_not_generalizing"]),
        (("empirical", "species_support", True, True, True, "mixed"), "descriptive_projection_only", (True, False, False), ["independent_axis_resolved_organization_mixed"]),
        (("empirical", "species_support", True, True, False, "unavailable"), "unavailable", (False, False, False), ["thickness_not_estimable"]),
        (("known_truth", "species_support", True, False, True, "generalizing"), "known_truth_method_state_only", (True, True, False), ["known_truth_state_not_empirical_species_evidence"]),
        (("empirical", "structural_capacity", True, True, True, "generalizing"), "structural_capacity_only", (True, False, False), ["structural_capacity_is_not_species_support"]),
        (("empirical", "species_support", True, False, True, "generalizing"), "descriptive_projection_only", (True, False, False), ["empirical_source_boundary_not_prospectively_frozen"]),
        (("empirical", "species_support", False, False, False, "not_tested"), "unavailable", (False, False, False), ["added_axis_semantics_not_declared", "thickness_not_estimable", "empirical_source_boundary_not_prospectively_frozen"]),
    ],
)
def test_handoff_cases(spark, given, category, allowed, reasons):
    row = decided(spark, given)[0]
    assert (row.category, (row.summary_allowed, row.method_allowed, row.empirical_allowed), row.reasons) == (category, allowed, reasons)


def test_permissions_never_contradict(spark):
    every = list(itertools.product(decisions.SCOPES, decisions.SEMANTICS, (True, False), (True, False), (True, False), decisions.TRANSFER))
    for r in decided(spark, *every):
        assert not (r.method_allowed and r.empirical_allowed) and (r.summary_allowed or not (r.method_allowed or r.empirical_allowed))
        assert (r.category == "empirical_axis_resolved_supported") == r.empirical_allowed and (r.category == "known_truth_method_state_only") == r.method_allowed
        assert (r.reasons == []) == r.empirical_allowed


@pytest.mark.parametrize("bad", [("other", "species_support", True, True, True, "mixed"), ("empirical", "species_support", None, True, True, "mixed"), ("empirical", "species_support", True, True, True, None)])
def test_undeclared_inputs_are_errors(spark, bad):
    with pytest.raises(Exception, match="unsupported"):
        decided(spark, bad)


def test_first_match_goes_by_priority(spark):
    rules = [({"x": (1, 2)}, {"y": "low"}), ({"x": 2}, {"y": "never"}), ({"x": None}, {"y": "null"})]
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int").select("x", decisions.first_match(rules)["y"].alias("y"))
    assert {r.x: r.y for r in rows.collect()} == {1: "low", 2: "low", 3: None, None: "null"}


BASE = "subject string, base_validation string, base_certification string, statistical_reasons array<string>, provenance_reasons array<string>, warnings array<string>"


def dossiers(spark, base, statuses):
    layers = [("s", i, f"l{i}", s) for i, s in enumerate(statuses)]
    audits = spark.createDataFrame(layers, "subject string, position int, layer string, status string")
    return decisions.dossier(spark.createDataFrame([("s", *base)], BASE), audits).first()


def test_clean_audits_keep_the_base(spark):
    row = dossiers(spark, ("admitted", "certified", [], [], []), ["pass", "pass"])
    assert (row.failed_layer, row.certification, row.operational, row.trace) == (None, "certified", "admitted", ["l0:pass", "l1:pass", "certification:certified", "operational:admitted"])
    assert dossiers(spark, ("admitted", "certified", [], [], ["thin"]), ["pass"]).operational == "admitted_with_warnings"


def test_mismatch_stops_everything_below(spark):
    row = dossiers(spark, ("admitted", "certified", ["s1"], ["p1", "l1_mismatch"], ["w"]), ["pass", "mismatch", "pass", "mismatch"])
    assert (row.failed_layer, row.certification, row.operational) == ("l1", "unavailable", "admitted_extended_unavailable")
    assert row.trace[:4] == ["l0:pass", "l1:mismatch", "l2:not_run_l1_mismatch", "l3:not_run_l1_mismatch"]
    assert row.provenance_reasons == ["p1", "l1_mismatch"] and row.statistical_reasons == ["s1"] and row.warnings == ["w"]


@pytest.mark.parametrize(
    ("base", "expected"),
    [(("unavailable", "certified"), ("unavailable", "unavailable")), (("blocked", "certified"), ("not_certified", "blocked")), (("admitted", "not_certified"), ("not_certified", "admitted_extended_not_certified")), (("admitted", "unavailable"), ("unavailable", "admitted_extended_unavailable"))],
)
def test_a_mismatch_never_raises_the_base(spark, base, expected):
    for statuses in (["mismatch", "pass"], ["pass"]):
        row = dossiers(spark, (*base, [], [], []), statuses)
        assert (row.certification, row.operational) == expected


def test_subject_without_audits(spark):
    audits = spark.createDataFrame([], "subject string, position int, layer string, status string")
    row = decisions.dossier(spark.createDataFrame([("s", "admitted", "certified", [], [], [])], BASE), audits).first()
    assert row.certification == "certified" and row.trace == ["certification:certified", "operational:admitted"] and decisions.effective_layers(audits).filter(F.lit(True)).count() == 0
