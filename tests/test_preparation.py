import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import decisions, events, novelty, normalize, provenance
from tessera.sources import contracts, tables
from tessera.streaming import thinning


def test_reasons_come_in_order(spark):
    rows = spark.createDataFrame([(1, -5.0), (None, -5.0), (2, 3.0), (3, None)], "id int, v double")
    got = events.with_reason(rows, [("no_id", F.col("id").isNull()), ("negative", F.col("v") < 0)])
    assert [r.reason for r in got.collect()] == ["negative", "no_id", None, None]


def _times(spark, seconds):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, i, base + dt.timedelta(seconds=s)) for k in (1, 2) for i, s in enumerate(seconds)], "user_id long, event_id long, ts timestamp")


def test_rolling_rule_counts_from_the_last_kept(spark):
    rows = _times(spark, [0, 40, 70, 100, 135, 400, 401])
    got = sorted(r.event_id for r in events.rolling_thin(rows, "user_id", "ts", "event_id", 60).filter("user_id = 1").collect())
    assert got == [0, 2, 4, 5]


def test_intervals_merge_with_slack(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([("a", d(1), d(3)), ("a", d(4), d(5)), ("a", d(7), d(9)), ("a", d(2), d(2)), ("b", d(1), d(1))], "k string, s date, e date")
    got = sorted(tuple(r) for r in events.coalesced(rows, "k", "s", "e").collect())
    assert got == [("a", d(1), d(5), 5), ("a", d(7), d(9), 3), ("b", d(1), d(1), 1)]


def test_split_and_folds_are_stable(spark):
    groups = spark.createDataFrame([(i, i % 2) for i in range(20)], "g long, s int")
    a, b = (sorted(tuple(r) for r in events.hash_split(x, "g", "s", "v1", 0.3).collect()) for x in (groups, groups.union(groups).repartition(5)))
    assert a == b and sum(r[2] == "heldout" for r in a) == 6
    assert events.hash_folds(groups, "g", "s", "v1", 5).groupBy("fold").count().filter("count != 4").count() == 0


def test_permutation_sees_structure(spark):
    rows = spark.createDataFrame([(i, i % 2, "a" if i % 4 < 2 else "b", i % 4 // 2) for i in range(80)], "id long, site int, identity string, state int")
    got = events.permutation_null(rows, "site", "identity", "state", 19, "t").first()
    assert got.observed > got.null_mean and got.p_value == 0.05


@pytest.mark.parametrize(("raw", "precision", "basis"), [
    ("2020", "year", "date_only"), ("2020-05", "month", "date_only"), ("2020-13", "unknown", "unknown"), ("2020-02-30", "unknown", "unknown"), (" 2020-02-29 ", "day", "date_only"),
    ("2020-02-29T10:15", "minute", "source_local_unknown_timezone"), ("2020-02-29T10:15:30Z", "second", "utc"), ("2020-02-29 10:15:30+05:30", "second", "source_offset"), ("2020-01-01/2020-02-01", "interval", "interval"), ("", "unknown", "unknown"), (None, "unknown", "unknown"), ("noon", "unknown", "unknown"),
])
def test_time_keeps_its_precision(spark, raw, precision, basis):
    got = spark.createDataFrame([(raw,)], "raw string").select(normalize.temporal(F.col("raw")).alias("t")).first().t
    assert (got.precision, got.clock_basis) == (precision, basis)
    assert got.hour is None or precision in ("minute", "second")


def test_vertical_precedence(spark):
    rows = spark.createDataFrame([("5", "1", "2", None), ("5", None, None, None), (None, "3", "2", "canopy"), ("x", None, None, None)], "v string, lo string, hi string, layer string")
    got = normalize.vertical(rows, normalize.VerticalFields("organism_depth", "v", "lo", "hi", "layer", default_reference="surface")).collect()
    assert [r.v_precision for r in got] == ["interval", "point", "categorical", "unknown"] and [r.v_usable for r in got] == [False] * 4
    assert "vertical_interval_reversed" in got[2].v_flags and "vertical_unit_missing" in got[0].v_flags


def test_novelty_labels(spark):
    ref = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<double>")
    q = spark.createDataFrame([(100, [3.0, 1.0]), (101, [500.0, 1.0])], "id long, v array<double>")
    got = {r.id: r.label for r in novelty.novelty(q, ref, "id", "v").collect()}
    assert got == {100: "familiar", 101: "novel"}


def test_alignment_and_leakage(spark):
    base = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "row_id int, position int")
    for other, expected in (([(1, 0), (2, 1), (3, 2)], "exact"), ([(2, 0), (1, 1), (3, 2)], "reorderable"), ([(1, 0), (2, 1)], "mismatch"), ([(1, 0), (1, 0), (2, 1), (3, 2)], "mismatch")):
        assert provenance.row_alignment(base, spark.createDataFrame(other, "row_id int, position int")).first().alignment == expected
    got = provenance.leakage(spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,), (3,)], "k int"), "k").first()
    assert (got.leaked_ids, got.leaked_rows, got.training_duplicates, got.category) == (1, 2, 1, "leakage")


def test_chain_audit_finds_forgery(spark):
    previous, log = provenance.GENESIS, []
    for i in range(5):
        body = {"event": f"e{i}é", "previous_event_hash": previous}
        own = provenance.fingerprint(body)
        log.append(("c", i, body["event"], previous, own))
        previous = own
    columns = "chain string, sequence_index int, event string, previous_event_hash string, event_hash string"
    assert tuple(provenance.chain_audit(spark.createDataFrame(log, columns), ("event",)).first())[1:] == (5, 0, 0, 0)
    forged = [(*r[:2], "x", *r[3:]) if r[1] == 2 else r for r in log if r[1] != 3]
    assert tuple(provenance.chain_audit(spark.createDataFrame(forged, columns), ("event",)).first())[1:] == (4, 1, 1, 1)


def test_blob_id_is_that_of_git():
    assert provenance.blob_id(b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_gates_block_later_layers(spark):
    rows = spark.createDataFrame([("a", 1, "x", "pass"), ("a", 2, "y", "fail"), ("a", 3, "z", "unavailable"), ("b", 1, "x", "unavailable"), ("c", 1, "x", "pass")], "subject string, position int, layer string, status string")
    got = {r.subject: (r.decision, r.blocking_layer, r.not_run) for r in decisions.gate_ladder(rows).collect()}
    assert got == {"a": ("not_certified", "y", 1), "b": ("unavailable", None, 0), "c": ("certified", None, 0)}
    assert decisions.operational_status("blocked", "certified") == "base_blocked" and decisions.operational_status("ok", "certified", ["w"]) == "certified_with_warnings"


def test_contract_runs_over_csv_and_json(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿event_id,site,s0,s1\n1,a,-2,-1\n2,a,-2,-inf\n3,b,-2,-1\n")
    contract = {"schema_version": "1", "data": "s.csv", "format": "csv", "row_id": "event_id", "group": "site", "levels": ["s0", "s1"]}
    got = contracts.run_transfer(spark, contract, f"file://{tmp_path}")["result"]
    assert got["ceiling"] == 0 and got["steps"][0]["category"] == "mixed"
    (tmp_path / "s.json").write_text(json.dumps([{"event_id": i, "site": "a", "s0": -2.0, "s1": -1.0} for i in range(3)]))
    assert contracts.run_transfer(spark, contract | {"data": "s.json", "format": "json"}, f"file://{tmp_path}")["result"]["ceiling"] == 1
    with pytest.raises(contracts.ContractError):
        contracts.run_transfer(spark, contract | {"extra": 1}, str(tmp_path))
    (tmp_path / "d.csv").write_text("event_id,site,s0,s1\n1,a,-2,-1\n1,a,-2,-1\n")
    with pytest.raises(contracts.ContractError):
        contracts.run_transfer(spark, contract | {"data": "d.csv"}, f"file://{tmp_path}")


def test_strict_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,y\nbad,z\n")
    df = tables.read_csv(spark, f"file://{tmp_path}/t.csv", ["a", "b"])
    assert [(r.a, r.malformed) for r in tables.typed(df, {"a": "int"}).collect()] == [(1, False), (None, False), (None, True)]
    with pytest.raises(tables.ColumnMismatch):
        tables.exact_columns(df, ["a"])
    assert tables.normal_name("﻿Start Date") == "startdate"


def test_streaming_thinning_equals_batch(spark, tmp_path):
    rows = _times(spark, [0, 40, 70, 100, 135, 400, 401])
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = thinning.rolling_thin(source, "user_id", "ts", "event_id", 60).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        streamed = sorted((r.user_id, r.event_id) for r in spark.sql("select * from kept").collect())
    finally:
        query.stop()
    assert streamed == sorted((r.user_id, r.event_id) for r in events.rolling_thin(rows, "user_id", "ts", "event_id", 60).collect())


def _refits(scores, **more):
    part = {"familywise_confidence_level": 0.9, "nested_draws": 500, "seed": 3, "minimum_refits": 2, "minimum_blocks_per_group": 2, "gain_tolerance": 0.0} | more
    true = ("heldout_predictions", "same_rows_across_levels", "same_rows_across_refits", "heldout_outcome_not_used_for_prediction_or_selection", "filtration_frozen_before_outcome_scoring", "refit_scheme_frozen_before_outcome_scoring")
    return {
        "schema_version": 1, "endpoint_id": "e", "data": {"path": scores, "format": "csv"}, "columns": {"row_id": "id", "refit_id": "fit", "group": "g", "block": "b"},
        "score": {"kind": "log", "name": "log", "orientation": "higher_is_better", "common_scoring_rule": True, "common_reference_measure": True},
        "evaluation": {"analysis_mode": "descriptive", "refit_independence_assumed": False, "refit_mixture_weighting": "uniform"} | dict.fromkeys(true, True),
        "levels": [{"name": n, "information": i, "score_column": c} for n, i, c in (("none", [], "s0"), ("place", ["xy"], "s1"), ("time", ["xy", "t"], "s2"))], "certification": part,
    }


def _refit_rows(top):
    head = "id,fit,g,b,s0,s1,s2\n"
    return head + "".join(f"{i},{f},{'ab'[i % 2]},{i // 4},-3,{-2 - 0.01 * i - 0.1 * f},{top(i, f)}\n" for f in range(3) for i in range(16))


def test_refit_contract_certifies_steps_over_all_refits(spark, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / "r.csv").write_text(_refit_rows(lambda i, f: -1.9 if f == 0 else -9))
    got = contracts.run_refits(spark, _refits("r.csv"), folder)["result"]
    assert got["steps"][1] == "all_positive" and got["steps"][2] != "all_positive" and got["ceiling"] == "place"
    assert got["point_ceilings"] == {"0": "time", "1": "place", "2": "place"} and got["reference_point_ceiling"] == "time"
    assert got["reference_ceiling"] == "time" and len(got["reference_cells"]) == 4 and all(c["lower"] > 0 for c in got["reference_cells"])
    assert contracts.run_refits(spark, _refits("r.csv", minimum_refits=4), folder)["result"]["steps"] == {1: "unavailable", 2: "unavailable"}
    (tmp_path / "r.csv").write_text(_refit_rows(lambda i, f: "-inf" if i == 0 else -1))
    assert contracts.run_refits(spark, _refits("r.csv"), folder)["result"]["steps"][2] == "unavailable"


def test_refit_contract_refuses(spark, tmp_path):
    good = _refits("r.csv")
    rows = _refit_rows(lambda i, f: -1)
    for part, change in (("score", {"common_reference_measure": None}), ("evaluation", {"refit_independence_assumed": True}), ("evaluation", {"same_rows_across_refits": False}), ("evaluation", {"analysis_mode": "confirmatory"}), ("certification", {"nested_draws": 499}), ("certification", {"seed": True}), ("columns", {"weight": "g"}), ("data", {"path": " "})):
        with pytest.raises(contracts.ContractError):
            contracts.refit_contract(good | {part: good[part] | change})
    with pytest.raises(contracts.ContractError):
        contracts.refit_contract(good | {"levels": good["levels"][::-1]})
    bad = [rows + "0,0,a,0,-3,-2,-1\n", rows + "99,0,a,0,-3,-2,-1\n", rows.replace("5,2,b,1,", "5,2,b,0,"), rows.replace("5,2,b,1,-3,", "5,2,b,1,-inf,"), rows.replace("5,2,b,1,", "5,2,,1,"), rows.split("\n")[0] + "\n"]
    for text in bad:
        (tmp_path / "r.csv").write_text(text)
        with pytest.raises(contracts.ContractError):
            contracts.run_refits(spark, good, f"file://{tmp_path}")


def test_occurrence_times_come_from_several_fields(spark):
    cases = [
        ("2020-05-01", "10:30", "2020", "5", "1", "minute", "timezone_missing"), ("2020-05-01", "10:30:15Z", None, None, None, "second", ""), (None, None, "2020", "5", None, "month", "date_only"),
        ("soon", None, "2020", "5", "7", "day", "date_only"), ("2020-05-01", None, "2020", "5", "2", "day", "date_field_mismatch,date_only"), ("2020-05-01", "noon", None, None, None, "day", "date_only,unparsed_event_time"),
        ("2020-05", "10:30", None, None, None, "month", "date_only,time_without_complete_date"), (None, None, None, "5", "1", "unknown", "missing_or_unparsed_observation_time"), ("2020-05-01/2020-05-03", "10:30", "2021", "1", "1", "interval", "interval"),
    ]
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, eventDate string, eventTime string, year string, month string, day string")
    assert [tuple(r) for r in normalize.occurrence_time(rows).orderBy("i").select("t.precision", "t_flags").collect()] == [c[5:] for c in cases]
    assert normalize.occurrence_time(rows.select("i", "eventDate")).filter("t.precision = 'day'").count() == 4


def test_portal_times_never_use_management_stamps(spark):
    cases = [
        ("2020-05-01T10:30:00+02:00", "2020-05-01T08:30:00Z", "2020-05-01", None, "second", 1588321800, ""), ("2020-05-01T10:30:00+02:00", "2020-05-01T09:30:00Z", None, None, "second", 1588321800, "utc_timestamp_mismatch"),
        (None, "2020-05-01T08:30:00Z", "2020-05-02", None, "day", 1588321800, "date_only"), (None, None, None, "2020-05-01T08:30:00Z", "unknown", None, "missing_or_unparsed_observation_time,record_management_timestamp_present_not_used"),
        ("2020-05-01T10:30", None, "2020-05-02", None, "minute", None, "date_field_mismatch,timezone_missing"),
    ]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, time_observed_at string, time_observed_at_utc string, observed_on string, created_at string")
    assert [tuple(r) for r in normalize.portal_time(rows).orderBy("i").select("t.precision", "t_utc_seconds", "t_flags").collect()] == [c[4:] for c in cases]
