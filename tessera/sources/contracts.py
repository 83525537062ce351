"""JSON contracts: strict fields, digests of contract and data, and runs that end in a receipt."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.algebra import interval_status
from tessera.operators import ladder, resample, transfer
from tessera.operators.provenance import fingerprint
from tessera.operators.workflow import EventTable, cross_validated
from tessera.sources.tables import read_csv, read_json_records

# fixed values: fields of the contracts
ENDPOINT = {"schema_version": str, "data": str, "format": str, "state": str, "group": str, "stratum": str, "fold": str, "features": list, "model": str}
SCORES = {"schema_version": str, "data": str, "format": str, "row_id": str, "group": str, "levels": list}
REFITS = {"schema_version": int, "endpoint_id": str, "data": dict, "columns": dict, "score": dict, "evaluation": dict, "levels": list, "certification": dict}
REFIT_PARTS = {
    "data": {"path": str, "format": str},
    "columns": {"row_id": str, "refit_id": str, "group": str, "block": str},
    "score": {"kind": str, "name": str, "orientation": str, "common_scoring_rule": bool},
    "evaluation": {
        "analysis_mode": str, "heldout_predictions": bool, "same_rows_across_levels": bool, "same_rows_across_refits": bool,
        "heldout_outcome_not_used_for_prediction_or_selection": bool, "filtration_frozen_before_outcome_scoring": bool,
        "refit_scheme_frozen_before_outcome_scoring": bool, "refit_independence_assumed": bool, "refit_mixture_weighting": str,
    },
    "certification": {"familywise_confidence_level": float, "nested_draws": int, "seed": int, "minimum_refits": int, "minimum_blocks_per_group": int, "gain_tolerance": float},
}
REFIT_OPTIONAL = {"columns": "weight", "score": "common_reference_measure", "certification": "reference_refit_id"}
LEVEL = {"name": str, "information": list, "score_column": str}
MUST_HOLD = ("heldout_predictions", "same_rows_across_levels", "same_rows_across_refits", "heldout_outcome_not_used_for_prediction_or_selection")


class ContractError(ValueError):
    """A contract with unknown, missing or mistyped fields."""


def _is(value: object, kind: type) -> bool:
    """Whole numbers are floats too; booleans are neither; texts are not blank."""
    if isinstance(value, bool):
        return kind is bool
    if kind is str:
        return isinstance(value, str) and bool(value.strip())
    return isinstance(value, (int, float) if kind is float else kind)


def validated(contract: dict, fields: dict[str, type], optional: tuple[str, ...] = ("weight", "block")) -> dict:
    unknown, missing = sorted(set(contract) - set(fields) - set(optional)), sorted(set(fields) - set(contract))
    wrong = sorted(k for k, kind in fields.items() if k in contract and not _is(contract[k], kind))
    if unknown or missing or wrong:
        raise ContractError(f"unknown {unknown}, missing {missing}, mistyped {wrong}")
    return contract


def _data(spark: SparkSession, contract: dict, folder: str) -> DataFrame:
    path = contract["data"] if "://" in contract["data"] or contract["data"].startswith("/") else f"{folder}/{contract['data']}"
    return {"csv": read_csv, "json": read_json_records}[contract["format"]](spark, path)


#: Where the four 60-bit parts of a row's digest start; their sums do not depend on the order of rows.
LANES = (1, 16, 31, 46)


def _receipt(contract: dict, data: DataFrame, result: dict) -> dict:
    order_free = data.select(F.sha2(F.to_json(F.struct(*sorted(data.columns))), 256).alias("h")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in LANES]).first()
    sums = ",".join(str(order_free[f"s{at}"]) for at in LANES)
    return {"contract_digest": fingerprint(contract), "data_rows": order_free["n"], "data_digest": hashlib.sha256(sums.encode()).hexdigest(), "result": result}


def run_endpoint(spark: SparkSession, contract: dict, folder: str = ".") -> dict:
    """Cross-validates the declared event table and returns a receipt with per-group gains."""
    c = validated(contract, ENDPOINT)
    rows = _data(spark, c, folder)
    rows = rows.withColumns({f: F.col(f).try_cast("double") for f in c["features"]})
    roles = EventTable(c["state"], c["group"], c["stratum"], c["fold"], tuple(c["features"]), c.get("weight"))
    gains = cross_validated(rows, roles, c["model"])
    summary = transfer.summarise(gains.withColumn("gain", F.col("pooled_gain"))).first().asDict()
    return _receipt(c, rows, {"groups": [r.asDict() for r in gains.orderBy(c["group"]).collect()], "summary": summary})


def run_transfer(spark: SparkSession, contract: dict, folder: str = ".") -> dict:
    """Audits a ladder of held-out scores: unique rows, finite comparators, gains per step and the ceiling."""
    c = validated(contract, SCORES)
    levels = c["levels"]
    rows = _data(spark, c, folder).withColumns({name: F.col(name).try_cast("double") for name in levels})
    rows = rows.withColumn("w", F.col(c["weight"]).try_cast("double") if c.get("weight") else F.lit(1.0))
    bad = F.lit(False)
    for name in levels[:-1]:
        bad = bad | F.col(name).isNull() | F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
    bad = bad | F.col(levels[-1]).isNull() | F.isnan(levels[-1]) | (F.col(levels[-1]) == float("inf"))
    check = rows.agg(F.count("*").alias("n"), F.countDistinct(c["row_id"]).alias("ids"), F.sum(bad.cast("int")).alias("bad")).first()
    if check["n"] != check["ids"] or check["bad"]:
        raise ContractError(f"{check['n'] - check['ids']} repeated row ids, {check['bad']} rows with scores that are not allowed")
    gains = ladder.adjacent_gains(rows, c["group"], "w", levels)
    steps = [r.asDict() for r in ladder.ladder_steps(gains).orderBy("level").collect()]
    return _receipt(c, rows, {"steps": steps, "ceiling": ladder.ceiling(gains).first()["ceiling"]})


def refit_contract(contract: dict) -> dict:
    """The contract, or an error that names all rules of a refit transfer that it breaks."""
    c = validated(contract, REFITS, ())
    for part, fields in REFIT_PARTS.items():
        validated(c[part], fields, (REFIT_OPTIONAL[part],) if part in REFIT_OPTIONAL else ())
    for level in c["levels"]:
        if not isinstance(level, dict):
            raise ContractError("a level is not an object")
        validated(level, LEVEL, ())
    data, columns, score, evaluation, limits = (c[part] for part in REFIT_PARTS)
    roles = [columns[k] for k in ("row_id", "refit_id", "group", "block", "weight") if columns.get(k) is not None]
    scores, names, known = [x["score_column"] for x in c["levels"]], [x["name"] for x in c["levels"]], [set(x["information"]) for x in c["levels"]]
    confirmatory = evaluation["analysis_mode"] == "confirmatory"
    frozen = evaluation["filtration_frozen_before_outcome_scoring"] and evaluation["refit_scheme_frozen_before_outcome_scoring"]
    rules = {
        "schema_version is 1": c["schema_version"] == 1,
        "data.format is csv or json": data["format"] in ("csv", "json"),
        "row roles have columns of their own": len(set(roles)) == len(roles) and not set(roles) & set(scores),
        "levels have names and score columns of their own": len(set(scores)) == len(scores) and len(set(names)) == len(names),
        "there are two levels or more": len(scores) >= 2,
        "each level knows strictly more than the one before": all(a < b for a, b in zip(known, known[1:], strict=False)),
        "score.kind is log or other_proper": score["kind"] in ("log", "other_proper"),
        "higher scores are better": score["orientation"] == "higher_is_better",
        "all levels are scored by one rule": score["common_scoring_rule"],
        "log scores have a common reference measure": score["kind"] != "log" or score.get("common_reference_measure") is True,
        "analysis_mode is confirmatory or descriptive": evaluation["analysis_mode"] in ("confirmatory", "descriptive"),
        **{f"evaluation.{name} holds": evaluation[name] for name in MUST_HOLD},
        "a confirmatory analysis was frozen before scoring": not confirmatory or frozen,
        "refits are not taken as independent": not evaluation["refit_independence_assumed"],
        "refits weigh alike": evaluation["refit_mixture_weighting"] == "uniform",
        "the confidence level lies between 0 and 1": 0 < limits["familywise_confidence_level"] < 1,
        "there are 500 draws or more": limits["nested_draws"] >= 500,
        "at least two refits and two blocks are asked for": min(limits["minimum_refits"], limits["minimum_blocks_per_group"]) >= 2,
        "gain_tolerance is finite and not negative": 0 <= limits["gain_tolerance"] < float("inf"),
        "a confirmatory analysis names its reference refit": not confirmatory or limits.get("reference_refit_id") is not None,
    }
    broken = [rule for rule, holds in rules.items() if not holds]
    if broken:
        raise ContractError("broken: " + "; ".join(broken))
    return c


def _aligned(rows: DataFrame, levels: list[str], reference: str | None) -> tuple[int, int, str]:
    """Numbers of refits and rows per refit, and the reference refit (the first if not given); raises where refits differ."""
    score = lambda name, top: F.col(name).isNull() | F.isnan(name) | (F.col(name) == float("inf")) | (F.lit(not top) & (F.col("w") > 0) & (F.col(name) == float("-inf")))
    bad = F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0) | (F.col("w") == float("inf"))
    for name in levels:
        bad = bad | score(name, name == levels[-1])
    blank = F.lit(False)
    for name in ("row", "refit", "grp", "block"):
        blank = blank | F.coalesce(F.col(name), F.lit("")).eqNullSafe("")
    per_row = rows.groupBy("row").agg(F.count("*").alias("n"), F.countDistinct("refit").alias("refits"), F.countDistinct("grp", "block", "w").alias("kinds"), F.sum((bad | blank).cast("int")).alias("bad"), F.first("w").alias("w"))
    refits = [r[0] for r in rows.select("refit").distinct().orderBy("refit").collect()]  # a few fits
    got = per_row.agg(F.count("*").alias("rows"), F.sum((F.col("n") > F.col("refits")).cast("int")).alias("repeated"), F.sum((F.col("refits") < len(refits)).cast("int")).alias("lacking"), F.sum((F.col("kinds") > 1).cast("int")).alias("changing"), F.sum("bad").alias("bad"), F.sum("w").alias("mass")).first()
    if not got["rows"] or got["repeated"] or got["lacking"] or got["changing"] or got["bad"] or not got["mass"]:
        raise ContractError(f"{got['rows']} held-out rows of mass {got['mass']}: {got['repeated']} repeated in a refit, {got['lacking']} not in all refits, {got['changing']} with other groups, blocks or weights in another refit, {got['bad']} values that are not allowed")
    if reference is not None and reference not in refits:
        raise ContractError(f"reference refit {reference} is not in the data")
    return len(refits), got["rows"], reference if reference is not None else refits[0]


def run_refits(spark: SparkSession, contract: dict, folder: str = ".") -> dict:
    """Certifies an information ladder over refits and blocks; the data hold one row per refit and held-out row.

    The family is made of all groups and steps; one refit per draw serves all of it. A step generalizes if it does so
    robustly in every group; the ceiling is reached by such steps alone, and good points of one refit do not lift it. The
    reference refit is certified on its blocks alone beside it (reference_cells, reference_ceiling), which lifts nothing either.
    """
    c = refit_contract(contract)
    columns, limits, levels = c["columns"], c["certification"], [x["score_column"] for x in c["levels"]]
    data = _data(spark, c["data"] | {"data": c["data"]["path"]}, folder)
    weight = F.col(columns["weight"]).try_cast("double") if columns.get("weight") else F.lit(1.0)
    text = {"row": "row_id", "refit": "refit_id", "grp": "group", "block": "block"}
    rows = data.select(*[F.trim(F.col(columns[k]).cast("string")).alias(name) for name, k in text.items()], weight.alias("w"), *[F.col(x).try_cast("double").alias(x) for x in levels])
    n_refits, n_rows, reference = _aligned(rows, levels, limits.get("reference_refit_id"))
    pairs = ", ".join(f"{n}, `{b}` - `{a}`" for n, (a, b) in enumerate(zip(levels, levels[1:], strict=False), 1))
    gains = rows.filter("w > 0").select("refit", "grp", "block", "w", F.expr(f"stack({len(levels) - 1}, {pairs}) as (level, gain)"))
    blocks = gains.groupBy("refit", "grp", "level", "block").agg(F.sum(F.col("w") * F.col("gain")).alias("num"), F.sum("w").alias("w")).cache()  # refits x groups x steps x blocks
    tolerance = limits["gain_tolerance"]
    points = blocks.groupBy("refit", "grp", "level").agg((F.sum("num") / F.sum("w")).alias("gain"))
    steps = points.groupBy("refit", "level").agg(F.min(F.col("gain") > tolerance).alias("ok")).collect()  # refits x steps
    reached = lambda held: next((n - 1 for n in range(1, len(levels)) if not held.get(n)), len(levels) - 1)
    by_refit = {}
    for r in steps:
        by_refit.setdefault(r["refit"], {})[r["level"]] = r["ok"]
    nested = resample.nested_refits(blocks, limits["nested_draws"], limits["seed"], 1 - limits["familywise_confidence_level"], ("level",), limits["minimum_blocks_per_group"])
    status = interval_status(F.col("lower"), F.col("upper"), tolerance) if n_refits >= limits["minimum_refits"] else F.lit("unavailable")
    cells = nested.withColumn("status", status).cache()
    robust = {r["level"]: r["category"] for r in resample.family_category(cells, "level").collect()}
    alone = resample.nested_refits(blocks.filter(F.col("refit") == reference), limits["nested_draws"], limits["seed"], 1 - limits["familywise_confidence_level"], ("level",), limits["minimum_blocks_per_group"])
    own = alone.withColumn("status", interval_status(F.col("lower"), F.col("upper"), tolerance)).cache()
    certain = {r["level"]: r["category"] for r in resample.family_category(own, "level").collect()}
    out = {
        "endpoint_id": c["endpoint_id"], "refits": n_refits, "rows_per_refit": n_rows, "reference_refit": reference,
        "cells": [r.asDict() for r in cells.orderBy("level", "grp").collect()], "steps": robust,
        "point_ceilings": {refit: c["levels"][reached(held)]["name"] for refit, held in sorted(by_refit.items())},
        "reference_point_ceiling": c["levels"][reached(by_refit[reference])]["name"],
        "reference_cells": [r.asDict() for r in own.orderBy("level", "grp").collect()],
        "reference_ceiling": c["levels"][reached({n: kind == "all_positive" for n, kind in certain.items()})]["name"],
        "ceiling": c["levels"][reached({n: kind == "all_positive" for n, kind in robust.items()})]["name"],
        "confirmatory_eligible": c["evaluation"]["analysis_mode"] == "confirmatory",
    }
    receipt = _receipt(c, data, out)
    for kept in (blocks, cells, own):
        kept.unpersist()
    return receipt


def main(argv: list[str], spark: SparkSession) -> int:
    """`run CONTRACT`, `transfer CONTRACT` or `transfer-refits CONTRACT`, with the receipt as sorted JSON on standard output."""
    commands: dict[str, Callable] = {"run": run_endpoint, "transfer": run_transfer, "transfer-refits": run_refits}
    command, path = argv
    print(json.dumps(commands[command](spark, json.loads(Path(path).read_text()), str(Path(path).parent)), sort_keys=True, default=str))
    return 0
