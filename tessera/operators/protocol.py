"""Frozen forecasts for groups in roles: a plan binds every role's rows by a digest, and scoring re-reads and rechecks them.

A digest is a sum over rows: the SHA-256 of each row's fields, taken as LIMBS numbers, is added up limb by limb, and the
sums and the row count are hashed once more with the role. It is the same in any order and over any partitions, partial
digests of parts of a table add up to that of the whole, and a changed, missing or doubled row changes it. It guards
against drift between steps, not against someone who builds rows to make sums agree.

Forecast rows: role (calibration or validation), row_id, grp, stratum, conditional and reference (arrays of class
probabilities), weight. Outcomes: row_id, state (the class's place, from 0). Outcomes are never part of a plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.algebra import weighted_mean
from tessera.operators.conformal import TOLERANCE, group_envelope

LIMBS, DIGITS, TOGETHER = 16, 4, 3  # 16 hexadecimal numbers of four digits: sums stay exact to 1e14 rows
ROLES = ("training", "calibration", "validation")
SUM_TO_ONE = 1e-8


def encoded(columns: Sequence[Column]) -> Column:
    """One text for a row's fields, each with its length, so that no two different rows have the same; null has its own mark."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("~")) for c in columns]
    return F.concat_ws(";", *parts)


def digest_sums(rows: DataFrame, columns: Sequence[Column], *by: str) -> DataFrame:
    """by, n_rows, sums: the additive part of a digest, which parts of a table add up to."""
    hashed = rows.select(*by, F.sha2(encoded(columns).cast("binary"), 256).alias("__h"))
    # numbers are read three at a time, and parted by shifts
    words = hashed.select(*by, *[F.conv(F.substring("__h", DIGITS * i + 1, DIGITS * TOGETHER), 16, 10).cast("long").alias(f"__w{i}") for i in range(0, LIMBS, TOGETHER)])
    last = lambda i: min(i - i % TOGETHER + TOGETHER, LIMBS) - 1
    limbs = [F.sum(F.shiftright(f"__w{i - i % TOGETHER}", 4 * DIGITS * (last(i) - i)).bitwiseAND((1 << 4 * DIGITS) - 1)) for i in range(LIMBS)]
    return words.groupBy(*by).agg(F.count("*").alias("n_rows"), F.array(*limbs).alias("sums"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """The sums of a whole table from those of its parts."""
    return parts.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.array(*[F.sum(F.col("sums")[i]) for i in range(LIMBS)]).alias("sums"))


def sealed(sums: DataFrame, label: Column) -> DataFrame:
    """digest_sums with the digest in place of the sums; label (the role) is part of it."""
    return sums.withColumn("digest", F.sha2(F.concat_ws(";", label, F.col("n_rows").cast("string"), F.array_join(F.col("sums").cast("array<string>"), ",")).cast("binary"), 256)).drop("sums")


def _probabilities(name: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), ",")


def forecast_fields() -> list[Column]:
    return [F.col("row_id"), F.col("grp"), F.col("stratum"), _probabilities("conditional"), _probabilities("reference"), F.col("weight")]


def role_digests(forecasts: DataFrame, training: DataFrame, fields: Sequence[Column] | None = None) -> DataFrame:
    """role, n_rows, n_groups, digest. training: grp and stratum, one row for each group, of which a digest is kept too."""
    rows = sealed(digest_sums(forecasts, fields or forecast_fields(), "role"), F.col("role"))
    groups = forecasts.groupBy("role").agg(F.countDistinct("grp").alias("n_groups"))
    learnt = sealed(digest_sums(training.withColumn("role", F.lit("training")), [F.col("grp"), F.col("stratum")], "role"), F.col("role"))
    learnt = learnt.join(training.agg(F.lit("training").alias("role"), F.countDistinct("grp").alias("n_groups")), "role")
    return rows.join(groups, "role").unionByName(learnt).select("role", "n_rows", "n_groups", "digest")


def plan_problems(forecasts: DataFrame, training: DataFrame, classes: int) -> DataFrame:
    """problem, n: what must not be frozen, with how many rows or groups; no rows if all is well."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) != F.col(c).cast("string")) | (F.length(F.col(c).cast("string")) == 0)
    fair = lambda c: F.coalesce((F.size(c) == classes) & F.forall(c, lambda p: F.coalesce((p > 0) & (p <= 1), F.lit(False))) & (F.abs(F.aggregate(c, F.lit(0.0), lambda a, p: a + p) - 1) <= SUM_TO_ONE), F.lit(False))
    sound = F.coalesce((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.lit(False))
    row = forecasts.agg(
        F.count_if(blank("row_id") | blank("grp") | blank("stratum")).alias("bad_name"), F.count_if(~F.coalesce(F.col("role").isin(*ROLES[1:]), F.lit(False))).alias("unknown_role"),
        F.count_if(~fair("conditional") | ~fair("reference")).alias("bad_probabilities"), F.count_if(~sound).alias("bad_weight"),
        *[(F.count_if(F.col("role") == r) == 0).cast("long").alias(f"no_{r}") for r in ROLES[1:]],
    )
    doubled = forecasts.groupBy("row_id").count().agg(F.count_if(F.expr("count > 1")).alias("repeated_row"))
    crossing = forecasts.groupBy("grp").agg(F.countDistinct("role", "stratum").alias("k")).agg(F.count_if(F.expr("k > 1")).alias("crossing_group"))
    learnt = training.groupBy("grp").agg(F.count("*").alias("k"))
    overlap = forecasts.select("grp").distinct().join(learnt, "grp", "left_semi").agg(F.count("*").alias("training_overlap"))
    repeated = learnt.agg(F.count_if(F.expr("k > 1")).alias("repeated_training_group"))
    strata = forecasts.groupBy("stratum").agg(F.count_if(F.expr("role = 'calibration'")).alias("c"), F.count_if(F.expr("role = 'validation'")).alias("v")).agg(F.count_if(F.expr("v > 0 and c = 0")).alias("stratum_without_calibration"))
    wide = row
    for one in (doubled, crossing, overlap, repeated, strata):
        wide = wide.crossJoin(F.broadcast(one))
    names = wide.columns
    return wide.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (problem, n)")).filter("n > 0")


def _refuse(problems: DataFrame, what: str) -> None:
    found = sorted(tuple(r) for r in problems.collect())  # a row for each kind of problem
    if found:
        raise ValueError(f"{what}: " + ", ".join(f"{p} ({n})" for p, n in found))


def with_plan_digest(digests: DataFrame, classes: int, alpha: float, model: bytes, reference: bytes) -> DataFrame:
    """role_digests with the settings that the plan holds and plan_sha256, which covers all of them."""
    if not model or not reference:
        raise ValueError("a plan needs the bytes of the model and of the reference")
    if not 0 < alpha < 1 or classes < 2:
        raise ValueError("alpha must lie between 0 and 1, and there must be two classes at least")
    shas = [hashlib.sha256(b).hexdigest() for b in (model, reference)]
    roles = digests.groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "role", "digest"))), ";").alias("__roles"))  # three at most
    out = digests.crossJoin(F.broadcast(roles)).withColumns({"classes": F.lit(classes), "alpha": F.lit(alpha), "model_sha256": F.lit(shas[0]), "reference_sha256": F.lit(shas[1])})
    return out.withColumn("plan_sha256", F.sha2(F.concat_ws("|", "__roles", "classes", F.col("alpha").cast("string"), "model_sha256", "reference_sha256").cast("binary"), 256)).drop("__roles")


def freeze(forecasts: DataFrame, training: DataFrame, classes: int, alpha: float, model: bytes, reference: bytes, fields: Sequence[Column] | None = None) -> DataFrame:
    """The plan, one row for each role; refuses tables with problems. It is small, and the caller writes it where it lasts."""
    _refuse(plan_problems(forecasts, training, classes), "not fit to freeze")
    return with_plan_digest(role_digests(forecasts, training, fields), classes, alpha, model, reference)


def role_audit(plan: DataFrame, forecasts: DataFrame, training: DataFrame, fields: Sequence[Column] | None = None) -> DataFrame:
    """role, planned, found, status of the tables as they are now: unchanged, changed, rows_missing or rows_added."""
    now = role_digests(forecasts, training, fields).select("role", F.col("n_rows").alias("found"), F.col("digest").alias("__now"))
    both = plan.select("role", F.col("n_rows").alias("planned"), F.col("digest")).join(now, "role", "full")
    planned, found = F.coalesce("planned", F.lit(0)), F.coalesce("found", F.lit(0))
    status = F.when(found < planned, "rows_missing").when(found > planned, "rows_added").when(F.col("digest") == F.col("__now"), "unchanged").otherwise("changed")
    return both.select("role", planned.cast("long").alias("planned"), found.cast("long").alias("found"), status.alias("status"))


def assert_unchanged(plan: DataFrame, forecasts: DataFrame, training: DataFrame, model: bytes, reference: bytes, fields: Sequence[Column] | None = None) -> None:
    """Raises unless tables and artifacts are those of the plan, and the plan is whole."""
    kept = plan.collect()  # three rows
    if {r["role"] for r in kept} != set(ROLES):
        raise ValueError("the plan lacks a role")
    first = kept[0]
    for name, data in (("model", model), ("reference", reference)):
        if hashlib.sha256(data).hexdigest() != first[f"{name}_sha256"]:
            raise ValueError(f"{name} differs from the frozen one")
    drift = [(r["role"], r["status"]) for r in role_audit(plan, forecasts, training, fields).collect() if r["status"] != "unchanged"]
    if drift:
        raise ValueError("rows differ from the frozen ones: " + ", ".join(f"{a} {b}" for a, b in sorted(drift)))
    again = with_plan_digest(plan.select("role", "n_rows", "n_groups", "digest"), first["classes"], first["alpha"], model, reference)
    if {r["plan_sha256"] for r in again.select("plan_sha256").collect()} != {r["plan_sha256"] for r in kept}:
        raise ValueError("the plan itself was changed")


def outcome_problems(forecasts: DataFrame, outcomes: DataFrame, role: str, classes: int) -> DataFrame:
    """problem, n: outcomes must be those of the role's rows, once each, with a class of the plan."""
    mine = forecasts.filter(F.col("role") == role).select("row_id", F.lit(1).alias("__planned"))
    seen = outcomes.groupBy("row_id").agg(F.count("*").alias("__times"), F.count_if(~F.coalesce(F.col("state").between(0, classes - 1), F.lit(False))).alias("__bad"))
    wide = mine.join(seen, "row_id", "full").agg(
        F.count_if(F.col("__times").isNull()).alias("missing"), F.count_if(F.col("__planned").isNull()).alias("of_another_role"),
        F.count_if(F.expr("__planned is not null and __times > 1")).alias("doubled"), F.count_if(F.expr("__planned is not null and __bad > 0")).alias("unknown_state"),
    )
    names = wide.columns
    return wide.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (problem, n)")).filter("n > 0")


def group_gains(forecasts: DataFrame, outcomes: DataFrame, role: str) -> DataFrame:
    """grp, stratum, n_rows, gain: weighted mean of the log ratio of conditional and reference probability of what came."""
    rows = forecasts.filter(F.col("role") == role).join(outcomes.select("row_id", "state"), "row_id")
    ratio = F.ln(F.get("conditional", F.col("state").cast("int"))) - F.ln(F.get("reference", F.col("state").cast("int")))
    return rows.withColumn("__gain", ratio).groupBy("grp", "stratum").agg(F.count("*").alias("n_rows"), weighted_mean(F.col("__gain"), F.col("weight")).alias("gain"))


def gains_digest(gains: DataFrame) -> DataFrame:
    """One row: the digest of the groups' gains."""
    return sealed(digest_sums(gains, [F.col("grp"), F.col("stratum"), F.col("n_rows"), F.round("gain", 12)]), F.lit("gains"))


def scored(plan: DataFrame, forecasts: DataFrame, training: DataFrame, outcomes: DataFrame, role: str, model: bytes, reference: bytes, fields: Sequence[Column] | None = None) -> DataFrame:
    """group_gains of a role, after the plan, its tables and its artifacts were rechecked and the outcomes found to fit."""
    assert_unchanged(plan, forecasts, training, model, reference, fields)
    _refuse(outcome_problems(forecasts, outcomes, role, plan.first()["classes"]), f"outcomes do not fit the {role} rows")
    return group_gains(forecasts, outcomes, role)


def coverage(calibration: DataFrame, validation: DataFrame, alpha: float) -> DataFrame:
    """Per stratum of the validation gains: counts, rank, bound of the calibration gains, whether it is vacuous, coverage."""
    bounds = group_envelope(calibration.select("stratum", "grp", "gain"), alpha)
    rank = F.floor((F.col("n_groups") + 1) * alpha + TOLERANCE)
    seen = validation.join(F.broadcast(bounds), "stratum").groupBy("stratum").agg(
        F.first("n_groups").alias("n_calibration"), F.count("*").alias("n_validation"), F.first(rank).alias("rank"), F.first("bound").alias("bound"),
        F.count_if(F.col("gain") >= F.col("bound")).alias("n_covered"), F.count_if(F.col("gain") > 0).alias("n_positive"),
    )
    fair = (F.col("n_calibration") + 1 - F.col("rank")) / (F.col("n_calibration") + 1)
    return seen.select("stratum", "n_calibration", "n_validation", "rank", "bound", (F.col("rank") == 0).alias("vacuous"), fair.alias("expected_coverage"), "n_covered", (F.col("n_covered") / F.col("n_validation")).alias("coverage"), "n_positive")


def validated(plan: DataFrame, calibration: DataFrame, calibration_digest: str, forecasts: DataFrame, training: DataFrame, outcomes: DataFrame, model: bytes, reference: bytes, fields: Sequence[Column] | None = None) -> DataFrame:
    """coverage of the untouched validation groups; refuses a calibration that is not the frozen one or not of the plan's groups."""
    if gains_digest(calibration).first()["digest"] != calibration_digest:
        raise ValueError("the calibration gains differ from the frozen ones")
    planned = forecasts.filter("role = 'calibration'").select("grp", "stratum").distinct()
    strange = planned.join(calibration.select("grp", "stratum", F.lit(1).alias("__c")), ["grp", "stratum"], "full").withColumn("__n", F.count("*").over(Window.partitionBy("grp"))).filter("__c is null or __n > 1")
    unknown = calibration.join(planned, ["grp", "stratum"], "left_anti")
    if strange.limit(1).count() or unknown.limit(1).count():
        raise ValueError("the calibration gains are not those of the plan's groups")
    tested = scored(plan, forecasts, training, outcomes, "validation", model, reference, fields)
    return coverage(calibration, tested, plan.first()["alpha"])
