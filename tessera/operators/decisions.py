"""Evidence composition: gates in order, the first that fails blocks all after it; decision tables; the handoff decision.

A decision table is data: rules by priority, each with the values that some columns must have and what follows. It is
compiled to one expression, so that rows are decided where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[Mapping[str, object], Mapping[str, object]]


def first_match(rules: Sequence[Rule]) -> Column:
    """The outcome (a struct) of the first rule whose values all hold; null if none does. A null column holds no value but None."""
    found = None
    for given, outcome in rules:
        holds = F.lit(True)
        for name, value in given.items():
            values = value if isinstance(value, tuple) else (value,)
            one = F.lit(False)
            for v in values:
                one = one | F.col(name).eqNullSafe(F.lit(v))
            holds = holds & one
        then = F.struct(*[F.lit(v).alias(k) for k, v in outcome.items()])
        found = F.when(holds, then) if found is None else found.when(holds, then)
    return found


# fixed values: names of inputs, categories, reasons and statuses
SCOPES, SEMANTICS = ("known_truth", "empirical"), ("species_support", "structural_capacity")
TRANSFER = ("generalizing", "mixed", "non_generalizing", "unavailable", "not_tested")
HANDOFF_RULES: list[Rule] = [
    ({"semantics": "structural_capacity", "summary_allowed": True}, {"category": "structural_capacity_only"}),
    ({"semantics": "structural_capacity"}, {"category": "unavailable"}),
    ({"method_allowed": True}, {"category": "known_truth_method_state_only", "reason": "known_truth_state_not_empirical_species_evidence"}),
    ({"empirical_allowed": True}, {"category": "empirical_axis_resolved_supported"}),
    ({"summary_allowed": True, "transfer": "non_generalizing"}, {"category": "descriptive_projection_only", "reason": "independent_axis_resolved_organization_not_generalizing"}),
    ({"summary_allowed": True, "transfer": "mixed"}, {"category": "descriptive_projection_only", "reason": "independent_axis_resolved_organization_mixed"}),
    ({"summary_allowed": True, "transfer": "unavailable"}, {"category": "descriptive_projection_only", "reason": "independent_transferability_unavailable"}),
    ({"summary_allowed": True, "transfer": "not_tested"}, {"category": "descriptive_projection_only", "reason": "independent_transferability_not_tested"}),
    ({"summary_allowed": True}, {"category": "descriptive_projection_only"}),
    ({}, {"category": "unavailable"}),
]
DOSSIER_RULES: list[Rule] = [
    ({"base_validation": "unavailable"}, {"certification": "unavailable", "operational": "unavailable"}),
    ({"base_validation": "blocked"}, {"certification": "not_certified", "operational": "blocked"}),
    ({"base_certification": "not_certified"}, {"certification": "not_certified", "operational": "admitted_extended_not_certified"}),
    ({"base_certification": "unavailable"}, {"certification": "unavailable", "operational": "admitted_extended_unavailable"}),
    ({"failed": True}, {"certification": "unavailable", "operational": "admitted_extended_unavailable"}),
    ({"warned": True}, {"certification": "certified", "operational": "admitted_with_warnings"}),
    ({}, {"certification": "certified", "operational": "admitted"}),
]


def handoff(rows: DataFrame) -> DataFrame:
    """rows with category, summary_allowed, method_allowed, empirical_allowed and reasons (in order).

    Six inputs: scope, semantics, declared, frozen, estimable (booleans), transfer. Any other value, and null, is an error:
    a permission must not rest on what nobody declared.
    """
    for name, allowed in (("scope", SCOPES), ("semantics", SEMANTICS), ("transfer", TRANSFER), ("declared", (True, False)), ("frozen", (True, False)), ("estimable", (True, False))):
        said = F.raise_error(F.concat(F.lit(f"unsupported {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
        rows = rows.withColumn(name, F.when(F.coalesce(F.col(name).isin(*allowed), F.lit(False)), F.col(name)).otherwise(said.cast(rows.schema[name].dataType)))
    species, empirical = F.col("semantics") == "species_support", F.col("scope") == "empirical"
    summary = F.col("declared") & F.col("estimable")
    out = rows.withColumns({
        "summary_allowed": summary, "method_allowed": summary & species & ~empirical,
        "empirical_allowed": summary & species & empirical & F.col("frozen") & (F.col("transfer") == "generalizing"),
    })
    rules = [(given, {"category": then["category"], "reason": then.get("reason")}) for given, then in HANDOFF_RULES]
    reasons = F.array_compact(F.array(
        F.when(~F.col("declared"), "added_axis_semantics_not_declared"), F.when(~F.col("estimable"), "thickness_not_estimable"),
        F.when(empirical & ~F.col("frozen"), "empirical_source_boundary_not_prospectively_frozen"), F.when(~species, "structural_capacity_is_not_species_support"), F.col("__rule.reason"),
    ))
    return out.withColumn("__rule", first_match(rules)).withColumns({"category": F.col("__rule.category"), "reasons": reasons}).drop("__rule")


def effective_layers(audits: DataFrame) -> DataFrame:
    """audits (subject, position, layer, status) with effective: below the first mismatch, a sentinel that names it."""
    over = Window.partitionBy("subject").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.first(F.when(F.col("status") == "mismatch", F.col("layer")), ignorenulls=True).over(over)
    return audits.withColumn("effective", F.when(failed.isNull(), F.col("status")).otherwise(F.concat(F.lit("not_run_"), failed, F.lit("_mismatch"))))


def dossier(bases: DataFrame, audits: DataFrame) -> DataFrame:
    """Per subject: failed_layer, certification, operational, provenance_reasons, statistical_reasons, warnings, trace.

    bases: subject, base_validation (admitted, blocked, unavailable), base_certification (certified, not_certified,
    unavailable), statistical_reasons, provenance_reasons, warnings (arrays). A failed audit can only lower what the base
    says, and nothing below it is run or believed.
    """
    layers = effective_layers(audits).groupBy("subject").agg(
        F.min(F.when(F.col("effective") == "mismatch", F.struct("position", "layer")))["layer"].alias("failed_layer"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "layer", "effective"))), lambda x: F.concat_ws(":", x["layer"], x["effective"])).alias("__steps"),  # as many as layers
    )
    out = bases.join(layers, "subject", "left").withColumns({"failed": F.col("failed_layer").isNotNull(), "warned": F.size("warnings") > 0})
    out = out.withColumn("__rule", first_match(DOSSIER_RULES)).withColumns({"certification": F.col("__rule.certification"), "operational": F.col("__rule.operational")})
    mine = F.when(F.col("failed"), F.array(F.concat("failed_layer", F.lit("_mismatch")))).otherwise(F.array().cast("array<string>"))
    trace = F.concat(F.coalesce("__steps", F.array().cast("array<string>")), F.array(F.concat(F.lit("certification:"), "certification"), F.concat(F.lit("operational:"), "operational")))
    return out.select("subject", "failed_layer", "certification", "operational", F.array_distinct(F.concat("provenance_reasons", mine)).alias("provenance_reasons"), "statistical_reasons", "warnings", trace.alias("trace"))


def gate_ladder(layers: DataFrame) -> DataFrame:
    """subject, position, layer, status (pass, fail, uncertain, unavailable) -> per subject the decision.

    A failing or uncertain layer blocks: later layers are `not_run`. Otherwise any unavailable layer makes the subject
    unavailable, and all passing makes it certified.
    """
    blocks = F.col("status").isin("fail", "uncertain")
    before = F.max(blocks.cast("int")).over(Window.partitionBy("subject").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    run = layers.withColumn("effective", F.when(F.coalesce(before, F.lit(0)) == 1, "not_run").otherwise(F.col("status")))
    first = F.min(F.when(F.col("effective").isin("fail", "uncertain"), F.struct("position", "layer")))["layer"]
    n = lambda s: F.sum((F.col("effective") == s).cast("long"))
    out = run.groupBy("subject").agg(first.alias("blocking_layer"), n("pass").alias("passed"), n("unavailable").alias("unavailable"), n("not_run").alias("not_run"))
    return out.withColumn("decision", F.when(F.col("blocking_layer").isNotNull(), "not_certified").when(F.col("unavailable") > 0, "unavailable").otherwise("certified"))


def operational_status(base: str, certification: str, warnings: Sequence[str] = ()) -> str:
    """Base unavailable before base blocked, then certification; warnings only qualify a certified result."""
    if base in ("unavailable", "blocked"):
        return f"base_{base}"
    if certification != "certified":
        return certification
    return "certified_with_warnings" if warnings else "certified"
