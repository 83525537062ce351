"""Identity of units that go by several names: alias sets joined over all keys, and what may not cross between roles.

Two units that share a value of any key are one entity, and so are all that a chain of such values connects. Roles
(training, calibration, validation) must not share an entity, under whatever names it appears in them.

Units: role, grp, stratum, source, cluster, and key columns. Null keys connect nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.conformal import TOLERANCE

PASSED, VACUOUS, UNVERIFIED = "count_gate_passed", "hold_vacuous_rank", "hold_identity_unverified"


def entities(units: DataFrame, unit: str, keys: Sequence[str]) -> DataFrame:
    """unit, entity: the least unit that is reached through shared values of the keys.

    Every round each key value takes the least entity of its units, each unit the least of its values, and then the
    entity of its entity, so that chains shorten by far more than a step a round. Rounds end when nothing moved.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)]))
    links = cut(units.select(F.col(unit).alias("unit"), pairs.alias("k")).select("unit", "k.key", "k.value").filter("value is not null").distinct())
    # a value that one unit alone has connects nothing
    shared = links.groupBy("key", "value").agg(F.count("*").alias("n")).filter("n > 1").select("key", "value")
    links = cut(links.join(shared, ["key", "value"]))
    found = cut(units.select(F.col(unit).alias("unit")).distinct().withColumn("entity", F.col("unit")))
    while True:
        least = links.join(found, "unit").groupBy("key", "value").agg(F.min("entity").alias("least"))
        nearer = links.join(least, ["key", "value"]).groupBy("unit").agg(F.min("least").alias("least"))
        step = found.join(nearer, "unit", "left").select("unit", "entity", F.least("entity", F.coalesce("least", "entity")).alias("next"))
        above = step.select(F.col("unit").alias("next"), F.col("next").alias("above"))
        moved = cut(step.join(above, "next").select("unit", F.least("next", "above").alias("now"), (F.least("next", "above") < F.col("entity")).alias("moved")))
        found = moved.select("unit", F.col("now").alias("entity"))
        if not moved.filter("moved").limit(1).count():
            return found


def crossings(units: DataFrame, unit: str, keys: Sequence[str]) -> DataFrame:
    """entity, n_units, n_groups, roles (sorted, comma-joined), crosses (more than one role), reused (more than one group)."""
    named = units.join(entities(units, unit, keys).withColumnRenamed("unit", unit), unit)
    out = named.groupBy("entity").agg(F.countDistinct(unit).alias("n_units"), F.countDistinct("grp").alias("n_groups"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct("role").alias("n_roles"))
    return out.select("entity", "n_units", "n_groups", "roles", (F.col("n_roles") > 1).alias("crosses"), (F.col("n_groups") > 1).alias("reused"))


def identity_problems(units: DataFrame, unit: str, keys: Sequence[str], forecasts: DataFrame, training: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """problem, n: rosters that differ from the plan's, strata that differ, groups in several roles, wrong sources, entities reused or crossing."""
    roster = units.groupBy("role", "grp").agg(F.min("stratum").alias("stratum"), F.countDistinct("stratum").alias("__s"))
    planned = forecasts.select("role", "grp", "stratum").unionByName(training.select(F.lit("training").alias("role"), "grp", "stratum")).distinct().withColumnRenamed("stratum", "__planned")
    both = roster.join(planned, ["role", "grp"], "full").agg(
        F.count_if(F.expr("__planned is null")).alias("group_not_in_plan"), F.count_if(F.expr("stratum is null and __planned is not null and __s is null")).alias("group_without_identity"),
        F.count_if(F.expr("(__planned is not null and __s is not null and not (stratum <=> __planned)) or __s > 1")).alias("stratum_conflict"),
    )
    roles = units.groupBy("grp").agg(F.countDistinct("role").alias("k")).agg(F.count_if(F.expr("k > 1")).alias("group_in_several_roles"))
    expected = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
    wrong = units.agg(F.count_if(~F.col("source").eqNullSafe(F.element_at(expected, F.col("role")))).alias("undeclared_source"))
    met = crossings(units, unit, keys).agg(F.count_if(F.expr("reused")).alias("entity_reused"), F.count_if(F.expr("crosses")).alias("entity_crossing_roles"))
    wide = both.crossJoin(F.broadcast(roles)).crossJoin(F.broadcast(wrong)).crossJoin(F.broadcast(met))
    names = wide.columns
    return wide.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (problem, n)")).filter("n > 0")


def support_gate(units: DataFrame, alpha: float, attested: bool = True, min_training: int = 2) -> DataFrame:
    """Per stratum with calibration or validation groups: groups by role, the rank a one-sided bound would have, whether
    it can be more than vacuous, clusters by role and those that calibration and validation share; status of the whole.

    Passing says that counts suffice, not that groups are exchangeable.
    """
    n = lambda r: F.countDistinct(F.when(F.col("role") == r, F.col("grp")))
    c = lambda r: F.countDistinct(F.when(F.col("role") == r, F.col("cluster")))
    shared = units.filter("role != 'training'").groupBy("stratum", "cluster").agg(F.countDistinct("role").alias("k")).groupBy("stratum").agg(F.count_if(F.expr("k = 2")).alias("shared_clusters"))
    out = units.groupBy("stratum").agg(*[n(r).alias(f"n_{r}") for r in ("training", "calibration", "validation")], *[c(r).alias(f"clusters_{r}") for r in ("training", "calibration", "validation")])
    out = out.filter("n_calibration + n_validation > 0").join(shared, "stratum").withColumn("rank", F.floor((F.col("n_calibration") + 1) * alpha + TOLERANCE))
    out = out.withColumns({"possible": (F.col("rank") >= 1) & (F.col("n_validation") >= 1), "enough_training": F.col("n_training") >= min_training})
    whole = out.agg(F.min(F.col("possible") & F.col("enough_training")).alias("__all"))
    status = F.when(F.lit(not attested), UNVERIFIED).when(F.col("__all"), PASSED).otherwise(VACUOUS)
    return out.crossJoin(F.broadcast(whole)).withColumn("status", status).drop("__all")


def admit(units: DataFrame, unit: str, keys: Sequence[str], forecasts: DataFrame, training: DataFrame, sources: Mapping[str, str], alpha: float, attested: bool = True) -> DataFrame:
    """support_gate, after identities were checked against the plan's tables; raises unless all is well and the gate passes."""
    found = sorted(tuple(r) for r in identity_problems(units, unit, keys, forecasts, training, sources).collect())  # a row for each kind
    if found:
        raise ValueError("identities not admitted: " + ", ".join(f"{p} ({n})" for p, n in found))
    gate = support_gate(units, alpha, attested)
    held = gate.select("status").distinct().collect()
    if [r[0] for r in held] != [PASSED]:
        raise ValueError("identity gate holds: " + ", ".join(r[0] for r in held))
    return gate
