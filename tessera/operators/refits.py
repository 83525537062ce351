"""Certification over a fixed set of supplied refits: every refit has to pass, none can make up for another.

Blocks come as refit, grp, level (number of the step from the level below), block, num (weighted gain) and w. Refits are
neither drawn nor averaged: each has its own family of groups and steps, all have the same draws, and a step holds if it
holds in every refit (intersection and union), so that no correction for the number of refits is due.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.algebra import counter_draw, interval_status
from tessera.operators import resample
from tessera.operators.provenance import row_alignment

CELL = ["refit", "grp", "level"]


def refit_bounds(blocks: DataFrame, draws: int, seed: int, alpha: float = 0.05, min_blocks: int = 8, tolerance: float = 0.0, shared: bool = False) -> DataFrame:
    """Per refit, group and step: n_blocks, mean, se, critical value of its refit, one-sided lower bound and status.

    How often a draw takes each block is counted once and serves all refits and steps. A cell is unavailable, and takes no
    part in its refit's family, if a sum is not finite, if it lacks a block that its group has in another cell, or if there
    are fewer than min_blocks. With shared draws a block means the same thing in all groups: unless all groups have the same
    blocks, every cell is unavailable. Blocks without weight are left out; an empty table gives an empty table.
    """
    blocks = blocks.filter("w > 0")
    order, whole = Window.partitionBy("grp").orderBy("block"), Window.partitionBy("grp")
    places = blocks.select("grp", "block").distinct().withColumns({"idx": F.row_number().over(order) - 1, "n_places": F.count("*").over(whole)})
    held = places.groupBy("block").agg(F.count("*").alias("holders")).agg(F.min("holders").alias("fewest")).crossJoin(places.agg(F.countDistinct("grp").alias("n_groups")))
    parts = [str(seed), *([] if shared else [F.col("grp")]), F.col("draw"), F.col("idx")]
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the places are few, their draws many
    slots = places.crossJoin(F.broadcast(blocks.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw")))).repartition(tasks, "draw")
    times = slots.select("grp", "draw", counter_draw(F.col("n_places"), *parts).alias("idx")).groupBy("grp", "draw", "idx").agg(F.count("*").alias("t"))

    points = blocks.groupBy(*CELL).agg(F.count("*").alias("n_blocks"), F.min(F.coalesce(F.abs("num") < float("inf"), F.lit(False))).alias("finite"), *_sums(F.lit(1)))
    points = points.select(*CELL, "n_blocks", "finite", (F.col("sn") / F.col("sw")).alias("mean"), F.when(F.col("finite"), resample.cluster_error(F.col("n_blocks"))).alias("se"))
    points = points.join(places.groupBy("grp").agg(F.max("n_places").alias("n_places")), "grp").crossJoin(F.broadcast(held))
    sound = F.col("finite") & (F.col("n_blocks") == F.col("n_places")) & (F.col("n_blocks") >= min_blocks)
    if shared:
        sound = sound & (F.col("fewest") == F.col("n_groups"))
    points = points.withColumn("sound", sound).drop("fewest", "n_groups", "n_places")

    live = blocks.join(places.select("grp", "block", "idx"), ["grp", "block"]).join(points.filter("sound").select(*CELL, "n_blocks", "mean"), CELL)
    drawn = times.join(live, ["grp", "idx"]).groupBy(*CELL, "draw").agg(F.first("n_blocks").alias("n"), F.first("mean").alias("mean"), *_sums(F.col("t")))
    move, error = F.col("sn") / F.col("sw") - F.col("mean"), resample.cluster_error(F.col("n"))
    stat = F.when(error > 1e-15, move / error).when(F.abs(move) <= 1e-15, 0.0).otherwise(F.when(move > 0, float("inf")).otherwise(float("-inf")))
    rank = int(-(-((1 - alpha) * (draws - 1)) // 1)) + 1
    critical = drawn.groupBy("refit", "draw").agg(F.max(stat).alias("stat")).groupBy("refit").agg(F.greatest(F.lit(0.0), F.element_at(F.sort_array(F.collect_list("stat")), rank)).alias("critical"))  # a list is as long as the draws
    lower = F.when(F.col("se") > 1e-15, F.col("mean") - F.col("critical") * F.col("se")).otherwise(F.col("mean"))
    out = points.join(critical, "refit", "left").withColumn("lower", F.when(F.col("sound"), lower))
    status = F.when(F.col("lower") > tolerance, "robust_positive").otherwise("not_robust_positive")
    return out.select(*CELL, "n_blocks", "mean", "se", F.when(F.col("sound"), F.col("critical")).alias("critical"), "lower", F.when(F.col("lower").isNull() | F.isnan("lower"), "unavailable").otherwise(status).alias("status"))


def _sums(times: Column) -> list[Column]:
    n, w = F.col("num"), F.col("w")
    return [F.sum(times * x).alias(name) for x, name in ((n, "sn"), (w, "sw"), (n * n, "snn"), (n * w, "snw"), (w * w, "sww"))]


def refit_steps(cells: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per refit and step: whether all groups are robustly positive (unavailable if one group is), and whether all means are."""
    unknown, ok = F.max(F.col("status") == "unavailable"), F.min(F.col("status") == "robust_positive")
    return cells.groupBy("refit", "level").agg(F.when(unknown, "unavailable").when(ok, "robust_generalizing").otherwise("not_robust_generalizing").alias("category"), F.min("lower").alias("min_lower"), (F.min("mean") > tolerance).alias("point"))


def across_refits(steps: DataFrame, min_refits: int = 2) -> DataFrame:
    """Per step: how many refits are robust, not robust and unavailable, and what that makes of the step.

    Fewer than min_refits refits in the whole table, or one without the step, make it unavailable.
    """
    n = lambda c: F.count_if(F.col("category") == c)
    robust, weak, unknown = n("robust_generalizing"), n("not_robust_generalizing"), n("unavailable")
    out = _supplied(steps).groupBy("level").agg(robust.alias("robust_refits"), weak.alias("not_robust_refits"), unknown.alias("unavailable_refits"), F.count("*").alias("n_refits"), F.max("supplied").alias("supplied"))
    lost = (F.col("supplied") < min_refits) | (F.col("n_refits") < F.col("supplied")) | (F.col("unavailable_refits") > 0)
    category = F.when(lost, "unavailable").when(F.col("robust_refits") == F.col("n_refits"), "robust_across_refits").otherwise("not_robust_across_refits")
    return out.select("level", "robust_refits", "not_robust_refits", "unavailable_refits", category.alias("category"))


def _supplied(steps: DataFrame) -> DataFrame:
    """Adds the number of refits; the table has as many rows as refits and steps."""
    return steps.withColumn("supplied", F.size(F.collect_set("refit").over(Window.partitionBy())))


def refit_ceilings(cells: DataFrame, min_refits: int = 2, tolerance: float = 0.0) -> DataFrame:
    """Per refit: certified_ceiling and point_ceiling, the highest level that is reached by steps that hold one after the other
    from the first (0 if that fails); and over all refits: all_refit_ceiling and stability.

    stability is stable if all refits certify the same level. A refit's good points lift no ceiling of the others.
    """
    step, whole = Window.partitionBy("level"), Window.partitionBy()  # as many rows as refits and steps
    steps = _supplied(refit_steps(cells, tolerance)).withColumn("robust", F.col("category") == "robust_generalizing")
    every = F.min("robust").over(step) & (F.count("*").over(step) == F.col("supplied")) & (F.col("supplied") >= min_refits)
    reached = lambda holds: F.coalesce(F.min(F.when(~F.col(holds), F.col("level"))) - 1, F.max("level")).cast("long")
    steps = steps.withColumn("every", every)
    steps = steps.withColumn("all_refit_ceiling", F.coalesce(F.min(F.when(~F.col("every"), F.col("level"))).over(whole) - 1, F.max("level").over(whole)).cast("long"))
    out = steps.groupBy("refit").agg(reached("robust").alias("certified_ceiling"), reached("point").alias("point_ceiling"), F.max("all_refit_ceiling").alias("all_refit_ceiling"))
    same = F.min("certified_ceiling").over(whole) == F.max("certified_ceiling").over(whole)
    return out.withColumn("stability", F.when(same, "stable").otherwise("refit_sensitive"))


def all_refits_pass(blocks: DataFrame, draws: int, seed: int, alpha: float = 0.05, min_refits: int = 2) -> DataFrame:
    """refit, grp, block, num, w -> one row: whether every refit's groups are all robustly positive."""
    steps = refit_steps(refit_bounds(blocks.withColumn("level", F.lit(1)), draws, seed, alpha))
    kind = lambda c: F.col("category") == c
    category = F.when((F.count("*") < min_refits) | F.max(kind("unavailable")), "unavailable").when(F.min(kind("robust_generalizing")), "robust_generalizing").otherwise("not_robust")
    return steps.agg(category.alias("category"), F.count("*").alias("n_refits"), F.min("min_lower").alias("min_lower"))


def sign_stability(blocks: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """refit, grp, block, num, w -> per group: refits with positive and other means; and stability over all groups.

    refit_sensitive if a group is positive in some refits only; else stable_generalizing (all positive),
    stable_non_generalizing (none) or stable_mixed. A mean that is not finite counts as not positive.
    """
    means = blocks.filter("w > 0").groupBy("refit", "grp").agg((F.sum("num") / F.sum("w")).alias("mean"))
    up = F.col("mean").isNotNull() & ~F.isnan("mean") & (F.col("mean") > tolerance)
    groups = means.groupBy("grp").agg(F.count_if(up).alias("positive_refits"), F.count_if(~up).alias("other_refits"))
    all_up, none_up = F.col("other_refits") == 0, F.col("positive_refits") == 0
    stability = F.when(F.max(~all_up & ~none_up), "refit_sensitive").when(F.min(all_up), "stable_generalizing").when(F.min(none_up), "stable_non_generalizing").otherwise("stable_mixed")
    return groups.crossJoin(F.broadcast(groups.agg(stability.alias("stability"))))


def scheme_sensitivity(schemes: Mapping[str, DataFrame], draws: int, seed: int, alpha: float = 0.05, min_refits: int = 8, min_blocks: int = 8, tolerance: float = 0.0) -> DataFrame:
    """Declared schemes of refits (refit, grp, block, num, w) -> per scheme: n_refits, category, mean over groups, least lower
    and greatest upper bound (null unless all groups have bounds); and sensitivity over the schemes.

    Each scheme has its own nested draws of one seed. sensitivity is unavailable if a scheme is, scheme_robust_generalizing or
    scheme_robust_non_generalizing if all agree on that, stable_ and the category if all agree on another, else
    scheme_sensitive. No scheme is chosen for the caller.
    """
    out = None
    for name, blocks in sorted(schemes.items()):
        blocks = blocks.filter("w > 0")
        cells = resample.nested_refits(blocks, draws, seed, alpha, (), min_blocks)
        size = blocks.agg(F.countDistinct("refit").alias("n_refits"))
        cells = cells.crossJoin(F.broadcast(size)).withColumn("status", F.when(F.col("n_refits") < min_refits, "unavailable").otherwise(interval_status(F.col("lower"), F.col("upper"), tolerance)))
        n = lambda s: F.count_if(F.col("status") == s)
        category = F.when(n("unavailable") > 0, "unavailable").when(n("robust_positive") == F.count("*"), "robust_generalizing").when(n("robust_nonpositive") == F.count("*"), "robust_non_generalizing").when(n("uncertain") > 0, "uncertain").otherwise("mixed")
        bounded = n("unavailable") == 0
        one = cells.agg(F.lit(name).alias("scheme"), F.max("n_refits").alias("n_refits"), category.alias("category"), F.avg("mean").alias("mean"), F.when(bounded, F.min("lower")).alias("min_lower"), F.when(bounded, F.max("upper")).alias("max_upper"))
        out = one if out is None else out.unionByName(one)
    whole = Window.partitionBy()  # as many rows as schemes
    first, last, lost = F.min("category").over(whole), F.max("category").over(whole), F.max(F.col("category") == "unavailable").over(whole)
    verdict = F.when(lost, "unavailable").when(first != last, "scheme_sensitive").otherwise(F.concat(F.when(first.startswith("robust"), "scheme_").otherwise("stable_"), first))
    return out.withColumn("sensitivity", verdict)


def scheme_alignment(base: DataFrame, schemes: Mapping[str, DataFrame]) -> DataFrame:
    """row_id, position of the validation rows and of each scheme's -> per scheme: missing, extra, moved, alignment; and status.

    status is row_mismatch if one scheme has other rows than the base, in which case the audit of schemes must not run, else
    audited_reordered_alignment or audited_exact_alignment. Joined rows need no reordering: a place is only reported.
    """
    out = None
    for name, rows in sorted(schemes.items()):
        one = row_alignment(base, rows).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    kind = lambda c: F.max(F.col("alignment") == c).over(Window.partitionBy())  # noqa: E731 (as many rows as schemes)
    status = F.when(kind("mismatch"), "row_mismatch").when(kind("reorderable"), "audited_reordered_alignment").otherwise("audited_exact_alignment")
    return out.withColumn("status", status)
