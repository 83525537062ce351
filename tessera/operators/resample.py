"""Block resampling of gains. Rows are summed to blocks first; draws only ever touch the block table.

Draws come from a counter (an MD5 of seed, group, draw and slot), so that any engine can repeat them. A draw needs five
sums per group (N, W, NN, NW, WW), from which its mean and its cluster standard error follow.

Rows without weight are ignored. A group with a gain of minus infinity has that mean and is not estimable, nor is one with
too few blocks: such groups are reported as unavailable, without bounds, and take no part in draws and maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.algebra import counter_draw, interval_status, weighted_mean


def block_table(rows: DataFrame, group: str, block: str, gain: str, weight: str) -> DataFrame:
    """grp, block, num (weighted gain), w and the block's index in its group; blocks without weight are left out.

    The table is as small as the number of blocks and is cached: draws, points and bounds all start from it.
    """
    live = rows.filter(F.col(weight) > 0)
    return _indexed(live.groupBy(F.col(group).alias("grp"), F.col(block).alias("block")).agg(F.sum(F.col(weight) * F.col(gain)).alias("num"), F.sum(weight).alias("w"))).cache()


def _indexed(sums: DataFrame) -> DataFrame:
    """Adds each block's index, the number of blocks of its group and whether all of the group's sums are finite."""
    order, whole = Window.partitionBy("grp").orderBy("block"), Window.partitionBy("grp")
    finite = F.min(F.coalesce(F.abs("num") < float("inf"), F.lit(False))).over(whole)
    return sums.withColumns({"idx": F.row_number().over(order) - 1, "n_blocks": F.count("*").over(whole), "finite": finite})


def estimable(blocks: DataFrame, min_blocks: int = 1) -> DataFrame:
    return blocks.filter(F.col("finite") & (F.col("n_blocks") >= min_blocks))


def point(blocks: DataFrame) -> DataFrame:
    """Per group: mean, cluster standard error (null if the mean is minus infinity), number of blocks and whether it is finite."""
    sums = blocks.groupBy("grp").agg(F.count("*").alias("n"), F.min("finite").alias("finite"), *_sums())
    return sums.select("grp", F.col("n").alias("n_blocks"), (F.col("sn") / F.col("sw")).alias("mean"), F.when(F.col("finite"), cluster_error(F.col("n"))).alias("se"), "finite")


def _sums() -> list:
    n, w = F.col("num"), F.col("w")
    return [F.sum(n).alias("sn"), F.sum(w).alias("sw"), F.sum(n * n).alias("snn"), F.sum(n * w).alias("snw"), F.sum(w * w).alias("sww")]


def cluster_error(size):
    m = F.col("sn") / F.col("sw")
    inner = F.col("snn") - 2 * m * F.col("snw") + m * m * F.col("sww")
    return F.when(size > 1, F.sqrt(F.greatest(F.lit(0.0), inner) * size / F.greatest(size - 1, F.lit(1))) / F.col("sw")).otherwise(0.0)


def drawn(blocks: DataFrame, draws: int, seed: int, shared: bool = False) -> DataFrame:
    """grp, draw, mean and se of each resample; shared draws use one sequence of slots for all groups."""
    slots = blocks.select("grp", "n_blocks", F.col("idx").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    parts = [str(seed), *([] if shared else [F.col("grp")]), F.col("draw"), F.col("slot")]
    picks = slots.select("grp", "draw", counter_draw(F.col("n_blocks"), *parts).alias("pick"))
    sums = picks.join(blocks.select("grp", F.col("idx").alias("pick"), "num", "w", "n_blocks"), ["grp", "pick"]).groupBy("grp", "draw").agg(F.first("n_blocks").alias("n_blocks"), *_sums())
    return sums.select("grp", "draw", (F.col("sn") / F.col("sw")).alias("d_mean"), cluster_error(F.col("n_blocks")).alias("d_se"))


def percentile_interval(blocks: DataFrame, draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Per group: mean and linear percentile interval of the resampled means."""
    ends = drawn(estimable(blocks), draws, seed).groupBy("grp").agg(F.percentile("d_mean", F.lit(alpha / 2)).alias("lower"), F.percentile("d_mean", F.lit(1 - alpha / 2)).alias("upper"))
    return point(blocks).join(ends, "grp", "left").select("grp", "n_blocks", "mean", "lower", "upper", interval_status(F.col("lower"), F.col("upper")).alias("status"))


def _critical_higher(maxima: DataFrame, level: float) -> DataFrame:
    """The order statistic at the level, rounded up in rank; one row per draw goes in."""
    n = maxima.count()  # as many as draws
    rank = int(-(-(level * (n - 1)) // 1)) + 1
    return maxima.select("stat", F.row_number().over(Window.orderBy("stat")).alias("rank")).filter(F.col("rank") == rank).select(F.col("stat").alias("critical"))


def familywise(blocks: DataFrame, draws: int, seed: int, alpha: float = 0.05, min_blocks: int = 8) -> DataFrame:
    """Simultaneous intervals with each group's scale fixed at the spread of its resampled means; linear critical value."""
    d = drawn(estimable(blocks, min_blocks), draws, seed).join(point(blocks).select("grp", "mean"), "grp")
    spread = d.groupBy("grp").agg(F.stddev_samp("d_mean").alias("sd"))
    stat = F.when(F.col("sd") > 1e-15, F.abs(F.col("d_mean") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    critical = d.join(spread, "grp").groupBy("draw").agg(F.max(stat).alias("stat")).agg(F.percentile("stat", F.lit(1 - alpha)).alias("critical"))
    out = point(blocks).join(spread, "grp", "left").crossJoin(F.broadcast(critical))
    out = out.withColumns({"lower": F.col("mean") - F.col("critical") * F.col("sd"), "upper": F.col("mean") + F.col("critical") * F.col("sd")})
    return out.select("grp", "n_blocks", "mean", "critical", "lower", "upper", interval_status(F.col("lower"), F.col("upper")).alias("status"))


def group_intervals(blocks: DataFrame, draws: int, seed: int, alpha: float = 0.05, min_blocks: int = 8, tolerance: float = 0.0) -> DataFrame:
    """Per group, three intervals of the same draws: percentiles at alpha (marginal), at alpha over the number of groups
    (bonferroni), and max-t with the spread of the drawn means (max_t); each with lower, upper and status.

    The number of groups counts those that are not estimable too.
    """
    d = drawn(estimable(blocks, min_blocks), draws, seed)
    size = blocks.agg(F.countDistinct("grp").alias("n_groups"))
    ends = d.groupBy("grp").agg(
        F.stddev_samp("d_mean").alias("se"), F.percentile("d_mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("m"), F.sort_array(F.collect_list("d_mean")).alias("sorted"),  # as many as draws
    )

    def linear(share: Column) -> Column:
        place = share * (draws - 1)
        at = F.floor(place).cast("int")
        low, high = F.get("sorted", at), F.get("sorted", F.least(at + 1, F.lit(draws - 1)))
        return low + (high - low) * (place - at)

    tail = F.lit(alpha) / (2 * F.col("n_groups"))
    ends = ends.crossJoin(F.broadcast(size)).withColumns({"b_lower": linear(tail), "b_upper": linear(1 - tail)}).drop("sorted")
    stat = F.when(F.col("se") > 1e-15, F.abs(F.col("d_mean") - F.col("mean")) / F.col("se")).otherwise(0.0)
    critical = d.join(ends.select("grp", "se"), "grp").join(point(blocks).select("grp", "mean"), "grp").groupBy("draw").agg(F.max(stat).alias("stat")).agg(F.percentile("stat", F.lit(1 - alpha)).alias("critical"))
    out = point(blocks).drop("se").join(ends, "grp", "left").crossJoin(F.broadcast(critical))
    pairs = {"marginal": (F.col("m")[0], F.col("m")[1]), "bonferroni": (F.col("b_lower"), F.col("b_upper")), "max_t": (F.col("mean") - F.col("critical") * F.col("se"), F.col("mean") + F.col("critical") * F.col("se"))}
    columns = [c for name, (low, high) in pairs.items() for c in (low.alias(f"{name}_lower"), high.alias(f"{name}_upper"), interval_status(low, high, tolerance).alias(f"{name}_status"))]
    return out.select("grp", "n_blocks", "mean", "se", *columns)


def interval_categories(intervals: DataFrame) -> DataFrame:
    """rule (marginal, bonferroni, max_t), category over the groups, admissible (the rule's category is robust_generalizing)."""
    each = intervals.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_status").alias("status")) for r in ("marginal", "bonferroni", "max_t")])).alias("x")).select("x.*")
    count = lambda s: F.count_if(F.col("status") == s)
    category = F.when(count("unavailable") > 0, "unavailable").when(count("robust_positive") == F.count("*"), "robust_generalizing").when(count("robust_nonpositive") == F.count("*"), "robust_non_generalizing").when(count("uncertain") > 0, "uncertain").otherwise("mixed")
    return each.groupBy("rule").agg(category.alias("category")).withColumn("admissible", F.col("category") == "robust_generalizing")


def bootstrap_t(blocks: DataFrame, draws: int, seed: int, alpha: float = 0.05, shared: bool = False, one_sided: bool = False, min_blocks: int = 8) -> DataFrame:
    """Simultaneous studentised intervals; the standard error is computed anew in every draw.

    A draw without spread that did not move counts 0, one that moved counts infinity (signed if one-sided). One-sided
    critical values are at least 0 and give lower bounds only. With shared draws all groups are unavailable unless they
    have one and the same set of blocks: a slot must mean the same block in each.
    """
    d = drawn(estimable(blocks, min_blocks), draws, seed, shared).join(point(blocks).select("grp", "mean"), "grp")
    move = F.col("d_mean") - F.col("mean")
    size = move if one_sided else F.abs(move)
    endless = F.when(size > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    stat = F.when(F.col("d_se") > 1e-15, size / F.col("d_se")).when(F.abs(move) <= 1e-15, 0.0).otherwise(endless)
    critical = _critical_higher(d.groupBy("draw").agg(F.max(stat).alias("stat")), 1 - alpha)
    out = point(blocks).join(F.broadcast(critical), F.lit(True), "left")  # no critical value if no group is estimable
    c = F.greatest(F.lit(0.0), F.col("critical")) if one_sided else F.col("critical")
    lower = F.when(F.col("se") > 1e-15, F.col("mean") - c * F.col("se")).otherwise(F.col("mean"))
    upper = F.lit(float("inf")) if one_sided else F.when(F.col("se") > 1e-15, F.col("mean") + c * F.col("se")).otherwise(F.col("mean"))
    unequal = F.lit(False)
    if shared:
        held = blocks.groupBy("block").agg(F.count("*").alias("holders")).agg(F.min("holders").alias("fewest"))
        groups = blocks.agg(F.countDistinct("grp").alias("n_groups"))
        out = out.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(groups))
        unequal = F.col("fewest") < F.col("n_groups")
    sound = F.col("finite") & (F.col("n_blocks") >= min_blocks) & ~unequal & F.col("critical").isNotNull()
    out = out.withColumns({"lower": F.when(sound, lower), "upper": F.when(sound, upper), "critical": F.when(sound, c)})
    status = interval_status(F.col("lower"), F.col("upper"))
    return out.select("grp", "n_blocks", "mean", "se", "critical", "lower", *([] if one_sided else ["upper"]), status.alias("status"))


def family_category(cells: DataFrame, *by: str) -> DataFrame:
    """One row (or one per value of by): unavailable before all positive, all nonpositive, uncertain, mixed."""
    share = lambda s: F.avg((F.col("status") == s).cast("double"))
    return cells.groupBy(*by).agg(
        F.when(share("unavailable") > 0, "unavailable").when(share("robust_positive") == 1, "all_positive").when(share("robust_nonpositive") == 1, "all_nonpositive").when(share("uncertain") > 0, "uncertain").otherwise("mixed").alias("category"),
        F.count("*").alias("n_groups"),
    )


def nested_refits(refit_blocks: DataFrame, draws: int, seed: int, alpha: float = 0.05, steps: tuple[str, ...] = (), min_blocks: int = 1) -> DataFrame:
    """refit, grp, block, num, w -> per group: ensemble mean, nested standard error, simultaneous interval, spread of refits.

    Each draw takes one refit for all groups, then one sequence of blocks. With columns steps, the family is made of all
    groups and steps; the steps of a group share its blocks. Groups of fewer than min_blocks blocks have no bounds. The blocks are read
    several times: the caller caches them, and releases them when done.
    """
    cell = ["grp", *steps]
    refit_blocks = refit_blocks.filter("w > 0")
    order = Window.partitionBy("refit", *cell).orderBy("block")
    endless = refit_blocks.filter(~(F.abs("num") < float("inf"))).select(*cell).distinct()
    b = refit_blocks.join(endless, cell, "left_anti").withColumns({"idx": F.row_number().over(order) - 1, "n_blocks": F.count("*").over(Window.partitionBy("refit", *cell))})
    b = b.filter(F.col("n_blocks") >= min_blocks)
    refits = refit_blocks.select("refit").distinct().withColumn("r_idx", F.row_number().over(Window.orderBy("refit")) - 1)
    size = refits.agg(F.count("*").alias("n_refits"))
    picks = refits.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw")).crossJoin(F.broadcast(size)).select("draw", counter_draw(F.col("n_refits"), str(seed), "refit", F.col("draw")).alias("r_idx")).join(refits, "r_idx")
    slots = b.select("refit", *cell, "n_blocks", F.col("idx").alias("slot")).join(picks, "refit")
    chosen = slots.select("refit", *cell, "draw", counter_draw(F.col("n_blocks"), str(seed), F.col("grp"), F.col("draw"), F.col("slot")).alias("idx"))
    d = chosen.join(b, ["refit", *cell, "idx"]).groupBy(*cell, "draw").agg((F.sum("num") / F.sum("w")).alias("d_mean"))
    means = refit_blocks.groupBy("refit", *cell).agg((F.sum("num") / F.sum("w")).alias("m")).groupBy(*cell).agg(F.avg("m").alias("mean"), F.stddev_pop(F.when(F.abs("m") < float("inf"), F.col("m"))).alias("between_refits"))
    spread = d.groupBy(*cell).agg(F.stddev_samp("d_mean").alias("se")).join(means, cell, "right")
    stat = F.when(F.col("se") > 1e-15, F.abs(F.col("d_mean") - F.col("mean")) / F.col("se")).otherwise(0.0)
    critical = d.join(spread, cell).groupBy("draw").agg(F.max(stat).alias("stat")).agg(F.percentile("stat", F.lit(1 - alpha)).alias("critical"))
    out = spread.crossJoin(F.broadcast(critical))
    return out.select(*cell, "mean", "se", "between_refits", (F.col("mean") - F.col("critical") * F.col("se")).alias("lower"), (F.col("mean") + F.col("critical") * F.col("se")).alias("upper"))


def definition_sensitivity(rows: DataFrame, group: str, gain: str, weight: str, definitions: dict[str, object], draws: int, seed: int) -> DataFrame:
    """Per block definition and group: interval and status; and whether all definitions agree on the group's status."""
    out = None
    for name, column in definitions.items():
        one = percentile_interval(block_table(rows.withColumn("__block", column), group, "__block", gain, weight), draws, seed).select(F.lit(name).alias("definition"), "grp", "n_blocks", "lower", "upper", "status")
        out = one if out is None else out.unionByName(one)
    agree = out.groupBy("grp").agg((F.countDistinct("status") == 1).alias("stable"))
    return out.join(agree, "grp")


def weight_sensitivity(rows: DataFrame, group: str, block: str, gain: str, weights: dict[str, object]) -> DataFrame:
    """Per weighting and group: the mean gain; and whether its sign is the same under all weightings.

    Rows to which a weighting gives no weight are left out of it. A gain of minus infinity gives that mean. A weighting
    that leaves a group no rows has a null mean there, and the group is not stable.
    """
    out = None
    for name, column in weights.items():
        one = rows.withColumn("__w", column).groupBy(F.col(group).alias("grp")).agg(weighted_mean(F.col(gain), F.col("__w")).alias("mean")).select(F.lit(name).alias("weighting"), "grp", "mean")
        out = one if out is None else out.unionByName(one)
    told = F.count(F.when(~F.isnan("mean"), F.col("mean"))) == F.count("*")
    agree = out.groupBy("grp").agg((told & (F.countDistinct(F.col("mean") > 0) == 1)).alias("stable"))
    return out.join(agree, "grp")


def membership(units: DataFrame, unit: str, stratum: str, replicates: int, seed: int) -> DataFrame:
    """How often each unit is in each stratified bootstrap replicate (units drawn 0 times are left out)."""
    order = Window.partitionBy("stratum").orderBy("unit")
    indexed = units.select(F.col(unit).alias("unit"), F.col(stratum).alias("stratum")).distinct().withColumns({"idx": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("stratum"))})
    slots = indexed.select("stratum", "n", F.col("idx").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    picks = slots.select("stratum", "replicate", counter_draw(F.col("n"), str(seed), F.col("stratum"), F.col("replicate"), F.col("slot")).alias("idx"))
    return picks.join(indexed.select("stratum", "idx", "unit"), ["stratum", "idx"]).groupBy("replicate", "stratum", "unit").agg(F.count("*").alias("times"))
