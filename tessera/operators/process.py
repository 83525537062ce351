"""Inference over training processes: gains of refits on blocks, with variance along both.

Cells without weight are ignored. A group with a gain of minus infinity has that mean; like one whose variance cannot be
told (a single refit or block), it is unavailable, without variances and bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.algebra import MINUS_INFINITY, counter_draw, t_quantile
from tessera.operators.resample import _indexed, bootstrap_t


def _margin(cells: DataFrame, by: str) -> DataFrame:
    return cells.groupBy("grp", by).agg(F.sum("num").alias("num"), F.sum("w").alias("w"))


def _jackknife(cells: DataFrame, by: str) -> DataFrame:
    """Per group: delete-one variance along `by`, from totals minus own part."""
    whole = Window.partitionBy("grp")
    m = _margin(cells, by).select("grp", "num", "w", F.sum("num").over(whole).alias("sn"), F.sum("w").over(whole).alias("sw"), F.count("*").over(whole).alias("n"))
    # without a second line nothing is left, and no variance can be told
    left = F.when(F.col("n") > 1, F.try_divide(F.col("sn") - F.col("num"), F.col("sw") - F.col("w")) - F.col("sn") / F.col("sw"))
    return m.groupBy("grp").agg((F.sum(left * left) * (F.first("n") - 1) / F.first("n")).alias("v"), F.first("n").alias("n"))


def _clustered(cells: DataFrame, *by: str) -> DataFrame:
    whole = Window.partitionBy("grp")
    m = cells.groupBy("grp", *by).agg(F.sum("num").alias("num"), F.sum("w").alias("w")).select("grp", "num", "w", F.sum("num").over(whole).alias("sn"), F.sum("w").over(whole).alias("sw"), F.count("*").over(whole).alias("n"))
    gap = F.col("num") - F.col("w") * F.col("sn") / F.col("sw")
    return m.groupBy("grp").agg((F.sum(gap * gap) / F.pow(F.first("sw"), F.lit(2)) * F.first("n") * F.try_divide(F.lit(1.0), F.first("n") - 1)).alias("v"), F.first("n").alias("n"))


def jackknife_bounds(cells: DataFrame, alpha: float = 0.05, rule: str = "sum") -> DataFrame:
    """refit, grp, block, num, w -> per group: mean, variances along refits and blocks, lower t bound.

    rule `sum` adds both variances, `max` takes the larger. Degrees of freedom: the smaller number of refits or blocks, less one.
    """
    cells = cells.filter("w > 0").cache()  # refits x groups x blocks
    r = _jackknife(cells, "refit").select("grp", F.col("v").alias("v_refit"), F.col("n").alias("n_refits"))
    b = _jackknife(cells, "block").select("grp", F.col("v").alias("v_block"), F.col("n").alias("n_blocks"))
    mean = cells.groupBy("grp").agg((F.sum("num") / F.sum("w")).alias("mean"))
    both = mean.join(r, "grp").join(b, "grp").withColumn("df", F.least("n_refits", "n_blocks") - 1)
    v = F.col("v_refit") + F.col("v_block") if rule == "sum" else F.greatest("v_refit", "v_block")
    return _bounded(both.withColumn("variance", v), alpha)


def source_bounds(cells: DataFrame, alpha: float = 0.05, minimum: int = 8) -> DataFrame:
    """source, inner, grp, block, num, w -> bounds as of jackknife_bounds along sources and blocks.

    Inner refits are averaged within their source first. Groups with fewer sources, inner refits of a source or blocks
    than the minimum are unavailable.
    """
    cells = cells.cache()  # sources x inner refits x groups x blocks
    inner = cells.groupBy("grp", "source").agg(F.countDistinct("inner").alias("n")).groupBy("grp").agg(F.min("n").alias("n_inner"), F.count("*").alias("n_sources"))
    sizes = inner.join(cells.groupBy("grp").agg(F.countDistinct("block").alias("n_blocks")), "grp")
    bounds = jackknife_bounds(cells.groupBy(F.col("source").alias("refit"), "grp", "block").agg(F.avg("num").alias("num"), F.avg("w").alias("w")), alpha)
    few = F.least("n_inner", "n_sources", "n_blocks") < minimum
    return bounds.join(sizes, "grp").select(*[F.col(c) for c in bounds.columns if c != "status"], F.when(few, "unavailable").otherwise(F.col("status")).alias("status"))


def crossed_bounds(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-way clustered variance V_refit + V_block - V_cell, not below either one-way part."""
    cells = cells.filter("w > 0").cache()
    parts = [_clustered(cells, *by).select("grp", F.col("v").alias(name), F.col("n").alias(f"n_{name}")) for by, name in ((("refit",), "v_refit"), (("block",), "v_block"), (("refit", "block"), "v_cell"))]
    both = cells.groupBy("grp").agg((F.sum("num") / F.sum("w")).alias("mean"))
    for p in parts:
        both = both.join(p, "grp")
    v = F.greatest(F.col("v_refit") + F.col("v_block") - F.col("v_cell"), "v_refit", "v_block")
    return _bounded(both.withColumns({"df": F.least("n_v_refit", "n_v_block") - 1, "variance": v}), alpha)


def _bounded(rows: DataFrame, alpha: float) -> DataFrame:
    dfs = sorted(r[0] for r in rows.select("df").distinct().collect())  # a few distinct numbers
    quantile = F.coalesce(*[F.when(F.col("df") == n, F.lit(t_quantile(1 - alpha, n))) for n in dfs if n > 0], F.lit(None).cast("double"))
    told = lambda c: F.when((F.col("mean") > MINUS_INFINITY) & (F.col("df") >= 1) & ~F.isnan(c), F.col(c))
    lower = F.col("mean") - quantile * F.sqrt(told("variance"))
    status = F.when((F.col("df") < 1) | lower.isNull() | F.isnan(lower), "unavailable").when(lower > 0, "robust_positive").otherwise("not_positive")
    return rows.select("grp", "mean", told("v_refit").alias("v_refit"), told("v_block").alias("v_block"), told("variance").alias("variance"), F.col("df").cast("long").alias("df"), lower.alias("lower"), status.alias("status"))


def component_bounds(cells: DataFrame, draws: int, seed: int, alpha: float = 0.05, min_units: int = 8) -> DataFrame:
    """Test of both components (v2): per group, one-sided bootstrap-t bounds along refits and along blocks, each for itself.

    A group is robustly positive if both lower bounds are above 0. Critical values are common to all estimable groups.
    """
    out = None
    for by in ("refit", "block"):
        one = bootstrap_t(_indexed(_margin(cells.filter("w > 0"), by).withColumnRenamed(by, "block")), draws, seed, alpha, one_sided=True, min_blocks=min_units)
        one = one.select("grp", "mean", F.col("n_blocks").alias(f"n_{by}s"), F.col("lower").alias(f"lower_{by}"), F.col("status").alias(f"s_{by}"))
        out = one if out is None else out.join(one.drop("mean"), "grp")
    either = lambda s: (F.col("s_refit") == s) | (F.col("s_block") == s)
    status = F.when(either("unavailable"), "unavailable").when((F.col("s_refit") == "robust_positive") & (F.col("s_block") == "robust_positive"), "robust_positive").otherwise("not_positive")
    return out.select("grp", "mean", "n_refits", "n_blocks", "lower_refit", "lower_block", status.alias("status"))


def pigeonhole_bounds(cells: DataFrame, draws: int, seed: int, alpha: float = 0.05, min_units: int = 8) -> DataFrame:
    """Pigeonhole bootstrap (v3): refits and blocks are drawn independently, a cell counts as often as both of its lines.

    Per group: mean and the lower alpha quantile of the drawn means. The same drawn refits and blocks serve all groups.
    """
    cells = cells.filter("w > 0").cache()
    endless = cells.filter(~(F.abs("num") < float("inf"))).select("grp").distinct()
    times = []
    for by in ("refit", "block"):
        lines = cells.select(by).distinct().withColumns({"idx": F.row_number().over(Window.orderBy(by)) - 1, "n": F.count("*").over(Window.partitionBy())})  # a few lines of the design
        slots = lines.select("n", F.col("idx").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        picks = slots.select("draw", counter_draw(F.col("n"), str(seed), F.lit(by), F.col("draw"), F.col("slot")).alias("idx")).groupBy("draw", "idx").agg(F.count("*").alias(f"t_{by}"))
        times.append(picks.join(lines.select("idx", by), "idx").select("draw", by, f"t_{by}"))
    drawn = cells.join(endless, "grp", "left_anti").join(times[0], "refit").join(times[1], ["draw", "block"])
    weight = F.col("t_refit") * F.col("t_block")
    means = drawn.groupBy("grp", "draw").agg((F.sum(weight * F.col("num")) / F.sum(weight * F.col("w"))).alias("m"))
    lower = means.groupBy("grp").agg(F.percentile("m", F.lit(alpha)).alias("lower"))
    whole = cells.groupBy("grp").agg((F.sum("num") / F.sum("w")).alias("mean"), F.countDistinct("refit").alias("n_refits"), F.countDistinct("block").alias("n_blocks"))
    few = F.least("n_refits", "n_blocks") < min_units
    out = whole.join(lower, "grp", "left").withColumn("lower", F.when(~few, F.col("lower")))
    return out.select("grp", "mean", "n_refits", "n_blocks", "lower", F.when(F.col("lower").isNull(), "unavailable").when(F.col("lower") > 0, "robust_positive").otherwise("not_positive").alias("status"))
