"""Population summaries of group gains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.algebra import normal_quantile
from tessera.operators.resample import block_table, drawn

# fixed values: two-sided 95 % points of Student's t for 1 to 8 degrees of freedom
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306)
FEW_CLUSTERS = 10


def population_summary(gains: DataFrame, draws: int, seed: int, tolerance: float = 0.0) -> DataFrame:
    """grp, cluster, gain -> one row: mean, 95 % interval, share of positive groups with its Wilson bound, spread and quantiles.

    Ten clusters or more are resampled (linear percentiles); fewer get a cluster-robust Student interval, and a single one
    an interval without ends. With a gain that is not finite no bound can be told: they are null, and the status is
    unavailable.
    """
    one = gains.select(F.lit(0).alias("all"), "cluster", "gain", F.lit(1.0).alias("w"))
    blocks = block_table(one, "all", "cluster", "gain", "w").cache()
    clusters = blocks.count()
    z = normal_quantile(0.975)
    base = gains.agg(F.count("*").alias("n"), F.avg("gain").alias("mean"), F.stddev_samp("gain").alias("sd"), F.sum((F.col("gain") > tolerance).cast("int")).alias("k"), F.min(F.coalesce(F.abs("gain") < float("inf"), F.lit(False))).alias("finite"), *[F.percentile("gain", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])
    if clusters >= FEW_CLUSTERS:
        ends = drawn(blocks, draws, seed).agg(F.percentile("d_mean", F.lit(0.025)).alias("lower"), F.percentile("d_mean", F.lit(0.975)).alias("upper"))
        base = base.crossJoin(ends)
    else:
        m = F.col("mean")
        error = blocks.crossJoin(base.select("mean", "n")).agg(F.sqrt(F.sum(F.pow(F.col("num") - F.col("w") * m, F.lit(2))) / F.first(F.col("n") * F.col("n")) * clusters / max(1, clusters - 1)).alias("se"))
        half = F.col("se") * T95[clusters - 2] if clusters > 1 else F.lit(math.inf)
        base = base.crossJoin(error).withColumns({"lower": m - half, "upper": m + half})
    p, n = F.col("k") / F.col("n"), F.col("n")
    wilson = F.greatest(F.lit(0.0), (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))
    ahead = z * F.col("sd") * F.sqrt(1 + 1 / n)
    told = lambda c: F.when(F.col("finite"), c)
    status = F.when(~F.col("finite"), "unavailable").when(F.col("lower") > tolerance, "positive").when(F.col("upper") <= tolerance, "nonpositive").otherwise("uncertain")
    return base.select(
        "n", F.lit(clusters).cast("long").alias("clusters"), "mean", told(F.col("lower")).alias("lower"), told(F.col("upper")).alias("upper"), status.alias("status"), p.alias("positive_share"), wilson.alias("positive_share_lower"),
        told(F.col("mean") - ahead).alias("new_group_lower"), told(F.col("mean") + ahead).alias("new_group_upper"), "p10", "p50", "p90",
    )
