"""Choice among forecast candidates and audits of their trust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pareto_front(candidates: DataFrame, error: str = "coverage_error") -> DataFrame:
    """candidate, gain, region_size, admissible and the error column -> the admissible rows no other dominates.

    Dominance: no worse in gain (up), error and size (down), and better in one. The recommended row has the greatest gain
    (least name among equals). Candidates are few; the comparison is a join of their table with itself.
    """
    ok = candidates.filter("admissible")
    other = ok.select(F.col("candidate").alias("o"), F.col("gain").alias("og"), F.col(error).alias("oe"), F.col("region_size").alias("os"))
    no_worse = (F.col("og") >= F.col("gain")) & (F.col("oe") <= F.col(error)) & (F.col("os") <= F.col("region_size"))
    better = (F.col("og") > F.col("gain")) | (F.col("oe") < F.col(error)) | (F.col("os") < F.col("region_size"))
    front = ok.join(other, no_worse & better & (F.col("o") != F.col("candidate")), "left_anti")
    best = front.agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("candidate").alias("c")))["c"].alias("best"))
    return front.crossJoin(F.broadcast(best)).select("candidate", "gain", error, "region_size", (F.col("candidate") == F.col("best")).alias("recommended"))


def coverage_audit(rows: DataFrame, group: str, covered: str, weight: str, target: float, tolerance: float) -> DataFrame:
    """Per group: weighted coverage, its absolute error and whether that is within the tolerance (inclusive)."""
    out = rows.groupBy(group).agg((F.sum(F.col(weight) * F.col(covered).cast("double")) / F.sum(weight)).alias("coverage"), F.sum(weight).alias("weight"))
    error = F.abs(F.col("coverage") - target)
    return out.select(group, "coverage", error.alias("error"), (error <= tolerance).alias("calibrated"), "weight")


def trust_audit(coverage: DataFrame, gains: DataFrame, group: str, tolerance: float = 1e-9) -> DataFrame:
    """Per group: trusted if calibrated and its gain exceeds the tolerance."""
    label = F.when(F.col("calibrated") & (F.col("gain") > tolerance), "trusted").when(F.col("calibrated"), "calibrated_without_gain").when(F.col("gain") > tolerance, "gain_without_calibration").otherwise("neither")
    return coverage.join(gains.select(group, "gain"), group).select(group, "coverage", "gain", label.alias("trust"))


def trust_category(audit: DataFrame) -> DataFrame:
    share = F.avg((F.col("trust") == "trusted").cast("double"))
    return audit.agg(F.when(share == 1, "trusted").when(share == 0, "not_trusted").otherwise("mixed").alias("category"), F.sum((F.col("trust") == "trusted").cast("long")).alias("n_trusted"), F.count("*").alias("n_groups"))
