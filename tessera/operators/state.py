"""Dirichlet-smoothed state models and discrete scores of their probability fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.algebra import log_or_failure, weighted_mean


def dirichlet_field(train: DataFrame, base: Sequence[str], added: str, alpha: float, unseen: str = "marginal", domain: DataFrame | None = None) -> DataFrame:
    """p(added | base) for all base cells (of the domain, if given) and all added states, with the smoothed marginal.

    unseen decides what base cells without training mass get: the marginal, a uniform distribution, or an error.
    """
    states = train.groupBy(added).agg(F.sum("mass").alias("n_a"))
    size = states.agg(F.count("*").alias("k"), F.sum("n_a").alias("n"))
    bases = (domain if domain is not None else train).select(*base).distinct()
    by_base = train.groupBy(*base).agg(F.sum("mass").alias("n_b"))
    joint = train.groupBy(*base, added).agg(F.sum("mass").alias("n_ba"))
    if unseen == "error" and bases.join(by_base.filter("n_b > 0"), list(base), "left_anti").limit(1).count():
        raise ValueError("base cells without training mass")
    # the field itself is base cells x added states; states are few and broadcast below Spark's own size check
    field = bases.crossJoin(states).crossJoin(F.broadcast(size)).join(by_base, list(base), "left").join(joint, [*base, added], "left")
    marginal = (F.col("n_a") + alpha) / (F.col("n") + alpha * F.col("k"))
    seen = (F.coalesce("n_ba", F.lit(0.0)) + alpha) / (F.col("n_b") + alpha * F.col("k"))
    fallback = 1 / F.col("k") if unseen == "uniform" else marginal
    return field.select(*base, added, F.when(F.col("n_b") > 0, seen).otherwise(fallback).alias("p"), marginal.alias("p_marginal"))


def score_field(heldout: DataFrame, field: DataFrame, base: Sequence[str], added: str, group: Sequence[str] = ()) -> DataFrame:
    """Per group: log score, Brier score and top-1 rate of the field and of the marginal, and the mass whose base the field has."""
    cell = Window.partitionBy(*base)
    best = F.row_number().over(cell.orderBy(F.col("p").desc(), F.col(added)))
    best_marginal = F.row_number().over(cell.orderBy(F.col("p_marginal").desc(), F.col(added)))
    rated = field.select(*base, added, "p", "p_marginal", F.sum(F.col("p") * F.col("p")).over(cell).alias("sq"), F.sum(F.col("p_marginal") * F.col("p_marginal")).over(cell).alias("sq_marginal"), (best == 1).cast("double").alias("top"), (best_marginal == 1).cast("double").alias("top_marginal"))
    rows = heldout.groupBy(*group, *base, added).agg(F.sum("mass").alias("mass")).join(rated, [*base, added], "left")
    w = F.when(F.col("p").isNotNull(), F.col("mass")).otherwise(0.0)
    mean = lambda c: weighted_mean(c, w)
    out = rows.groupBy(*group).agg(
        mean(log_or_failure(F.col("p"))).alias("log_score"), mean(log_or_failure(F.col("p_marginal"))).alias("marginal_log_score"),
        mean(1 - 2 * F.col("p") + F.col("sq")).alias("brier"), mean(1 - 2 * F.col("p_marginal") + F.col("sq_marginal")).alias("marginal_brier"),
        mean(F.col("top")).alias("top1"), mean(F.col("top_marginal")).alias("marginal_top1"), (F.sum(w) / F.sum("mass")).alias("seen_mass"),
    )
    return out.withColumn("gain", F.col("log_score") - F.col("marginal_log_score"))
