"""Held-out scoring: does the conditional distribution learnt on some groups beat the marginal on others?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.algebra import gain_category, log_or_failure, weighted_mean


class UnseenState(ValueError):
    """A held-out row has a base or added state that training never saw."""


def strict_gain(train: DataFrame, heldout: DataFrame, base: Sequence[str], added: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Per group: weighted means of ln P(added | base), ln P(added) and their difference; no smoothing.

    train and heldout hold base, added and mass. States that training never saw raise; a pair of known states that never
    met scores minus infinity.
    """
    for axes in (base, added):
        if heldout.filter("mass > 0").join(train.filter("mass > 0"), list(axes), "left_anti").limit(1).count():
            raise UnseenState(f"held-out states of {list(axes)} are not in training")
    joint = train.groupBy(*base, *added).agg(F.sum("mass").alias("n_ba"))
    by_base = train.groupBy(*base).agg(F.sum("mass").alias("n_b"))
    by_added = train.groupBy(*added).agg(F.sum("mass").alias("n_a"))
    total = train.agg(F.sum("mass").alias("n"))
    rows = heldout.join(joint, [*base, *added], "left").join(by_base, list(base)).join(by_added, list(added)).crossJoin(F.broadcast(total))
    rows = rows.withColumns({"conditional": log_or_failure(F.coalesce("n_ba", F.lit(0.0)) / F.col("n_b")), "marginal": log_or_failure(F.col("n_a") / F.col("n"))})
    return grouped_gain(rows, group, "conditional", "marginal", "mass")


def grouped_gain(rows: DataFrame, group: Sequence[str], richer: str, plain: str, weight: str) -> DataFrame:
    """Per group: weighted means of two scores and the gain of the richer one."""
    w = F.col(weight)
    means = rows.groupBy(*group).agg(weighted_mean(F.col(richer), w).alias("conditional_score"), weighted_mean(F.col(plain), w).alias("marginal_score"), F.sum(w).alias("weight"))
    return means.withColumn("gain", F.col("conditional_score") - F.col("marginal_score"))


def crossfit_gain(rows: DataFrame, base: Sequence[str], added: Sequence[str], fold: str, group: Sequence[str], pseudocount: float) -> DataFrame:
    """Smoothed gains of each held-out row's fold under the other folds' counts; counts of a fold are totals minus its own.

    Returns one row per fold and group with the scores, the gain and the weight.
    """

    def others(keys: Sequence[str], name: str) -> DataFrame:
        own = rows.groupBy(fold, *keys).agg(F.sum("mass").alias("own"))
        every = rows.groupBy(*keys).agg(F.sum("mass").alias("every")) if keys else None
        folds = rows.select(fold).distinct()
        if every is None:
            whole = rows.agg(F.sum("mass").alias("every"))
            return own.crossJoin(F.broadcast(whole)).select(fold, (F.col("every") - F.col("own")).alias(name))
        full = every.crossJoin(F.broadcast(folds)).join(own, [fold, *keys], "left")  # a few folds per key
        return full.select(fold, *keys, (F.col("every") - F.coalesce("own", F.lit(0.0))).alias(name))

    states = rows.select(*added).distinct().agg(F.count("*").alias("k"))
    cells = rows.groupBy(fold, *group, *base, *added).agg(F.sum("mass").alias("mass"))
    scored = cells.join(others([*base, *added], "n_ba"), [fold, *base, *added]).join(others(base, "n_b"), [fold, *base]).join(others(added, "n_a"), [fold, *added]).join(others([], "n"), fold).crossJoin(F.broadcast(states))
    smooth = lambda top, bottom: F.ln((F.col(top) + pseudocount) / (F.col(bottom) + pseudocount * F.col("k")))
    scored = scored.withColumns({"conditional": smooth("n_ba", "n_b"), "marginal": smooth("n_a", "n")})
    return grouped_gain(scored, [fold, *group], "conditional", "marginal", "mass")


def summarise(gains: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: category over groups, with least, mean and greatest gain; groups weigh equally."""
    return gains.agg(gain_category(F.col("gain"), tolerance).alias("category"), F.min("gain").alias("min_gain"), F.avg("gain").alias("mean_gain"), F.max("gain").alias("max_gain"), F.count("*").alias("n_groups"))


def generalization_profile(rows: DataFrame, group: str, richer: str, plain: str, weight: str, epsilon: float = 1e-15) -> DataFrame:
    """Per group: gain of log scores of probabilities that are clamped at epsilon; here zero never becomes minus infinity."""
    w = F.col(weight)
    gain = F.sum(w * (F.ln(F.greatest(F.col(richer), F.lit(epsilon))) - F.ln(F.greatest(F.col(plain), F.lit(epsilon))))) / F.sum(w)
    return rows.groupBy(group).agg(gain.alias("gain"), F.sum(w).alias("weight"))
