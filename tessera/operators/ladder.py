"""Nested information ladders and full subset lattices of held-out scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.algebra import gain_category, weighted_mean
from tessera.functions.lineage import cut


def level_means(rows: DataFrame, group: str, weight: str, levels: Sequence[str]) -> DataFrame:
    """Long table of weighted mean scores: group, level (position in levels), score."""
    wide = rows.groupBy(group).agg(*[weighted_mean(F.col(c), F.col(weight)).alias(c) for c in levels])
    pairs = ", ".join(f"{n}, `{c}`" for n, c in enumerate(levels))
    return wide.select(group, F.expr(f"stack({len(levels)}, {pairs}) as (level, score)"))


def adjacent_gains(rows: DataFrame, group: str, weight: str, levels: Sequence[str]) -> DataFrame:
    """Gain of each level over the one below, per group."""
    below = F.lag("score").over(Window.partitionBy(group).orderBy("level"))
    return level_means(rows, group, weight, levels).withColumn("gain", F.col("score") - below).filter("level > 0")


def ladder_steps(gains: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row per step with its category, and whether all steps up to it generalize."""
    steps = gains.groupBy("level").agg(gain_category(F.col("gain"), tolerance).alias("category"), F.min("gain").alias("min_gain"))
    so_far = F.min(F.col("category") == "generalizing").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("reached", so_far)  # as many rows as the ladder has steps


def ceiling(gains: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: the highest level reached by generalizing steps alone (0 if the first fails)."""
    return ladder_steps(gains, tolerance).agg(F.coalesce(F.max(F.when(F.col("reached"), F.col("level"))), F.lit(0)).alias("ceiling"), F.count("*").alias("steps"))


def lattice_edges(nodes: DataFrame, blocks: int, tolerance: float = 1e-9) -> DataFrame:
    """nodes: subset_mask, group, score for all 2^blocks subsets. One row per edge: lower, block, category, min and mean gain."""
    nodes = cut(nodes)  # subsets x groups
    upper = nodes.select(F.col("subset_mask").alias("upper"), F.col("group").alias("u_group"), F.col("score").alias("u_score"))
    low = nodes.withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(blocks)]))).filter(F.expr("(subset_mask & shiftleft(1, block)) = 0"))
    joined = low.join(upper, (F.expr("subset_mask | shiftleft(1, block)") == F.col("upper")) & (F.col("group") == F.col("u_group")))
    gain = F.col("u_score") - F.col("score")
    return joined.groupBy("subset_mask", "block").agg(gain_category(gain, tolerance).alias("category"), F.min(gain).alias("min_gain"), F.avg(gain).alias("mean_gain"))


def shapley(edges: DataFrame, blocks: int) -> DataFrame:
    """Each block's mean gain over all orders of adding the blocks."""
    weights = [math.factorial(s) * math.factorial(blocks - s - 1) / math.factorial(blocks) for s in range(blocks)]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.bit_count("subset_mask") + 1)
    return edges.groupBy("block").agg(F.sum(weight * F.col("mean_gain")).alias("shapley"))


def monotone_paths(edges: DataFrame, blocks: int) -> DataFrame:
    """One row: in how many orders of adding the blocks every step generalizes, out of all orders."""
    edges = cut(edges)  # one row per edge
    good = edges.filter("category = 'generalizing'").select(F.col("subset_mask").alias("lower"), F.expr("subset_mask | shiftleft(1, block)").alias("upper"))
    reached = edges.select(F.lit(0).alias("mask"), F.lit(1).cast("long").alias("ways")).limit(1)
    for _ in range(blocks):  # as many small joins as blocks
        reached = reached.join(good, F.col("mask") == F.col("lower")).groupBy(F.col("upper").alias("mask")).agg(F.sum("ways").alias("ways"))
    return reached.agg(F.coalesce(F.sum("ways"), F.lit(0)).cast("long").alias("generalizing_paths"), F.lit(math.factorial(blocks)).cast("long").alias("paths"))
