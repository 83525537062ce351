"""Information measures over support cubes: entropies, conditional information, local thickness, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.algebra import entropy
from tessera.operators.cube import marginals, normalised


def joint_entropies(cube: DataFrame, subsets: Sequence[Sequence[str]]) -> DataFrame:
    """One row per subset of axes: subset_no, entropy in nats."""
    return marginals(cube, subsets).groupBy("subset_no").agg(entropy(F.col("mass")).alias("entropy"))


def thickness_profile(cube: DataFrame, base: Sequence[str], z: str, t: str) -> DataFrame:
    """One row: how much information the axes z and t add once the base is known, alone, together and shared."""
    subsets = [[*base], [*base, z], [*base, t], [*base, z, t]]
    wide = joint_entropies(cube, subsets).agg(*[F.max(F.when(F.col("subset_no") == n, F.col("entropy"))).alias(f"h{n}") for n in range(4)])
    over = lambda n: F.greatest(F.lit(0.0), F.col(f"h{n}") - F.col("h0"))
    return wide.select(
        F.col("h0").alias("base_entropy"), over(1).alias("z_given_base"), over(2).alias("t_given_base"), over(3).alias("zt_given_base"),
        F.exp(over(1)).alias("z_effective"), F.exp(over(2)).alias("t_effective"), F.exp(over(3)).alias("zt_effective"), (over(1) + over(2) - over(3)).alias("shared_zt"),
    )


def thickness_map(cube: DataFrame, base: Sequence[str], added: Sequence[str], domain: DataFrame | None = None) -> DataFrame:
    """Per base cell: mass, entropy of the added axes and effective number of states; cells of the domain without mass are null."""
    cells = cube.groupBy(*base, *added).agg(F.sum("mass").alias("mass")).groupBy(*base).agg(F.sum("mass").alias("mass"), entropy(F.col("mass")).alias("entropy"))
    if domain is not None:
        cells = domain.select(*base).distinct().join(cells, list(base), "left")
    return cells.select(*base, F.coalesce("mass", F.lit(0.0)).alias("mass"), "entropy", F.exp("entropy").alias("effective"))


def overlap(a: DataFrame, b: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Schoener's overlap of two cubes over the given axes: 1 - sum |pa - pb| / 2."""
    pa = normalised(a.groupBy(*axes).agg(F.sum("mass").alias("mass"))).select(*axes, F.col("share").alias("pa"))
    pb = normalised(b.groupBy(*axes).agg(F.sum("mass").alias("mass"))).select(*axes, F.col("share").alias("pb"))
    gap = F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))))
    return pa.join(pb, list(axes), "full_outer").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.5 * gap)).alias("overlap"))


def overlaps(a: DataFrame, b: DataFrame, subsets: Sequence[Sequence[str]]) -> DataFrame:
    """subset_no, overlap: Schoener's overlap of two cubes on each subset of axes, all from one pass over both."""
    axes = sorted({x for s in subsets for x in s})
    side = lambda cube, mine, other: cube.select(*axes, F.col("mass").alias(mine), F.lit(0.0).alias(other))
    both = side(a, "ma", "mb").unionByName(side(b, "mb", "ma"))
    totals = both.agg(F.sum("ma").alias("ta"), F.sum("mb").alias("tb"))
    share = lambda m, t: F.coalesce(F.try_divide(F.col(m), F.col(t)), F.lit(0.0))
    gap = F.sum(F.abs(share("ma", "ta") - share("mb", "tb")))
    return marginals(both, subsets, ("ma", "mb")).crossJoin(F.broadcast(totals)).groupBy("subset_no").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.5 * gap)).alias("overlap"))


def overlap_profile(a: DataFrame, b: DataFrame, base: Sequence[str], z: str, t: str) -> DataFrame:
    """One row: overlaps on the base, with z, with t and on all axes, and what projections make look more alike.

    All are null if neither cube has mass.
    """
    names = ("base", "with_z", "with_t", "full")
    each = overlaps(a, b, [[*base], [*base, z], [*base, t], [*base, z, t]])
    out = each.agg(*[F.max(F.when(F.col("subset_no") == n, F.col("overlap"))).alias(name) for n, name in enumerate(names)])
    over = lambda c: F.when(F.col("full").isNotNull(), F.greatest(F.lit(0.0), c - F.col("full")))
    return out.select(*names, over(F.col("base")).alias("inflation"), over(F.least("with_z", "with_t")).alias("joint_only"))


def mutual_information(cube: DataFrame, base: Sequence[str], added: Sequence[str]) -> DataFrame:
    """One row: mutual information of base and added axes in nats."""
    h = joint_entropies(cube, [[*base], [*added], [*base, *added]]).agg(*[F.max(F.when(F.col("subset_no") == n, F.col("entropy"))).alias(f"h{n}") for n in range(3)])
    return h.select(F.greatest(F.lit(0.0), F.col("h0") + F.col("h1") - F.col("h2")).alias("information"), F.col("h0").alias("base_entropy"), F.col("h1").alias("added_entropy"))
