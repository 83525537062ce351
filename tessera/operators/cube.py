"""Support cubes: masses over cells of axes, kept as one row per cell that holds mass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def support_cube(events: DataFrame, axes: dict[str, Column], mass: Column) -> DataFrame:
    """One row per cell of the named axes with its summed mass; rows with a null axis or without positive mass don't count."""
    rows = events.select(*[c.alias(name) for name, c in axes.items()], mass.cast("double").alias("mass"))
    rows = rows.filter(F.col("mass") > 0).dropna(subset=list(axes))
    return rows.groupBy(*axes).agg(F.sum("mass").alias("mass"))


def marginal(cube: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The cube summed over all axes that are not kept."""
    return cube.groupBy(*axes).agg(F.sum("mass").alias("mass"))


def marginals(cube: DataFrame, subsets: Sequence[Sequence[str]], masses: Sequence[str] = ("mass",)) -> DataFrame:
    """All wanted marginals of the masses in one pass of GROUPING SETS; subset_no tells them apart."""
    axes = sorted({a for s in subsets for a in s})
    sets = [[F.col(a) for a in s] for s in subsets]
    rows = cube.groupingSets(sets, *[F.col(a) for a in axes]).agg(*[F.sum(m).alias(m) for m in masses], F.grouping_id().alias("gid"))
    code = {sum(1 << (len(axes) - 1 - i) for i, a in enumerate(axes) if a not in s): n for n, s in enumerate(subsets)}
    number = F.coalesce(*[F.when(F.col("gid") == g, n) for g, n in code.items()])
    return rows.withColumn("subset_no", number).drop("gid")


def normalised(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of the mass, within each cell of `by` if given; the totals are one small aggregate joined back."""
    if not by:
        return cube.crossJoin(F.broadcast(cube.agg(F.sum("mass").alias("total")))).withColumn("share", F.col("mass") / F.col("total")).drop("total")
    total = cube.groupBy(*by).agg(F.sum("mass").alias("total"))
    return cube.join(total, list(by)).withColumn("share", F.col("mass") / F.col("total")).drop("total")
