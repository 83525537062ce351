"""Certified subset lattices: every edge and group of a lattice of held-out scores is one cell of one family.

A node is a subset of the added blocks of information, written as a bitmask; an edge adds one block to a subset. Rows are
summed to resampling blocks with one vector of weighted score sums, an entry for each node. A draw adds up vectors, and
edges are differences of its entries, so that all edges of a group share the draws that make them comparable, and a
lattice costs one resampling, however many edges it has.

Scores of minus infinity are legal for any node: edges that touch one such score in a group are not estimable there. Rows
without weight are ignored. Tables after the draws have a row for each edge and group at most; lattices have 2^k nodes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.algebra import counter_draw, gain_category, interval_status


def edges_of(k: int) -> list[tuple[int, int, int]]:
    """(lower subset, added block, upper subset) of all k * 2^(k-1) edges."""
    return [(mask, block, mask | 1 << block) for mask in range(1 << k) for block in range(k) if not mask >> block & 1]


def node_sums(rows: DataFrame, group: str, block: str, weight: str, scores: Sequence[str]) -> DataFrame:
    """grp, block, w, nums (weighted score sums, an entry for each node), idx of the block in its group, n_blocks.

    The table has a row for each block and is cached, since points, spreads and maxima all start from it; the caller may
    unpersist it.
    """
    live = rows.filter(F.col(weight) > 0)
    sums = live.groupBy(F.col(group).alias("grp"), F.col(block).alias("block")).agg(F.sum(weight).alias("w"), F.array(*[F.sum(F.col(weight) * F.col(s)) for s in scores]).alias("nums"))
    return sums.withColumns({"idx": F.row_number().over(Window.partitionBy("grp").orderBy("block")) - 1, "n_blocks": F.count("*").over(Window.partitionBy("grp"))}).cache()


def _cells(sums: DataFrame, k: int, *keep: str) -> DataFrame:
    """A row for each edge of each row of node means (grp, keep, means)."""
    parts = [F.struct(F.lit(low).alias("subset_mask"), F.lit(block).alias("added"), (F.col("means")[high] - F.col("means")[low]).alias("gain")) for low, block, high in edges_of(k)]
    return sums.select("grp", *keep, F.explode(F.array(*parts)).alias("e")).select("grp", *keep, "e.*")


def _means(parts: DataFrame, nodes: int, *by: str) -> DataFrame:
    total = parts.groupBy(*by).agg(F.first("n_blocks").alias("n_blocks"), F.sum("w").alias("w"), F.array(*[F.sum(F.col("nums")[i]) for i in range(nodes)]).alias("nums"))
    return total.withColumn("means", F.transform("nums", lambda x: x / F.col("w")))


def point_cells(sums: DataFrame, k: int) -> DataFrame:
    """subset_mask, added, grp, n_blocks, weight, mean_gain (minus infinity where a score is), finite."""
    cells = _cells(_means(sums, 1 << k, "grp"), k, "n_blocks", "w")
    finite = F.coalesce(F.abs("gain") < float("inf"), F.lit(False))
    return cells.select("subset_mask", "added", "grp", "n_blocks", F.col("w").alias("weight"), F.when(finite, F.col("gain")).otherwise(float("-inf")).alias("mean_gain"), finite.alias("finite"))


def certified_cells(sums: DataFrame, k: int, draws: int, seed: int, confidence: float = 0.95, min_blocks: int = 8, tolerance: float = 0.0) -> DataFrame:
    """point_cells with se, critical, lower, upper, status and estimable; one critical value for all cells of the family."""
    cells = point_cells(sums, k)
    slots = sums.select("grp", "n_blocks", F.col("idx").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picks = slots.select("grp", "draw", counter_draw(F.col("n_blocks"), str(seed), F.col("grp"), F.col("draw"), F.col("slot")).alias("idx"))
    drawn = _cells(_means(picks.join(sums, ["grp", "idx"]), 1 << k, "grp", "draw"), k, "draw")
    sound = cells.filter(F.col("finite") & (F.col("n_blocks") >= min_blocks)).select("subset_mask", "added", "grp", "mean_gain")
    key = ["subset_mask", "added", "grp"]
    moved = drawn.join(F.broadcast(sound), key)  # an edge and group each
    spread = moved.groupBy(*key).agg(F.stddev_samp("gain").alias("se"))
    stat = F.when(F.col("se") > 1e-15, F.abs(F.col("gain") - F.col("mean_gain")) / F.col("se")).otherwise(0.0)
    critical = moved.join(F.broadcast(spread), key).groupBy("draw").agg(F.max(stat).alias("stat")).agg(F.percentile("stat", F.lit(confidence)).alias("critical"))
    out = cells.join(F.broadcast(spread), key, "left").crossJoin(F.broadcast(critical))
    out = out.withColumns({"lower": F.col("mean_gain") - F.col("critical") * F.col("se"), "upper": F.col("mean_gain") + F.col("critical") * F.col("se")})
    status = interval_status(F.col("lower"), F.col("upper"), tolerance)
    return out.select(*key, "n_blocks", "weight", "mean_gain", "se", "critical", "lower", "upper", status.alias("status"), F.col("se").isNotNull().alias("estimable"))


def certified_edges(cells: DataFrame) -> DataFrame:
    """subset_mask, added, category over the groups, and how many of them have each status."""
    count = lambda s: F.count_if(F.col("status") == s)
    n = F.count("*")
    category = F.when(count("unavailable") > 0, "unavailable").when(count("robust_positive") == n, "robust_generalizing").when(count("robust_nonpositive") == n, "robust_non_generalizing").when(count("uncertain") > 0, "uncertain").otherwise("mixed")
    kinds = ("robust_positive", "robust_nonpositive", "uncertain", "unavailable")
    return cells.groupBy("subset_mask", "added").agg(category.alias("category"), *[count(s).alias(f"n_{s}") for s in kinds])


def certified_blocks(edges: DataFrame) -> DataFrame:
    """added, n_edges, category of each block over all orders."""
    count = lambda s: F.count_if(F.col("category") == s)
    n = F.count("*")
    category = F.when(count("unavailable") > 0, "unavailable").when(count("robust_generalizing") == n, "order_robust_generalizing").when(count("robust_non_generalizing") == n, "order_robust_non_generalizing").when(count("uncertain") > 0, "uncertain_or_order_sensitive").otherwise("order_sensitive")
    return edges.groupBy("added").agg(n.alias("n_edges"), category.alias("category"))


def paths(edges: DataFrame, k: int, good: str = "robust_generalizing") -> DataFrame:
    """One row: in how many of the k! orders every step is good, the share of them, and what that means.

    Ways to reach a subset are carried up the lattice inside one row: edges ascending by their lower subset, so that a
    subset's ways are complete before any edge leaves it.
    """
    steps = F.array_sort(F.collect_list(F.when(F.col("category") == good, F.struct("subset_mask", (F.col("subset_mask") + F.pow(F.lit(2), F.col("added")).cast("int")).alias("upper")))))
    start = F.concat(F.array(F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), (1 << k) - 1))
    ways = F.aggregate("steps", start, lambda w, s: F.transform(w, lambda x, i: F.when(i == s["upper"], x + F.get(w, s["subset_mask"])).otherwise(x)), lambda w: F.get(w, F.lit((1 << k) - 1)))
    total = math.factorial(k)
    out = edges.agg(steps.alias("steps")).select(ways.alias("full_paths"))
    status = F.when(F.col("full_paths") == total, "universal_full_transfer").when(F.col("full_paths") == 0, "no_full_transfer").otherwise("order_sensitive_full_transfer")
    return out.select("full_paths", F.lit(total).cast("long").alias("paths"), (F.col("full_paths") / total).alias("share"), status.alias("status"))


def certified_paths(cells: DataFrame, k: int) -> DataFrame:
    """paths of the certified edges with the size of the family: cells, estimable cells, critical value."""
    family = cells.agg(F.count("*").alias("n_cells"), F.count_if("estimable").alias("n_estimable"), F.max("critical").alias("critical"))
    return paths(certified_edges(cells), k).crossJoin(F.broadcast(family))


def shapley_by_group(cells: DataFrame, k: int, tolerance: float = 0.0) -> DataFrame:
    """added, grp, shapley, full_gain, additivity_error, category: order averages of the cells' mean gains.

    Null for all (category unavailable) if any cell lacks a finite gain: an average must not hide a failed edge.
    """
    weights = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.bit_count("subset_mask") + 1)
    whole = F.min(F.abs("mean_gain") < float("inf"))
    parts = cells.groupBy("grp", "added").agg(F.sum(weight * F.col("mean_gain")).alias("shapley"), whole.alias("whole"))
    # any one path from the empty to the full subset adds up to the full gain
    chain = cells.filter(F.col("subset_mask") == F.pow(F.lit(2), F.col("added")).cast("int") - 1).groupBy("grp").agg(F.sum("mean_gain").alias("full_gain"))
    over = Window.partitionBy("grp")
    out = parts.join(chain, "grp").withColumns({"sound": F.min("whole").over(Window.partitionBy()), "error": F.abs(F.sum("shapley").over(over) - F.col("full_gain"))})
    category = out.groupBy("added").agg(F.when(F.min("sound"), gain_category(F.col("shapley"), tolerance)).otherwise("unavailable").alias("category"))
    kept = [F.when(F.col("sound"), F.col(c)).alias(n) for c, n in (("shapley", "shapley"), ("full_gain", "full_gain"), ("error", "additivity_error"))]
    return out.select("added", "grp", *kept).join(F.broadcast(category), "added")
