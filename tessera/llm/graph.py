"""Connected components by hooking, pointer jumping and contraction; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import staged


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, up) with up followed to the top: every round doubles the length of the jumps."""
    jumps = staged(hooks, "hooks")
    while True:
        above = jumps.select(F.col("node").alias("a_node"), F.col("up").alias("a_up"))
        further = jumps.join(above, F.col("up") == F.col("a_node"), "left")
        jumps = staged(further.select("node", F.coalesce("a_up", "up").alias("up"), F.col("a_up").isNotNull().alias("moved")), "hooks")
        moved = jumps.filter("moved").limit(1).count()
        jumps = jumps.select("node", "up")
        if not moved:
            return jumps


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of the edges (a, b); comp is the least node reachable.

    In each round every node hooks on to its least lesser neighbour, and the edges that are left between different
    trees go on, once each, with the trees' roots for ends. A node that no tree took up has a lesser neighbour in the
    next round, so the nodes at least halve in two rounds.
    """
    left = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    names = left.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)
    while left.limit(1).count():
        up = _roots(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        below, beside = up.select(F.col("node").alias("b"), F.col("up").alias("to_b")), up.select(F.col("node").alias("a"), F.col("up").alias("to_a"))
        ends = left.join(below, "b").join(beside, "a", "left").select("to_b", F.coalesce("to_a", "a").alias("to_a")).filter("to_a != to_b")
        left = staged(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        again = names.join(up.select(F.col("node").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        names = staged(again.unionByName(up.select("node", F.col("up").alias("comp"))), "labels")
    return names.unionByName(names.select(F.col("comp").alias("node"), "comp").distinct())
