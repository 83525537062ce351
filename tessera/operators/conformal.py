"""Split-conformal regions and bounds for new groups; ranks are exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import order_statistic

TOLERANCE = 1e-12


def threshold(scores: DataFrame, alpha: float, clip: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th least score (per key). Beyond n: infinity, or the greatest score if clipped."""

    def want(n: Column) -> Column:
        rank = F.ceil((n + 1) * (1 - alpha) - TOLERANCE)
        return F.least(rank, n) if clip else rank

    found = order_statistic(scores, "score", keys, 1 - alpha, want)
    return found.select(*keys, F.coalesce("value", F.lit(float("inf"))).alias("threshold"), F.col("n").alias("n_calibration"))


def prediction_sets(calibration: DataFrame, field: DataFrame, alpha: float) -> DataFrame:
    """calibration: score = 1 - p of the true state. field: row_id, state, p. One row per row_id: states of the set, sorted, and its size.

    A set that would be empty holds the likeliest state (the least label among equals).
    """
    t = threshold(calibration, alpha, clip=False)
    rows = field.crossJoin(F.broadcast(t)).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.when(1 - F.col("p") <= F.col("threshold") + TOLERANCE, F.col("state")))).alias("states"),
        F.min(F.struct((-F.col("p")).alias("q"), F.col("state").alias("state"))).alias("best"),
    )
    states = F.when(F.size("states") > 0, F.col("states")).otherwise(F.array("best.state"))
    return rows.select("row_id", states.alias("states"), F.size(states).cast("long").alias("set_size"))


def circular_distance(a: Column, b: Column, period: float) -> Column:
    gap = F.pmod(a - b, F.lit(period))
    return F.least(gap, F.lit(period) - gap)


def interval_coverage(calibration: DataFrame, test: DataFrame, alpha: float) -> DataFrame:
    """y, mu, s in both tables -> one row: half width in units of s, covered share and mean width of the test intervals."""
    t = threshold(calibration.select((F.abs(F.col("y") - F.col("mu")) / F.col("s")).alias("score")), alpha, clip=True)
    inside = F.abs(F.col("y") - F.col("mu")) <= F.col("threshold") * F.col("s")
    return test.crossJoin(F.broadcast(t)).agg(F.first("threshold").alias("threshold"), F.avg(inside.cast("double")).alias("coverage"), F.avg(2 * F.col("threshold") * F.col("s")).alias("mean_width"), F.count("*").alias("n_test"))


def arc_coverage(calibration: DataFrame, test: DataFrame, alpha: float, period: float = 24.0) -> DataFrame:
    """y, mu on a circle -> one row: half width (at most half the period), covered share and arc length."""
    t = threshold(calibration.select(circular_distance(F.col("y"), F.col("mu"), period).alias("score")), alpha, clip=True)
    half = F.least(F.col("threshold"), F.lit(period / 2))
    inside = circular_distance(F.col("y"), F.col("mu"), period) <= half + TOLERANCE
    return test.crossJoin(F.broadcast(t)).agg(F.first(half).alias("half_width"), F.avg(inside.cast("double")).alias("coverage"), F.first(2 * half).alias("arc"), F.count("*").alias("n_test"))


def joint_coverage(calibration: DataFrame, test: DataFrame, alpha: float, period: float = 24.0) -> DataFrame:
    """Product region of an arc for c (around c_mu) and an interval for y (around mu, scale s), each at half of alpha."""
    arc = threshold(calibration.select(circular_distance(F.col("c"), F.col("c_mu"), period).alias("score")), alpha / 2, clip=True).select(F.least(F.col("threshold"), F.lit(period / 2)).alias("half_width"))
    line = threshold(calibration.select((F.abs(F.col("y") - F.col("mu")) / F.col("s")).alias("score")), alpha / 2, clip=True).select("threshold")
    both = (circular_distance(F.col("c"), F.col("c_mu"), period) <= F.col("half_width") + TOLERANCE) & (F.abs(F.col("y") - F.col("mu")) <= F.col("threshold") * F.col("s"))
    return test.crossJoin(F.broadcast(arc)).crossJoin(F.broadcast(line)).agg(F.first("half_width").alias("half_width"), F.first("threshold").alias("threshold"), F.avg(both.cast("double")).alias("coverage"), F.count("*").alias("n_test"))


def group_envelope(gains: DataFrame, alpha: float) -> DataFrame:
    """stratum, grp, gain -> per stratum: the floor((n + 1) alpha)-th least gain, a lower bound for a new group (minus infinity at rank 0)."""
    found = order_statistic(gains, "gain", ("stratum",), alpha, lambda n: F.floor((n + 1) * alpha + TOLERANCE))
    return found.select("stratum", F.col("n").alias("n_groups"), F.coalesce("value", F.lit(float("-inf"))).alias("bound"))


def envelope_validation(bounds: DataFrame, gains: DataFrame) -> DataFrame:
    """Per stratum: share of validation groups at or above the frozen bound; groups weigh equally."""
    return gains.join(bounds, "stratum").groupBy("stratum").agg(F.avg((F.col("gain") >= F.col("bound")).cast("double")).alias("coverage"), F.count("*").alias("n_validation"))
