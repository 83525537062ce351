"""Exact order statistics without ranking a whole table in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

MARGIN, ACCURACY, SMALL = 0.002, 20_000, 10_000


def order_statistic(rows: DataFrame, value: str, keys: tuple[str, ...], share: float, want: Callable[[Column], Column]) -> DataFrame:
    """Per key: n, and the want(n)-th least value; null where that rank lies outside 1 to n. Exact, with ties counted.

    share is the rank's part of n, up to two ranks. A mergeable quantile sketch, wrong by at most n / ACCURACY ranks,
    brackets the value; what lies below the bracket is only counted, what lies above is left out, and equal values inside
    are counted together before the few that remain are ordered. Up to SMALL values the bracket is open to the right,
    since two ranks are more than the margin there. Null values take no part. Without keys and rows there is one row, with
    n 0; a key whose values are all null has no row.
    """
    given = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    quantile = lambda p: F.percentile_approx("v", F.lit(min(max(p, 0.0), 1.0)), ACCURACY)
    bounds = given.groupBy(*keys).agg(F.count("*").alias("n"), quantile(share - MARGIN).alias("low"), quantile(share + MARGIN).alias("high"))
    wide = F.col("n") > SMALL
    bounds = bounds.withColumns({"low": F.when(wide, F.col("low")), "high": F.when(wide, F.col("high"))}).select(*[F.col(k).alias(f"b_{k}") for k in keys], "n", "low", "high")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    inside = given.join(bounds if keys else F.broadcast(bounds), met).filter("high is null or v <= high")
    cells = inside.groupBy(*keys, F.when(F.col("low").isNull() | (F.col("v") >= F.col("low")), F.col("v")).alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    through = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rank = want(F.col("n"))
    hits = cells.withColumn("through", through).filter((F.col("through") >= rank) & (F.col("through") - F.col("c") < rank)).select(*keys, F.col("v").alias("value"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"b_{k}").eqNullSafe(F.col(k))
    found = bounds.select(*[f"b_{k}" for k in keys], "n").join(hits if keys else F.broadcast(hits), met, "left")
    return found.select(*[F.col(f"b_{k}").alias(k) for k in keys], "n", "value")


BINS, GREATEST, TOLERANCE = 1024, 1.7976931348623157e308, 1e-12


def weighted_quantiles(rows: DataFrame, value: str, weight: str, keys: tuple[str, ...], shares: tuple[float, ...]) -> DataFrame:
    """Per key and share: the least value at which the weight up to it, ties included, reaches that share of the whole.

    keys, share, value, n, weight. Weights are summed over bins of equal width inside a bracket, a row for each bin and
    task; the bin in which the share is reached becomes the next bracket, until few rows or one value are left in it, and
    only those are ordered. So no task ranks a table, and the result is exact. Rows whose value is null or NaN, or whose
    weight is not positive, take no part; keys without rows have none. Infinite values are the greatest and least.
    """
    given = rows.select(*keys, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).filter("v is not null and not isnan(v) and w > 0")
    given = given.withColumn("v", F.greatest(F.least("v", F.lit(GREATEST)), F.lit(-GREATEST)))
    whole = given.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    named = [F.col(k).alias(f"b_{k}") for k in keys]
    marks = cut(whole.select(*named, wanted.alias("share"), "n", "total", "low", "high", F.lit(0.0).alias("below"), F.col("n").alias("inside")))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    own = [f"b_{k}" for k in keys]
    reached = F.col("through") >= F.col("share") * F.col("total") * (1 - TOLERANCE)

    def narrowed(marks: DataFrame) -> DataFrame:
        held = given.join(marks if keys else F.broadcast(marks), met & F.col("v").between(F.col("low"), F.col("high")))
        place = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        bins = held.groupBy(*own, "share", place.alias("bin")).agg(*[F.first(c).alias(c) for c in ("n", "total", "below")], F.sum("w").alias("w"), F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = Window.partitionBy(*own, "share").orderBy("bin")  # BINS rows at most
        bins = bins.withColumn("through", F.col("below") + F.sum("w").over(order)).withColumn("place", F.row_number().over(Window.partitionBy(*own, "share").orderBy(~reached, "bin")))
        # rounding may leave the last share unreached: then the last bin has it
        last = F.max("bin").over(Window.partitionBy(*own, "share"))
        chosen = bins.withColumn("last", last).filter((F.col("place") == 1) & (reached | (F.col("bin") == F.col("last"))) | (F.col("bin") == F.col("last")) & ~reached)
        return chosen.select(*own, "share", "n", "total", "low", "high", (F.col("through") - F.col("w")).alias("below"), "inside")

    wide = (F.col("inside") > SMALL) & (F.col("low") < F.col("high"))
    while marks.filter(wide).limit(1).count():
        marks = cut(narrowed(marks.filter(wide)).unionByName(marks.filter(~wide)))
    cells = given.join(marks if keys else F.broadcast(marks), met & F.col("v").between(F.col("low"), F.col("high")))
    cells = cells.groupBy(*own, "share", "v").agg(*[F.first(c).alias(c) for c in ("n", "total", "below")], F.sum("w").alias("w"))
    cells = cells.withColumn("through", F.col("below") + F.sum("w").over(Window.partitionBy(*own, "share").orderBy("v")))
    found = cells.groupBy(*own, "share").agg(F.coalesce(F.min(F.when(reached, F.col("v"))), F.max("v")).alias("value"), F.first("n").alias("n"), F.first("total").alias("weight"))
    endless = F.when(F.col("value") >= GREATEST, float("inf")).when(F.col("value") <= -GREATEST, float("-inf")).otherwise(F.col("value"))
    return found.select(*[F.col(f"b_{k}").alias(k) for k in keys], "share", endless.alias("value"), "n", "weight")
