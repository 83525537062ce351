"""Running values in the order of rows, for keys of any size.

A window over a key is one task, however many rows the key has. Where a key is large, rows are dealt to ranges of key and
order instead, each range is summed up by itself, the few summaries of a key are scanned, and what came before is carried
back to the range's rows. The ranges are written once, so that summaries and rows speak of the same ones; where they lie
does not change the result.

Running sums of doubles may differ in their last digits from those of a single pass, since they are added in other groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

HOT_ROWS = 2_000_000  # of a key, from which its rows are dealt to ranges
KINDS = ("sum", "count", "min", "max", "lag")


def _whole(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], inclusive: bool = True, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """rows with a column for each of values: name -> (kind, column), over the rows of the key up to the present one.

    kind: sum, count, min, max, or lag (the value of the row before, null for the first). inclusive: whether the present
    row counts (never for lag). Rows come in ascending order of `order`, nulls first; rows that tie in all of it are
    in an order of no promise, as in a window. Keys may be null, and may be none at all.
    """
    if any(kind not in KINDS for kind, _ in values.values()):
        raise ValueError(f"kinds are {KINDS}")
    end = 0 if inclusive else -1
    largest = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    def over(*by: str) -> dict[str, Column]:
        plain = Window.partitionBy(*by).orderBy(*order)
        frame = plain.rowsBetween(Window.unboundedPreceding, end)
        return {name: F.lag(F.struct(value.alias("v"))).over(plain) if kind == "lag" else _whole(kind, value).over(frame) for name, (kind, value) in values.items()}

    def opened(name: str) -> Column:
        return F.col(f"{name}.v") if values[name][0] == "lag" else F.col(name)

    if largest <= hot_rows:
        found = rows.withColumns(over(*keys))
        return found.withColumns({name: opened(name) for name in values if values[name][0] == "lag"}) if any(k == "lag" for k, _ in values.values()) else found
    n = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-largest // hot_rows))
    dealt = cut(rows.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()))
    last = F.struct(*order) if order else F.lit(0)
    parts = dealt.groupBy(*keys, "__range").agg(*[F.max_by(F.struct(value.alias("v")), last).alias(name) if kind == "lag" else _whole(kind, value).alias(name) for name, (kind, value) in values.items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    carried = parts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__of"),
        *[(F.last(name, ignorenulls=True) if kind == "lag" else again[kind](name)).over(before).alias(f"__before_{name}") for name, (kind, _) in values.items()],
    )
    met = F.col("__range") == F.col("__of")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = dealt.withColumns(over(*keys, "__range")).join(F.broadcast(carried) if n * 8 < 100_000 and not keys else carried, met, "left")
    out = {}
    for name, (kind, _) in values.items():
        mine, old = F.col(name), F.col(f"__before_{name}")
        out[name] = {"sum": F.coalesce(mine + old, mine, old), "count": F.coalesce(mine, F.lit(0)) + F.coalesce(old, F.lit(0)), "min": F.least(mine, old), "max": F.greatest(mine, old)}[kind] if kind != "lag" else F.coalesce(mine, old)["v"]
    return local.withColumns(out).select(*rows.columns, *values)
