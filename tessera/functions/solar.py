"""Local mean solar time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows so close to sunrise or sunset (6 and 18 h mean solar time) are ambiguous.
MARGIN_HOURS = 12 / 3600


def solar_hour(ts: Column, longitude: Column) -> Column:
    """Hour of mean solar time in [0, 24) from a UTC timestamp and degrees east."""
    day = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(86_400_000_000)) / 3_600_000_000
    return F.pmod(day + longitude / 15, F.lit(24.0))


def solar_context(ts: Column, longitude: Column) -> Column:
    """1 by day, 0 by night, null within the margin of a boundary or where an input is null."""
    h = solar_hour(ts, longitude)
    near = (F.abs(h - 6) <= MARGIN_HOURS) | (F.abs(h - 18) <= MARGIN_HOURS)
    return F.when(~near, ((h > 6) & (h < 18)).cast("int"))


def altitude_band(height: Column, cuts: tuple[float, ...] = (50.0, 200.0, 500.0)) -> Column:
    """Number of cuts at or below the height; null stays null."""
    return F.when(height.isNotNull(), sum(((height >= c).cast("int") for c in cuts), F.lit(0)))
