"""Streaming forms of the thinning rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_per_window(events: DataFrame, key: str, ts: str, id_: str, width: str, late: str) -> DataFrame:
    """The earliest event of each key and tumbling window, emitted once the watermark has passed the window."""
    timed = events.withWatermark(ts, late)
    found = timed.groupBy(key, F.window(ts, width)).agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(id_).alias("id"))).alias("e"))
    return found.select(key, F.col("window.start").alias("bin"), F.col("e.id").alias(id_), F.col("e.ts").alias(ts))


def rolling_thin(events: DataFrame, key: str, ts: str, id_: str, seconds: float) -> DataFrame:
    """Keeps an event if it comes at least so many seconds after the last kept one of its key; one timestamp of state per key."""
    gap = int(seconds * 1_000_000)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["us", id_])
        kept = []
        for us, i in zip(rows["us"], rows[id_], strict=True):
            if last is None or us - last >= gap:
                kept.append((name[0], int(i), int(us)))
                last = int(us)
        state.update((last,))
        yield pd.DataFrame(kept, columns=[key, id_, "us"])

    rows = events.select(key, id_, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {id_} long, us long", "last long", "append", GroupStateTimeout.NoTimeout)
