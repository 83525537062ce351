"""Known-truth panels: error and power rates of the certification rules over simulated worlds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def certification_panel(spark: SparkSession, worlds: int, effects: dict[str, float], groups: int = 4, blocks: int = 20, rows: int = 10, draws: int = 300, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """Per scenario: shares of worlds where all groups are certified positive, and where some group's interval misses the truth.

    Each world is one row of a distributed range and is seeded by its own number.
    """
    names = sorted(effects)
    grid = spark.range(worlds).crossJoin(spark.createDataFrame([(n, float(effects[n])) for n in names], "scenario string, effect double"))

    def run(batches):
        for batch in batches:
            out = []
            for world, scenario, effect in zip(batch["id"], batch["scenario"], batch["effect"], strict=True):
                rng = np.random.default_rng([seed, int(world), names.index(scenario)])
                num = (effect + rng.normal(0, 0.5, (groups, blocks)) + rng.normal(0, 1, (groups, blocks, rows)).mean(axis=2)) * rows
                m, w = num.sum(axis=1) / (blocks * rows), float(blocks * rows)
                se = np.sqrt(blocks / (blocks - 1) * ((num - rows * m[:, None]) ** 2).sum(axis=1)) / w
                pick = rng.integers(0, blocks, (draws, groups, blocks))
                d = np.take_along_axis(np.broadcast_to(num, (draws, groups, blocks)), pick, axis=2)
                dm = d.sum(axis=2) / w
                dse = np.sqrt(blocks / (blocks - 1) * ((d - rows * dm[..., None]) ** 2).sum(axis=2)) / w
                critical = np.quantile(np.abs((dm - m) / dse).max(axis=1), 1 - alpha, method="higher")
                out.append((scenario, int((m - critical * se > 0).all()), int((np.abs(m - effect) > critical * se).any())))
            yield pd.DataFrame(out, columns=["scenario", "certified", "missed"])

    return grid.mapInPandas(run, "scenario string, certified int, missed int").groupBy("scenario").agg(F.count("*").alias("worlds"), F.avg("certified").alias("certified_rate"), F.avg("missed").alias("miss_rate"))
