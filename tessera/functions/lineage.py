"""Cutting the lineage of tables that loops build on, in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed under spark.checkpoint.dir; where that is unset, only local mode falls back to a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        context.setCheckpointDir(path)
    return df.checkpoint()
