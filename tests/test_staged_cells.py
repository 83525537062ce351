"""Queries over cells of lineitem read it once: later plans hold neither its scan nor a cache of many empty partitions."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from tessera.operators import ladder, workflow
from tessera.plans import information, inputs, lattices

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("made", [lambda s: information._lattice_nodes(s, DIR), lambda s: ladder.lattice_edges(information._lattice_nodes(s, DIR), 3), lambda s: lattices.node_scores(s, DIR)])
def test_lattices_are_built_from_staged_cells(spark, made):
    assert "FileScan parquet" not in plan(made(spark)) and "InMemory" not in plan(made(spark))


@pytest.mark.parametrize("made", [inputs.score_cells, inputs.gain_rows, inputs.refit_blocks, inputs.source_cells])
def test_margins_are_counted_from_staged_cells(spark, made):
    assert "FileScan parquet" not in plan(made(spark, DIR))


def test_rows_of_a_group_do_not_meet_in_one_task(spark, monkeypatch):
    """Weights and baselines are sent to the rows, and learners are given partitions of bounded size."""
    rows = spark.range(5000).selectExpr("id % 2 as stratum", "id % 4 as grp", "id").repartition(3)
    weighted = workflow.hierarchical_weights(rows, "stratum", "grp")
    assert "SortMergeJoin" not in plan(weighted) and weighted.agg({"training_weight": "sum"}).first()[0] == pytest.approx(1)
    monkeypatch.setattr(workflow, "SENT", 3)
    assert workflow.hierarchical_weights(rows, "stratum", "grp").agg({"training_weight": "sum"}).first()[0] == pytest.approx(1)
    monkeypatch.setattr(workflow, "HELD", 700)
    sizes = workflow._dealt(rows).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) <= 720
