"""Stages that drop rows by number must drop the rows they judged, even if a second read would number rows otherwise."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, quality


@pytest.fixture
def resplit(spark):
    """Reads come with all files in one part first, and with one part per file after the call."""
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield lambda: spark.conf.set("spark.sql.files.minPartitionNum", "6")
    spark.conf.unset("spark.sql.files.minPartitionNum")


def _files(spark, path, rows, columns):
    frame = spark.createDataFrame(rows, columns).withColumn("part", F.col("doc_id") % 6)
    for i in range(6):
        frame.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def test_exact_copies_go_by_the_numbers_they_were_judged_by(spark, tmp_path, resplit):
    rows = [(i, f"text {i % 40} of many") for i in range(120)]
    docs = _files(spark, f"file://{tmp_path}/docs", rows, "doc_id long, text string")
    kept = exact_dedup.drop_copies(docs)
    resplit()  # the kept rows are read after the decision, on other splits
    got = sorted(r.doc_id for r in kept.collect())
    assert got == list(range(80, 120))


def test_poor_documents_go_by_the_numbers_they_were_judged_by(spark, tmp_path, resplit):
    rows = [(i, "This is a good plain sentence, written with care. " * 6 if i % 3 else "!!! ### $$$ @@@ %%% " * 12) for i in range(180)]
    docs = _files(spark, f"file://{tmp_path}/docs", rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(180)], "doc_id long, quality int")
    kept = quality.drop_poor(docs, labels)
    resplit()
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(180) if i % 3]
