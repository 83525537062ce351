"""The pipeline against brute force where its stages allow it, and the guard of the driver entry."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.sql import SQL

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert all(set(b) <= set(a) for a, b in zip(seen, seen[1:], strict=False))
    exact = {}
    for i, t in seen[0].items():
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        exact[digest] = max(i, exact.get(digest, i))
    assert set(seen[1]) == set(exact.values())
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= set(seen[-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "mix"]


def test_run_returns_the_mixture(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} >= {"pipeline", *(n for n in names if n.startswith("op"))}
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= names


def test_stages_equal_their_sql_on_awkward_rows(spark, tmp_path):
    """Each stage but the first against the SQL of its operator, over what the stage before it kept; the first against its operator's predictions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = next(r.text for r in docs.filter("length(text) > 400").orderBy("doc_id").collect())
    words, item = clean.split(), next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").collect())
    near = " ".join([*words[:-1], "otherwise"])
    awkward = [(900001, None), (900002, ""), (900003, ""), (900004, clean), (900005, near), (900006, item + " " + " ".join(words[:20])), (900007, clean * 200), (900007, clean * 200), (900008, None)]
    rows = spark.createDataFrame([(i, t, None, "made" if i % 2 else None, 0) for i, t in awkward], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(rows).withColumns({"node": F.lit(1), "n_tokens": F.lit(2), "row_no": F.lit(3), "kept": F.lit(False)})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    ids = lambda sql: Counter(r[0] for r in con.execute(sql).fetchall())

    judged = {r.doc_id: r.predicted for r in quality.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert Counter(r.doc_id for r in good.select("doc_id").collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect() if judged[r.doc_id])

    kept = {"exact": "SELECT doc_id FROM ({}) WHERE kept", "near": "SELECT doc_id FROM ({}) WHERE kept", "benchmark": "SELECT doc_id FROM ({}) WHERE NOT contaminated"}
    twins = {"exact": "op2_exact_dedup", "near": "op10_near_dedup", "benchmark": "op1_decontaminate"}
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        after = stage(spark, docs, SF)
        if name == "mix":
            found = con.execute(SQL["op6_mixing"])
            columns = [c[0] for c in found.description]
            assert Counter(map(tuple, after.select(*columns).collect())) == Counter(found.fetchall())
        else:
            expected = ids(kept[name].format(SQL[twins[name]]))
            if name == "exact":  # the SQL names one row of each text by its id, which two rows may share
                expected = Counter(set(expected))
            assert after.columns == docs.columns and Counter(r.doc_id for r in after.select("doc_id").collect()) == expected, name
        docs = after


def test_stages_on_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
