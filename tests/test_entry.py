import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["support_cube", "thickness_map", "projection_overlap_profile", "grouped_transfer", "identity_time_transfer", "state_scores", "ladder_ceiling", "bootstrap_t_v2", "joint_reweight", "conformal_sets", "pareto_front", "hash_chain", "temporal_normalize", "rolling_thin", "interval_coalesce"]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: f"{x:.8g}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    frame = duck.execute(catalogue.SQL[name]).df()
    expected = [[None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in row] for row in frame.itertuples(index=False)]
    assert sorted(got.columns) == sorted(frame.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(list(frame.columns), expected)


def test_every_sql_belongs_to_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 70


def test_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'thickness_profile' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
