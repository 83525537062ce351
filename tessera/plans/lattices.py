"""Queries of the certified information lattice, with their SQL.

The return flag is predicted from each subset of line status (bit 0), month (bit 1) and line number (bit 2); groups are
supplier remainders, resampling blocks are part remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators import lattice
from tessera.plans.certification import DRAWS, _pick
from tessera.plans.information import rounds
from tessera.plans.inputs import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AXES = ("s", "t", "z")
K = len(AXES)
NODES = [f"n{mask}" for mask in range(1 << K)]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _axes(mask: int) -> list[str]:
    return [a for i, a in enumerate(AXES) if mask >> i & 1]


def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, block, w and the smoothed log score of each subset; a few cells per group and block."""
    rows = table(spark, sf_dir, "lineitem")
    x = cut(rows.groupBy(
        (F.col("l_suppkey") % 4).cast("int").alias("grp"), (F.col("l_partkey") % 12).cast("int").alias("block"), F.col("l_returnflag").alias("a"),
        F.col("l_linestatus").alias("s"), F.month("l_shipdate").alias("t"), F.col("l_linenumber").alias("z"),
    ).agg(F.count("*").cast("double").alias("w")))
    cells = x
    for mask in range(1 << K):
        keys = _axes(mask)
        joint = cells.groupBy("a", *keys).agg(F.sum("w").alias("n_ak"))
        base = joint.groupBy(*keys).agg(F.sum("n_ak").alias("n_k"))
        x = x.join(joint, ["a", *keys])
        x = x.join(base, keys) if keys else x.crossJoin(F.broadcast(base))
        x = x.withColumn(f"n{mask}", F.ln((F.col("n_ak") + 0.5) / (F.col("n_k") + 1.5))).drop("n_ak", "n_k")
    return x


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.node_sums(node_scores(spark, sf_dir), "grp", "block", "w", NODES)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.certified_cells(_sums(spark, sf_dir), K, DRAWS, 15)


def _scores_sql() -> str:
    columns = []
    for mask in range(1 << K):
        keys = ", ".join(_axes(mask))
        columns.append(f"ln((sum(w) OVER (PARTITION BY a{', ' + keys if keys else ''}) + 0.5) / (sum(w) OVER ({'PARTITION BY ' + keys if keys else ''}) + 1.5)) AS n{mask}")
    return f"""lc AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS grp, CAST(l_partkey % 12 AS INTEGER) AS block, l_returnflag AS a, l_linestatus AS s, month(l_shipdate) AS t, l_linenumber AS z, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
 sc AS (SELECT grp, block, w, {', '.join(columns)} FROM lc),
 bl AS (SELECT grp, block, sum(w) AS w, {', '.join(f'sum(w * {n}) AS {n}' for n in NODES)}, row_number() OVER (PARTITION BY grp ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM sc GROUP BY grp, block)"""


def _edges_sql(source: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, {low} AS subset_mask, {b} AS added, (n{high} - n{low}) / w AS gain FROM {source}" for low, b, high in lattice.edges_of(K))


CELLS = f"""{_scores_sql()},
 gt AS (SELECT grp, any_value(n) AS n_blocks, sum(w) AS w, {', '.join(f'sum({n}) AS {n}' for n in NODES)} FROM bl GROUP BY grp),
 pc AS ({_edges_sql('gt', 'grp, n_blocks, w AS weight')})"""
FAMILY = f"""{CELLS},
 dv AS (SELECT p.grp, p.d, sum(w) AS w, {', '.join(f'sum({n}) AS {n}' for n in NODES)} FROM (SELECT b.grp, d.d, {_pick(15, 'b.n', 'b.grp', 'd.d', 'b.idx')} AS pick FROM bl b CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS d) d) p JOIN bl ON bl.grp = p.grp AND bl.idx = p.pick GROUP BY p.grp, p.d),
 de AS ({_edges_sql('dv', 'grp, d')}),
 sp AS (SELECT grp, subset_mask, added, stddev_samp(gain) AS se FROM de GROUP BY ALL),
 cr AS (SELECT quantile_cont(stat, 0.95) AS critical FROM (SELECT de.d, max(abs(de.gain - pc.gain) / se) AS stat FROM de JOIN sp USING (grp, subset_mask, added) JOIN pc USING (grp, subset_mask, added) GROUP BY de.d) t),
 ce AS (SELECT pc.*, se, critical, gain - critical * se AS lower, gain + critical * se AS upper, CASE WHEN gain - critical * se > 0 THEN 'robust_positive' WHEN gain + critical * se <= 0 THEN 'robust_nonpositive' ELSE 'uncertain' END AS status FROM pc JOIN sp USING (grp, subset_mask, added), cr),
 ed AS (SELECT subset_mask, added, CASE WHEN bool_and(status = 'robust_positive') THEN 'robust_generalizing' WHEN bool_and(status = 'robust_nonpositive') THEN 'robust_non_generalizing' WHEN bool_or(status = 'uncertain') THEN 'uncertain' ELSE 'mixed' END AS category,
   {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ('robust_positive', 'robust_nonpositive', 'uncertain', 'unavailable'))} FROM ce GROUP BY ALL)"""


@query(f"WITH {FAMILY} SELECT subset_mask, added, grp, n_blocks, weight, round(gain, 9) AS mean_gain, round(se, 9) AS se, round(critical, 9) AS critical, round(lower, 9) AS lower, round(upper, 9) AS upper, status, true AS estimable FROM ce")
def lattice_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(_cells(spark, sf_dir))


@query(f"WITH {FAMILY} SELECT * FROM ed")
def lattice_certified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.certified_edges(_cells(spark, sf_dir))


@query(f"WITH {FAMILY} SELECT added, count(*) AS n_edges, CASE WHEN bool_and(category = 'robust_generalizing') THEN 'order_robust_generalizing' WHEN bool_and(category = 'robust_non_generalizing') THEN 'order_robust_non_generalizing' WHEN bool_or(category = 'uncertain') THEN 'uncertain_or_order_sensitive' ELSE 'order_sensitive' END AS category FROM ed GROUP BY added")
def lattice_certified_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.certified_blocks(lattice.certified_edges(_cells(spark, sf_dir)))


@query(f"""WITH {FAMILY}, ok AS (SELECT subset_mask AS lo, subset_mask + (1 << added) AS hi FROM ed WHERE category = 'robust_generalizing'),
 pa AS (SELECT count(*) AS n FROM ok a JOIN ok b ON a.hi = b.lo JOIN ok c ON b.hi = c.lo WHERE a.lo = 0)
 SELECT n AS full_paths, CAST(6 AS BIGINT) AS paths, round(n / 6, 9) AS share, CASE WHEN n = 6 THEN 'universal_full_transfer' WHEN n = 0 THEN 'no_full_transfer' ELSE 'order_sensitive_full_transfer' END AS status,
   (SELECT count(*) FROM ce) AS n_cells, (SELECT count(*) FROM ce) AS n_estimable, (SELECT round(max(critical), 9) FROM ce) AS critical FROM pa""")
def lattice_certified_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(lattice.certified_paths(_cells(spark, sf_dir), K))


@query(f"""WITH {CELLS}, sh AS (SELECT grp, added, sum(gain * CASE bit_count(CAST(subset_mask AS INTEGER)) WHEN 1 THEN 1 / 6.0 ELSE 1 / 3.0 END) AS v FROM pc GROUP BY ALL),
 fu AS (SELECT grp, (n7 - n0) / w AS f FROM gt), ca AS (SELECT added, CASE WHEN min(v) > 0 THEN 'generalizing' WHEN max(v) <= 0 THEN 'non_generalizing' ELSE 'mixed' END AS category FROM sh GROUP BY added)
 SELECT sh.added, sh.grp, round(v, 9) AS shapley, round(f, 9) AS full_gain, round(abs(sum(v) OVER (PARTITION BY sh.grp) - f), 9) AS additivity_error, category FROM sh JOIN fu ON sh.grp = fu.grp JOIN ca ON ca.added = sh.added""")
def lattice_shapley_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(lattice.shapley_by_group(lattice.point_cells(_sums(spark, sf_dir), K), K))
