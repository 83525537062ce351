"""Queries that certify gains by resampling, reweighting, conformal ranks and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.algebra import t_quantile
from tessera.operators import conformal, decisions, density, novelty, population, process, refits, resample, robust, selection, simulate, stacking
from tessera.plans import inputs
from tessera.plans.information import rounds
from tessera.plans.inputs import gain_rows, nation_gains, refit_blocks, refit_level_blocks, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: the reference's defaults: draws of the bootstraps, of joint reweighting, and of each simulated world; bisections; worlds
DRAWS, JOINT_DRAWS, PANEL_DRAWS, BISECTIONS, WORLDS = 4000, 1000, 500, 50, 1000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _status(lower: str, upper: str) -> str:
    return f"CASE WHEN {lower} > 0 THEN 'robust_positive' WHEN {upper} <= 0 THEN 'robust_nonpositive' ELSE 'uncertain' END"


def _pick(seed: int, size: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(parts) + f"), 1, 12) AS BIGINT) % {size}"


BLOCKS = f"{inputs.SCORES}, bl AS (SELECT g AS grp, b AS block, sum(w * (s2 - s0)) AS num, sum(w) AS w, row_number() OVER (PARTITION BY g ORDER BY b) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM sc GROUP BY g, b)"
ERROR = "sqrt(greatest(0, sum(num * num) - 2 * (sum(num) / sum(w)) * sum(num * w) + (sum(num) / sum(w)) ** 2 * sum(w * w)) * any_value(n) / (any_value(n) - 1)) / sum(w)"
POINT = f"pt AS (SELECT grp, any_value(n) AS n_blocks, sum(num) / sum(w) AS mean, {ERROR} AS se FROM bl GROUP BY grp)"


def _draws(seed: int, shared: bool = False) -> str:
    pick = _pick(seed, "b.n", *([] if shared else ["b.grp"]), "d.d", "b.idx")
    return f"dr AS (SELECT p.grp, p.d, sum(num) / sum(w) AS m, {ERROR} AS se FROM (SELECT b.grp, d.d, {pick} AS pick FROM bl b CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS d) d) p JOIN bl ON bl.grp = p.grp AND bl.idx = p.pick GROUP BY p.grp, p.d)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.block_table(gain_rows(spark, sf_dir), "grp", "block", "gain", "w")


@query(f"""WITH {BLOCKS}, {POINT}, {_draws(1)}, q AS (SELECT grp, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM dr GROUP BY grp)
 SELECT pt.grp, n_blocks, round(mean, 9) AS mean, round(lower, 9) AS lower, round(upper, 9) AS upper, {_status('lower', 'upper')} AS status FROM pt JOIN q ON pt.grp = q.grp""")
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.percentile_interval(_blocks(spark, sf_dir), DRAWS, 1))


@query(f"""WITH {BLOCKS}, {POINT}, {_draws(2)}, sp AS (SELECT grp, stddev_samp(m) AS sd FROM dr GROUP BY grp),
 c AS (SELECT quantile_cont(stat, 0.95) AS critical FROM (SELECT d, max(CASE WHEN sd > 1e-15 THEN abs(m - mean) / sd ELSE 0 END) AS stat FROM dr JOIN pt ON dr.grp = pt.grp JOIN sp ON dr.grp = sp.grp GROUP BY d))
 SELECT pt.grp, n_blocks, round(mean, 9) AS mean, round(critical, 9) AS critical, round(mean - critical * sd, 9) AS lower, round(mean + critical * sd, 9) AS upper, {_status('mean - critical * sd', 'mean + critical * sd')} AS status FROM pt JOIN sp ON pt.grp = sp.grp, c""")
def familywise_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.familywise(_blocks(spark, sf_dir), DRAWS, 2))


INTERVALS = f"""{BLOCKS}, {POINT}, {_draws(2)}, sp AS (SELECT grp, stddev_samp(m) AS se, quantile_cont(m, 0.025) AS ml, quantile_cont(m, 0.975) AS mu, list(m ORDER BY m) AS ms FROM dr GROUP BY grp),
 c AS (SELECT quantile_cont(stat, 0.95) AS c FROM (SELECT d, max(CASE WHEN sp.se > 1e-15 THEN abs(m - mean) / sp.se ELSE 0 END) AS stat FROM dr JOIN pt ON dr.grp = pt.grp JOIN sp ON dr.grp = sp.grp GROUP BY d)),
 tl AS (SELECT 0.05 / (2 * count(*)) * {DRAWS - 1} AS lo, (1 - 0.05 / (2 * count(*))) * {DRAWS - 1} AS hi FROM sp),
 iv AS (SELECT sp.grp, n_blocks, mean, sp.se, ml, mu, ms[CAST(floor(lo) AS INTEGER) + 1] + (ms[CAST(floor(lo) AS INTEGER) + 2] - ms[CAST(floor(lo) AS INTEGER) + 1]) * (lo - floor(lo)) AS bl, ms[CAST(floor(hi) AS INTEGER) + 1] + (ms[CAST(floor(hi) AS INTEGER) + 2] - ms[CAST(floor(hi) AS INTEGER) + 1]) * (hi - floor(hi)) AS bu, mean - c * sp.se AS tl, mean + c * sp.se AS tu FROM sp JOIN pt ON sp.grp = pt.grp, c, tl),
 ig AS (SELECT *, {_status('ml', 'mu')} AS s1, {_status('bl', 'bu')} AS s2, {_status('tl', 'tu')} AS s3 FROM iv)"""


@query(f"WITH {INTERVALS} SELECT grp, n_blocks, round(mean, 9) AS mean, round(se, 9) AS se, round(ml, 9) AS marginal_lower, round(mu, 9) AS marginal_upper, s1 AS marginal_status, round(bl, 9) AS bonferroni_lower, round(bu, 9) AS bonferroni_upper, s2 AS bonferroni_status, round(tl, 9) AS max_t_lower, round(tu, 9) AS max_t_upper, s3 AS max_t_status FROM ig")
def group_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.group_intervals(_blocks(spark, sf_dir), DRAWS, 2))


@query(f"""WITH {INTERVALS}, e AS (SELECT 'marginal' AS rule, s1 AS s FROM ig UNION ALL SELECT 'bonferroni', s2 FROM ig UNION ALL SELECT 'max_t', s3 FROM ig),
 ca AS (SELECT rule, CASE WHEN bool_and(s = 'robust_positive') THEN 'robust_generalizing' WHEN bool_and(s = 'robust_nonpositive') THEN 'robust_non_generalizing' WHEN bool_or(s = 'uncertain') THEN 'uncertain' ELSE 'mixed' END AS category FROM e GROUP BY rule) SELECT rule, category, category = 'robust_generalizing' AS admissible FROM ca""")
def interval_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.interval_categories(resample.group_intervals(_blocks(spark, sf_dir), DRAWS, 2))


def _t_sql(seed: int, shared: bool = False, one_sided: bool = False) -> str:
    size = "(m - mean)" if one_sided else "abs(m - mean)"
    rank = int(-(-(0.95 * (DRAWS - 1)) // 1)) + 1
    c = "greatest(0, critical)" if one_sided else "critical"
    upper = "" if one_sided else f", round(mean + {c} * pt.se, 9) AS upper"
    status = _status(f"mean - {c} * pt.se", "CAST('inf' AS DOUBLE)" if one_sided else f"mean + {c} * pt.se")
    return f"""WITH {BLOCKS}, {POINT}, {_draws(seed, shared)}, st AS (SELECT d, max({size} / dr.se) AS stat FROM dr JOIN pt ON dr.grp = pt.grp GROUP BY d),
 c AS (SELECT stat AS critical FROM (SELECT stat, row_number() OVER (ORDER BY stat) AS r FROM st) WHERE r = {rank})
 SELECT pt.grp, n_blocks, round(mean, 9) AS mean, round(pt.se, 9) AS se, round({c}, 9) AS critical, round(mean - {c} * pt.se, 9) AS lower{upper}, {status} AS status FROM pt, c"""


@query(_t_sql(3))
def bootstrap_t_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.bootstrap_t(_blocks(spark, sf_dir), DRAWS, 3))


@query(_t_sql(4, one_sided=True))
def one_sided_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.bootstrap_t(_blocks(spark, sf_dir), DRAWS, 4, one_sided=True))


@query(_t_sql(5, shared=True))
def shared_block_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.bootstrap_t(_blocks(spark, sf_dir), DRAWS, 5, shared=True))


#: the first group's first block gets a gain of minus infinity: the group is out, the others are as without it
ENDLESS = BLOCKS.replace("bl AS (", "bl0 AS (") + ", bl AS (SELECT * FROM bl0 WHERE grp > (SELECT min(grp) FROM bl0))"
OUT = "SELECT min(grp) AS grp, (SELECT n FROM bl0 ORDER BY grp LIMIT 1) AS n_blocks, CAST('-inf' AS DOUBLE) AS mean"


def _endless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gain_rows(spark, sf_dir)
    first = rows.agg(F.min(F.struct("grp", "block")).alias("first"))
    marked = rows.crossJoin(F.broadcast(first)).withColumn("gain", F.when(F.struct("grp", "block") == F.col("first"), float("-inf")).otherwise(F.col("gain")))
    return marked.drop("first")


@query(_t_sql(3).replace(BLOCKS, ENDLESS) + f" UNION ALL {OUT}, NULL AS se, NULL AS critical, NULL AS lower, NULL AS upper, 'unavailable' AS status FROM bl0")
def bootstrap_t_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.bootstrap_t(resample.block_table(_endless(spark, sf_dir), "grp", "block", "gain", "w"), DRAWS, 3))


@query(f"WITH {BLOCKS}, {POINT} SELECT grp, n_blocks, round(mean, 9) AS mean, round(se, 9) AS se, CAST(NULL AS DOUBLE) AS critical, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, 'unavailable' AS status FROM pt")
def shared_block_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last group's blocks have other names than those of the rest."""
    rows = gain_rows(spark, sf_dir)
    last = rows.agg(F.max("grp").alias("last"))
    named = rows.crossJoin(F.broadcast(last)).withColumn("block", F.col("block") + F.when(F.col("grp") == F.col("last"), 100).otherwise(0)).drop("last")
    return rounds(resample.bootstrap_t(resample.block_table(named, "grp", "block", "gain", "w"), DRAWS, 5, shared=True))


@query(f"WITH t AS ({_t_sql(3)}) SELECT CASE WHEN min(status) = 'robust_positive' AND max(status) = 'robust_positive' THEN 'all_positive' WHEN min(status) = 'robust_nonpositive' AND max(status) = 'robust_nonpositive' THEN 'all_nonpositive' WHEN max(status) = 'uncertain' THEN 'uncertain' ELSE 'mixed' END AS category, count(*) AS n_groups FROM t")
def family_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.family_category(resample.bootstrap_t(_blocks(spark, sf_dir), DRAWS, 3))


def _nested_sql(seed: int) -> str:
    return f"""b AS (SELECT *, row_number() OVER (PARTITION BY refit, grp ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY refit, grp) AS n FROM rb),
 p AS (SELECT d, {_pick(seed, '5', "'refit'", 'd')} AS refit FROM (SELECT unnest(generate_series(0, {DRAWS - 1})) AS d)),
 k AS (SELECT b.refit, b.grp, p.d, {_pick(seed, 'b.n', 'b.grp', 'p.d', 'b.idx')} AS idx FROM b JOIN p ON b.refit = p.refit),
 dr AS (SELECT k.grp, k.d, sum(num) / sum(w) AS m FROM k JOIN b ON k.refit = b.refit AND k.grp = b.grp AND k.idx = b.idx GROUP BY ALL),
 mm AS (SELECT grp, avg(m) AS mean, stddev_pop(m) AS br FROM (SELECT refit, grp, sum(num) / sum(w) AS m FROM rb GROUP BY ALL) GROUP BY grp), sp AS (SELECT grp, stddev_samp(m) AS se FROM dr GROUP BY grp),
 c AS (SELECT quantile_cont(stat, 0.95) AS c FROM (SELECT d, max(abs(m - mean) / se) AS stat FROM dr JOIN mm ON dr.grp = mm.grp JOIN sp ON dr.grp = sp.grp GROUP BY d))"""


@query(f"""WITH {inputs.REFITS}, {_nested_sql(6)}
 SELECT mm.grp, round(mean, 9) AS mean, round(se, 9) AS se, round(br, 9) AS between_refits, round(mean - c * se, 9) AS lower, round(mean + c * se, 9) AS upper FROM mm JOIN sp ON mm.grp = sp.grp, c""")
def refit_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.nested_refits(refit_blocks(spark, sf_dir).cache(), DRAWS, 6))


def _fixed_set(seed: int, table: str, shared: bool = False) -> str:
    """Cells of a fixed set of refits with one-sided bounds: table `fc`, from refit, grp, level, block, num, w."""
    pick = _pick(seed, "n", *([] if shared else ["grp"]), "d", "idx")
    move, unit = "(sn / sw - mean)", "sqrt(greatest(0, snn - 2 * (sn / sw) * snw + (sn / sw) ** 2 * sww) * n / (n - 1)) / sw"
    rank = int(-(-(0.95 * (DRAWS - 1)) // 1)) + 1
    sums = lambda t: ", ".join(f"sum({t}{x}) AS {name}" for x, name in (("num", "sn"), ("w", "sw"), ("num * num", "snn"), ("num * w", "snw"), ("w * w", "sww")))
    return f"""ix AS (SELECT grp, block, row_number() OVER (PARTITION BY grp ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT grp, block FROM {table})),
 tm AS (SELECT grp, d, idx, count(*) AS t FROM (SELECT grp, d, {pick} AS idx FROM ix CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS d) d) GROUP BY ALL),
 fp AS (SELECT refit, grp, level, n, sn / sw AS mean, {unit} AS se FROM (SELECT refit, grp, level, count(*) AS n, {sums('')} FROM {table} GROUP BY ALL)),
 fd AS (SELECT refit, d, CASE WHEN unit > 1e-15 THEN move / unit WHEN abs(move) <= 1e-15 THEN 0 WHEN move > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST('-inf' AS DOUBLE) END AS stat FROM (SELECT refit, d, {move} AS move, {unit} AS unit FROM
   (SELECT {table}.refit, {table}.grp, {table}.level, d, any_value(fp.n) AS n, any_value(fp.mean) AS mean, {sums('t * ')} FROM {table} JOIN ix ON ix.grp = {table}.grp AND ix.block = {table}.block JOIN tm ON tm.grp = ix.grp AND tm.idx = ix.idx
     JOIN fp ON fp.refit = {table}.refit AND fp.grp = {table}.grp AND fp.level = {table}.level GROUP BY ALL))),
 fk AS (SELECT refit, greatest(0, stat) AS critical FROM (SELECT refit, stat, row_number() OVER (PARTITION BY refit ORDER BY stat) AS r FROM (SELECT refit, d, max(stat) AS stat FROM fd GROUP BY ALL)) WHERE r = {rank}),
 fc AS (SELECT fp.refit, grp, level, n AS n_blocks, mean, se, critical, mean - critical * se AS lower, CASE WHEN mean - critical * se > 0 THEN 'robust_positive' ELSE 'not_robust_positive' END AS status FROM fp JOIN fk ON fp.refit = fk.refit)"""


@query(f"""WITH {inputs.REFITS}, r1 AS (SELECT refit, grp, 1 AS level, block, num, w FROM rb), {_fixed_set(7, 'r1')}
 SELECT CASE WHEN bool_and(status = 'robust_positive') THEN 'robust_generalizing' ELSE 'not_robust' END AS category, count(DISTINCT refit) AS n_refits, round(min(lower), 9) AS min_lower FROM fc""")
def all_refit_iut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(refits.all_refits_pass(refit_blocks(spark, sf_dir), DRAWS, 7))


CELLS = "SELECT refit, grp, level, n_blocks, round(mean, 9) AS mean, round(se, 9) AS se, round(critical, 9) AS critical, round(lower, 9) AS lower, status FROM fc"


@query(f"WITH {inputs.REFIT_LEVELS}, {_fixed_set(10, 'rl')} {CELLS}")
def refit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(refits.refit_bounds(refit_level_blocks(spark, sf_dir), DRAWS, 10))


@query(f"WITH {inputs.REFIT_LEVELS}, {_fixed_set(11, 'rl', shared=True)} {CELLS}")
def refit_bounds_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(refits.refit_bounds(refit_level_blocks(spark, sf_dir), DRAWS, 11, shared=True))


STEPS = "fs AS (SELECT refit, level, bool_and(status = 'robust_positive') AS ok, min(mean) > 0 AS point FROM fc GROUP BY ALL)"


@query(f"""WITH {inputs.REFIT_LEVELS}, {_fixed_set(10, 'rl')}, {STEPS} SELECT level, count(*) FILTER (ok) AS robust_refits, count(*) FILTER (NOT ok) AS not_robust_refits, CAST(0 AS BIGINT) AS unavailable_refits,
 CASE WHEN bool_and(ok) THEN 'robust_across_refits' ELSE 'not_robust_across_refits' END AS category FROM fs GROUP BY level""")
def all_refit_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refits.across_refits(refits.refit_steps(refits.refit_bounds(refit_level_blocks(spark, sf_dir), DRAWS, 10)))


@query(f"""WITH {inputs.REFIT_LEVELS}, {_fixed_set(10, 'rl')}, {STEPS}, ce AS (SELECT refit, CAST(coalesce(min(CASE WHEN NOT ok THEN level END) - 1, max(level)) AS BIGINT) AS certified_ceiling, CAST(coalesce(min(CASE WHEN NOT point THEN level END) - 1, max(level)) AS BIGINT) AS point_ceiling FROM fs GROUP BY refit)
 SELECT ce.*, (SELECT CAST(coalesce(min(CASE WHEN NOT ok THEN level END) - 1, max(level)) AS BIGINT) FROM fs) AS all_refit_ceiling, CASE WHEN (SELECT count(DISTINCT certified_ceiling) FROM ce) <= 1 THEN 'stable' ELSE 'refit_sensitive' END AS stability FROM ce""")
def refit_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refits.refit_ceilings(refits.refit_bounds(refit_level_blocks(spark, sf_dir), DRAWS, 10))


@query(f"""WITH {inputs.REFITS}, g AS (SELECT grp, count(*) FILTER (m > 0) AS positive_refits, count(*) FILTER (NOT m > 0) AS other_refits FROM (SELECT refit, grp, sum(num) / sum(w) AS m FROM rb GROUP BY ALL) GROUP BY grp)
 SELECT g.*, (SELECT CASE WHEN bool_or(positive_refits > 0 AND other_refits > 0) THEN 'refit_sensitive' WHEN bool_and(other_refits = 0) THEN 'stable_generalizing' WHEN bool_and(positive_refits = 0) THEN 'stable_non_generalizing' ELSE 'stable_mixed' END FROM g) AS stability FROM g""")
def refit_sign_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refits.sign_stability(refit_blocks(spark, sf_dir))


def _scheme_sql(name: str, inner: int) -> str:
    """Nested bounds of the refits with one smoothing: one row of the audit of schemes."""
    z = inputs.INNER[inner]
    return f"""SELECT '{name}' AS scheme, CAST(5 AS BIGINT) AS n_refits, CASE WHEN min(lower) > 0 THEN 'robust_generalizing' WHEN max(upper) <= 0 THEN 'robust_non_generalizing' WHEN bool_or(lower <= 0 AND upper > 0) THEN 'uncertain' ELSE 'mixed' END AS category, round(avg(mean), 9) AS mean, round(min(lower), 9) AS min_lower, round(max(upper), 9) AS max_upper FROM
 (WITH {inputs.REFITS.replace('+ 0.5', f'+ {z}').replace('+ 1.5', f'+ {3 * z}')}, {_nested_sql(12)} SELECT mm.grp, mean, mean - c * se AS lower, mean + c * se AS upper FROM mm JOIN sp ON mm.grp = sp.grp, c)"""


@query(f"""WITH sc AS ({_scheme_sql('light', 0)} UNION ALL {_scheme_sql('strong', 1)})
 SELECT *, CASE WHEN min(category) OVER () <> max(category) OVER () THEN 'scheme_sensitive' WHEN category LIKE 'robust%' THEN 'scheme_' || category ELSE 'stable_' || category END AS sensitivity FROM sc""")
def refit_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two schemes of five refits, which differ in smoothing; a minimum of five refits."""
    cells = inputs.source_cells(spark, sf_dir).select(F.col("source").alias("refit"), "inner", "grp", "block", "num", "w")
    schemes = {"light": cells.filter("inner = 0"), "strong": cells.filter("inner = 1")}
    return rounds(refits.scheme_sensitivity(schemes, DRAWS, 12, min_refits=5))


@query("""WITH b AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
 s AS (SELECT 'lacking' AS scheme, count(*) FILTER (o_orderstatus = 'P') AS missing, 0 AS moved FROM b UNION ALL SELECT 'same', 0, 0 UNION ALL SELECT 'turned', 0, count(*) FILTER (o_orderkey <> 0) FROM b)
 SELECT scheme, CAST(missing AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(moved AS BIGINT) AS moved, CASE WHEN missing > 0 THEN 'mismatch' WHEN moved > 0 THEN 'reorderable' ELSE 'exact' END AS alignment,
  CASE WHEN max(missing) OVER () > 0 THEN 'row_mismatch' WHEN max(moved) OVER () > 0 THEN 'audited_reordered_alignment' ELSE 'audited_exact_alignment' END AS status FROM s""")
def scheme_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as validation rows: one scheme has them in turned order, one lacks those of status P."""
    rows = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").alias("position"), "o_orderstatus")
    schemes = {"same": rows, "turned": rows.withColumn("position", -F.col("position")), "lacking": rows.filter("o_orderstatus != 'P'")}
    return refits.scheme_alignment(rows, schemes)


def _jackknife_sql(by: str, name: str) -> str:
    return f"""{name} AS (SELECT grp, sum(((sn - num) / (sw - w) - sn / sw) ** 2) * (any_value(k) - 1) / any_value(k) AS v, any_value(k) AS k FROM
 (SELECT grp, num, w, sum(num) OVER g AS sn, sum(w) OVER g AS sw, count(*) OVER g AS k FROM (SELECT grp, {by}, sum(num) AS num, sum(w) AS w FROM rb GROUP BY grp, {by}) WINDOW g AS (PARTITION BY grp)) GROUP BY grp)"""


def _bounds_sql(variance: str) -> str:
    q = t_quantile(0.95, 4)
    return f"""SELECT m.grp, round(mean, 9) AS mean, round(r.v, 9) AS v_refit, round(b.v, 9) AS v_block, round({variance}, 9) AS variance, CAST(least(r.k, b.k) - 1 AS BIGINT) AS df, round(mean - {q!r} * sqrt({variance}), 9) AS lower,
 CASE WHEN mean - {q!r} * sqrt({variance}) > 0 THEN 'robust_positive' ELSE 'not_positive' END AS status FROM (SELECT grp, sum(num) / sum(w) AS mean FROM rb GROUP BY grp) m JOIN vr r ON m.grp = r.grp JOIN vb b ON m.grp = b.grp"""


@query(f"WITH {inputs.REFITS}, {_jackknife_sql('refit', 'vr')}, {_jackknife_sql('block', 'vb')} {_bounds_sql('(r.v + b.v)')}")
def cv3two_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(process.jackknife_bounds(refit_blocks(spark, sf_dir)))


@query(f"WITH {inputs.REFITS.replace('rb AS (', 'rb0 AS (')}, rb AS (SELECT * FROM rb0 WHERE grp > (SELECT min(grp) FROM rb0)), {_jackknife_sql('refit', 'vr')}, {_jackknife_sql('block', 'vb')} {_bounds_sql('(r.v + b.v)')}"
       " UNION ALL SELECT min(grp), CAST('-inf' AS DOUBLE), NULL, NULL, NULL, CAST(4 AS BIGINT), NULL, 'unavailable' FROM rb0")
def jackknife_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = refit_blocks(spark, sf_dir)
    first = cells.agg(F.min(F.struct("grp", "refit", "block")).alias("first"))
    marked = cells.crossJoin(F.broadcast(first)).withColumn("num", F.when(F.struct("grp", "refit", "block") == F.col("first"), float("-inf")).otherwise(F.col("num"))).drop("first")
    return rounds(process.jackknife_bounds(marked))


def _margin_t(by: str) -> str:
    """One-sided bootstrap-t bounds of the margin along one side of the refit design; 2 units at least."""
    t = _t_sql(8, one_sided=True).replace(BLOCKS, f"{inputs.REFITS}, bl AS (SELECT grp, {by} AS b, sum(num) AS num, sum(w) AS w, row_number() OVER (PARTITION BY grp ORDER BY {by}) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM rb GROUP BY grp, {by})")
    return f"SELECT * FROM ({t})"


@query(f"""SELECT r.grp, r.mean, r.n_blocks AS n_refits, b.n_blocks, r.lower AS lower_refit, b.lower AS lower_block, CASE WHEN r.lower > 0 AND b.lower > 0 THEN 'robust_positive' ELSE 'not_positive' END AS status
 FROM ({_margin_t('refit')}) r JOIN ({_margin_t('block')}) b ON r.grp = b.grp""")
def component_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(process.component_bounds(refit_blocks(spark, sf_dir), DRAWS, 8, min_units=2))


def _lines_sql(by: str) -> str:
    pick = _pick(9, "l.n", f"'{by}'", "d.d", "l.idx")
    return f"""l_{by} AS (SELECT {by}, row_number() OVER (ORDER BY {by}) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {by} FROM rb)),
 t_{by} AS (SELECT k.d, l.{by}, count(*) AS t FROM (SELECT d.d, {pick} AS pick FROM l_{by} l CROSS JOIN (SELECT unnest(generate_series(0, {JOINT_DRAWS - 1})) AS d) d) k JOIN l_{by} l ON l.idx = k.pick GROUP BY k.d, l.{by})"""


@query(f"""WITH {inputs.REFITS}, {_lines_sql('refit')}, {_lines_sql('block')}, m AS (SELECT rb.grp, r.d, sum(r.t * b.t * num) / sum(r.t * b.t * w) AS m FROM rb JOIN t_refit r ON rb.refit = r.refit JOIN t_block b ON b.d = r.d AND rb.block = b.block GROUP BY rb.grp, r.d),
 q AS (SELECT grp, quantile_cont(m, 0.05) AS lower FROM m GROUP BY grp), p AS (SELECT grp, sum(num) / sum(w) AS mean, count(DISTINCT refit) AS n_refits, count(DISTINCT block) AS n_blocks FROM rb GROUP BY grp)
 SELECT p.grp, round(mean, 9) AS mean, n_refits, n_blocks, round(lower, 9) AS lower, CASE WHEN lower > 0 THEN 'robust_positive' ELSE 'not_positive' END AS status FROM p JOIN q ON p.grp = q.grp""")
def pigeonhole_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(process.pigeonhole_bounds(refit_blocks(spark, sf_dir), JOINT_DRAWS, 9, min_units=2))


@query(f"WITH {inputs.SOURCES}, {_jackknife_sql('refit', 'vr')}, {_jackknife_sql('block', 'vb')} {_bounds_sql('(r.v + b.v)')}")
def source_process_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources of two inner refits, and therefore a minimum of two."""
    return rounds(process.source_bounds(inputs.source_cells(spark, sf_dir), minimum=2))


@query(f"WITH {inputs.REFITS}, {_jackknife_sql('refit', 'vr')}, {_jackknife_sql('block', 'vb')} {_bounds_sql('greatest(r.v, b.v)')}")
def cv3max_jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(process.jackknife_bounds(refit_blocks(spark, sf_dir), rule="max"))


def _cluster_sql(by: str, name: str) -> str:
    return f"""{name} AS (SELECT grp, sum((num - w * sn / sw) ** 2) / any_value(sw) ** 2 * any_value(k) / (any_value(k) - 1) AS v, any_value(k) AS k FROM
 (SELECT grp, num, w, sum(num) OVER g AS sn, sum(w) OVER g AS sw, count(*) OVER g AS k FROM (SELECT grp, {by}, sum(num) AS num, sum(w) AS w FROM rb GROUP BY grp, {by}) WINDOW g AS (PARTITION BY grp)) GROUP BY grp)"""


@query(f"WITH {inputs.REFITS}, {_cluster_sql('refit', 'vr')}, {_cluster_sql('block', 'vb')}, {_cluster_sql('refit, block', 'vc')} {_bounds_sql('greatest(r.v + b.v - c.v, r.v, b.v)')} JOIN vc c ON m.grp = c.grp")
def crossed_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(process.crossed_bounds(refit_blocks(spark, sf_dir)))


PREFIX = f"{inputs.SCORES}, gr AS (SELECT g AS grp, s2 - s0 AS gain, sum(w) AS w FROM sc GROUP BY ALL), pf AS (SELECT grp, gain, sum(w * gain) OVER o AS pn, sum(w) OVER o AS pw, sum(w * gain) OVER g AS sn, sum(w) OVER g AS sw FROM gr WINDOW o AS (PARTITION BY grp ORDER BY gain ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY grp))"


@query(f"WITH {PREFIX} SELECT grp, round(any_value(sn / sw), 9) AS mean, round(min((2 * pn + 0.5 * (sn - pn)) / (2 * pw + 0.5 * (sw - pw))), 9) AS least, round(max((0.5 * pn + 2 * (sn - pn)) / (0.5 * pw + 2 * (sw - pw))), 9) AS greatest FROM pf GROUP BY grp")
def reweight_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(robust.extremes(gain_rows(spark, sf_dir), 2.0))


@query(f"WITH {PREFIX}, k AS (SELECT grp, any_value(sn) AS sn, min(CASE WHEN pn < 0 AND sn > 0 THEN sqrt((sn - pn) / -pn) END) AS gamma FROM pf GROUP BY grp) SELECT grp, round(CASE WHEN sn <= 0 THEN 1 WHEN gamma <= 100 THEN gamma END, 9) AS critical_gamma, CASE WHEN sn <= 0 THEN 'not_positive' WHEN gamma <= 100 THEN 'finite' ELSE 'beyond_limit' END AS status FROM k")
def critical_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(robust.critical_gamma(gain_rows(spark, sf_dir)))


@query(f"""WITH {inputs.SCORES}, br AS (SELECT grp, block, row_number() OVER (PARTITION BY grp ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT g AS grp, b AS block FROM sc)),
 pk AS (SELECT grp, d, idx, count(*) AS times FROM (SELECT b.grp, d.d, {_pick(8, 'b.n', 'b.grp', 'd.d', 'b.idx')} AS idx FROM br b CROSS JOIN (SELECT unnest(generate_series(0, {JOINT_DRAWS - 1})) AS d) d) GROUP BY ALL),
 ch AS (SELECT p.grp, p.d, round(c.s2 - c.s0, 12) AS gain, sum(c.w * p.times) AS w FROM pk p JOIN br b ON p.grp = b.grp AND p.idx = b.idx JOIN sc c ON c.g = b.grp AND c.b = b.block GROUP BY ALL),
 pf AS (SELECT grp, d, sum(w * gain) OVER o AS pn, sum(w) OVER o AS pw, sum(w * gain) OVER g AS sn, sum(w) OVER g AS sw FROM ch WINDOW o AS (PARTITION BY grp, d ORDER BY gain ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY grp, d)),
 ex AS (SELECT grp, d, min((2 * pn + 0.5 * (sn - pn)) / (2 * pw + 0.5 * (sw - pw))) AS lo, max((0.5 * pn + 2 * (sn - pn)) / (0.5 * pw + 2 * (sw - pw))) AS hi FROM pf GROUP BY ALL)
 SELECT grp, round(quantile_cont(lo, 0.025), 9) AS lower, round(quantile_cont(hi, 0.975), 9) AS upper, count(*) AS n_draws FROM ex GROUP BY grp""")
def joint_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(robust.joint_extremes(gain_rows(spark, sf_dir).withColumn("gain", F.round("gain", 12)), 2.0, JOINT_DRAWS, 8))


@query()
def robustness_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(robust.robustness_radius(gain_rows(spark, sf_dir), JOINT_DRAWS, 9, steps=BISECTIONS))


@query()
def radius_non_generalizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius of a family that does not generalize: gains less a number somewhat above every group's mean."""
    rows = gain_rows(spark, sf_dir)
    means = rows.groupBy("grp").agg((F.sum(F.col("w") * F.col("gain")) / F.sum("w")).alias("mean"), F.max("gain").alias("top"))
    less = means.agg((F.max("mean") + 0.2 * (F.max("top") - F.max("mean"))).alias("less"))
    shifted = rows.crossJoin(F.broadcast(less)).withColumn("gain", F.col("gain") - F.col("less")).drop("less")
    return rounds(robust.robustness_radius(shifted, JOINT_DRAWS, 9, steps=BISECTIONS))


@query(f"WITH {inputs.SCORES} SELECT 'unavailable' AS category, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS DOUBLE) AS radius, CAST(NULL AS DOUBLE) AS break_gamma, CAST(NULL AS DOUBLE) AS weight_ratio, CAST(min(g) AS VARCHAR) AS limiting_groups FROM sc")
def radius_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block of the first group has a gain of minus infinity."""
    return robust.robustness_radius(_endless(spark, sf_dir), JOINT_DRAWS, 9, steps=BISECTIONS)


@query(f"""WITH {PREFIX}, ok AS (SELECT * FROM pf WHERE grp > (SELECT min(grp) FROM pf)), ex AS (SELECT grp, any_value(sn / sw) AS mean, min((2 * pn + 0.5 * (sn - pn)) / (2 * pw + 0.5 * (sw - pw))) AS least, max((0.5 * pn + 2 * (sn - pn)) / (0.5 * pw + 2 * (sw - pw))) AS greatest FROM ok GROUP BY grp)
 SELECT grp, round(mean, 9) AS mean, round(least, 9) AS least, round(greatest, 9) AS greatest FROM ex UNION ALL SELECT min(grp), CAST('-inf' AS DOUBLE), NULL, NULL FROM pf""")
def reweight_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(robust.extremes(_endless(spark, sf_dir), 2.0))


@query(f"WITH {inputs.REFITS}, one AS (SELECT * FROM rb WHERE grp > 1 OR refit = 0), rest AS (SELECT * FROM rb WHERE grp > 1), {_jackknife_sql('refit', 'vr').replace('FROM rb', 'FROM rest')}, {_jackknife_sql('block', 'vb').replace('FROM rb', 'FROM rest')} {_bounds_sql('(r.v + b.v)').replace('FROM rb', 'FROM rest')}"
       " UNION ALL SELECT grp, round(sum(num) / sum(w), 9), NULL, NULL, NULL, CAST(0 AS BIGINT), NULL, 'unavailable' FROM one WHERE grp = 1 GROUP BY grp")
def jackknife_one_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group has one refit, the others five."""
    return rounds(process.jackknife_bounds(refit_blocks(spark, sf_dir).filter("grp > 1 or refit = 0")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.hour("ts") + F.minute("ts") / 60.0
    return e.select("event_id", "event_type", "value", hour.alias("h"), (F.col("event_id") % 2).alias("part"))


EVENTS = "ev AS (SELECT event_id, event_type, value, hour(ts) + minute(ts) / 60.0 AS h, event_id % 2 AS part FROM events)"
CENTRES = "ce AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS s, atan2(avg(sin(2 * pi() * h / 24)), avg(cos(2 * pi() * h / 24))) * 24 / (2 * pi()) AS cm FROM ev WHERE part = 0 GROUP BY event_type)"
PLACED = f"{EVENTS}, {CENTRES}, pl AS (SELECT ev.*, mu, s, cm, abs(value - mu) / s AS r, least(((h - cm) % 24 + 24) % 24, 24 - ((h - cm) % 24 + 24) % 24) AS cd FROM ev JOIN ce ON ev.event_type = ce.event_type WHERE event_id % 4 IN (1, 3)), ca AS (SELECT * FROM pl WHERE event_id % 4 = 1), te AS (SELECT * FROM pl WHERE event_id % 4 = 3)"


def _rank_sql(column: str, alpha: float) -> str:
    return f"(SELECT {column} FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) AS k, count(*) OVER () AS n FROM ca) WHERE k = least(n, CAST(ceil((n + 1) * {1 - alpha} - 1e-12) AS BIGINT)))"


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    angle = F.col("h") * (2 * 3.141592653589793 / 24)
    centre = e.filter("part = 0").groupBy("event_type").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("s"), (F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * (24 / (2 * 3.141592653589793))).alias("c_mu"))
    rows = e.join(centre, "event_type").withColumnsRenamed({"value": "y", "h": "c"})
    return rows.filter("event_id % 4 = 1"), rows.filter("event_id % 4 = 3")


@query(f"WITH {PLACED}, t AS (SELECT {_rank_sql('r', 0.1)} AS t) SELECT round(any_value(t), 9) AS threshold, round(avg(CAST(abs(value - mu) <= t * s AS DOUBLE)), 9) AS coverage, round(avg(2 * t * s), 9) AS mean_width, count(*) AS n_test FROM te, t")
def conformal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(conformal.interval_coverage(*_placed(spark, sf_dir), 0.1))


@query(f"WITH {PLACED}, t AS (SELECT least({_rank_sql('cd', 0.1)}, 12) AS t) SELECT round(any_value(t), 9) AS half_width, round(avg(CAST(cd <= t + 1e-9 AS DOUBLE)), 9) AS coverage, round(any_value(2 * t), 9) AS arc, count(*) AS n_test FROM te, t")
def circular_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal, test = (d.select(F.col("c").alias("y"), F.col("c_mu").alias("mu")) for d in _placed(spark, sf_dir))
    return rounds(conformal.arc_coverage(cal, test, 0.1))


@query(f"WITH {PLACED}, t AS (SELECT least({_rank_sql('cd', 0.05)}, 12) AS a, {_rank_sql('r', 0.05)} AS t) SELECT round(any_value(a), 9) AS half_width, round(any_value(t), 9) AS threshold, round(avg(CAST(cd <= a + 1e-9 AND abs(value - mu) <= t * s AS DOUBLE)), 9) AS coverage, count(*) AS n_test FROM te, t")
def joint_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(conformal.joint_coverage(*_placed(spark, sf_dir), 0.1))


SETS = """os AS (SELECT o_orderkey AS id, c_mktsegment AS seg, o_orderpriority AS pri, o_orderkey % 3 AS part FROM orders JOIN customer ON o_custkey = c_custkey),
 f AS (SELECT s.seg, a.pri, (coalesce((SELECT count(*) FROM os WHERE part = 0 AND os.seg = s.seg AND os.pri = a.pri), 0) + 0.5) / ((SELECT count(*) FROM os WHERE part = 0 AND os.seg = s.seg) + 2.5) AS p FROM (SELECT DISTINCT seg FROM os WHERE part = 0) s CROSS JOIN (SELECT DISTINCT pri FROM os WHERE part = 0) a),
 ca AS (SELECT 1 - p AS score FROM os JOIN f ON os.seg = f.seg AND os.pri = f.pri WHERE part = 1), t AS (SELECT score AS t FROM (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM ca) WHERE k = CAST(ceil((n + 1) * 0.7 - 1e-12) AS BIGINT))"""


@query(f"WITH {SETS}, m AS (SELECT id AS row_id, f.pri, 1 - f.p <= t + 1e-12 AS inside, row_number() OVER (PARTITION BY id ORDER BY p DESC, f.pri) AS k FROM os JOIN f ON os.seg = f.seg, t WHERE part = 2), g AS (SELECT row_id, bool_or(inside) AS any_in FROM m GROUP BY row_id) SELECT m.row_id, string_agg(pri, ',' ORDER BY pri) AS states, count(*) AS set_size FROM m JOIN g ON m.row_id = g.row_id WHERE inside OR (NOT any_in AND k = 1) GROUP BY m.row_id")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.state import dirichlet_field

    rows = inputs.order_states(spark, sf_dir).withColumn("part", F.col("o_orderkey") % 3)
    field = dirichlet_field(rows.filter("part = 0"), ["seg"], "pri", 0.5).select("seg", "pri", "p")
    scores = rows.filter("part = 1").join(field, ["seg", "pri"]).select((1 - F.col("p")).alias("score"))
    test = rows.filter("part = 2").select("o_orderkey", "seg").join(field, "seg").select(F.col("o_orderkey").alias("row_id"), F.col("pri").alias("state"), "p")
    return conformal.prediction_sets(scores, test, 0.3).select("row_id", F.array_join("states", ",").alias("states"), "set_size")


@query(f"WITH {inputs.NATION_GAINS}, r AS (SELECT stratum, gain, row_number() OVER (PARTITION BY stratum ORDER BY gain) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM ng) SELECT stratum, any_value(n) AS n_groups, coalesce(round(max(CASE WHEN k = CAST(floor((n + 1) * 0.4 + 1e-12) AS BIGINT) THEN gain END), 9), CAST('-inf' AS DOUBLE)) AS bound FROM r GROUP BY stratum")
def group_gain_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(conformal.group_envelope(nation_gains(spark, sf_dir), 0.4))


@query("""WITH e AS (SELECT vec_id AS id, label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings), r AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s, min(v) AS lo, max(v) AS hi FROM e WHERE label < 5 GROUP BY i),
 z AS (SELECT id, label, e.i, (v - m) / s AS z, v < lo OR v > hi AS o FROM e JOIN r ON e.i = r.i), d AS (SELECT a.id, a.label, b.id AS ref, sqrt(sum((a.z - b.z) ** 2)) AS d FROM z a JOIN z b ON a.i = b.i WHERE b.label < 5 AND a.id <> b.id GROUP BY ALL), nn AS (SELECT id, label, min(d) AS d FROM d GROUP BY ALL),
 l AS (SELECT d AS lim FROM (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM nn WHERE label < 5) WHERE k = CAST(ceil(0.95 * (n - 1)) AS BIGINT) + 1), ou AS (SELECT id, bool_or(o) AS outside FROM z GROUP BY id)
 SELECT nn.id, round(d, 6) AS distance, round(lim, 6) AS "limit", outside, CASE WHEN d > lim AND outside THEN 'novel' WHEN d > lim THEN 'distant' WHEN outside THEN 'out_of_range' ELSE 'familiar' END AS label FROM nn JOIN ou ON nn.id = ou.id, l WHERE nn.label >= 5""")
def novelty_1nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = novelty.novelty(e.filter("label >= 5"), e.filter("label < 5"), "vec_id", "embedding")
    return found.withColumns({"distance": F.round("distance", 6), "limit": F.round("limit", 6)})


@query(f"""WITH {EVENTS}, x AS (SELECT event_type, part, value AS y, sin(2 * pi() * h / 24) AS x FROM ev), b AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS c, avg(y) AS m, sqrt(var_pop(y)) AS ps FROM x WHERE part = 0), v AS (SELECT sqrt(avg((y - c - k * x) ** 2)) AS sd FROM x, b WHERE part = 0)
 SELECT event_type, round(avg(-0.5 * ((y - c - k * x) / sd) ** 2 - ln(sd * sqrt(2 * pi()))) - avg(-0.5 * ((y - m) / ps) ** 2 - ln(ps * sqrt(2 * pi()))), 9) AS gain, count(*) AS n FROM x, b, v WHERE part = 1 GROUP BY event_type""")
def gaussian_density_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    y = F.col("value")
    model = density.GaussianModel(e.filter("part = 0"), y, [F.sin(F.col("h") * (2 * 3.141592653589793 / 24))])
    return rounds(e.filter("part = 1").groupBy("event_type").agg(F.avg(model.log_density(y) - model.plain_log_density(y)).alias("gain"), F.count("*").alias("n")))


def _kappa(r: str) -> str:
    return f"(CASE WHEN {r} < 0.53 THEN 2 * {r} + {r} ** 3 + 5 * {r} ** 5 / 6 WHEN {r} < 0.85 THEN -0.4 + 1.39 * {r} + 0.43 / (1 - {r}) ELSE 1 / ({r} ** 3 - 4 * {r} ** 2 + 3 * {r}) END)"


def _log_i0(k: str) -> str:
    t = f"({k} / 3.75)"
    return f"ln(1.0 + 3.5156229 * {t} ** 2 + 3.0899424 * {t} ** 4 + 1.2067492 * {t} ** 6 + 0.2659732 * {t} ** 8 + 0.0360768 * {t} ** 10 + 0.0045813 * {t} ** 12)"


@query(f"""WITH {EVENTS}, x AS (SELECT event_type, part, 2 * pi() * h / 24 AS a, value / 100 AS x FROM ev), b AS (SELECT regr_slope(cos(a), x) AS ck, regr_intercept(cos(a), x) AS cc, regr_slope(sin(a), x) AS sk, regr_intercept(sin(a), x) AS si, avg(cos(a)) AS mc, avg(sin(a)) AS ms FROM x WHERE part = 0),
 r AS (SELECT greatest(avg(cos(a - atan2(si + sk * x, cc + ck * x))), 0) AS r, any_value(sqrt(mc ** 2 + ms ** 2)) AS pr FROM x, b WHERE part = 0), k AS (SELECT {_kappa('r')} AS k, {_kappa('pr')} AS pk FROM r)
 SELECT event_type, round(avg(k * cos(a - atan2(si + sk * x, cc + ck * x)) - {_log_i0('k')}) - avg(pk * cos(a - atan2(ms, mc)) - {_log_i0('pk')}), 9) AS gain, count(*) AS n FROM x, b, k WHERE part = 1 GROUP BY event_type""")
def von_mises_density_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    model = density.VonMisesModel(e.filter("part = 0"), F.col("h"), [F.col("value") / 100])
    return rounds(e.filter("part = 1").groupBy("event_type").agg(F.avg(model.log_density(F.col("h")) - model.plain_log_density(F.col("h"))).alias("gain"), F.count("*").alias("n")))


@query(f"""WITH {EVENTS}, x AS (SELECT event_id, event_type, part, h, 2 * pi() * h / 24 AS a, value / 100 AS x FROM ev), b AS (SELECT regr_slope(cos(a), x) AS ck, regr_intercept(cos(a), x) AS cc, regr_slope(sin(a), x) AS sk, regr_intercept(sin(a), x) AS si FROM x WHERE part = 0),
 g AS (SELECT event_type, CAST(event_id % 4 AS DOUBLE) AS w, ((h - atan2(si + sk * x, cc + ck * x) / (2 * pi() / 24)) % 24 + 24) % 24 AS gap FROM x, b WHERE part = 1),
 c AS (SELECT event_type, least(gap, 24 - gap) AS v, w FROM g WHERE w > 0), s AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY v) AS t, sum(w) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS n FROM c)
 SELECT event_type, q AS share, round(min(v), 9) AS value, any_value(n) AS n, any_value(total) AS weight FROM s, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS q) WHERE t >= q * total * (1 - 1e-12) GROUP BY event_type, q""")
def circular_residual_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    model = density.VonMisesModel(e.filter("part = 0"), F.col("h"), [F.col("value") / 100])
    found = model.residual_quantiles(e.filter("part = 1"), F.col("h"), (0.5, 0.9), (F.col("event_id") % 4).cast("double"), ("event_type",))
    return rounds(found)


@query()
def joint_density_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("k", (F.col("event_type") == "click").cast("double"))
    return rounds(density.joint_gain(e.filter("part = 0"), e.filter("part = 1"), F.col("h"), F.col("value"), [F.col("k")], "event_type"))


@query()
def stacking_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    y = F.col("value")
    wide = density.GaussianModel(e.filter("part = 0"), y, [F.sin(F.col("h") * (2 * 3.141592653589793 / 24))])
    scores = e.filter("part = 1").select(wide.log_density(y).alias("gaussian"), (-y / 50.0 - 3.912023005428146).alias("exponential"))
    return rounds(stacking.stack(scores, ["gaussian", "exponential"]))


CANDIDATES = "cd AS (SELECT l_linenumber AS candidate, avg(l_discount) AS gain, abs(avg(l_tax) - 0.04) AS coverage_error, avg(l_quantity) AS region_size, count(*) > 10 AS admissible FROM lineitem GROUP BY l_linenumber), cr AS (SELECT candidate, round(gain, 9) AS gain, round(coverage_error, 9) AS coverage_error, round(region_size, 9) AS region_size, admissible FROM cd)"


@query(f"""WITH {CANDIDATES}, fr AS (SELECT * FROM cr a WHERE admissible AND NOT EXISTS (SELECT 1 FROM cr o WHERE o.admissible AND o.candidate <> a.candidate AND o.gain >= a.gain AND o.coverage_error <= a.coverage_error AND o.region_size <= a.region_size AND (o.gain > a.gain OR o.coverage_error < a.coverage_error OR o.region_size < a.region_size)))
 SELECT candidate, gain, coverage_error, region_size, candidate = (SELECT candidate FROM fr ORDER BY gain DESC, candidate LIMIT 1) AS recommended FROM fr""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("candidate")).agg(F.avg("l_discount").alias("gain"), F.abs(F.avg("l_tax") - 0.04).alias("coverage_error"), F.avg("l_quantity").alias("region_size"), (F.count("*") > 10).alias("admissible"))
    return selection.pareto_front(rounds(rows))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "lang").join(lab.select("doc_id", "quality"), "doc_id").select(F.col("lang").alias("grp"), (F.col("quality") == 1).alias("covered"), F.lit(1.0).alias("w"))


COVERED = "co AS (SELECT lang AS grp, avg(CAST(quality = 1 AS DOUBLE)) AS coverage, CAST(count(*) AS DOUBLE) AS weight FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang)"


@query(f"WITH {COVERED} SELECT grp, round(coverage, 9) AS coverage, round(abs(coverage - 0.85), 9) AS error, abs(coverage - 0.85) <= 0.05 AS calibrated, weight FROM co")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(selection.coverage_audit(_covered(spark, sf_dir), "grp", "covered", "w", 0.85, 0.05))


@query(f"WITH {COVERED}, g AS (SELECT lang AS grp, avg(n_chars) / 2000 - 1 AS gain FROM documents GROUP BY lang) SELECT co.grp, round(coverage, 9) AS coverage, round(gain, 9) AS gain, CASE WHEN abs(coverage - 0.85) <= 0.05 AND gain > 1e-9 THEN 'trusted' WHEN abs(coverage - 0.85) <= 0.05 THEN 'calibrated_without_gain' WHEN gain > 1e-9 THEN 'gain_without_calibration' ELSE 'neither' END AS trust FROM co JOIN g ON co.grp = g.grp")
def trust_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    coverage = selection.coverage_audit(_covered(spark, sf_dir), "grp", "covered", "w", 0.85, 0.05)
    gains = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("grp")).agg((F.avg("n_chars") / 2000 - 1).alias("gain"))
    return rounds(selection.trust_audit(coverage, gains, "grp"))


@query(f"""WITH {inputs.NATION_GAINS}, b AS (SELECT cluster AS block, sum(gain) AS num, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY cluster) - 1 AS idx, count(*) OVER () AS n FROM ng GROUP BY cluster),
 dr AS (SELECT d, sum(num) / sum(w) AS m FROM (SELECT d.d, {_pick(11, 'b.n', "'0'", 'd.d', 'b.idx')} AS pick FROM b CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS d) d) p JOIN b ON b.idx = p.pick GROUP BY d),
 q AS (SELECT quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM dr), s AS (SELECT count(*) AS n, avg(gain) AS mean, stddev_samp(gain) AS sd, avg(CAST(gain > 0 AS DOUBLE)) AS p, quantile_cont(gain, 0.1) AS p10, quantile_cont(gain, 0.5) AS p50, quantile_cont(gain, 0.9) AS p90 FROM ng), z AS (SELECT 1.959963984540054 AS z)
 SELECT n, (SELECT count(*) FROM b) AS clusters, round(mean, 9) AS mean, round(lower, 9) AS lower, round(upper, 9) AS upper, CASE WHEN lower > 0 THEN 'positive' WHEN upper <= 0 THEN 'nonpositive' ELSE 'uncertain' END AS status, round(p, 9) AS positive_share,
 round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS positive_share_lower, round(mean - z * sd * sqrt(1 + 1.0 / n), 9) AS new_group_lower, round(mean + z * sd * sqrt(1 + 1.0 / n), 9) AS new_group_upper, round(p10, 9) AS p10, round(p50, 9) AS p50, round(p90, 9) AS p90 FROM s, q, z""")
def population_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(population.population_summary(nation_gains(spark, sf_dir).drop("stratum"), DRAWS, 11))


@query()
def null_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.certification_panel(spark, WORLDS, {"null": 0.0, "strong": 0.8}, draws=PANEL_DRAWS)


@query("""WITH l AS (SELECT o_custkey % 50 AS subject, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS position, o_orderpriority AS layer, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'fail' WHEN o_orderkey % 97 = 0 THEN 'unavailable' ELSE 'pass' END AS status FROM orders),
 e AS (SELECT *, CASE WHEN coalesce(max(CAST(status = 'fail' AS INTEGER)) OVER (PARTITION BY subject ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'not_run' ELSE status END AS eff FROM l),
 a AS (SELECT subject, min_by(layer, position) FILTER (WHERE eff = 'fail') AS blocking_layer, count(*) FILTER (WHERE eff = 'pass') AS passed, count(*) FILTER (WHERE eff = 'unavailable') AS unavailable, count(*) FILTER (WHERE eff = 'not_run') AS not_run FROM e GROUP BY subject)
 SELECT *, CASE WHEN blocking_layer IS NOT NULL THEN 'not_certified' WHEN unavailable > 0 THEN 'unavailable' ELSE 'certified' END AS decision FROM a""")
def evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("subject", F.col("o_custkey") % 50)
    status = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0), "fail").when(F.col("o_orderkey") % 97 == 0, "unavailable").otherwise("pass")
    layers = o.select("subject", F.row_number().over(Window.partitionBy("subject").orderBy("o_orderkey")).alias("position"), F.col("o_orderpriority").alias("layer"), status.alias("status"))
    return decisions.gate_ladder(layers)


def _definition_sql() -> str:
    parts = []
    for name, k in (("twenty", 20), ("ten", 10)):
        pick = _pick(12, "b.n", "b.grp", "d.d", "b.idx")
        parts.append(f"""SELECT '{name}' AS definition, grp, any_value(n) AS n_blocks, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM (
 SELECT p.grp, p.d, sum(num) / sum(w) AS m, any_value(n) AS n FROM (SELECT b.grp, d.d, {pick} AS pick FROM b{k} b CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS d) d) p JOIN b{k} ON b{k}.grp = p.grp AND b{k}.idx = p.pick GROUP BY p.grp, p.d) GROUP BY grp""")
    tables = ", ".join(f"b{k} AS (SELECT g AS grp, b % {k} AS block, sum(w * (s2 - s0)) AS num, sum(w) AS w, row_number() OVER (PARTITION BY g ORDER BY b % {k}) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM sc GROUP BY g, b % {k})" for k in (20, 10))
    return f"""WITH {inputs.SCORES}, {tables}, u AS ({' UNION ALL '.join(parts)}), v AS (SELECT *, {_status('lower', 'upper')} AS status FROM u)
 SELECT definition, grp, n_blocks, round(lower, 9) AS lower, round(upper, 9) AS upper, status, (SELECT count(DISTINCT status) FROM v i WHERE i.grp = v.grp) = 1 AS stable FROM v"""


@query(_definition_sql())
def block_definition_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = {"twenty": F.col("block"), "ten": F.col("block") % 10}
    return rounds(resample.definition_sensitivity(gain_rows(spark, sf_dir), "grp", "gain", "w", definitions, DRAWS, 12))


@query(f"""WITH {inputs.SCORES}, u AS (SELECT 'rows' AS weighting, g AS grp, sum(w * (s2 - s0)) / sum(w) AS mean FROM sc GROUP BY g UNION ALL SELECT 'cells', g, avg(s2 - s0) FROM sc GROUP BY g)
 SELECT weighting, grp, round(mean, 9) AS mean, (SELECT count(DISTINCT mean > 0) FROM u i WHERE i.grp = u.grp) = 1 AS stable FROM u""")
def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(resample.weight_sensitivity(gain_rows(spark, sf_dir), "grp", "block", "gain", {"rows": F.col("w"), "cells": F.lit(1.0)}))


@query(f"""WITH u AS (SELECT n_regionkey AS stratum, n_nationkey AS unit, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS idx, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
 p AS (SELECT u.stratum, d.d AS replicate, {_pick(13, 'u.n', 'u.stratum', 'd.d', 'u.idx')} AS idx FROM u CROSS JOIN (SELECT unnest(generate_series(0, 49)) AS d) d)
 SELECT CAST(replicate AS INTEGER) AS replicate, p.stratum, unit, count(*) AS times FROM p JOIN u ON p.stratum = u.stratum AND p.idx = u.idx GROUP BY ALL""")
def bootstrap_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.membership(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", 50, 13)


def _step_sql(step: int, gain: str) -> str:
    return _t_sql(14).replace("s2 - s0", gain).replace("SELECT pt.grp", f"SELECT {step} AS level, pt.grp")


@query(f"SELECT * FROM ({_step_sql(1, 's1 - s0')}) UNION ALL SELECT * FROM ({_step_sql(2, 's2 - s1')})")
def ladder_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, out = inputs.score_cells(spark, sf_dir), None
    for level, (rich, plain) in enumerate((("s1", "s0"), ("s2", "s1")), 1):
        rows = scores.select(F.col("g").alias("grp"), F.col("b").alias("block"), (F.col(rich) - F.col(plain)).alias("gain"), "w")
        cells = resample.bootstrap_t(resample.block_table(rows, "grp", "block", "gain", "w"), DRAWS, 14)
        one = cells.select(F.lit(level).alias("level"), *cells.columns)
        out = one if out is None else out.unionByName(one)
    return rounds(out)


@query(f"""WITH {inputs.NATION_GAINS}, ca AS (SELECT stratum, gain, row_number() OVER (PARTITION BY stratum ORDER BY gain) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM ng WHERE grp % 3 <> 0),
 b AS (SELECT stratum, coalesce(max(CASE WHEN k = CAST(floor((n + 1) * 0.4 + 1e-12) AS BIGINT) THEN gain END), CAST('-inf' AS DOUBLE)) AS bound FROM ca GROUP BY stratum)
 SELECT ng.stratum, round(avg(CAST(gain >= bound AS DOUBLE)), 9) AS coverage, count(*) AS n_validation FROM ng JOIN b ON ng.stratum = b.stratum WHERE grp % 3 = 0 GROUP BY ng.stratum""")
def envelope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = nation_gains(spark, sf_dir)
    bounds = conformal.group_envelope(gains.filter("grp % 3 != 0"), 0.4)
    return rounds(conformal.envelope_validation(bounds, gains.filter("grp % 3 = 0")))
