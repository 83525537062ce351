"""Queries over support cubes and held-out scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.algebra import rounded
from tessera.functions.lineage import cut
from tessera.operators import cube, information, ladder, state, transfer, workflow
from tessera.plans import inputs
from tessera.plans.inputs import event_cells, events_by_time, lineitem_cube, order_states, score_cells, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounds(df: DataFrame) -> DataFrame:
    """Floats to nine digits, so that sums in any order compare equal."""
    return df.select(*[(rounded(F.col(c)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


CUBE = "cube AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS z, month(l_shipdate) AS t, sum(l_quantity) AS mass FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"
ENTROPY = "ln(sum(m)) - sum(m * ln(m)) / sum(m)"
H = "h AS (SELECT " + ", ".join(f"(SELECT {ENTROPY} FROM (SELECT sum(mass) AS m FROM cube GROUP BY {k})) AS {n}" for n, k in (("h0", "flag, status"), ("h1", "flag, status, z"), ("h2", "flag, status, t"), ("h3", "flag, status, z, t"))) + ")"


@query(f"WITH {CUBE} SELECT flag, status, z, t, round(mass, 9) AS mass FROM cube")
def support_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(lineitem_cube(spark, sf_dir))


@query(f"WITH {CUBE} SELECT flag, status, round(sum(mass), 9) AS mass FROM cube GROUP BY flag, status")
def marginal_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(cube.marginal(lineitem_cube(spark, sf_dir), ["flag", "status"]))


@query(f"WITH {CUBE} " + " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS subset_no, round({ENTROPY}, 9) AS entropy FROM (SELECT sum(mass) AS m FROM cube GROUP BY {a})" for n, a in enumerate(("flag", "status", "z", "t"))))
def entropy_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(information.joint_entropies(lineitem_cube(spark, sf_dir), [["flag"], ["status"], ["z"], ["t"]]))


@query(f"""WITH {CUBE}, {H} SELECT round(h0, 9) AS base_entropy, round(h1 - h0, 9) AS z_given_base, round(h2 - h0, 9) AS t_given_base, round(h3 - h0, 9) AS zt_given_base,
 round(exp(h1 - h0), 9) AS z_effective, round(exp(h2 - h0), 9) AS t_effective, round(exp(h3 - h0), 9) AS zt_effective, round(h1 + h2 - h0 - h3, 9) AS shared_zt FROM h""")
def thickness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(information.thickness_profile(lineitem_cube(spark, sf_dir), ["flag", "status"], "z", "t"))


@query(f"""WITH {CUBE}, d AS (SELECT * FROM (SELECT DISTINCT flag FROM cube) CROSS JOIN (SELECT DISTINCT t FROM cube)),
 c AS (SELECT flag, t, sum(m) AS mass, {ENTROPY} AS e FROM (SELECT flag, t, z, sum(mass) AS m FROM cube WHERE status = 'F' GROUP BY ALL) GROUP BY flag, t)
 SELECT d.flag, d.t, round(coalesce(c.mass, 0), 9) AS mass, round(greatest(0, c.e), 9) AS entropy, round(exp(greatest(0, c.e)), 9) AS effective FROM d LEFT JOIN c ON d.flag = c.flag AND d.t = c.t""")
def thickness_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lineitem_cube(spark, sf_dir)
    domain = whole.select("flag").distinct().crossJoin(whole.select("t").distinct())  # 3 flags x 12 months
    return rounds(information.thickness_map(whole.filter("status = 'F'"), ["flag", "t"], ["z"], domain))


EVENT_CELLS = "ev AS (SELECT event_type AS k, user_id % 10 AS ub, hour(ts) // 6 AS hb, dayofweek(ts) AS wd, count(*) AS m FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)"


def _overlap_sql(axes: str) -> str:
    return f"(SELECT 1 - 0.5 * sum(abs(a - b)) FROM (SELECT sum(CASE WHEN k = 'click' THEN m ELSE 0 END) / (SELECT sum(m) FROM ev WHERE k = 'click') AS a, sum(CASE WHEN k = 'view' THEN m ELSE 0 END) / (SELECT sum(m) FROM ev WHERE k = 'view') AS b FROM ev GROUP BY {axes}))"


@query(f"WITH {EVENT_CELLS} SELECT round({_overlap_sql('ub, hb, wd')}, 9) AS overlap")
def schoener_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(information.overlap(event_cells(spark, sf_dir, "click"), event_cells(spark, sf_dir, "view"), ["ub", "hb", "wd"]))


@query(f"""WITH {EVENT_CELLS}, o AS (SELECT {_overlap_sql('ub')} AS base, {_overlap_sql('ub, hb')} AS with_z, {_overlap_sql('ub, wd')} AS with_t, {_overlap_sql('ub, hb, wd')} AS "full")
 SELECT round(base, 9) AS base, round(with_z, 9) AS with_z, round(with_t, 9) AS with_t, round("full", 9) AS "full", round(greatest(0, base - "full"), 9) AS inflation, round(greatest(0, least(with_z, with_t) - "full"), 9) AS joint_only FROM o""")
def projection_overlap_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(information.overlap_profile(event_cells(spark, sf_dir, "click"), event_cells(spark, sf_dir, "view"), ["ub"], "hb", "wd"))


ORDER_STATES = "os AS (SELECT c_mktsegment AS seg, o_orderpriority AS pri, c_nationkey AS nation, o_orderkey % 4 AS part, count(*) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"""WITH {ORDER_STATES}, h AS (SELECT (SELECT {ENTROPY} FROM (SELECT sum(m) AS m FROM os GROUP BY seg)) AS hb, (SELECT {ENTROPY} FROM (SELECT sum(m) AS m FROM os GROUP BY pri)) AS ha, (SELECT {ENTROPY} FROM (SELECT sum(m) AS m FROM os GROUP BY seg, pri)) AS hj)
 SELECT round(hb + ha - hj, 9) AS information, round(hb, 9) AS base_entropy, round(ha, 9) AS added_entropy FROM h""")
def base_added_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(information.mutual_information(order_states(spark, sf_dir), ["seg"], ["pri"]))


STRICT = f"""{ORDER_STATES}, tr AS (SELECT * FROM os WHERE part <> 0),
 r AS (SELECT o.nation, o.m, ln(j.n / b.n) AS c, ln(a.n / (SELECT sum(m) FROM tr)) AS p FROM os o JOIN (SELECT seg, pri, sum(m) AS n FROM tr GROUP BY ALL) j ON o.seg = j.seg AND o.pri = j.pri
   JOIN (SELECT seg, sum(m) AS n FROM tr GROUP BY ALL) b ON o.seg = b.seg JOIN (SELECT pri, sum(m) AS n FROM tr GROUP BY ALL) a ON o.pri = a.pri WHERE o.part = 0),
 sg AS (SELECT nation, sum(m * c) / sum(m) AS c, sum(m * p) / sum(m) AS p, sum(m) AS w FROM r GROUP BY nation)"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = order_states(spark, sf_dir)
    return rows.filter("o_orderkey % 4 != 0"), rows.filter("o_orderkey % 4 = 0")


@query(f"WITH {STRICT} SELECT round(sum(m * c) / sum(m), 9) AS conditional_score, round(sum(m * p) / sum(m), 9) AS marginal_score, CAST(sum(m) AS DOUBLE) AS weight, round(sum(m * c) / sum(m) - sum(m * p) / sum(m), 9) AS gain FROM r")
def heldout_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(transfer.strict_gain(*_split(spark, sf_dir), ["seg"], ["pri"]))


@query(f"WITH {STRICT} SELECT nation, round(c, 9) AS conditional_score, round(p, 9) AS marginal_score, CAST(w AS DOUBLE) AS weight, round(c - p, 9) AS gain FROM sg")
def grouped_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(transfer.strict_gain(*_split(spark, sf_dir), ["seg"], ["pri"], ["nation"]))


@query(f"""WITH {STRICT} SELECT CASE WHEN min(c - p) > 1e-9 THEN 'generalizing' WHEN max(c - p) <= 1e-9 THEN 'non_generalizing' ELSE 'mixed' END AS category,
 round(min(c - p), 9) AS min_gain, round(avg(c - p), 9) AS mean_gain, round(max(c - p), 9) AS max_gain, count(*) AS n_groups FROM sg""")
def gain_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(transfer.summarise(transfer.strict_gain(*_split(spark, sf_dir), ["seg"], ["pri"], ["nation"])))


CROSSFIT = """e AS (SELECT event_type AS identity, hour(ts) // 4 AS hb, user_id % 3 AS fold, user_id % 6 AS grp, count(*) AS m FROM events GROUP BY ALL), k AS (SELECT count(DISTINCT identity) AS k FROM e),
 x AS (SELECT e.fold, e.grp, e.m,
   ln(((SELECT sum(m) FROM e i WHERE i.identity = e.identity AND i.hb = e.hb AND i.fold <> e.fold) + 0.5) / ((SELECT sum(m) FROM e i WHERE i.hb = e.hb AND i.fold <> e.fold) + 0.5 * k)) AS c,
   ln(((SELECT sum(m) FROM e i WHERE i.identity = e.identity AND i.fold <> e.fold) + 0.5) / ((SELECT sum(m) FROM e i WHERE i.fold <> e.fold) + 0.5 * k)) AS p FROM e, k)"""


@query(f"WITH {CROSSFIT} SELECT CAST(fold AS INTEGER) AS fold, CAST(grp AS INTEGER) AS grp, round(sum(m * c) / sum(m), 9) AS conditional_score, round(sum(m * p) / sum(m), 9) AS marginal_score, CAST(sum(m) AS DOUBLE) AS weight, round(sum(m * c) / sum(m) - sum(m * p) / sum(m), 9) AS gain FROM x GROUP BY fold, grp")
def identity_time_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(transfer.crossfit_gain(events_by_time(spark, sf_dir), ["hb"], ["identity"], "fold", ["grp"], 0.5))


@query(f"WITH {CROSSFIT} SELECT CAST(fold AS INTEGER) AS fold, round(sum(m * c) / sum(m), 9) AS conditional_score, round(sum(m * p) / sum(m), 9) AS marginal_score, CAST(sum(m) AS DOUBLE) AS weight, round(sum(m * c) / sum(m) - sum(m * p) / sum(m), 9) AS gain FROM x GROUP BY fold")
def crossfit_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(transfer.crossfit_gain(events_by_time(spark, sf_dir), ["hb"], ["identity"], "fold", [], 0.5))


FIELD = f"""{ORDER_STATES}, tr AS (SELECT * FROM os WHERE part <> 0), k AS (SELECT count(DISTINCT pri) AS k, sum(m) AS n FROM tr),
 f AS (SELECT s.seg, a.pri, (coalesce((SELECT sum(m) FROM tr WHERE tr.seg = s.seg AND tr.pri = a.pri), 0) + 0.5) / (s.n + 0.5 * k.k) AS p, (a.n + 0.5) / (k.n + 0.5 * k.k) AS pm
   FROM (SELECT seg, sum(m) AS n FROM tr GROUP BY seg) s CROSS JOIN (SELECT pri, sum(m) AS n FROM tr GROUP BY pri) a CROSS JOIN k),
 r AS (SELECT seg, pri, p, pm, sum(p * p) OVER w AS sq, sum(pm * pm) OVER w AS sm, CAST(row_number() OVER (PARTITION BY seg ORDER BY p DESC, pri) = 1 AS INTEGER) AS top, CAST(row_number() OVER (PARTITION BY seg ORDER BY pm DESC, pri) = 1 AS INTEGER) AS tm FROM f WINDOW w AS (PARTITION BY seg)),
 hs AS (SELECT nation, seg, pri, sum(m) AS m FROM os WHERE part = 0 GROUP BY ALL)"""
FIELD_SCORES = """round(sum(m * ln(p)) / sum(m), 9) AS log_score, round(sum(m * ln(pm)) / sum(m), 9) AS marginal_log_score, round(sum(m * (1 - 2 * p + sq)) / sum(m), 9) AS brier, round(sum(m * (1 - 2 * pm + sm)) / sum(m), 9) AS marginal_brier,
 round(sum(m * top) / sum(m), 9) AS top1, round(sum(m * tm) / sum(m), 9) AS marginal_top1, CAST(1 AS DOUBLE) AS seen_mass, round(sum(m * ln(p)) / sum(m) - sum(m * ln(pm)) / sum(m), 9) AS gain FROM hs JOIN r ON hs.seg = r.seg AND hs.pri = r.pri"""


@query(f"WITH {FIELD} SELECT seg, pri, round(p, 9) AS p, round(pm, 9) AS p_marginal FROM f")
def dirichlet_state_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(state.dirichlet_field(_split(spark, sf_dir)[0], ["seg"], "pri", 0.5))


@query(f"WITH {FIELD} SELECT {FIELD_SCORES}")
def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return rounds(state.score_field(test, state.dirichlet_field(train, ["seg"], "pri", 0.5), ["seg"], "pri"))


@query(f"WITH {FIELD} SELECT nation, {FIELD_SCORES} GROUP BY nation")
def state_scores_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return rounds(state.score_field(test, state.dirichlet_field(train, ["seg"], "pri", 0.5), ["seg"], "pri", ["nation"]))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_regionkey").alias("stratum"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("state"), (F.col("c_nationkey") % 3).alias("fold"), F.lit(1.0).alias("w"))


CUSTOMERS = "cu AS (SELECT c_custkey, n_regionkey AS stratum, c_nationkey AS grp, c_mktsegment AS state, c_nationkey % 3 AS fold FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {CUSTOMERS}, g AS (SELECT stratum, grp, count(*) AS n FROM cu GROUP BY ALL), s AS (SELECT stratum, count(*) AS k FROM g GROUP BY stratum)
 SELECT c_custkey, round(1.0 / ((SELECT count(*) FROM s) * s.k * g.n), 15) AS training_weight FROM cu JOIN g ON cu.stratum = g.stratum AND cu.grp = g.grp JOIN s ON cu.stratum = s.stratum""")
def hierarchical_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.hierarchical_weights(_customers(spark, sf_dir), "stratum", "grp").select("c_custkey", F.round("training_weight", 15).alias("training_weight"))


@query(f"""WITH {CUSTOMERS}, g AS (SELECT * FROM (SELECT DISTINCT fold FROM cu) CROSS JOIN (SELECT DISTINCT stratum FROM cu) CROSS JOIN (SELECT DISTINCT state FROM cu)), k AS (SELECT count(DISTINCT state) AS k FROM cu)
 SELECT g.fold, g.stratum, g.state, round(((SELECT count(*) FROM cu WHERE cu.state = g.state AND cu.fold <> g.fold) + 0.5) / ((SELECT count(*) FROM cu WHERE cu.fold <> g.fold) + 0.5 * k), 9) AS p_pooled,
  round(((SELECT count(*) FROM cu WHERE cu.state = g.state AND cu.stratum = g.stratum AND cu.fold <> g.fold) + 0.5) / ((SELECT count(*) FROM cu WHERE cu.stratum = g.stratum AND cu.fold <> g.fold) + 0.5 * k), 9) AS p_stratum FROM g, k""")
def fold_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(workflow.fold_baselines(_customers(spark, sf_dir), "fold", "stratum", "state", 0.5))


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("state"), (F.col("l_suppkey") % 20).cast("int").alias("grp"), (F.col("l_suppkey") % 4).cast("int").alias("stratum"), (F.col("l_suppkey") % 20 % 3).cast("int").alias("fold"), "l_quantity", "l_extendedprice", "l_discount")


def _cross_validated(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir).withColumns({"l_quantity": F.col("l_quantity") / 50, "l_extendedprice": F.col("l_extendedprice") / 1e5})
    roles = workflow.EventTable("state", "grp", "stratum", "fold", ("l_quantity", "l_extendedprice", "l_discount"))
    return workflow.cross_validated(rows, roles, model)


@query()
def cv_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross_validated(spark, sf_dir, "logit")


@query()
def cv_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross_validated(spark, sf_dir, "forest")


LEVELS = f"{inputs.SCORES}, lv AS (SELECT g, sum(w * s0) / sum(w) AS a0, sum(w * s1) / sum(w) AS a1, sum(w * s2) / sum(w) AS a2 FROM sc GROUP BY g), gn AS (SELECT g, 1 AS level, a1 AS score, a1 - a0 AS gain FROM lv UNION ALL SELECT g, 2, a2, a2 - a1 FROM lv)"


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.adjacent_gains(score_cells(spark, sf_dir), "g", "w", ["s0", "s1", "s2"])


@query(f"WITH {LEVELS} SELECT g, level, round(score, 9) AS score, round(gain, 9) AS gain FROM gn")
def ladder_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(_gains(spark, sf_dir))


@query(f"""WITH {LEVELS}, st AS (SELECT level, min(gain) > 1e-9 AS ok FROM gn GROUP BY level), up AS (SELECT level, min(CAST(ok AS INTEGER)) OVER (ORDER BY level) AS reached FROM st)
 SELECT CAST(coalesce(max(level) FILTER (WHERE reached = 1), 0) AS INTEGER) AS ceiling, count(*) AS steps FROM up""")
def ladder_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.ceiling(_gains(spark, sf_dir))


BLOCKS = ("s", "t", "z")


def _lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean smoothed log score of the return flag given each subset of status (1), month (2) and line number (4), by supplier group."""
    rows = table(spark, sf_dir, "lineitem")
    cells = cut(rows.groupBy((F.col("l_suppkey") % 4).cast("int").alias("group"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("s"), F.month("l_shipdate").alias("t"), F.col("l_linenumber").alias("z")).agg(F.count("*").cast("double").alias("w")))  # read once for all eight subsets; few cells, in as few partitions
    out = None
    for mask in range(8):
        keys = [k for i, k in enumerate(BLOCKS) if mask >> i & 1]
        joint = cells.groupBy("a", *keys).agg(F.sum("w").alias("n_ak"))
        base = joint.groupBy(*keys).agg(F.sum("n_ak").alias("n_k"))
        x = cells.join(joint, ["a", *keys])
        x = x.join(base, keys) if keys else x.crossJoin(F.broadcast(base))
        s = x.groupBy("group").agg((F.sum(F.col("w") * F.ln((F.col("n_ak") + 0.5) / (F.col("n_k") + 1.5))) / F.sum("w")).alias("score")).select(F.lit(mask).alias("subset_mask"), "group", "score")
        out = s if out is None else out.unionByName(s)
    return out


def _nodes_sql() -> str:
    parts = []
    for mask in range(8):
        keys = "".join(f", {k}" for i, k in enumerate(BLOCKS) if mask >> i & 1)
        by = f"PARTITION BY {keys[2:]}" if keys else ""
        parts.append(f"SELECT {mask} AS mask, grp, sum(w * ln((na + 0.5) / (nk + 1.5))) / sum(w) AS score FROM (SELECT grp, w, sum(w) OVER (PARTITION BY a{keys}) AS na, sum(w) OVER ({by}) AS nk FROM lc) GROUP BY grp")
    return "lc AS (SELECT l_suppkey % 4 AS grp, l_returnflag AS a, l_linestatus AS s, month(l_shipdate) AS t, l_linenumber AS z, count(*) AS w FROM lineitem GROUP BY ALL), nd AS (" + " UNION ALL ".join(parts) + ")"


EDGES = f"""{_nodes_sql()}, ed AS (SELECT l.mask AS subset_mask, b.b AS block, CASE WHEN min(u.score - l.score) > 1e-9 THEN 'generalizing' WHEN max(u.score - l.score) <= 1e-9 THEN 'non_generalizing' ELSE 'mixed' END AS category, min(u.score - l.score) AS min_gain, avg(u.score - l.score) AS mean_gain
 FROM nd l CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS b) b JOIN nd u ON u.mask = l.mask + (1 << b.b) AND u.grp = l.grp WHERE (l.mask >> b.b) % 2 = 0 GROUP BY l.mask, b.b)"""


@query(f"WITH {EDGES} SELECT CAST(subset_mask AS INTEGER) AS subset_mask, CAST(block AS INTEGER) AS block, category, round(min_gain, 9) AS min_gain, round(mean_gain, 9) AS mean_gain FROM ed")
def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(ladder.lattice_edges(_lattice_nodes(spark, sf_dir), 3))


@query(f"WITH {EDGES} SELECT CAST(block AS INTEGER) AS block, round(sum(mean_gain * CASE bit_count(CAST(subset_mask AS INTEGER)) WHEN 1 THEN 1 / 6.0 ELSE 1 / 3.0 END), 9) AS shapley FROM ed GROUP BY block")
def lattice_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(ladder.shapley(ladder.lattice_edges(_lattice_nodes(spark, sf_dir), 3), 3))


@query(f"""WITH {EDGES}, ok AS (SELECT subset_mask AS lo, subset_mask + (1 << block) AS hi FROM ed WHERE category = 'generalizing')
 SELECT count(*) AS generalizing_paths, CAST(6 AS BIGINT) AS paths FROM ok a JOIN ok b ON a.hi = b.lo JOIN ok c ON b.hi = c.lo WHERE a.lo = 0""")
def lattice_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.monotone_paths(ladder.lattice_edges(_lattice_nodes(spark, sf_dir), 3), 3)


@query(f"WITH {FIELD}, z AS (SELECT nation, m, CASE WHEN hs.pri = '2-HIGH' AND nation % 5 = 0 THEN 0 ELSE p END AS p, pm FROM hs JOIN r ON hs.seg = r.seg AND hs.pri = r.pri) SELECT nation, round(sum(m * (ln(greatest(p, 1e-15)) - ln(greatest(pm, 1e-15)))) / sum(m), 9) AS gain, CAST(sum(m) AS DOUBLE) AS weight FROM z GROUP BY nation")
def generalization_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    rows = test.join(state.dirichlet_field(train, ["seg"], "pri", 0.5), ["seg", "pri"])
    rows = rows.withColumn("p", F.when((F.col("pri") == "2-HIGH") & (F.col("nation") % 5 == 0), 0.0).otherwise(F.col("p")))
    return rounds(transfer.generalization_profile(rows, "nation", "p", "p_marginal", "mass"))
