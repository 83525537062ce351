"""Queries of the frozen group protocol, of identity-checked roles and of evidence dossiers, with their SQL.

Customers are groups: a third each for training, calibration and validation. An order's priority is forecast from its
customer's segment, with counts of the training groups alone, against the pooled shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators import decisions, identity, protocol
from tessera.plans.information import rounds
from tessera.plans.inputs import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CLASSES, MISCOVERAGE = 5, 0.1
MODEL, REFERENCE = b"priority given segment, 0.5", b"pooled priority, 0.5"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    role = F.element_at(F.array(*[F.lit(r) for r in protocol.ROLES]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), F.col("c_custkey").alias("grp"), F.concat(F.lit("n"), (F.col("c_nationkey") % 2).cast("string")).alias("stratum"), role.alias("role"),
        F.col("c_mktsegment").alias("seg"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("state"), (F.col("o_orderkey") % 3 + 1).cast("double").alias("weight"),
    )


def forecasts(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    orders = _orders(spark, sf_dir) if orders is None else orders
    learnt = orders.filter("role = 'training'")
    count = lambda k: F.count_if(F.col("state") == k) + 0.5
    shares = F.array(*[count(k) / (F.count("*") + 0.5 * CLASSES) for k in range(CLASSES)])
    given, pooled = learnt.groupBy("seg").agg(shares.alias("conditional")), learnt.agg(shares.alias("reference"))
    rows = orders.filter("role != 'training'").join(F.broadcast(given), "seg").crossJoin(F.broadcast(pooled))
    return rows.select("role", "row_id", "grp", "stratum", "conditional", "reference", "weight")


def training(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    return (_orders(spark, sf_dir) if orders is None else orders).filter("role = 'training'").select("grp", "stratum").distinct()


def outcomes(spark: SparkSession, sf_dir: str, role: str, orders: DataFrame | None = None) -> DataFrame:
    return (_orders(spark, sf_dir) if orders is None else orders).filter(F.col("role") == role).select("row_id", "state")


def _text(name: str):
    return F.array_join(F.transform(name, lambda p: p.cast("decimal(20,12)").cast("string")), ",")


def fields() -> list:
    """Numbers by their decimals, which another engine writes alike."""
    return [F.col("row_id"), F.col("grp"), F.col("stratum"), _text("conditional"), _text("reference"), F.col("weight").cast("decimal(20,12)")]


def _listed(name: str) -> str:
    return f"array_to_string(list_transform({name}, lambda p: CAST(CAST(p AS DECIMAL(20, 12)) AS VARCHAR)), ',')"


def _encoded(*parts: str) -> str:
    return " || ';' || ".join(f"coalesce(length(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '~')" for p in parts)


_SHARES = "[" + ", ".join(f"(count(*) FILTER (WHERE state = {k}) + 0.5) / (count(*) + 2.5)" for k in range(CLASSES)) + "]"
FORECASTS = f"""od AS (SELECT o_orderkey AS row_id, c_custkey AS grp, 'n' || (c_nationkey % 2) AS stratum, ['training', 'calibration', 'validation'][c_custkey % 3 + 1] AS role, c_mktsegment AS seg,
   CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS state, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS weight FROM orders JOIN customer ON o_custkey = c_custkey),
 gi AS (SELECT seg, {_SHARES} AS conditional FROM od WHERE role = 'training' GROUP BY seg), po AS (SELECT {_SHARES} AS reference FROM od WHERE role = 'training'),
 fo AS (SELECT role, row_id, grp, stratum, conditional, reference, weight, state FROM od JOIN gi USING (seg), po WHERE role <> 'training'),
 tr AS (SELECT DISTINCT grp, stratum FROM od WHERE role = 'training')"""
_LIMBS = " || ',' || ".join(f"CAST(sum(CAST('0x' || substr(h, {4 * i + 1}, 4) AS BIGINT)) AS VARCHAR)" for i in range(protocol.LIMBS))


def _digest_sql(source: str, where: str = "", by: str = "") -> str:
    fields = _encoded("row_id", "grp", "stratum", _listed("conditional"), _listed("reference"), "CAST(weight AS DECIMAL(20, 12))")
    return f"""SELECT {by}role, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, sha256(role || ';' || count(*) || ';' || {_LIMBS}) AS digest
   FROM (SELECT {by}role, grp, sha256({fields}) AS h FROM {source} {where}) GROUP BY {by}role"""


_TRAINED = f"SELECT 'training' AS role, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, sha256('training' || ';' || count(*) || ';' || {_LIMBS}) AS digest FROM (SELECT grp, sha256({_encoded('grp', 'stratum')}) AS h FROM tr)"


@query(f"WITH {FORECASTS} {_digest_sql('fo')} UNION ALL {_TRAINED}")
def protocol_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frozen(spark, sf_dir)[0].select("role", "n_rows", "n_groups", "digest")


_SCENES = ("same", "changed", "missing", "doubled")


@query(f"""WITH {FORECASTS}, fi AS (SELECT min(row_id) AS r FROM fo WHERE role = 'calibration'),
 sc AS (SELECT 'same' AS scene, fo.* FROM fo UNION ALL SELECT 'changed', fo.* REPLACE (CASE WHEN row_id = r THEN weight + 1 ELSE weight END AS weight) FROM fo, fi
   UNION ALL SELECT 'missing', fo.* FROM fo, fi WHERE row_id <> r UNION ALL SELECT 'doubled', fo.* FROM fo UNION ALL SELECT 'doubled', fo.* FROM fo, fi WHERE row_id = r),
 pl AS ({_digest_sql('fo')} UNION ALL {_TRAINED}), nw AS ({_digest_sql('sc', by='scene, ')} UNION ALL SELECT s.scene, t.* FROM ({_TRAINED}) t, (SELECT DISTINCT scene FROM sc) s)
 SELECT scene, role, pl.n_rows AS planned, nw.n_rows AS found, CASE WHEN nw.n_rows < pl.n_rows THEN 'rows_missing' WHEN nw.n_rows > pl.n_rows THEN 'rows_added' WHEN pl.digest = nw.digest THEN 'unchanged' ELSE 'changed' END AS status FROM pl JOIN nw USING (role)""")
def protocol_role_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every role on the frozen tables and with one calibration row changed, missing and doubled."""
    rows, learnt = _staged(spark, sf_dir)[:2]
    plan = protocol.role_digests(rows, learnt, fields())
    first = rows.filter("role = 'calibration'").agg(F.min("row_id").alias("__r"))
    marked = rows.crossJoin(F.broadcast(first)).withColumn("__hit", F.col("row_id") == F.col("__r")).drop("__r")
    scenes = {
        "same": marked, "changed": marked.withColumn("weight", F.when(F.col("__hit"), F.col("weight") + 1).otherwise(F.col("weight"))),
        "missing": marked.filter("not __hit"), "doubled": marked.unionByName(marked.filter("__hit")),
    }
    out = None
    for name in _SCENES:
        one = protocol.role_audit(plan, scenes[name].drop("__hit"), learnt, fields()).select(F.lit(name).alias("scene"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _gains_sql(role: str) -> str:
    return f"SELECT grp, stratum, count(*) AS n_rows, sum(weight * (ln(conditional[state + 1]) - ln(reference[state + 1]))) / sum(weight) AS gain FROM fo WHERE role = '{role}' GROUP BY grp, stratum"


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecasts, training, and the orders that they and the outcomes are read from: staged as a plan binds them, so that
    rechecks read what was frozen, and orders meet their customers once.
    """
    orders = cut(_orders(spark, sf_dir))
    return cut(forecasts(spark, sf_dir, orders)), cut(training(spark, sf_dir, orders)), orders


def _frozen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The plan and what _staged gives."""
    rows, learnt, orders = _staged(spark, sf_dir)
    return protocol.freeze(rows, learnt, CLASSES, MISCOVERAGE, MODEL, REFERENCE, fields()), rows, learnt, orders


def _calibrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What _frozen gives, with a plan that is staged, and the calibration gains."""
    plan, rows, learnt, orders = _frozen(spark, sf_dir)
    plan = cut(plan)
    return plan, rows, learnt, orders, protocol.scored(plan, rows, learnt, outcomes(spark, sf_dir, "calibration", orders), "calibration", MODEL, REFERENCE, fields())


@query(f"WITH {FORECASTS} SELECT grp, stratum, n_rows, round(gain, 9) AS gain FROM ({_gains_sql('calibration')})")
def protocol_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(_calibrated(spark, sf_dir)[4])


@query(f"""WITH {FORECASTS}, ca AS ({_gains_sql('calibration')}), va AS ({_gains_sql('validation')}),
 rk AS (SELECT stratum, gain, row_number() OVER (PARTITION BY stratum ORDER BY gain) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM ca),
 bo AS (SELECT stratum, any_value(n) AS n, CAST(floor((any_value(n) + 1) * 0.1 + 1e-12) AS BIGINT) AS r, coalesce(max(CASE WHEN k = CAST(floor((n + 1) * 0.1 + 1e-12) AS BIGINT) THEN gain END), CAST('-inf' AS DOUBLE)) AS b FROM rk GROUP BY stratum)
 SELECT stratum, n AS n_calibration, count(*) AS n_validation, r AS rank, round(b, 9) AS bound, r = 0 AS vacuous, round((n + 1 - r) / (n + 1), 9) AS expected_coverage, count(*) FILTER (WHERE gain >= b) AS n_covered,
   round(count(*) FILTER (WHERE gain >= b) / count(*), 9) AS coverage, count(*) FILTER (WHERE gain > 0) AS n_positive FROM va JOIN bo USING (stratum) GROUP BY stratum, n, r, b""")
def protocol_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freeze, calibrate, then validate with the calibration's digest; each step rechecks the plan."""
    plan, rows, learnt, orders, gains = _calibrated(spark, sf_dir)
    gains = cut(gains)
    digest = protocol.gains_digest(gains).first()["digest"]
    return rounds(protocol.validated(plan, gains, digest, rows, learnt, outcomes(spark, sf_dir, "validation", orders), MODEL, REFERENCE, fields()))


KEYS = ("by_nation", "by_segment")
SOURCES = {"training": "north", "calibration": "south", "validation": "south"}


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under two kinds of alias: equal balances by nation, or by segment, to within a few units."""
    c = table(spark, sf_dir, "customer")
    role = F.element_at(F.array(*[F.lit(r) for r in protocol.ROLES]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(
        role.alias("role"), F.col("c_custkey").alias("unit"), F.col("c_custkey").alias("grp"), F.concat(F.lit("n"), (F.col("c_nationkey") % 2).cast("string")).alias("stratum"), F.when(F.col("c_custkey") % 3 == 0, "north").otherwise("south").alias("source"),
        (F.col("c_nationkey") % 7).alias("cluster"), F.concat_ws("/", "c_nationkey", F.floor(F.col("c_acctbal") / 3).cast("string")).alias("by_nation"), F.concat_ws("/", "c_mktsegment", F.floor("c_acctbal").cast("string")).alias("by_segment"),
    )


UNITS = """un AS (SELECT ['training', 'calibration', 'validation'][c_custkey % 3 + 1] AS role, c_custkey AS unit, 'n' || (c_nationkey % 2) AS stratum, c_nationkey % 7 AS cluster,
   c_nationkey || '/' || CAST(floor(c_acctbal / 3) AS BIGINT) AS k1, c_mktsegment || '/' || CAST(floor(c_acctbal) AS BIGINT) AS k2 FROM customer)"""
ENTITIES = f"""{UNITS}, ln AS (SELECT a.unit AS x, b.unit AS y FROM un a JOIN un b ON a.k1 = b.k1 AND a.unit <> b.unit UNION SELECT a.unit, b.unit FROM un a JOIN un b ON a.k2 = b.k2 AND a.unit <> b.unit),
 re AS (SELECT unit AS unit, unit AS seen FROM un UNION SELECT re.unit, ln.y FROM re JOIN ln ON re.seen = ln.x), en AS (SELECT unit, min(seen) AS entity FROM re GROUP BY unit)"""


@query(f"WITH RECURSIVE {ENTITIES} SELECT unit, entity FROM en")
def identity_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.entities(units(spark, sf_dir), "unit", KEYS)


@query(f"WITH RECURSIVE {ENTITIES} SELECT entity, count(*) AS n_units, count(*) AS n_groups, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT role) > 1 AS crosses, count(*) > 1 AS reused FROM en JOIN un USING (unit) GROUP BY entity")
def identity_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.crossings(units(spark, sf_dir), "unit", KEYS)


@query(f"""WITH RECURSIVE {ENTITIES}, rs AS (SELECT role, unit FROM un), pl AS (SELECT DISTINCT o_custkey AS unit FROM orders)
 SELECT problem, n FROM (SELECT 'group_not_in_plan' AS problem, (SELECT count(*) FROM un WHERE unit NOT IN (SELECT unit FROM pl)) AS n
   UNION ALL SELECT 'entity_reused', (SELECT count(*) FROM (SELECT entity FROM en GROUP BY entity HAVING count(*) > 1))
   UNION ALL SELECT 'entity_crossing_roles', (SELECT count(*) FROM (SELECT entity FROM en JOIN un USING (unit) GROUP BY entity HAVING count(DISTINCT role) > 1))) WHERE n > 0""")
def identity_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_problems(units(spark, sf_dir), "unit", KEYS, forecasts(spark, sf_dir), training(spark, sf_dir), SOURCES)


@query(f"""WITH {UNITS}, cl AS (SELECT stratum, count(*) AS shared_clusters FROM (SELECT stratum, cluster FROM un WHERE role <> 'training' GROUP BY ALL HAVING count(DISTINCT role) = 2) GROUP BY stratum),
 st AS (SELECT stratum, {', '.join(f"count(DISTINCT unit) FILTER (WHERE role = '{r}') AS n_{r}, count(DISTINCT cluster) FILTER (WHERE role = '{r}') AS clusters_{r}" for r in protocol.ROLES)} FROM un GROUP BY stratum),
 ra AS (SELECT *, CAST(floor((n_calibration + 1) * 0.1 + 1e-12) AS BIGINT) AS rank FROM st JOIN cl USING (stratum)), ok AS (SELECT *, rank >= 1 AND n_validation >= 1 AS possible, n_training >= 2 AS enough_training FROM ra)
 SELECT *, CASE WHEN (SELECT bool_and(possible AND enough_training) FROM ok) THEN 'count_gate_passed' ELSE 'hold_vacuous_rank' END AS status FROM ok""")
def identity_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.support_gate(units(spark, sf_dir), MISCOVERAGE)


HANDOFF = """ho AS (SELECT c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'known_truth' ELSE 'empirical' END AS scope, CASE WHEN c_custkey % 5 = 0 THEN 'structural_capacity' ELSE 'species_support' END AS semantics,
   c_nationkey % 7 <> 0 AS declared, c_nationkey % 4 <> 0 AS frozen, count(o_orderkey) >= 7 AS estimable, ['generalizing', 'mixed', 'non_generalizing', 'unavailable', 'not_tested'][count(o_orderkey) % 5 + 1] AS transfer
   FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey),
 hp AS (SELECT *, declared AND estimable AS summary_allowed, declared AND estimable AND semantics = 'species_support' AND scope = 'known_truth' AS method_allowed,
   declared AND estimable AND semantics = 'species_support' AND scope = 'empirical' AND frozen AND transfer = 'generalizing' AS empirical_allowed FROM ho)"""


@query(f"""WITH {HANDOFF} SELECT subject, summary_allowed, method_allowed, empirical_allowed,
   CASE WHEN semantics = 'structural_capacity' THEN CASE WHEN summary_allowed THEN 'structural_capacity_only' ELSE 'unavailable' END WHEN method_allowed THEN 'known_truth_method_state_only' WHEN empirical_allowed THEN 'empirical_axis_resolved_supported' WHEN summary_allowed THEN 'descriptive_projection_only' ELSE 'unavailable' END AS category,
   concat_ws(',', CASE WHEN NOT declared THEN 'added_axis_semantics_not_declared' END, CASE WHEN NOT estimable THEN 'thickness_not_estimable' END, CASE WHEN scope = 'empirical' AND NOT frozen THEN 'empirical_source_boundary_not_prospectively_frozen' END,
     CASE WHEN semantics = 'structural_capacity' THEN 'structural_capacity_is_not_species_support' WHEN method_allowed THEN 'known_truth_state_not_empirical_species_evidence' WHEN empirical_allowed OR NOT summary_allowed THEN NULL WHEN transfer = 'non_generalizing' THEN 'independent_axis_resolved_organization_not_generalizing'
       WHEN transfer = 'mixed' THEN 'independent_axis_resolved_organization_mixed' WHEN transfer = 'unavailable' THEN 'independent_transferability_unavailable' WHEN transfer = 'not_tested' THEN 'independent_transferability_not_tested' END) AS reasons FROM hp""")
def handoff_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rows = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("subject"), F.when(F.col("c_custkey") % 3 == 0, "known_truth").otherwise("empirical").alias("scope"), F.when(F.col("c_custkey") % 5 == 0, "structural_capacity").otherwise("species_support").alias("semantics"),
        (F.col("c_nationkey") % 7 != 0).alias("declared"), (F.col("c_nationkey") % 4 != 0).alias("frozen"), (n >= 7).alias("estimable"), F.get(F.array(*[F.lit(t) for t in decisions.TRANSFER]), (n % 5).cast("int")).alias("transfer"),
    )
    return decisions.handoff(rows).select("subject", "summary_allowed", "method_allowed", "empirical_allowed", "category", F.array_join("reasons", ",").alias("reasons"))


#: the audits of a dossier, outermost first
LAYERS = ("access_checkpoints", "access_log_chain", "ledger_binding", "content_provenance", "access_provenance", "selection_provenance", "training_provenance")
_AUDITS = f"""au AS (SELECT o_custkey % 60 AS subject, CAST(o_orderkey % {len(LAYERS)} AS INTEGER) AS position, {list(LAYERS)}[o_orderkey % {len(LAYERS)} + 1] AS layer, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') % 9 = 0 THEN 'mismatch' ELSE 'pass' END AS status FROM orders GROUP BY ALL),
 fl AS (SELECT subject, min(position) AS low FROM au WHERE status = 'mismatch' GROUP BY subject),
 ef AS (SELECT au.*, CASE WHEN position > low THEN 'not_run_' || {list(LAYERS)}[low + 1] || '_mismatch' ELSE status END AS effective, {list(LAYERS)}[low + 1] AS failed FROM au LEFT JOIN fl USING (subject))"""


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.col("o_orderkey") % len(LAYERS)).cast("int")
    cells = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 60).alias("subject"), place.alias("position")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    return cells.select("subject", "position", F.get(F.array(*[F.lit(x) for x in LAYERS]), F.col("position")).alias("layer"), F.when(F.col("n") % 9 == 0, "mismatch").otherwise("pass").alias("status"))


@query(f"WITH {_AUDITS} SELECT subject, position, layer, status, effective FROM ef")
def dossier_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.effective_layers(_audits(spark, sf_dir))


@query(f"""WITH {_AUDITS}, ba AS (SELECT o_custkey % 60 AS subject, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') % 13 = 0 THEN 'unavailable' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') % 13 = 1 THEN 'blocked' ELSE 'admitted' END AS bv,
   CASE WHEN count(*) % 11 = 0 THEN 'not_certified' WHEN count(*) % 11 = 1 THEN 'unavailable' ELSE 'certified' END AS bc, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') % 3 = 0 AS wa FROM orders GROUP BY 1),
 st AS (SELECT subject, any_value(failed) AS failed_layer, string_agg(layer || ':' || effective, '|' ORDER BY position) AS steps FROM ef GROUP BY subject),
 de AS (SELECT *, CASE WHEN bv = 'unavailable' THEN 'unavailable' WHEN bv = 'blocked' THEN 'not_certified' WHEN bc <> 'certified' THEN bc WHEN failed_layer IS NOT NULL THEN 'unavailable' ELSE 'certified' END AS certification,
   CASE WHEN bv <> 'admitted' THEN bv WHEN bc = 'not_certified' THEN 'admitted_extended_not_certified' WHEN bc = 'unavailable' OR failed_layer IS NOT NULL THEN 'admitted_extended_unavailable' WHEN wa THEN 'admitted_with_warnings' ELSE 'admitted' END AS operational FROM ba JOIN st USING (subject))
 SELECT subject, failed_layer, certification, operational, coalesce(failed_layer || '_mismatch', '') AS provenance_reasons, CASE WHEN wa THEN 'urgent_share' ELSE '' END AS warnings, steps || '|certification:' || certification || '|operational:' || operational AS trace FROM de""")
def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    late, all_, urgent = F.count_if(F.col("o_orderstatus") == "F") % 13, F.count("*") % 11, F.count_if(F.col("o_orderpriority") == "1-URGENT") % 3
    none = F.array().cast("array<string>")
    bases = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 60).alias("subject")).agg(
        F.when(late == 0, "unavailable").when(late == 1, "blocked").otherwise("admitted").alias("base_validation"), F.when(all_ == 0, "not_certified").when(all_ == 1, "unavailable").otherwise("certified").alias("base_certification"),
        F.when(urgent == 0, F.array(F.lit("urgent_share"))).otherwise(none).alias("warnings"),
    ).withColumns({"statistical_reasons": none, "provenance_reasons": none})
    found = decisions.dossier(bases, _audits(spark, sf_dir))
    return found.select("subject", "failed_layer", "certification", "operational", F.array_join("provenance_reasons", ",").alias("provenance_reasons"), F.array_join("warnings", ",").alias("warnings"), F.array_join("trace", "|").alias("trace"))
