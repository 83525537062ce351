"""Queries that prepare and audit event tables, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import solar
from tessera.operators import events, normalize, provenance
from tessera.plans.information import rounds
from tessera.plans.inputs import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PERMUTATIONS = 199  # as the reference takes; p can then be as low as 0.005


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""WITH t AS (SELECT doc_id AS k FROM labels), h AS (SELECT doc_id AS k FROM documents WHERE lang = 'fr')
 SELECT (SELECT count(DISTINCT k) FROM h WHERE k IN (SELECT k FROM t)) AS leaked_ids, (SELECT count(*) FROM h WHERE k IN (SELECT k FROM t)) AS leaked_rows, (SELECT count(*) FROM h) AS heldout_rows,
 (SELECT count(*) FROM (SELECT k FROM t GROUP BY k HAVING count(*) > 1)) AS training_duplicates, (SELECT count(*) FROM (SELECT k FROM h GROUP BY k HAVING count(*) > 1)) AS heldout_duplicates,
 CASE WHEN (SELECT count(*) FROM h WHERE k IN (SELECT k FROM t)) > 0 THEN 'leakage' ELSE 'disjoint' END AS category""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.leakage(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id"), "doc_id")


@query("SELECT grp, string_agg(role, ',' ORDER BY role) AS roles FROM (SELECT DISTINCT o_custkey AS grp, o_orderstatus AS role FROM orders) GROUP BY grp HAVING count(*) > 1")
def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.identity_gate(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("role"), F.col("o_custkey").alias("grp")))


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS moved, CASE WHEN count(*) FILTER (WHERE o_orderkey % 7 = 0) > 0 THEN 'reorderable' ELSE 'exact' END AS alignment FROM orders")
def row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return provenance.row_alignment(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").alias("position")), o.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).alias("position")))


@query("""WITH m AS (SELECT o_orderpriority AS stage, md5(CAST(o_custkey AS VARCHAR)) AS digest, count(*) AS m FROM orders GROUP BY ALL), d AS (SELECT o_orderpriority AS stage, md5(CAST(o_custkey AS VARCHAR)) AS digest, count(*) AS d FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
 g AS (SELECT coalesce(m.stage, d.stage) AS stage, coalesce(m, 0) - coalesce(d, 0) AS gap FROM m FULL JOIN d ON m.stage = d.stage AND m.digest = d.digest)
 SELECT stage, CAST(sum(greatest(gap, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-gap, 0)) AS BIGINT) AS unexpected, CAST(greatest(sum(greatest(gap, 0)), sum(greatest(-gap, 0))) AS BIGINT) AS discrepancy FROM g GROUP BY stage""")
def ledger_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.md5(F.col("o_custkey").cast("string").cast("binary")).alias("digest"), "o_orderstatus")
    return provenance.ledger_binding(rows, rows.filter("o_orderstatus != 'P'"))


def _chained_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash-chained log per user of the events table, in which some events were forged afterwards.

    A task goes through its users' sorted events and carries only the last hash from row to row.
    """
    names = ["chain", "sequence_index", "event_id", "event_type", "previous_event_hash", "event_hash"]
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("chain"), F.col("event_id").cast("long").alias("event_id"), "event_type")
    ordered = e.repartition("chain").sortWithinPartitions("chain", "event_id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, index, last = object(), 0, ""
        for batch in batches:
            indexes, before, own = [], [], []
            for c, i, t in zip(*(batch.column(n).to_pylist() for n in ("chain", "event_id", "event_type")), strict=True):
                if c != chain:
                    chain, index, last = c, 0, "0" * 64
                indexes.append(index)
                before.append(last)
                last = sha256(f'{{"event_id":{i},"event_type":"{t}","previous_event_hash":"{last}"}}'.encode()).hexdigest()
                own.append(last)
                index += 1
            yield pa.RecordBatch.from_arrays([batch.column("chain"), pa.array(indexes, pa.int32()), batch.column("event_id"), batch.column("event_type"), pa.array(before, pa.string()), pa.array(own, pa.string())], names=names)

    log = ordered.mapInArrow(link, "chain bigint, sequence_index int, event_id bigint, event_type string, previous_event_hash string, event_hash string")
    return log.withColumn("event_type", F.when(F.col("event_id") % 997 == 0, "forged").otherwise(F.col("event_type")))


LOG = """e AS (SELECT user_id AS chain, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
 lg AS (SELECT chain, i, event_id, event_type, repeat('0', 64) AS prev, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","previous_event_hash":"' || repeat('0', 64) || '"}') AS own FROM e WHERE i = 0
   UNION ALL SELECT e.chain, e.i, e.event_id, e.event_type, l.own, sha256('{"event_id":' || e.event_id || ',"event_type":"' || e.event_type || '","previous_event_hash":"' || l.own || '"}') FROM lg l JOIN e ON e.chain = l.chain AND e.i = l.i + 1)"""


@query(f"WITH RECURSIVE {LOG} SELECT chain, count(*) AS events, CAST(0 AS BIGINT) AS index_gaps, CAST(0 AS BIGINT) AS broken_links, count(*) FILTER (WHERE event_id % 997 = 0) AS bad_hashes FROM lg GROUP BY chain")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.chain_audit(_chained_log(spark, sf_dir), ("event_id", "event_type"))


@query(f"""WITH RECURSIVE {LOG}, m AS (SELECT chain, max(i) AS t FROM lg GROUP BY chain), c AS (SELECT lg.chain, i, event_id, t FROM lg JOIN m ON lg.chain = m.chain WHERE i % 10 = 0 OR (i = t AND lg.chain % 3 <> 0))
 SELECT chain, count(*) AS checkpoints, count(*) FILTER (WHERE event_id % 101 = 0) AS mismatched, CAST(0 AS BIGINT) AS out_of_order, bool_or(i = t) AS terminal_covered FROM c GROUP BY chain""")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _chained_log(spark, sf_dir)
    last = log.groupBy(F.col("chain").alias("c")).agg(F.max("sequence_index").alias("t"))
    marks = log.join(last, F.col("chain") == F.col("c")).filter("sequence_index % 10 = 0 or (sequence_index = t and chain % 3 != 0)")
    marks = marks.select("chain", F.col("sequence_index").alias("position"), F.col("sequence_index").alias("event_index"), F.when(F.col("event_id") % 101 == 0, "0").otherwise(F.col("event_hash")).alias("event_hash"))
    return provenance.checkpoint_audit(log, marks)


def _time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 8
    clock = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    text = (
        F.when(k == 0, F.substring(day, 1, 4)).when(k == 1, F.substring(day, 1, 7)).when(k == 2, day).when(k == 3, F.concat(day, F.lit("T"), clock)).when(k == 4, F.concat(day, F.lit(" "), clock, F.lit(":30Z")))
        .when(k == 5, F.concat(day, F.lit("T"), clock, F.lit(":05-03:30"))).when(k == 6, F.concat(day, F.lit("/"), day)).otherwise(F.concat(F.substring(day, 1, 5), F.lit("13-40")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderkey % 24 AS h, o_orderkey % 60 AS m, o_orderdate AS d FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'minute' WHEN 4 THEN 'second' WHEN 5 THEN 'second' WHEN 6 THEN 'interval' ELSE 'unknown' END AS "precision",
 CASE WHEN k < 3 THEN 'date_only' WHEN k = 3 THEN 'source_local_unknown_timezone' WHEN k = 4 THEN 'utc' WHEN k = 5 THEN 'source_offset' WHEN k = 6 THEN 'interval' ELSE 'unknown' END AS clock_basis,
 CASE WHEN k < 6 THEN CAST(year(d) AS INTEGER) END AS year, CASE WHEN k BETWEEN 1 AND 5 THEN CAST(month(d) AS INTEGER) END AS month, CASE WHEN k BETWEEN 2 AND 5 THEN CAST(dayofyear(d) AS INTEGER) END AS day_of_year,
 CASE WHEN k BETWEEN 3 AND 5 THEN CAST(h AS INTEGER) END AS hour, CASE WHEN k BETWEEN 3 AND 5 THEN CAST(m AS INTEGER) END AS minute, CASE k WHEN 4 THEN 30 WHEN 5 THEN 5 END AS second, CASE k WHEN 4 THEN 0 WHEN 5 THEN -210 END AS utc_offset_minutes,
 CASE WHEN k < 2 THEN 'coarse_date' WHEN k = 3 THEN 'timezone_unknown' WHEN k = 6 THEN 'time_interval' WHEN k = 7 THEN 'missing_or_unparsed_time' ELSE '' END AS flags FROM o""")
def temporal_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _time_texts(spark, sf_dir).withColumn("t", normalize.temporal(F.col("raw")))
    return t.select("o_orderkey", "t.precision", "t.clock_basis", "t.year", "t.month", "t.day_of_year", "t.hour", "t.minute", "t.second", "t.utc_offset_minutes", F.array_join(normalize.temporal_flags(F.col("t")), ",").alias("flags"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_size AS s FROM part)
 SELECT p_partkey, CASE k WHEN 0 THEN 'point' WHEN 1 THEN 'interval' WHEN 2 THEN 'categorical' WHEN 3 THEN 'categorical' ELSE 'unknown' END AS v_precision, k <> 4 AND k <> 3 AS v_usable,
 CASE k WHEN 0 THEN 'sensor_vertical_coverage_not_supplied,vertical_reference_missing' WHEN 1 THEN 'open_vertical_interval,sensor_vertical_coverage_not_supplied,vertical_reference_missing' WHEN 2 THEN 'sensor_vertical_coverage_not_supplied' WHEN 3 THEN 'sensor_vertical_coverage_not_supplied,vertical_interval_reversed' ELSE 'missing_or_unparsed_vertical_information,sensor_vertical_coverage_not_supplied' END AS v_flags FROM p""")
def vertical_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, size).when(k == 4, "deep").alias("value"), F.when(k == 1, size).when(k == 3, "9").alias("low"), F.when(k == 3, "1").alias("high"), F.when(k.isin(2, 3), "canopy").alias("layer"))
    fields = normalize.VerticalFields("organism_height", value="value", minimum="low", maximum="high", stratum="layer", default_unit="m")
    return normalize.vertical(rows, fields).select("p_partkey", "v_precision", "v_usable", "v_flags")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN user_id IS NULL THEN 'missing_identity' WHEN value < 1 THEN 'implausible_value' WHEN event_type = 'error' THEN 'marked_outlier' WHEN hour(ts) < 3 THEN 'night' END AS reason FROM events) GROUP BY reason")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("missing_identity", F.col("user_id").isNull()), ("implausible_value", F.col("value") < 1), ("marked_outlier", F.col("event_type") == "error"), ("night", F.hour("ts") < 3)]
    return events.with_reason(table(spark, sf_dir, "events"), rules).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT user_id, epoch_us(ts) // 3600000000 AS bin, arg_min(event_id, (ts, event_id)) AS event_id, epoch_us(min(ts)) AS us FROM events GROUP BY ALL")
def thin_first_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = events.first_per_bin(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)
    return first.select("user_id", "bin", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


RANKED = "rk AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('{label}|' || c_custkey), c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"


@query(f"WITH {RANKED.format(label='split-v1')} SELECT c_custkey, c_nationkey, CASE WHEN r < floor(n * 0.3) THEN 'heldout' ELSE 'training' END AS role FROM rk")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.hash_split(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "split-v1", 0.3)


@query(f"WITH {RANKED.format(label='folds-v1')} SELECT c_custkey, c_nationkey, CAST(r % 5 AS INTEGER) AS fold FROM rk")
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.hash_folds(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "folds-v1", 5)


@query("""WITH o AS (SELECT c_nationkey AS nation, o_custkey AS cust, o_orderpriority AS state FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT nation, cust, count(*) AS n_rows, count(DISTINCT state) AS n_states FROM o GROUP BY ALL HAVING count(*) >= 12 AND count(DISTINCT state) >= 5), s AS (SELECT nation, count(*) AS n_groups FROM g GROUP BY nation HAVING count(*) >= 8)
 SELECT g.nation, cust, n_rows, n_states, n_groups FROM g JOIN s ON g.nation = s.nation""")
def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("state"))
    return events.admission(rows, "cust", "nation", "state", 12, 5, 8)


@query("SELECT CAST(floor(c_acctbal / 500.0) AS BIGINT) AS cell_x, CAST(floor(c_nationkey * 100 / 500.0) AS BIGINT) AS cell_y, count(*) AS n FROM customer GROUP BY ALL")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.grid_cells(table(spark, sf_dir, "customer"), F.col("c_acctbal"), F.col("c_nationkey") * 100, 500.0)


@query("""WITH i AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS e FROM orders), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT o_custkey, CAST(min(s) AS VARCHAR) AS s, CAST(max(e) AS VARCHAR) AS e, CAST(max(e) - min(s) + 1 AS BIGINT) AS days FROM g GROUP BY o_custkey, island""")
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("e"))
    return events.coalesced(rows, "o_custkey", "s", "e").withColumns({"s": F.col("s").cast("string"), "e": F.col("e").cast("string")})


@query("""WITH g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000.0 AS gap FROM events)
 SELECT CAST(CASE WHEN gap >= 86400 THEN 3 WHEN gap >= 21600 THEN 2 WHEN gap >= 3600 THEN 1 ELSE 0 END AS BIGINT) AS bin, count(*) AS n, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def gap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(events.gap_bins(table(spark, sf_dir, "events"), "user_id", "ts", [3600, 21600, 86400]))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 w AS (SELECT user_id, event_id, ts, us AS last, r, true AS kept FROM e WHERE r = 1
   UNION ALL SELECT e.user_id, e.event_id, e.ts, CASE WHEN e.us - w.last >= 43200000000 THEN e.us ELSE w.last END, e.r, e.us - w.last >= 43200000000 FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
 SELECT user_id, event_id, epoch_us(ts) AS us FROM w WHERE kept""")
def rolling_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = events.rolling_thin(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 12 * 3600)
    return kept.select("user_id", "event_id", F.unix_micros("ts").alias("us"))


def _mi_sql(source: str, keys: str) -> str:
    by = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    whole = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}sum(n / nt * ln(n * nt / (na * nb))) AS information FROM (SELECT {lead}n, sum(n) OVER ({by}identity) AS na, sum(n) OVER ({by}state) AS nb, sum(n) OVER ({whole}) AS nt FROM (SELECT {lead}identity, state, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY {lead}identity, state)){' GROUP BY ' + keys if keys else ''}"


@query(f"""WITH c AS (SELECT event_id AS id, user_id % 10 AS site, event_type AS identity, hour(ts) // 4 AS state FROM events), s AS (SELECT c.*, d.d FROM c CROSS JOIN (SELECT unnest(generate_series(0, {PERMUTATIONS - 1})) AS d) d),
 a AS (SELECT site, d, state, row_number() OVER (PARTITION BY site, d ORDER BY id) AS r FROM s), b AS (SELECT site, d, identity, row_number() OVER (PARTITION BY site, d ORDER BY md5('null-v1|' || d || '|' || id), id) AS r FROM s),
 m AS (SELECT a.d, identity, state FROM a JOIN b ON a.site = b.site AND a.d = b.d AND a.r = b.r), nu AS ({_mi_sql('m', 'd')}), ob AS ({_mi_sql('c', '')})
 SELECT round(any_value(ob.information), 9) AS observed, round(avg(nu.information), 9) AS null_mean, round((1 + count(*) FILTER (WHERE nu.information >= ob.information - 1e-12)) / (1.0 + count(*)), 9) AS p_value FROM nu, ob""")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("site"), F.col("event_type").alias("identity"), F.floor(F.hour("ts") / 4).alias("state"))
    return rounds(events.permutation_null(cells, "site", "identity", "state", PERMUTATIONS, "null-v1"))


@query("""SELECT c_custkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS fingerprint FROM customer""")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(provenance.canonical_event("c_name", "c_nationkey", "c_mktsegment"), 256).alias("fingerprint"))


@query("""WITH h AS (SELECT user_id, value, ((epoch_us(ts) % 86400000000) / 3600000000.0 + (user_id % 360 - 180) / 15.0 + 48) % 24 AS h FROM events)
 SELECT CASE WHEN abs(h - 6) <= 12 / 3600.0 OR abs(h - 18) <= 12 / 3600.0 THEN NULL WHEN h > 6 AND h < 18 THEN 1 ELSE 0 END AS context, CAST(value >= 50 AS INTEGER) + CAST(value >= 200 AS INTEGER) + CAST(value >= 500 AS INTEGER) AS band, count(*) AS n FROM h GROUP BY ALL""")
def solar_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    longitude = (F.col("user_id") % 360 - 180).cast("double")
    return rows.groupBy(solar.solar_context(F.col("ts"), longitude).alias("context"), solar.altitude_band(F.col("value")).alias("band")).agg(F.count("*").alias("n"))
