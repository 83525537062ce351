"""The tables of the registered queries in the roles that the operators ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.cube import support_cube

ALPHA = 0.5
#: return flags, and refits that each leave out a share of the blocks
FLAGS, REFIT_COUNT = 3, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "z": F.col("l_linenumber"), "t": F.month("l_shipdate")}
    return support_cube(table(spark, sf_dir, "lineitem"), axes, F.col("l_quantity"))


def event_cells(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Cells (ub: user bucket, hb: quarter of the day, wd: weekday) of one event type."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return support_cube(rows, {"ub": F.col("user_id") % 10, "hb": F.floor(F.hour("ts") / 6), "wd": F.dayofweek("ts")}, F.lit(1.0))


def events_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity (event type), hb (4-hour bin), fold and grp of users, mass."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.col("event_type").alias("identity"), F.floor(F.hour("ts") / 4).cast("int").alias("hb"), (F.col("user_id") % 3).cast("int").alias("fold"), (F.col("user_id") % 6).cast("int").alias("grp")).agg(F.count("*").cast("double").alias("mass"))


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg (customer's segment), pri (order priority), nation, key and mass of orders."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("pri"), F.col("c_nationkey").alias("nation"), F.lit(1.0).alias("mass"))


def _flag_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows w by line number g, supplier bucket b of 20, return flag a, status s and month t; staged, as all margins are counted from them."""
    rows = table(spark, sf_dir, "lineitem")
    return cut(rows.groupBy(F.col("l_linenumber").alias("g"), (F.col("l_suppkey") % 20).cast("int").alias("b"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("s"), F.month("l_shipdate").alias("t")).agg(F.count("*").cast("double").alias("w")))


def _scored(cells: DataFrame, counts) -> tuple[DataFrame, list]:
    """The cells with the counts of all their margins, and the pairs of counts whose ratios the three levels' scores are."""
    n = lambda *keys: cells.groupBy(*keys).agg(counts.alias("n_" + "".join(keys)))
    x = cells.join(n("a"), "a").join(n("s"), "s").join(n("a", "s"), ["a", "s"]).join(n("s", "t"), ["s", "t"]).join(n("a", "s", "t"), ["a", "s", "t"]).crossJoin(F.broadcast(cells.agg(counts.alias("n"))))
    return x, [("n_a", "n"), ("n_as", "n_s"), ("n_ast", "n_st")]


def score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed log scores of the return flag at three levels of information, by group and block.

    g: line number, b: supplier bucket of 20, w: rows, s0: pooled, s1: given status, s2: given status and month.
    """
    x, pairs = _scored(_flag_cells(spark, sf_dir), F.sum("w"))
    return x.select("g", "b", "w", *[F.ln((F.col(top) + ALPHA) / (F.col(bottom) + ALPHA * FLAGS)).alias(f"s{n}") for n, (top, bottom) in enumerate(pairs)])


def refit_scores(spark: SparkSession, sf_dir: str, smoothings: tuple[float, ...] = (ALPHA,)) -> DataFrame:
    """refit, inner (number of the smoothing) and the columns of score_cells: each refit's counts leave out the blocks of
    its remainder modulo 5. Every margin is counted once, as its total less each fifth.
    """
    less = F.array(*[F.sum("w") - F.sum(F.when(F.col("b") % REFIT_COUNT == r, F.col("w")).otherwise(0.0)) for r in range(REFIT_COUNT)])
    x, pairs = _scored(_flag_cells(spark, sf_dir), less)
    x = x.withColumn("refit", F.explode(F.sequence(F.lit(0), F.lit(REFIT_COUNT - 1)))).select("*", F.posexplode(F.array(*[F.lit(z) for z in smoothings])).alias("inner", "z"))
    at = lambda name: F.get(name, F.col("refit"))
    return x.select("refit", "inner", "g", "b", "w", *[F.ln((at(top) + F.col("z")) / (at(bottom) + F.col("z") * FLAGS)).alias(f"s{n}") for n, (top, bottom) in enumerate(pairs)])


#: SQL of score_cells: table `sc`
SCORES = """cells AS (SELECT l_linenumber AS g, CAST(l_suppkey % 20 AS INTEGER) AS b, l_returnflag AS a, l_linestatus AS s, month(l_shipdate) AS t, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
 sc AS (SELECT c.g, c.b, c.w, ln((sum(w) OVER (PARTITION BY a) + 0.5) / (sum(w) OVER () + 1.5)) AS s0,
   ln((sum(w) OVER (PARTITION BY a, s) + 0.5) / (sum(w) OVER (PARTITION BY s) + 1.5)) AS s1,
   ln((sum(w) OVER (PARTITION BY a, s, t) + 0.5) / (sum(w) OVER (PARTITION BY s, t) + 1.5)) AS s2 FROM cells c)"""


def gain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, block, gain of the richest over the pooled score, w."""
    return score_cells(spark, sf_dir).select(F.col("g").alias("grp"), F.col("b").alias("block"), (F.col("s2") - F.col("s0")).alias("gain"), "w")


def refit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refit, grp, block, num, w: five refits that each leave out a fifth of the blocks."""
    gain = (F.col("s2") - F.col("s0")) * F.col("w")
    return refit_scores(spark, sf_dir).groupBy("refit", F.col("g").alias("grp"), F.col("b").alias("block")).agg(F.sum(gain).alias("num"), F.sum("w").alias("w"))


def refit_level_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """refit, grp, level, block, num, w: the same refits, by step of the ladder."""
    rows = refit_scores(spark, sf_dir).select("refit", F.col("g").alias("grp"), F.col("b").alias("block"), "w", F.expr("stack(2, 1, s1 - s0, 2, s2 - s1) as (level, gain)"))
    return rows.groupBy("refit", "grp", "level", "block").agg(F.sum(F.col("w") * F.col("gain")).alias("num"), F.sum("w").alias("w"))


#: SQL of refit_blocks: table `rb`
REFITS = """cells AS (SELECT l_linenumber AS g, CAST(l_suppkey % 20 AS INTEGER) AS b, l_returnflag AS a, l_linestatus AS s, month(l_shipdate) AS t, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
 rr AS (SELECT c.*, r.r AS refit, CASE WHEN c.b % 5 <> r.r THEN c.w ELSE 0 END AS v FROM cells c CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS r) r),
 rs AS (SELECT refit, g, b, w, ln((sum(v) OVER (PARTITION BY refit, a, s, t) + 0.5) / (sum(v) OVER (PARTITION BY refit, s, t) + 1.5)) - ln((sum(v) OVER (PARTITION BY refit, a) + 0.5) / (sum(v) OVER (PARTITION BY refit) + 1.5)) AS gain FROM rr),
 rb AS (SELECT CAST(refit AS INTEGER) AS refit, g AS grp, b AS block, sum(w * gain) AS num, sum(w) AS w FROM rs GROUP BY refit, g, b)"""


#: SQL of refit_level_blocks: table `rl`, after the tables of REFITS
REFIT_LEVELS = f"""{REFITS}, rv AS (SELECT refit, g, b, w, ln((sum(v) OVER (PARTITION BY refit, a) + 0.5) / (sum(v) OVER (PARTITION BY refit) + 1.5)) AS s0, ln((sum(v) OVER (PARTITION BY refit, a, s) + 0.5) / (sum(v) OVER (PARTITION BY refit, s) + 1.5)) AS s1,
   ln((sum(v) OVER (PARTITION BY refit, a, s, t) + 0.5) / (sum(v) OVER (PARTITION BY refit, s, t) + 1.5)) AS s2 FROM rr),
 rl AS (SELECT CAST(refit AS INTEGER) AS refit, g AS grp, level, b AS block, sum(w * (CASE level WHEN 1 THEN s1 - s0 ELSE s2 - s1 END)) AS num, sum(w) AS w FROM rv CROSS JOIN (SELECT unnest([1, 2]) AS level) l GROUP BY refit, g, level, b)"""


#: smoothing of the inner refits of a source
INNER = (0.5, 2.0)


def source_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, inner, grp, block, num, w: five sources that each leave out a fifth of the blocks, each refit with two smoothings."""
    gain = (F.col("s2") - F.col("s0")) * F.col("w")
    return refit_scores(spark, sf_dir, INNER).groupBy(F.col("refit").alias("source"), "inner", F.col("g").alias("grp"), F.col("b").alias("block")).agg(F.sum(gain).alias("num"), F.sum("w").alias("w"))


#: SQL of source_cells with inner refits averaged in their source: table `rb`, as of REFITS
SOURCES = f"""cells AS (SELECT l_linenumber AS g, CAST(l_suppkey % 20 AS INTEGER) AS b, l_returnflag AS a, l_linestatus AS s, month(l_shipdate) AS t, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
 rr AS (SELECT c.*, r.r AS refit, i.z AS z, CASE WHEN c.b % 5 <> r.r THEN c.w ELSE 0 END AS v FROM cells c CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS r) r CROSS JOIN (SELECT unnest([{', '.join(f'CAST({z} AS DOUBLE)' for z in INNER)}]) AS z) i),
 rs AS (SELECT refit, z, g, b, w, ln((sum(v) OVER (PARTITION BY refit, z, a, s, t) + z) / (sum(v) OVER (PARTITION BY refit, z, s, t) + 3 * z)) - ln((sum(v) OVER (PARTITION BY refit, z, a) + z) / (sum(v) OVER (PARTITION BY refit, z) + 3 * z)) AS gain FROM rr),
 rb AS (SELECT CAST(refit AS INTEGER) AS refit, grp, block, avg(num) AS num, avg(w) AS w FROM (SELECT refit, z, g AS grp, b AS block, sum(w * gain) AS num, sum(w) AS w FROM rs GROUP BY refit, z, g, b) GROUP BY refit, grp, block)"""


def nation_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp (nation), stratum (region), cluster and gain of the order priority given the segment, smoothed."""
    rows = order_states(spark, sf_dir)
    joint, by_seg, by_pri = (rows.groupBy(*k).agg(F.sum("mass").alias(n)) for k, n in ((["seg", "pri"], "n_ba"), (["seg"], "n_b"), (["pri"], "n_a")))
    total = rows.agg(F.sum("mass").alias("n"))
    x = rows.groupBy("nation", "seg", "pri").agg(F.sum("mass").alias("mass")).join(joint, ["seg", "pri"]).join(by_seg, "seg").join(by_pri, "pri").crossJoin(F.broadcast(total))
    gain = F.ln((F.col("n_ba") + ALPHA) / (F.col("n_b") + ALPHA * 5)) - F.ln((F.col("n_a") + ALPHA) / (F.col("n") + ALPHA * 5))
    g = x.groupBy("nation").agg((F.sum(F.col("mass") * gain) / F.sum("mass")).alias("gain"))
    n = table(spark, sf_dir, "nation")
    return g.join(n, g.nation == n.n_nationkey).select(F.col("nation").alias("grp"), F.col("n_regionkey").alias("stratum"), (F.col("nation") % 12).alias("cluster"), "gain")


#: SQL of nation_gains: table `ng`
NATION_GAINS = """os AS (SELECT c_mktsegment AS seg, o_orderpriority AS pri, c_nationkey AS nation, count(*) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 og AS (SELECT nation, m, ln((sum(m) OVER (PARTITION BY seg, pri) + 0.5) / (sum(m) OVER (PARTITION BY seg) + 2.5)) - ln((sum(m) OVER (PARTITION BY pri) + 0.5) / (sum(m) OVER () + 2.5)) AS gain FROM os),
 ng AS (SELECT nation AS grp, n_regionkey AS stratum, nation % 12 AS cluster, sum(m * gain) / sum(m) AS gain FROM og JOIN nation ON nation = n_nationkey GROUP BY ALL)"""
