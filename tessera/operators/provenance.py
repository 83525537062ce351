"""Data-integrity audits: leakage between roles, row alignment, ledgers, hash chains, checkpoints, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import running

GENESIS = "0" * 64


def leakage(training: DataFrame, heldout: DataFrame, key: str) -> DataFrame:
    """One row: distinct shared ids, held-out rows they hold, and duplicated ids on either side (they never multiply leaks)."""
    t, h = training.select(F.col(key).alias("k")), heldout.select(F.col(key).alias("k"))
    shared = h.join(t.distinct(), "k", "left_semi")
    twice = lambda d, name: d.groupBy("k").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias(name))
    out = shared.agg(F.countDistinct("k").alias("leaked_ids"), F.count("*").alias("leaked_rows")).crossJoin(h.agg(F.count("*").alias("heldout_rows")))
    out = out.crossJoin(twice(t, "training_duplicates")).crossJoin(twice(h, "heldout_duplicates"))  # single rows
    return out.withColumn("category", F.when(F.col("leaked_ids") > 0, "leakage").otherwise("disjoint"))


def identity_gate(roles: DataFrame) -> DataFrame:
    """role, grp -> one row per group in more than one role, with the roles in order."""
    return roles.select("role", "grp").distinct().groupBy("grp").agg(F.array_sort(F.collect_set("role")).alias("roles")).filter(F.size("roles") > 1).select("grp", F.array_join("roles", ",").alias("roles"))


def row_alignment(base: DataFrame, source: DataFrame) -> DataFrame:
    """row_id, position in both -> one row: exact, reorderable or mismatch, with what is missing, extra and moved."""
    dup = base.groupBy("row_id").count().filter("count > 1").limit(1).count() + source.groupBy("row_id").count().filter("count > 1").limit(1).count()
    b, s = base.select("row_id", F.col("position").alias("bp")), source.select("row_id", F.col("position").alias("sp"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = b.join(s, "row_id", "full_outer").agg(n(F.col("sp").isNull()).alias("missing"), n(F.col("bp").isNull()).alias("extra"), n(F.col("bp") != F.col("sp")).alias("moved"))
    bad = (F.col("missing") + F.col("extra") > 0) | F.lit(dup > 0)
    return out.withColumn("alignment", F.when(bad, "mismatch").when(F.col("moved") > 0, "reorderable").otherwise("exact"))


def ledger_binding(manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """stage, digest multisets -> per stage: missing and unexpected counts and the discrepancy, the larger of both."""
    m = manifest.groupBy("stage", "digest").agg(F.count("*").alias("m"))
    d = declared.groupBy("stage", "digest").agg(F.count("*").alias("d"))
    gap = F.coalesce("m", F.lit(0)) - F.coalesce("d", F.lit(0))
    out = m.join(d, ["stage", "digest"], "full_outer").groupBy("stage").agg(F.sum(F.greatest(gap, F.lit(0))).cast("long").alias("missing"), F.sum(F.greatest(-gap, F.lit(0))).cast("long").alias("unexpected"))
    return out.withColumn("discrepancy", F.greatest("missing", "unexpected"))


def canonical_event(*names: str):
    """Compact JSON of the named columns with sorted keys, as text."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def chain_audit(log: DataFrame, fields: tuple[str, ...], index: str = "sequence_index", previous: str = "previous_event_hash", own: str = "event_hash", chain: str = "chain") -> DataFrame:
    """Per chain: events, and how many break the index, the link to the event before, or their own hash."""
    log = running(log, [chain], [index], {"__before": ("lag", F.col(own)), "__nth": ("count", F.lit(1))})
    expected = F.coalesce("__before", F.lit(GENESIS))
    rows = log.select(chain, (F.col(index) != F.col("__nth") - 1).alias("gap"), (F.col(previous) != expected).alias("unlinked"), (F.col(own) != F.sha2(canonical_event(*fields, previous), 256)).alias("forged"))
    n = lambda c: F.sum(F.col(c).cast("long"))
    return rows.groupBy(chain).agg(F.count("*").alias("events"), n("gap").alias("index_gaps"), n("unlinked").alias("broken_links"), n("forged").alias("bad_hashes"))


def checkpoint_audit(log: DataFrame, checkpoints: DataFrame, chain: str = "chain") -> DataFrame:
    """Per chain: checkpoints, those whose hash differs, those out of order, and whether the last event is covered."""
    by = Window.partitionBy(chain).orderBy("position")
    marks = checkpoints.select(chain, "event_index", "event_hash", F.coalesce(F.col("event_index") <= F.lag("event_index").over(by), F.lit(False)).alias("backward"))
    events = log.select(F.col(chain).alias("e_chain"), F.col("sequence_index"), F.col("event_hash").alias("true_hash"))
    last = log.groupBy(chain).agg(F.max("sequence_index").alias("terminal"))
    joined = marks.join(events, (F.col(chain) == F.col("e_chain")) & (F.col("event_index") == F.col("sequence_index")), "left").join(last, chain)
    n = lambda c: F.sum(c.cast("long"))
    return joined.groupBy(chain).agg(F.count("*").alias("checkpoints"), n(~F.coalesce(F.col("true_hash") == F.col("event_hash"), F.lit(False))).alias("mismatched"), n(F.col("backward")).alias("out_of_order"), F.max(F.col("event_index") == F.col("terminal")).alias("terminal_covered"))


def fingerprint(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def blob_id(data: bytes) -> str:
    """The id git gives to a file's bytes."""
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
