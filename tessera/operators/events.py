"""Event-table preparation: reasons for rejection, thinning, hashed splits and folds, grids, intervals, gaps, permutation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.scan import running

#: Rows of a site up to which one task permutes it, in some 100 bytes each; draws at a time.
SITE_ROWS, BATCH = 4_000_000, 25


def with_reason(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows with the first rule in order that rejects them, null if none does; a rule that is null rejects nothing."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(rules)):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def first_per_bin(rows: DataFrame, key: str, ts: str, id_: str, seconds: int) -> DataFrame:
    """The earliest event of each key and time bin (least id among equals)."""
    bins = rows.withColumn("bin", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)))
    return bins.groupBy(key, "bin").agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(id_).alias("id"))).alias("e")).select(key, "bin", F.col("e.id").alias(id_), F.col("e.ts").alias(ts))


def hash_rank(groups: DataFrame, group: str, label: str, by: str | None = None) -> DataFrame:
    """Groups with their rank in the order of SHA-256 of `label|group`, within a stratum if given."""
    key = F.sha2(F.concat_ws("|", F.lit(label), F.col(group).cast("string")), 256)
    order = Window.partitionBy(*([by] if by else [])).orderBy(key, group)
    return groups.withColumns({"rank": F.row_number().over(order) - 1, "in_stratum": F.count("*").over(Window.partitionBy(*([by] if by else [])))})


def hash_split(groups: DataFrame, group: str, stratum: str, label: str, heldout: float) -> DataFrame:
    """role of each group: the first floor(n x heldout) of its stratum by hash rank are held out."""
    ranked = hash_rank(groups.select(group, stratum).distinct(), group, label, stratum)
    return ranked.select(group, stratum, F.when(F.col("rank") < F.floor(F.col("in_stratum") * heldout), "heldout").otherwise("training").alias("role"))


def hash_folds(groups: DataFrame, group: str, stratum: str, label: str, folds: int) -> DataFrame:
    ranked = hash_rank(groups.select(group, stratum).distinct(), group, label, stratum)
    return ranked.select(group, stratum, (F.col("rank") % folds).cast("int").alias("fold"))


def admission(rows: DataFrame, group: str, stratum: str, state: str, min_rows: int, min_states: int, min_groups: int) -> DataFrame:
    """Groups with enough rows and states, in strata with enough such groups."""
    per_group = rows.groupBy(stratum, group).agg(F.count("*").alias("n_rows"), F.countDistinct(state).alias("n_states")).filter((F.col("n_rows") >= min_rows) & (F.col("n_states") >= min_states))
    strata = per_group.groupBy(stratum).agg(F.count("*").alias("n_groups")).filter(F.col("n_groups") >= min_groups)
    return per_group.join(strata, stratum)


def grid_cells(rows: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """Occupied cells of a square grid with their number of rows."""
    return rows.groupBy(F.floor(x / size).alias("cell_x"), F.floor(y / size).alias("cell_y")).agg(F.count("*").alias("n"))


def coalesced(intervals: DataFrame, key: str, start: str, end: str, slack_days: int = 1) -> DataFrame:
    """Intervals of dates merged where the next starts at most slack_days after all before ended; inclusive days."""
    marked = running(intervals.select(key, start, end), [key], [start, end], {"reach": ("max", F.col(end))}, inclusive=False)
    marked = marked.select(key, start, end, F.coalesce((F.datediff(F.col(start), "reach") > slack_days).cast("int"), F.lit(1)).alias("new"))
    merged = running(marked, [key], [start, end], {"island": ("sum", F.col("new"))}).groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end))
    return merged.select(key, start, end, (F.datediff(F.col(end), F.col(start)) + 1).cast("long").alias("days"))


def gap_bins(rows: DataFrame, key: str, ts: str, edges: Sequence[float]) -> DataFrame:
    """Gaps between consecutive events of a key, in seconds, counted by bin (from each edge up to the next)."""
    stamped = rows.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    rows = running(stamped, [key], ["us"], {"before": ("lag", F.col("us"))})
    gap = (F.col("us") - F.col("before")) / 1_000_000.0
    label = F.lit(0)
    for n, edge in enumerate(edges, 1):
        label = F.when(F.col("gap") >= edge, n).otherwise(label)
    return rows.select(gap.alias("gap")).filter("gap is not null").groupBy(label.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


def rolling_thin(rows: DataFrame, key: str, ts: str, id_: str, seconds: float) -> DataFrame:
    """Events at least so many seconds after the last kept one of their key.

    The rule is a fold, not a window: events are cut into chains wherever the gap to the event before is long enough that
    the event is kept whatever came before. Chains are dealt to tasks and sorted there; a task carries one time from row
    to row, so that chains of any length need no memory. Events without a time are left out.
    """
    micros = int(seconds * 1_000_000)
    stamped = rows.filter(F.col(ts).isNotNull()).select(key, id_, F.col(ts).cast("timestamp").alias(ts)).withColumn("us", F.unix_micros(ts))
    cut = F.coalesce((F.col("us") - F.col("before") >= micros).cast("int"), F.lit(1))
    gaps = running(stamped, [key], ["us", id_], {"before": ("lag", F.col("us"))}).withColumn("cut", cut).drop("before")
    chains = running(gaps, [key], ["us", id_], {"chain": ("sum", F.col("cut"))})
    sorted_ = chains.repartition(key, "chain").sortWithinPartitions(key, "chain", "us", id_).select(key, id_, ts, "us", "cut")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            for i, (us, cut) in enumerate(zip(batch.column("us").to_pylist(), batch.column("cut").to_pylist(), strict=True)):
                # the first row of a chain always has its cut
                if cut or us - last >= micros:
                    last, kept[i] = us, True
            yield batch.filter(pa.array(kept)).select([0, 1, 2])

    return sorted_.mapInArrow(keep, sorted_.select(key, id_, ts).schema)


def _order(head: bytes, ids: np.ndarray) -> np.ndarray:
    """Places of the ids, which are sorted, in the order of the MD5 of head and id."""
    keys = np.empty((len(ids), 2), np.uint64)
    for k in range(0, len(ids), 65_536):
        keys[k : k + 65_536] = np.frombuffer(b"".join([md5(head + i).digest() for i in ids[k : k + 65_536].tolist()]), ">u8").reshape(-1, 2)
    order = np.argsort(keys[:, 0])
    high = keys[order, 0]
    if (high[1:] == high[:-1]).any():  # half of a digest settles nearly every order
        order = np.lexsort((keys[:, 1], keys[:, 0]))
    return order


def permutation_counts(cells: DataFrame, site: str, identity: str, state: str, draws: int, label: str, site_rows: int = SITE_ROWS, batch: int = BATCH) -> DataFrame:
    """draw, identity, state, n: how often they meet when identities are permuted within sites; draw -1 is as observed.

    A draw orders a site's rows once by id and once by the MD5 of label, draw and id, and gives each row of the first
    order the identity of equal rank in the second. A site's rows meet once for each batch of draws, so that few large
    sites are many tasks too, and only counts go on. Sites of more than site_rows rows, which one task should not hold,
    are ordered by Spark, a batch of draws at a time.
    """
    sizes = cells.groupBy(F.col(site).alias("__of")).agg(F.count("*").alias("__n"))
    known = cells.join(F.broadcast(sizes), F.col(site).eqNullSafe(F.col("__of"))).select(site, F.col(identity).alias("identity"), F.col(state).alias("state"), "id", "__n")
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    schema = f"draw int, identity {kinds['identity']}, state {kinds['state']}, n long"

    def permuted(rows: pa.Table) -> pa.Table:
        first = rows["__first"][0].as_py()
        rows = rows.select(["id", "identity", "state"]).combine_chunks().sort_by("id")
        who, what = (rows[c].combine_chunks().dictionary_encode("encode") for c in ("identity", "state"))
        mine, width = who.indices.to_numpy().astype(np.int32), len(what.dictionary)
        theirs = what.indices.to_numpy().astype(np.int32)
        ids = rows["id"].to_numpy()
        ids = ids.astype("S20") if ids.dtype.kind in "iu" else np.array([str(i).encode() for i in ids], object)
        del rows
        out = []
        for draw in range(first, min(first + batch, draws)):
            mixed = mine if draw < 0 else mine[_order(f"{label}|{draw}|".encode(), ids)]
            count = np.bincount(mixed * width + theirs, minlength=len(who.dictionary) * width)
            hit = np.flatnonzero(count)
            names, states = who.dictionary.take(pa.array(hit // width)), what.dictionary.take(pa.array(hit % width))
            out.append(pa.table({"draw": np.full(len(hit), draw, np.int32), "identity": names, "state": states, "n": count[hit].astype(np.int64)}))
        return pa.concat_tables(out)

    # a site stands for all of its rows: they are grouped by it, null sites too
    small = known.filter(F.col("__n") <= site_rows).drop("__n").withColumn("__first", F.explode(F.sequence(F.lit(-1), F.lit(max(draws - 1, -1)), F.lit(batch))))
    # by number: adaptive execution would put these few rows, and all the work on them, into a few tasks
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = small.repartition(tasks, site, "__first").groupBy(site, "__first").applyInArrow(permuted, schema)
    large = known.filter(F.col("__n") > site_rows)
    if large.limit(1).count():
        found = found.unionByName(large.groupBy("identity", "state").agg(F.count("*").alias("n")).select(F.lit(-1).alias("draw"), "identity", "state", "n"))
        plain = large.select(site, F.col("state").alias("p_state"), F.row_number().over(Window.partitionBy(site).orderBy("id")).alias("rank"))
        key = F.md5(F.concat_ws("|", F.lit(label), F.col("draw").cast("string"), F.col("id").cast("string")).cast("binary"))
        for first in range(0, draws, batch):
            spread = large.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(min(first + batch, draws) - 1))))
            mixed = spread.select(F.col(site).alias("__site"), "draw", "identity", F.row_number().over(Window.partitionBy(site, "draw").orderBy(key, "id")).alias("__rank"))
            met = plain.join(mixed, F.col(site).eqNullSafe(F.col("__site")) & (F.col("rank") == F.col("__rank")))
            found = found.unionByName(met.groupBy("draw", "identity", F.col("p_state").alias("state")).agg(F.count("*").alias("n")))
    return found.groupBy("draw", "identity", "state").agg(F.sum("n").alias("n"))


def permutation_null(cells: DataFrame, site: str, identity: str, state: str, draws: int, label: str, site_rows: int = SITE_ROWS, batch: int = BATCH) -> DataFrame:
    """Mutual information of identity and state, and its p value when identities are permuted within sites.

    cells: one row per event with row id `id`; p = (1 + draws at least as high) / (1 + draws).
    """
    joint = cut(permutation_counts(cells, site, identity, state, draws, label, site_rows, batch))  # read by all draws and by the observed one
    over = lambda *by: Window.partitionBy("draw", *by)  # noqa: E731  draws x identities x states
    parts = joint.select("draw", F.col("n").cast("double").alias("n"), F.sum("n").over(over("identity")).alias("na"), F.sum("n").over(over("state")).alias("nb"), F.sum("n").over(over()).alias("nt"))
    found = parts.groupBy("draw").agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("na") * F.col("nb")))).alias("information"))
    seen = found.filter("draw = -1").select(F.col("information").alias("observed"))
    rows = found.filter("draw >= 0").crossJoin(F.broadcast(seen))  # one row
    high = F.sum((F.col("information") >= F.col("observed") - 1e-12).cast("int"))
    return rows.agg(F.first("observed").alias("observed"), F.avg("information").alias("null_mean"), ((1 + high) / (1 + F.count("*"))).alias("p_value"))
