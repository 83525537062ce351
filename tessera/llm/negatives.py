"""Hard negatives by exact search with pruning on rotated vectors.

Components are scaled and floored to integers, and the score of two rows is their integer inner product. The second
moment of all rows, summed by partitions, gives an orthogonal rotation on to principal components, of which the leading
ones hold most of each vector. In a cell of anchors and rows, products of leading components are accumulated in single
precision; what is left of a score is at most the product of the residual norms, and rounding is covered by a slack that
grows with both norms. Pairs that cannot reach an anchor's range are discarded early, survivors go on to the next
components, and those of the last stage are verified by integer products. Any orthogonal matrix gives the same rows; the
rotation only decides how early pairs go.

Two searches follow each other: the best rows of the anchor's own label (positives), then, for each positive, the best
rows of other labels whose score lies in a share of the positive's. Rows are dealt evenly to groups of bounded size, and
anchors too; a cell is one group of each. Groups are searched in rounds, each of GROWTH times as many groups as all
before it: a round knows each anchor's last good score from the rounds before and so gives back only what may still
enter. After g groups that is about as many rows for each anchor as a round's growth times the size asked for, however
many groups follow. All rows are searched; the work is that of the stated anchors against all rows, in blocks.

Bounds: the rotation is a square matrix of the longest vector's length, computed on the driver and sent with the tasks.
A group has at most GROUP rows and about CELLS components.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; nor do rows whose
integer vector has a squared norm of 2**62 or more, since scores must fit 64 bits; shorter vectors count as filled up
with zeros; repeated ids are rows of their own; a null id is never an anchor and comes last among ties; anchors without
positives, and positives without negatives, give no rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.staging import staged

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
SHARE = (3, 9)  # tenths of the positive's score that a negative's must lie between
GROUP, CELLS, TILE = 8192, 1 << 19, 1 << 21
GROWTH = 16
RESIDUES = (0.25, 0.05)  # shares of the rows' energy that the stages leave to later components
POS_BITS = 16  # of a row's key: its place in its group
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PACK = "grp long, n int, ids binary, known binary, labels binary, vecs binary"
FOUND = "key long, slot int, score long, vec_id long"


def integer_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether the id is known, labels, int32 vectors of dim components) of the rows that take part."""
    ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
    n = batch.num_rows
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()  # without what null lists may hide
    gaps = flat.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        value = np.floor(SCALE * flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(n), size)
    wide = np.zeros((n, dim))
    wide[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = value
    bad = np.zeros(n, bool)
    bad[row[gaps | ~np.isfinite(value)]] = True
    with np.errstate(all="ignore"):
        bad |= ~(np.einsum("ij,ij->i", wide, wide) < 2.0**62)
    ok = ~bad & lists.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[ok], known[ok], labels.fill_null(0).to_numpy(zero_copy_only=False)[ok], wide[ok].astype(np.int32)


def packed_rows(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows in groups of bounded size (PACK), written once; the length of their vectors and the number of group numbers.

    Rows are dealt evenly, so that the first groups are a fair sample of all.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    dim = max(1, facts["dim"] or 1)
    height = int(np.clip(CELLS // dim, 64, GROUP))
    parts = max(1, min(-(-facts["n"] // height), 8192))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId()

        def block(columns: list[np.ndarray]) -> pa.RecordBatch:
            cells = [pa.array([number]), pa.array([len(columns[0])], pa.int32()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]]
            return pa.RecordBatch.from_arrays(cells, names=["grp", "n", "ids", "known", "labels", "vecs"])

        for batch in batches:
            step = max(1, CELLS // dim)
            for at in range(0, batch.num_rows, step):
                held.append(integer_rows(batch.slice(at, step), dim))
                while sum(len(h[0]) for h in held) >= height:
                    whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                    yield block([c[:height] for c in whole])
                    held, number = [tuple(c[height:] for c in whole)], number + parts
        rest = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [[]]
        if len(rest[0]):
            yield block(rest)

    packed = staged(rows.repartition(parts).mapInArrow(pack, PACK), "vectors")
    last = packed.agg(F.max("grp")).first()[0]
    return packed, dim, 0 if last is None else last + 1


def _vectors(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.int32).reshape(n, -1)


def rotation(packed: DataFrame, dim: int) -> tuple[np.ndarray, list[int]]:
    """The orthogonal matrix on to principal components, largest first, and the components at which the stages end."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _vectors(memoryview(blob.as_buffer()), n).astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})

    total = np.zeros((dim, dim))
    for row in packed.select("n", "vecs").mapInArrow(moments, "i long, sums array<double>").groupBy("i").applyInPandas(added, "i long, sums array<double>").collect():
        total[row["i"]] = row["sums"]
    energy, axes = np.linalg.eigh((total + total.T) / 2)
    energy, axes = np.maximum(energy[::-1], 0), axes[:, ::-1]
    left = 1 - np.cumsum(energy) / max(energy.sum(), 1e-300)
    return axes, sorted({min(dim, int(np.searchsorted(-left, -share)) + 1) for share in RESIDUES} | {dim})


class Side:
    """Rows of one side of a cell: integers, rotated components, and the norm of what each stage leaves."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray, stages: list[int]):
        self.whole = vectors
        turned = vectors.astype(np.float64) @ axes
        square = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt(square[:, 0]).astype(np.float32)
        self.rest = [np.sqrt(square[:, k]).astype(np.float32) if k < turned.shape[1] else np.zeros(len(turned), np.float32) for k in stages]
        self.turned = turned.astype(np.float32)


def survivors(a: Side, b: Side, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, stages: list[int], best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) among the allowed whose integer score lies in [low[i], high[i]], and that score.

    best: where low is unknown (LEAST), each i needs its so many best only, and the lower bounds of the first stage give a low.
    """
    slack = np.float32((a.turned.shape[1] + 16) * 2.0**-21)
    sum_, done = np.zeros(allowed.shape, np.float32), 0
    room = np.outer(a.norm, b.norm) * slack + np.float32(1)
    floor, ceiling = low.astype(np.float32), high.astype(np.float32)
    floor, ceiling = floor - np.abs(floor) * np.float32(2.0**-22), ceiling + np.abs(ceiling) * np.float32(2.0**-22)
    ok = allowed
    for stage, k in enumerate(stages):  # while many pairs are left, all of them by matrix products
        sum_ += a.turned[:, done:k] @ b.turned[:, done:k].T
        done = k
        reach = np.outer(a.rest[stage], b.rest[stage]) * np.float32(1 + 2.0**-20) + room
        if best and allowed.shape[1] > best:
            bound = np.where(allowed, sum_ - reach, np.float32(-np.inf))
            kth = np.partition(bound, -best, axis=1)[:, -best]
            floor = np.maximum(floor, kth - np.abs(kth) * np.float32(2.0**-22))
        ok = allowed & (sum_ + reach >= floor[:, None]) & (sum_ - reach <= ceiling[:, None])
        if ok.sum() * 8 <= ok.size:
            break
    i, j = np.nonzero(ok)
    kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 22) // a.turned.shape[1])
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        part, begin = sum_[x, y], done
        for more in range(stage + 1, len(stages)):
            part = part + np.einsum("ij,ij->i", a.turned[x, begin : stages[more]], b.turned[y, begin : stages[more]])
            begin = stages[more]
            reach = a.rest[more][x] * b.rest[more][y] * np.float32(1 + 2.0**-20) + room[x, y]
            good = (part + reach >= floor[x]) & (part - reach <= ceiling[x])
            x, y, part = x[good], y[good], part[good]
        score = np.einsum("ij,ij->i", a.whole[x].astype(np.int64), b.whole[y].astype(np.int64))
        good = (score >= low[x]) & (score <= high[x])
        for out, values in zip(kept, (x, y, score), strict=True):
            out.append(values[good])
    return tuple(np.concatenate(x) for x in kept)


def _cell(size: int, same: bool, axes: np.ndarray, stages: list[int]) -> Callable:
    """What one group of rows gives to one group of anchors: the best rows in each range."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for held in anchors.to_pylist():
            keys, label = np.frombuffer(held["keys"], np.int64), np.frombuffer(held["labels"], np.int64)
            low, high = (np.frombuffer(held[c], np.int64).reshape(len(keys), -1) for c in ("low", "high"))
            vectors = _vectors(held["vecs"], len(keys))
            for block in rows.to_pylist():
                ids, known, other = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["known"], bool), np.frombuffer(block["labels"], np.int64)
                b = Side(_vectors(block["vecs"], block["n"]), axes, stages)
                own = (block["grp"] << POS_BITS) + np.arange(block["n"])
                step = max(1, TILE // max(1, block["n"]))
                for at in range(0, len(keys), step):
                    to = slice(at, at + step)
                    least, most = low[to].min(axis=1), high[to].max(axis=1)
                    allowed = ((label[to, None] == other[None]) == same) & (keys[to, None] != own[None]) & (least <= most)[:, None]
                    i, j, score = survivors(Side(vectors[to], axes, stages), b, least, most, allowed, stages, size if same else 0)
                    for slot in range(low.shape[1]):
                        good = (score >= low[to][i, slot]) & (score <= high[to][i, slot])
                        x, y, s = i[good], j[good], score[good]
                        ranked = np.lexsort((ids[y], ~known[y], -s, x))
                        x, y, s = x[ranked], y[ranked], s[ranked]
                        first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
                        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
                        top = rank < size
                        out.append((keys[to][x[top]], np.full(int(top.sum()), slot, np.int32), s[top], ids[y[top]], ~known[y[top]]))
        key, slot, score, vec, hidden = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, bool))
        return pa.table({"key": key, "slot": slot, "score": score, "vec_id": pa.array(vec, mask=hidden)})

    return search


def _packed_anchors(rows: pa.Table) -> pa.Table:
    flat = {c: rows.column(c).combine_chunks() for c in ("key", "label", "low", "high", "vec")}
    blobs = {c: flat[c].to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("key", "label")} | {c: flat[c].flatten().to_numpy().tobytes() for c in ("low", "high")}
    return pa.table({
        "agrp": rows.column("agrp").slice(0, 1), "keys": pa.array([blobs["key"]], pa.binary()), "labels": pa.array([blobs["label"]], pa.binary()), "vecs": pa.array([b"".join(flat["vec"].to_pylist())], pa.binary()),
        "low": pa.array([blobs["low"]], pa.binary()), "high": pa.array([blobs["high"]], pa.binary()),
    })


def best_in_ranges(packed: DataFrame, groups: int, anchors: DataFrame, anchor_groups: int, size: int, same: bool, axes: np.ndarray, stages: list[int]) -> DataFrame:
    """key, slot, score, vec_id, rank: of all rows with the anchor's label (or, if not same, another), the first `size` in each range.

    anchors: key, agrp, label, vec, low and high (arrays: the ranges, one for each slot).
    """
    best = packed.sparkSession.createDataFrame([], FOUND)
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    begin, end, name = 0, 1, "positives" if same else "negatives"
    while begin < groups:
        full = best.groupBy("key", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == size)
        known = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("known"))  # one entry for each slot
        tight = F.transform("low", lambda x, slot: F.greatest(x, F.coalesce(F.element_at("known", slot), F.lit(LEAST))))
        now = anchors.join(known, "key", "left").select("key", "agrp", "label", "vec", tight.alias("low"), "high")
        now = now.groupBy("agrp").applyInArrow(_packed_anchors, "agrp int, keys binary, labels binary, vecs binary, low binary, high binary")
        cells = packed.filter(F.col("grp").between(begin, end - 1)).withColumn("agrp", F.explode(F.sequence(F.lit(0), F.lit(anchor_groups - 1))))
        asked = now.withColumn("grp", F.explode(F.sequence(F.lit(begin).cast("long"), F.lit(min(end, groups) - 1).cast("long"))))
        found = cells.groupBy("grp", "agrp").cogroup(asked.groupBy("grp", "agrp")).applyInArrow(_cell(size, same, axes, stages), FOUND)
        ranked = best.unionByName(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
        best = staged(ranked.drop("rank"), name)
        begin, end = end, end * GROWTH
    return best.withColumn("rank", F.row_number().over(order))


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding. Anchors are the rows whose vec_id is divisible by every; share: the tenths of the
    positive's score between which those of its negatives lie.
    """
    packed, dim, groups = packed_rows(rows)
    axes, stages = rotation(packed, dim)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                ids, known, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["known"], bool), np.frombuffer(block["labels"], np.int64)
                vectors, at = _vectors(block["vecs"], block["n"]), np.flatnonzero(known & (ids % every == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((block["grp"] << POS_BITS) + at), pa.array(ids[at]), pa.array(labels[at]), pa.array([v.tobytes() for v in vectors[at]], pa.binary())], names=["key", "anchor_id", "label", "vec"]
                )

    picked = staged(packed.mapInArrow(pick, "key long, anchor_id long, label long, vec binary"), "anchors")
    anchor_groups = max(1, -(-picked.count() // int(np.clip(CELLS // dim, 64, GROUP))))
    picked = picked.withColumn("agrp", F.pmod(F.xxhash64("key"), F.lit(anchor_groups)).cast("int"))

    wanted = picked.select("*", F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high"))
    near = staged(best_in_ranges(packed, groups, wanted, anchor_groups, positives, True, axes, stages), "positives")

    tens, units = F.expr("(score - pmod(score, 10)) div 10"), F.expr("pmod(score, 10)")  # products of the parts stay within 64 bits
    least, most = tens * share[0] + F.ceil(units * share[0] / 10), tens * share[1] + F.floor(units * share[1] / 10)
    ranges = near.select("key", F.struct(F.col("rank").alias("rank"), least.cast("long").alias("low"), most.cast("long").alias("high")).alias("range")).groupBy("key").agg(F.array_sort(F.collect_list("range")).alias("r"))  # at most `positives` entries
    slots = F.sequence(F.lit(0), F.lit(positives - 1))
    wanted = picked.join(ranges, "key").select(
        "key", "agrp", "label", "vec",
        F.transform(slots, lambda k: F.coalesce(F.get("r", k)["low"], F.lit(MOST))).alias("low"), F.transform(slots, lambda k: F.coalesce(F.get("r", k)["high"], F.lit(LEAST))).alias("high"),
    )
    far = best_in_ranges(packed, groups, wanted, anchor_groups, negatives, False, axes, stages)
    return (
        far.select("key", F.col("slot").alias("s"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near.select("key", (F.col("rank") - 1).alias("s"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "s"])
        .join(picked.select("key", "anchor_id"), "key")
        .select("anchor_id", "positive_id", (F.col("s") + 1).alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score")
    )
