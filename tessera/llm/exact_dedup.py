"""Exact dedup over a sharded cuckoo-filter index of text digests.

The index is two tables. `filters` has one row per shard: 16-bit fingerprints, four cells a bucket. `content` has a row for
each live digest, bucketed by shard and 64-bit key: the full SHA-256 digest, the number of its copies and the row that
stays. Inserting digests asks the filters alone, which only get keys; a key that misses is new, enters its filter and is
appended to the content unread. Only the keys that hit are joined to the content, and their full digests tell copies from
chance hits, which then enter the filter as well. A filter that overflows is rebuilt at twice the size from the stored
keys of its shard. Deleting withdraws live digests, verified in the same way, from filters and content. When an index
outgrows its shards, it is dealt to twice as many. Copies are folded inside every input task before the shuffle, so that a
hot text arrives as a few rows.

Defined cases: null text counts as empty; null doc_id ranks below every number and is kept only among null ids; of
repeated rows of one doc_id and text the last in file order stays; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.staging import numbered, shuffle_width, staged

CELLS, MAX_KICKS = 4, 256
DIGESTS_PER_SHARD, FOLD_ROWS = 50_000, 200_000
CHANGES = "shard int, key long, digest binary, copies long, keep_id long, keep_row long"
FILTERS = "shard int, size long, cells binary"
ENTERED = "shard int, key long, hit boolean, there boolean, size long, cells binary, full boolean"


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit keys with 16-bit fingerprints; buckets is a power of two."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, CELLS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(-1, CELLS).copy()
        self._turn = 0

    @classmethod
    def sized_for(cls, keys: int) -> CuckooFilter:
        return cls(max(8, 1 << int(keys / (0.8 * CELLS)).bit_length()))

    def _place(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) or 1
        first = key & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 + 1) & (self.buckets - 1))

    def contains(self, key: int) -> bool:
        mark, a, b = self._place(key)
        return bool((self.cells[a] == mark).any() or (self.cells[b] == mark).any())

    def contains_many(self, keys: np.ndarray) -> np.ndarray:
        marks = np.maximum(keys >> np.uint64(48), np.uint64(1))
        a = keys & np.uint64(self.buckets - 1)
        b = a ^ ((marks * np.uint64(0x5BD1E995) + np.uint64(1)) & np.uint64(self.buckets - 1))
        return ((self.cells[a.astype(np.int64)] == marks[:, None]) | (self.cells[b.astype(np.int64)] == marks[:, None])).any(axis=1)

    def insert(self, key: int) -> bool:
        """False if the filter overflows; it must then be rebuilt from the stored keys."""
        mark, a, b = self._place(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        bucket = a
        for _ in range(MAX_KICKS):
            self._turn = (self._turn + 1) % CELLS
            mark, self.cells[bucket, self._turn] = int(self.cells[bucket, self._turn]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        mark, a, b = self._place(key)
        for bucket in (a, b):
            there = np.flatnonzero(self.cells[bucket] == mark)
            if len(there):
                self.cells[bucket, there[0]] = 0
                return True
        return False


@dataclass(frozen=True)
class Index:
    """filters: shard, size, cells; content: shard, key, digest, copies, keep_id, keep_row."""

    filters: DataFrame
    content: DataFrame
    shards: int


def digests(docs: DataFrame, row_no: Column | None = None) -> DataFrame:
    """doc_id, row_no and the 32-byte SHA-256 digest of each text, written once: later steps never read text again.

    row_no: the rows' numbers where they have some already; otherwise rows are numbered here.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.monotonically_increasing_id() if row_no is None else row_no).alias("row_no"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
    )
    return staged(narrow, "digests")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest of up to FOLD_ROWS rows: its copies and the greatest (doc_id, row_no)."""

    def fold(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        codes, found = pd.factorize(table["digest"].to_pandas())
        known, row_no = table["doc_id"].is_valid().to_numpy(), table["row_no"].to_numpy()
        ids = table["doc_id"].fill_null(0).to_numpy()
        last = np.zeros(len(found), np.int64)
        order = np.lexsort((row_no, ids, known))
        last[codes[order]] = order  # of a digest's rows the greatest comes last
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(np.bincount(codes, minlength=len(found)), pa.int64()), pa.array(ids[last], mask=~known[last]), pa.array(row_no[last])], names=["digest", "copies", "keep_id", "keep_row"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= FOLD_ROWS:
            yield fold(held)
            held = []
    if sum(x.num_rows for x in held):
        yield fold(held)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(shards)).cast("int")


def _changes(keyed: DataFrame, shards: int) -> DataFrame:
    folded = keyed.select("digest", "doc_id", "row_no").mapInArrow(_fold, "digest binary, copies long, keep_id long, keep_row long")
    return staged(folded.select(_shard(shards).alias("shard"), F.xxhash64("digest").alias("key"), "digest", "copies", "keep_id", "keep_row"), "changes")


def _enter(probe: bool):
    """Puts a shard's keys into its filter; the other side holds the filter's cells, or the stored keys to build it from.

    Gives the filter's row and one row for each distinct key: hit says that it may be there already or comes twice, there
    that it was not put in. full: the cells overflowed, and stored keys are wanted. Without probe all keys are new.
    """

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        shard = int((new if len(new) else old)["shard"].iloc[0])
        keys, times = np.unique(new["key"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        cells = next((bytes(c) for c in old["cells"] if c is not None), None)
        stored = old["key"].to_numpy(np.int64).view(np.uint64).tolist() if cells is None and len(old) else []
        buckets = CuckooFilter.sized_for(2 * len(stored) + len(keys)).buckets
        while True:
            held = CuckooFilter(buckets) if cells is None else CuckooFilter(len(cells) // (2 * CELLS), cells)
            size, full = (len(stored) if cells is None else int(old["size"].iloc[0])), not all(map(held.insert, stored))
            there = held.contains_many(keys) if probe and len(keys) else np.zeros(len(keys), bool)
            for i in np.flatnonzero(~there).tolist():
                there[i] = probe and held.contains(int(keys[i]))  # the fingerprint of a key that has just come in
                if not there[i]:
                    full, size = full or not held.insert(int(keys[i])), size + 1
                if full:
                    break
            if not full or cells is not None:
                break
            buckets *= 2
        out = pd.DataFrame({"key": keys.view(np.int64), "hit": there | (times > 1), "there": there, "size": 0, "cells": None, "full": False})
        mark = pd.DataFrame({"key": [0], "hit": [False], "there": [False], "size": [size], "cells": [held.cells.tobytes()], "full": [full]})
        out = pd.concat([mark, out], ignore_index=True) if len(out) else mark
        return out.assign(shard=shard)[["shard", "key", "hit", "there", "size", "cells", "full"]]

    return run


def _entered(keys: DataFrame, index: Index, probe: bool) -> tuple[DataFrame, DataFrame]:
    """(keys: shard, key, hit, there; filters) after keys (shard, key) went into the filters, rebuilt where they overflow."""

    def meet(new: DataFrame, old: DataFrame) -> DataFrame:
        return staged(new.select("shard", "key").groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(_enter(probe), ENTERED), "entered")

    none = F.lit(None)
    out = meet(keys, index.filters.select("shard", F.lit(0).cast("long").alias("key"), "size", "cells"))
    full = out.filter("full").select("shard")
    if full.limit(1).count():
        stored = index.content.join(full, "shard", "left_semi").select("shard", "key", none.cast("long").alias("size"), none.cast("binary").alias("cells"))
        out = out.join(full, "shard", "left_anti").unionByName(meet(keys.join(full, "shard", "left_semi"), stored))
    return out.filter("cells is null").select("shard", "key", "hit", "there"), out.filter("cells is not null").select("shard", "size", "cells")


def empty_index(spark: SparkSession, shards: int) -> Index:
    return Index(spark.createDataFrame([], FILTERS), spark.createDataFrame([], CHANGES), shards)


def dealt(index: Index, shards: int) -> Index:
    """The same index in so many shards; the filters are built again from the stored keys."""
    content = staged(index.content.withColumn("shard", _shard(shards)), "content")
    return Index(_entered(content, empty_index(content.sparkSession, shards), False)[1], content, shards)


def verified(index: Index, hits: DataFrame) -> DataFrame:
    """The content rows that hits (shard, key) have to be verified against; no others are read."""
    return index.content.join(hits.select("shard", "key").distinct(), ["shard", "key"], "left_semi").select(*index.content.columns)


def insert(index: Index, keyed: DataFrame, digests_per_shard: int = DIGESTS_PER_SHARD) -> Index:
    """The index with the digests of keyed (see digests()) added, in more shards if it outgrows its own."""
    live = index.filters.agg(F.sum("size")).first()[0] or 0
    wanted = -(-(live + keyed.count()) // digests_per_shard)
    if wanted > index.shards:
        wanted = max(wanted, 2 * index.shards)
        index = dealt(index, wanted) if live else empty_index(keyed.sparkSession, wanted)
    changes = _changes(keyed, index.shards)
    keys, filters = _entered(changes, index, True)
    hits, columns, at_key = keys.filter("hit"), index.content.columns, ["shard", "key"]
    both = verified(index, hits).withColumn("stored", F.lit(True)).unionByName(changes.join(hits, at_key, "left_semi").withColumn("stored", F.lit(False)))
    keep = F.max(F.struct(F.col("keep_id").isNotNull().alias("known"), "keep_id", "keep_row")).alias("keep")
    merged = both.groupBy("shard", "key", "digest").agg(F.sum("copies").alias("copies"), keep, F.max("stored").alias("stored"))
    merged = staged(merged.select("shard", "key", "digest", "copies", "keep.keep_id", "keep.keep_row", "stored"), "verified")
    untouched = index.content.unionByName(changes).join(hits, at_key, "left_anti")
    content = staged(untouched.select(*columns).unionByName(merged.select(*columns)), "content")
    late = merged.filter(~F.col("stored")).join(hits.filter("there"), at_key, "left_semi")  # hits by chance: new after all
    if late.limit(1).count():
        filters = _entered(late, Index(filters, content.join(late, at_key, "left_anti"), index.shards), False)[1]
    return Index(filters, content, index.shards)


def _withdraw(gone: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    cells = bytes(old["cells"].iloc[0])
    held = CuckooFilter(len(cells) // (2 * CELLS), cells)
    n = sum(held.delete(k) for k in gone["key"].to_numpy(np.int64).view(np.uint64).tolist())
    return pd.DataFrame({"shard": old["shard"], "size": old["size"] - n, "cells": [held.cells.tobytes()]})


def delete(index: Index, keyed: DataFrame) -> Index:
    """The index without the texts of keyed: their digests are no longer live, whatever their copies."""
    asked = keyed.select("digest").distinct().select(_shard(index.shards).alias("shard"), F.xxhash64("digest").alias("key"), "digest")

    def ask(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        cells = next((bytes(c) for c in old["cells"]), None)
        if cells is None or not len(new):
            return new.iloc[:0]
        return new[CuckooFilter(len(cells) // (2 * CELLS), cells).contains_many(new["key"].to_numpy(np.int64).view(np.uint64))]

    hits = asked.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(ask, "shard int, key long, digest binary")
    dead = staged(verified(index, hits).join(hits.select("digest"), "digest", "left_semi").select(*index.content.columns), "withdrawn")
    filters = dead.select("shard", "key").groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(_withdraw, FILTERS)
    return Index(staged(filters, "filters"), staged(index.content.join(dead, "digest", "left_anti").select(*index.content.columns), "content"), index.shards)


def build_index(keyed: DataFrame, digests_per_shard: int = DIGESTS_PER_SHARD) -> Index:
    """A new index of all digests of keyed (see digests()); the number of shards follows the number of rows."""
    return insert(empty_index(keyed.sparkSession, shuffle_width(keyed.sparkSession)), keyed, digests_per_shard)


def resolve(index: Index, keyed: DataFrame) -> DataFrame:
    """Each row of keyed with its group: keep_id, group_size and kept. A hot digest is split by adaptive skew joins."""
    groups = index.content.filter("copies > 1").select(F.col("digest").alias("g_digest"), "copies", "keep_id", "keep_row")
    joined = keyed.join(groups, F.col("digest") == F.col("g_digest"), "left")
    single = F.col("copies").isNull()
    return joined.select(
        "doc_id", "row_no", "digest", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row_no") == F.col("keep_row"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, row_no: Column | None = None) -> DataFrame:
    """One row per document: doc_id, row_no, digest, keep_id, group_size, kept."""
    keyed = digests(docs, row_no)
    return resolve(build_index(keyed), keyed)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each text, columns as they were.

    The rows are numbered in one staged table, which both the decision and the kept rows are read from.
    """
    rows = numbered(docs, "numbered")
    dropped = exact_dedup(rows, F.col("__row")).filter(~F.col("kept")).select(F.col("row_no").alias("__dropped"))
    return rows.join(dropped, F.col("__row") == F.col("__dropped"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
