"""Substring dedup over words by level-wise doubling.

Levels double from SHORTEST words or less to the wanted length (12 or 13, 25, 50; the last step overlaps where it must):
windows that repeat at one length alone are extended to the next, until the wanted length is reached or no candidate
survives. Below the wanted length, only a content-chosen sample of the windows is counted: of each run that a window of
the next length can hold, the one with the least hash, so that equal windows hold equal samples. A window is counted only
if its own sample from the level before occurs in two documents; since a window repeats only if the windows inside it do,
no level misses one. From the wanted length on, each level tells for every window the least doc_id that holds it, and if
longer windows are asked for, doubling goes on in the same way.

Documents with the same words are folded before that: all but the least doc_id lose every word that a window covers.
Windows are counted in shards of bounded size; they are equal if 128 bits of hash agree. Of the holders of one window in a block of texts only the least and the
greatest go there; for those between, a lesser one is known already, and their verdict goes straight to their document.

Defined cases: null and empty texts have no words; rows without doc_id lose nothing and give no reason to remove; rows
of one doc_id are no reason for one another; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm.staging import shuffle_width, staged

WORDS, SHORTEST = 50, 13
WINDOWS_PER_SHARD = 1_500_000
ENTRY = [("hash", "u8"), ("again", "u8"), ("doc", "i8"), ("th", "i8"), ("pos", "u4")]
SURVEY = "doc_id long, th long, n_words long, whole_sha binary, anchors array<long>"


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _survey(half: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in at.blocks(batches):
            _, _, ptr, words = at.word_hashes(buf, off)
            starts = at.window_starts(ptr, half)
            prefix, row = at.prefix_hash(words), at.row_of(ptr)
            hashes = at.span_hash(prefix, starts, starts + half)
            chosen = at.anchors(hashes, row[starts], length - half + 1)
            owner = row[starts[chosen]]
            text = buf.tobytes()
            shas = [_digest(text[a:b].split()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(*at.distinct_lists(hashes[chosen], owner, len(off) - 1)[:2])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(ptr), pa.int64()), pa.array(shas, pa.binary()), lists], names=["doc_id", "th", "n_words", "whole_sha", "anchors"])

    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the third column, so that texts cross the network small."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([press.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "th", "packed"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with the bytes and offsets of their unpacked third column."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        column, begin = batch.column(2), 0
        while begin < batch.num_rows:
            texts, size, end = [], 0, begin
            while end < batch.num_rows and size < at.BLOCK:
                texts.append(open_(column[end].as_py()))
                size, end = size + len(texts[-1]), end + 1
            yield batch.slice(begin, end - begin), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            begin = end


def _list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and owning rows of a list column."""
    n = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), n)


def _isin(values: np.ndarray, row: np.ndarray, wanted: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each value is among its row's wanted ones."""
    key = lambda v, r: at.mix(v.view(np.uint64) ^ at.mix(r.astype(np.uint64)))
    return np.isin(key(values, row), key(wanted, owner))


def levels(words: int) -> list[int]:
    """Window lengths from a short one to the wanted one, each at most double the one before."""
    out = [words]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out if len(out) > 1 else [(words + 1) // 2, words]


def _sampled(prefix: np.ndarray, starts: np.ndarray, shorter: int, length: int, row: np.ndarray, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which windows' least shorter windows are among their row's values."""
    n = len(prefix) - 1
    hashes = at.span_hash(prefix, np.arange(max(0, n - shorter + 1)), np.arange(shorter, n + 1))
    least = at.sliding_min(hashes, length - shorter + 1)
    return _isin(least[starts].view(np.int64), row[starts], values.astype(np.int64), owner)


def _extended(shorter: int, length: int, longer: int):
    """The sample of windows of one length for the next, of those alone whose own sample was repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _opened(batches):
            _, _, ptr, words = at.word_hashes(buf, off)
            prefix, row = at.prefix_hash(words), at.row_of(ptr)
            values, owner = _list_values(rows.column(3))
            starts = at.window_starts(ptr, length)
            hashes = at.span_hash(prefix, starts, starts + length)
            chosen = at.anchors(hashes, row[starts], longer - length + 1)
            chosen = chosen[_sampled(prefix, starts[chosen], shorter, length, row, values, owner)]
            where = row[starts[chosen]]
            lists = pa.ListArray.from_arrays(*at.distinct_lists(hashes[chosen], where, len(off) - 1)[:2])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], names=["doc_id", "th", "anchors"])

    return run


def _windows(half: int, length: int, shards: int, sampled: bool):
    """Candidate windows of one level, one entry for each distinct window of a block, dealt to shards as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _opened(batches):
            _, _, ptr, words = at.word_hashes(buf, off)
            prefix, row = at.prefix_hash(words), at.row_of(ptr)
            values, owner = _list_values(rows.column(3))
            starts = at.window_starts(ptr, length)
            if sampled:
                starts = starts[_sampled(prefix, starts, half, length, row, values, owner)]
            else:
                known = np.zeros(len(words) + length, bool)
                known[ptr[owner] + values] = True
                starts = starts[known[starts] & known[starts + half]]
            if not len(starts):
                continue
            hashes = at.span_hash(prefix, starts, starts + length)
            again = at.span_hash(at.prefix_hash(at.word_hashes(buf, off, seed=11)[3]), starts, starts + length)  # windows are equal if 128 bits agree
            ids, ths = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
            frame = np.empty(len(starts), dtype=ENTRY)
            frame["hash"], frame["again"], frame["doc"], frame["th"], frame["pos"] = hashes, again, ids[row[starts]], ths[row[starts]], starts - ptr[row[starts]]
            frame = frame[np.lexsort((frame["doc"], frame["again"], frame["hash"]))]
            first = _heads(frame["hash"], frame["again"])
            last = np.append(first[1:], True)
            # least and greatest holder go on; for all between, a lesser one is known already
            sent = last | (frame["doc"] == frame["doc"][np.flatnonzero(first)][np.cumsum(first) - 1])
            parts = [(False, *x) for x in _dealt(frame[sent], frame["hash"][sent], shards)]
            known = frame[~sent]
            known["hash"], known["again"] = 1, 0
            parts += [(True, *x) for x in _dealt(known, _home(known), shards)]
            yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in parts], pa.int32()), pa.array([p[0] for p in parts]), pa.array([p[2] for p in parts], pa.binary())], names=["shard", "settled", "entries"])

    return run


def _home(entries: np.ndarray) -> np.ndarray:
    """A hash of each entry's document, where its verdicts are gathered."""
    return at.mix(entries["doc"].view(np.uint64) ^ at.mix(entries["th"].view(np.uint64))) if len(entries) else np.zeros(0, at.U64)


def _dealt(entries: np.ndarray, key: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """Entries packed by shard."""
    to = (key % at.U64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []
    return [(int(to[p[0]]), zstandard.compress(encode(entries[p]), 1)) for p in parts]


def encode(entries: np.ndarray) -> bytes:
    """Documents of the entries once, then both hashes, document number and position column by column."""
    keys, number = np.unique(entries[["doc", "th"]], return_inverse=True)
    head = np.array([len(entries), len(keys)], np.int64)
    return b"".join(x.tobytes() for x in (head, keys["doc"].astype(np.int64), keys["th"].astype(np.int64), entries["hash"], entries["again"], number.astype(np.uint16 if len(keys) < 65536 else np.uint32), entries["pos"]))


def decode(data: bytes) -> tuple[np.ndarray, ...]:
    """Both hashes, doc_id, text hash and position of each entry."""
    n, m = np.frombuffer(data, np.int64, 2)
    at_ = 16
    out = []
    for kind, count in (("i8", m), ("i8", m), ("u8", n), ("u8", n), ("u2" if m < 65536 else "u4", n), ("u4", n)):
        out.append(np.frombuffer(data, kind, count, at_))
        at_ += out[-1].nbytes
    return out[2], out[3], out[0][out[4]], out[1][out[4]], out[5]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _settle(shards: int):
    """Windows that other documents hold as well, with a flag for those a lesser doc_id holds, sent back by document."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        done, backs = rows["settled"].to_numpy(), []
        for settled in (True, False):
            data = [decode(zstandard.decompress(e)) for e in rows["entries"][done == settled]]
            if not data:
                continue
            hashes, again, doc, th, pos = (np.concatenate(x) for x in zip(*data, strict=True))
            if not settled:
                order = np.lexsort((again, hashes))
                hashes, again, doc, th, pos = (x[order] for x in (hashes, again, doc, th, pos))
                first = np.flatnonzero(_heads(hashes, again))
                size = np.diff(np.append(first, len(hashes)))
                least, most = np.repeat(np.minimum.reduceat(doc, first), size), np.repeat(np.maximum.reduceat(doc, first), size)
                shared = np.flatnonzero(least < most)
                hashes, doc, th, pos = (doc > least)[shared], doc[shared], th[shared], pos[shared]
            back = np.zeros(len(doc), dtype=ENTRY)
            back["hash"], back["doc"], back["th"], back["pos"] = hashes, doc, th, pos
            backs.append(back)
        back = np.concatenate(backs)
        parts = _dealt(back, _home(back), shards)
        return pd.DataFrame({"shard": [p[0] for p in parts], "entries": [p[1] for p in parts]}, dtype=object)

    return run


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """Per document, the starts of windows that other documents hold, and of those that a lesser doc_id holds."""
    later, _, doc, th, pos = (np.concatenate(x) for x in zip(*(decode(zstandard.decompress(e)) for e in rows["entries"]), strict=True))
    order = np.lexsort((pos, th, doc))
    doc, th, pos, later = doc[order], th[order], pos[order].astype(np.int32), later[order].astype(bool)
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])) + 1
    head = np.concatenate([[0], cut]).astype(np.int64)
    starts = np.split(pos, cut)
    return pd.DataFrame({"doc_id": doc[head], "th": th[head], "starts": starts, "later": [p[k] for p, k in zip(starts, np.split(later, cut), strict=True)]})


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _opened(batches):
            starts, ends, ptr = at.word_spans(buf, off)
            values, owner = _list_values(rows.column(3))
            begin = ptr[owner] + values
            gone = at.intervals_mask(len(starts), begin, begin + length)
            removed = np.concatenate([[0], np.cumsum(gone)])
            text, shas = buf.tobytes(), []
            for k in range(len(off) - 1):
                keep = np.arange(ptr[k], ptr[k + 1])[~gone[ptr[k] : ptr[k + 1]]]
                shas.append(_digest([text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(removed[ptr[1:]] - removed[ptr[:-1]], pa.int64()), pa.array(shas, pa.binary())], names=["doc_id", "th", "n_removed", "kept_sha"])

    return run


def substring_dedup(docs: DataFrame, words: int = WORDS, longest: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha (binary), longest_repeat.

    longest_repeat is the length of the longest counted level at which a window of the document was repeated (null if
    none was); levels double from words up to longest, which is words if not given.
    """
    spark = docs.sparkSession
    lengths = levels(words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    survey = staged(texts.mapInArrow(_survey(lengths[0], lengths[1]), SURVEY), "survey")
    able = survey.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= words))
    same = staged(able.groupBy("whole_sha").agg(F.min("doc_id").alias("least"), F.min_by("th", "doc_id").alias("least_th")), "same")

    solo = able.join(same.select("least", "least_th"), (F.col("doc_id") == F.col("least")) & (F.col("th") == F.col("least_th")), "left_semi")
    likely = repeated(solo).select(F.col("doc_id").alias("l_id"), F.col("th").alias("l_th"), "marks")
    packs = texts.filter("doc_id is not null").mapInArrow(packed, "doc_id long, th long, packed binary")
    held = staged(packs.join(likely, (F.col("doc_id") == F.col("l_id")) & (F.col("th") == F.col("l_th"))).select("doc_id", "th", "packed", "marks").dropDuplicates(["doc_id", "th"]), "candidates")
    for shorter, length, longer in zip(lengths, lengths[1:], lengths[2:]):
        sample = held.mapInArrow(_extended(shorter, length, longer), "doc_id long, th long, anchors array<long>")
        likely = repeated(staged(sample, "sample"))
        held = staged(held.drop("marks").join(likely, ["doc_id", "th"]).select("doc_id", "th", "packed", "marks"), "candidates")

    load = held.join(survey.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "n_words"), (F.col("doc_id") == F.col("s_id")) & (F.col("th") == F.col("s_th"))).agg(F.sum("n_words")).first()[0] or 0
    shards = max(shuffle_width(spark), -(-load // WINDOWS_PER_SHARD))
    found = _level(held, _windows(lengths[-2], words, shards, True), shards)
    gone = found.filter(F.size("later") > 0).select("doc_id", "th", F.col("later").alias("marks"))
    reach = found.select("doc_id", "th", F.lit(words).alias("length"))
    level, length = found, words
    while longest and 2 * length <= longest and level.limit(1).count():
        again = held.drop("marks").join(level.select("doc_id", "th", F.col("starts").alias("marks")), ["doc_id", "th"])
        level = _level(again.select("doc_id", "th", "packed", "marks"), _windows(length, 2 * length, shards, False), shards)
        length *= 2
        reach = reach.unionByName(level.select("doc_id", "th", F.lit(length).alias("length")))

    cut = held.drop("marks").join(gone, ["doc_id", "th"]).select("doc_id", "th", "packed", "marks").mapInArrow(_cut(words), "doc_id long, th long, n_removed long, kept_sha binary")
    cut = cut.join(reach.groupBy("doc_id", "th").agg(F.max("length").alias("longest_repeat")), ["doc_id", "th"], "right")
    cut = cut.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "n_removed", "kept_sha", "longest_repeat")
    rows = survey.drop("anchors").join(same.select(F.col("whole_sha").alias("w_sha"), "least"), F.col("whole_sha") == F.col("w_sha"), "left")
    rows = rows.join(cut, rows.doc_id.eqNullSafe(cut.c_id) & (rows.th == cut.c_th), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").digest())).otherwise(F.coalesce("kept_sha", "whole_sha")).alias("kept_sha"),
        F.when(copy, F.coalesce("longest_repeat", F.lit(words))).otherwise(F.col("longest_repeat")).alias("longest_repeat"),
    )


def repeated(sample: DataFrame) -> DataFrame:
    """doc_id, th and the marks: the row's sampled windows (anchors) that another document's sample holds as well."""
    each = sample.select("doc_id", "th", F.explode("anchors").alias("anchor"))
    twice = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    twice = staged(twice, "twice")  # a table of its own: a hot window is then split by the join
    return each.join(twice, "anchor").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("marks"))


def _level(held: DataFrame, windows, shards: int) -> DataFrame:
    settled = held.mapInArrow(windows, "shard int, settled boolean, entries binary").groupBy("shard").applyInPandas(_settle(shards), "shard int, entries binary")
    return staged(settled.groupBy("shard").applyInPandas(_gather, "doc_id long, th long, starts array<int>, later array<int>"), "level")
