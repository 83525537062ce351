"""Byte-level dedup with suffix arrays built by the difference-cover algorithm, distributed over shards.

Candidate search: of the runs of GRAM bytes that a window of the wanted length holds, the one with the least hash is its
mark, so that equal windows have equal marks. Marks are counted over all texts; only windows whose mark occurs twice can
repeat. Consecutive windows with one mark form a passage, which is dealt to a shard by the mark, so that equal windows
always meet. Equal passages are settled together, and one that is alone with its mark, which it holds once, cannot hold
a window of another. Of the rest, a shard sorts the suffixes of its passages by difference cover: it sorts and names the triples at positions
1 and 2 modulo 3, recurses on the names, sorts the remaining suffixes by first symbol and following rank, and merges by
comparing both sides in the cover. Neighbours in suffix order whose first bytes agree over the wanted length (by 128 bits
of hash) are repeats; equal windows are always neighbours.

Texts with equal copies are folded first (all of their windows repeat, one copy stays as a witness). Shards have a
bounded size. A mark with more than HOT occurrences would outgrow that; its windows go to shards one by one as 128 bits of hash,
one entry per distinct window and block, because windows that repeat inside a block are settled there.

Defined cases: null text counts as empty; texts shorter than the length lose nothing, even when they are copies; repeated
rows are texts of their own, hence copies; null doc_ids are like others; extra columns are ignored.
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

LENGTH, GRAM, HOT = 200, 32, 4096
SHARD_BYTES = 3_000_000
SORT_BYTES = 1_000_000
SURVEY = "doc_id long, n_bytes long, sha binary, marks array<struct<mark: long, n: long>>"


# --- difference cover -------------------------------------------------------------------------------------------------


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One integer per row that orders like the columns; columns are first replaced by ranks where they would not fit."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + column
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; symbols are positive integers, and a suffix's end ranks below all of them."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(symbols[i:])), np.int64)
    s = np.concatenate([symbols, np.zeros(3, symbols.dtype)]).astype(np.int64)
    # sampled positions, 1 modulo 3 before 2 modulo 3; one that lies past the end keeps the halves apart
    ones = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    key = _packed(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if int(new.sum()) < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_packed(s[rest], rank[rest + 1]), kind="stable")]
    # how many sampled suffixes of either residue come before each remaining one
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    both = _packed(s[np.concatenate([first, rest])], rank[np.concatenate([first, rest]) + 1])
    before = np.searchsorted(both[: len(first)], both[len(first) :])
    side = np.concatenate([second, rest])
    both = _packed(s[side], s[side + 1], rank[side + 2])
    before += np.searchsorted(both[: len(second)], both[len(second) :])
    out = np.empty(n, np.int64)
    at_rest = before + np.arange(len(rest))
    out[at_rest] = rest
    free = np.ones(n, bool)
    free[at_rest] = False
    out[free] = sorted_sample
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows start anywhere else among the texts."""
    joined = b"".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = np.zeros(len(buf) + len(texts), np.int64)
    place = np.arange(len(buf)) + at.row_of(off)  # a lower symbol closes each text
    symbols[place] = buf.astype(np.int64) + 2
    symbols[off[1:] + np.arange(len(texts))] = 1
    starts = at.window_starts(off, length)
    valid = np.zeros(len(symbols), bool)
    valid[place[starts]] = True
    order = suffix_array(symbols)
    order = order[valid[order]]
    back = np.zeros(len(symbols), np.int64)
    back[place] = np.arange(len(buf))
    p = back[order]
    heads = at.span_hash(at.byte_prefix(buf), p, p + length)
    same = np.flatnonzero(heads[1:] == heads[:-1])
    again = at.byte_prefix(buf, seed=5)
    left, right = p[:-1][same], p[1:][same]
    same = same[at.span_hash(again, left, left + length) == at.span_hash(again, right, right + length)]
    hit = np.zeros(len(buf) + 1, bool)
    hit[p[1:][same]] = True
    hit[p[:-1][same]] = True
    return [hit[a : max(a, b - length + 1)] for a, b in zip(off[:-1], off[1:], strict=True)]


# --- candidate search -------------------------------------------------------------------------------------------------


def _gram_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prefix = at.byte_prefix(buf)
    p = np.arange(max(0, len(buf) - GRAM + 1))
    return prefix, at.span_hash(prefix, p, p + GRAM)


def _survey(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in at.blocks(batches):
            starts = at.window_starts(off, GRAM)
            grams = _gram_hashes(buf)[1][starts]
            owner = at.row_of(off)[starts]
            chosen = at.anchors(grams, owner, length - GRAM + 1)
            text = buf.tobytes()
            shas = [hashlib.sha256(text[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            bounds, marks, times = at.distinct_lists(grams[chosen], owner[chosen], len(off) - 1)
            lists = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([marks, pa.array(times.astype(np.int64))], ["mark", "n"]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off), pa.int64()), pa.array(shas, pa.binary()), lists], names=["doc_id", "n_bytes", "sha", "marks"])

    return run


def _distinct_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts with their digests, each once per batch."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        found = {hashlib.sha256(t).digest(): t for t in ((x or "").encode() for x in batch.column(0).to_pylist())}
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([press.compress(t) for t in found.values()], pa.binary())], names=["sha", "packed"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        column, begin = batch.column(1), 0
        while begin < batch.num_rows:
            texts, size, end = [], 0, begin
            while end < batch.num_rows and size < at.BLOCK:
                texts.append(open_(column[end].as_py()))
                size, end = size + len(texts[-1]), end + 1
            yield batch.slice(begin, end - begin), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            begin = end


def _encode(kind: int, shas: list[bytes], text_no: np.ndarray, start: np.ndarray, stop: np.ndarray, mark: np.ndarray, payload: bytes = b"", times: np.ndarray | None = None) -> bytes:
    """Entries of one block for one shard: text, first window, end of windows, mark; payload holds passages' bytes or second hashes.

    times: how often a passage holds its mark (it can repeat inside itself if that is not once).
    """
    used, number = np.unique(text_no, return_inverse=True)
    head = np.array([kind, len(number), len(used)], np.int64)
    parts = [head.tobytes(), b"".join(shas[k] for k in used), number.astype(np.uint32).tobytes(), start.astype(np.uint32).tobytes(), (stop - start).astype(np.uint32).tobytes(), mark.astype(np.uint64).tobytes(), np.minimum(np.ones(len(mark)) if times is None else times, 255).astype(np.uint8).tobytes(), payload]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _decode(data: bytes) -> tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind, n, m = np.frombuffer(raw, np.int64, 3)
    shas = [raw[24 + 32 * k : 56 + 32 * k] for k in range(m)]
    i = 24 + 32 * m
    number, start, count = (np.frombuffer(raw, np.uint32, n, i + 4 * n * k).astype(np.int64) for k in range(3))
    mark = np.frombuffer(raw, np.uint64, n, i + 12 * n)
    times = np.frombuffer(raw, np.uint8, n, i + 20 * n)
    return int(kind), shas, number, start, start + count, mark, times, raw[i + 21 * n :]


PASSAGES, HASHES, SETTLED = range(3)


def _pair_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal pairs, and every row's group."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _passages(length: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _opened(batches):
            prefix, grams = _gram_hashes(buf)
            starts = at.window_starts(off, length)
            if not len(starts):
                continue
            least = at.sliding_min(grams, length - GRAM + 1)[starts]
            owner = at.row_of(off)[starts]
            wanted, hot = (np.unique(np.asarray(rows.column(i).flatten()).view(np.uint64)) for i in (2, 3))
            ok = np.isin(least, wanted)
            starts, least, owner = starts[ok], least[ok], owner[ok]
            if not len(starts):
                continue
            shas = rows.column(0).to_pylist()
            local = starts - off[owner]
            is_hot = np.isin(least, hot)
            out_shard, out_data = [], []

            cold = np.flatnonzero(~is_hot)
            if len(cold):
                s, v, o = starts[cold], least[cold], owner[cold]
                new = np.ones(len(s), bool)
                new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1] + 1) | (o[1:] != o[:-1])
                first = np.flatnonzero(new)
                begin, stop, mark, text_no = s[first], np.append(s[first[1:] - 1], s[-1]) + 1, v[first], o[first]
                inside = zip(begin.tolist(), (stop + length - GRAM).tolist(), mark, strict=True)  # the grams of a passage, none of them less than its mark
                times = np.array([np.count_nonzero(grams[a:b] == v) for a, b, v in inside])
                to = (mark % at.U64(shards)).astype(np.int64)
                text = buf.tobytes()
                order = np.argsort(to, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    payload = b"".join([text[a : b + length - 1] for a, b in zip(begin[part].tolist(), stop[part].tolist(), strict=True)])
                    out_shard.append(int(to[part[0]]))
                    base = off[text_no[part]]
                    out_data.append(_encode(PASSAGES, shas, text_no[part], begin[part] - base, stop[part] - base, mark[part], payload, times[part]))

            warm = np.flatnonzero(is_hot)
            if len(warm):
                h, again = (at.span_hash(x, starts[warm], starts[warm] + length) for x in (prefix, at.byte_prefix(buf, seed=5)))
                where, group = _pair_groups(h, again)
                here = warm[np.bincount(group)[group] > 1]  # repeated inside this block
                if len(here):
                    out_shard.append(int(h[0] % at.U64(shards)))
                    out_data.append(_encode(SETTLED, shas, owner[here], local[here], local[here] + 1, np.zeros(len(here), np.uint64)))
                to = (h[where] % at.U64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    pick = warm[where[part]]
                    out_shard.append(int(to[part[0]]))
                    out_data.append(_encode(HASHES, shas, owner[pick], local[pick], local[pick] + 1, h[where[part]], again[where[part]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.int32()), pa.array(out_data, pa.binary())], names=["shard", "entries"])

    return run


def _sorted_parts(marks: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of passages with whole groups of marks and about SORT_BYTES bytes."""
    if not len(marks):
        return
    order = np.argsort(marks, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(marks[order])) + 1, len(order))
    total, begin, done = np.cumsum(sizes[order]), 0, 0
    for end in ends:
        if total[end - 1] - done >= SORT_BYTES or end == len(order):
            yield order[begin:end]
            begin, done = int(end), int(total[end - 1])


def _settle(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        owner: list[bytes] = []
        text_no, begin, mark, often, passages = [], [], [], [], []
        hashed, found = [], []
        for data in rows["entries"]:
            kind, shas, number, first, last, key, inner, payload = _decode(data)
            base = len(owner)
            owner += shas
            if kind == PASSAGES:
                cut = np.concatenate([[0], np.cumsum(last - first + length - 1)]).tolist()
                passages += [payload[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                text_no.append(number + base)
                begin.append(first)
                mark.append(key)
                often.append(inner)
            elif kind == HASHES:
                hashed.append((key, np.frombuffer(payload, np.uint64), number + base, first))
            else:
                found.append((number + base, first, last))
        if passages:
            text_no, begin, mark, often = map(np.concatenate, (text_no, begin, mark, often))
            # equal passages are sorted once; all windows of those that occur twice repeat
            codes, distinct = pd.factorize(np.array(passages, dtype=object))
            times = np.bincount(codes)
            where = np.zeros(len(distinct), np.int64)
            where[codes] = np.arange(len(codes))
            sizes = np.array([len(x) for x in distinct])
            _, of_mark, peers = np.unique(mark[where], return_inverse=True, return_counts=True)
            sorts = np.flatnonzero((peers[of_mark] > 1) | (often[where] > 1))
            verdict: dict[int, np.ndarray] = {}
            for part in _sorted_parts(mark[where][sorts], sizes[sorts]):
                part = sorts[part]
                for k, hits in zip(part.tolist(), repeated_windows([distinct[k] for k in part], length), strict=True):
                    if times[k] == 1 and hits.any():
                        verdict[k] = np.flatnonzero(np.diff(np.concatenate([[0], hits.view(np.int8), [0]])))
            for i, code in enumerate(codes.tolist()):
                edge = np.array([0, sizes[code] - length + 1]) if times[code] > 1 else verdict.get(code, sizes[:0])
                if len(edge):
                    found.append((np.full(len(edge) // 2, text_no[i]), begin[i] + edge[::2], begin[i] + edge[1::2]))
        if hashed:
            key, again, number, first = map(np.concatenate, zip(*hashed, strict=True))
            group = _pair_groups(key, again)[1]
            twice = np.bincount(group)[group] > 1
            found.append((number[twice], first[twice], first[twice] + 1))
        if not found:
            return pd.DataFrame({"sha": [], "first": [], "last": []}, dtype=object)
        number, first, last = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(number, kind="stable")
        number, first, last = number[order], first[order].astype(np.int32), last[order].astype(np.int32)
        cut = np.flatnonzero(np.diff(number)) + 1
        heads = number[np.concatenate([[0], cut]).astype(np.int64)] if len(number) else []
        return pd.DataFrame({"sha": [owner[k] for k in heads], "first": np.split(first, cut) if len(number) else [], "last": np.split(last, cut) if len(number) else []}, dtype=object)

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.flatten()).astype(np.int64), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in _opened(batches):
            first, owner = _lists(rows.column(2))
            last, _ = _lists(rows.column(3))
            gone = at.intervals_mask(len(buf), off[owner] + first, off[owner] + last + length - 1)
            shas, removed, spans = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                out = gone[a:b]
                removed.append(int(out.sum()))
                spans.append(int((out[1:] & ~out[:-1]).sum() + (len(out) and out[0])))
                shas.append(hashlib.sha256(buf[a:b][~out].tobytes()).digest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.binary())], names=["sha", "n_removed", "n_spans", "kept_sha"])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha (binary)."""
    spark = docs.sparkSession
    survey = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_survey(length), SURVEY), "survey")
    texts = staged(survey.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("marks").alias("marks")), "distinct")
    marks = texts.select("sha", F.explode("marks").alias("m")).select("sha", "m.mark", "m.n")
    counts = marks.groupBy("mark").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = staged(counts, "counts")  # a table of its own: a hot mark is then split by the join
    likely = marks.drop("n").join(counts, "mark").groupBy("sha").agg(F.collect_set("mark").alias("marks"), F.collect_set(F.when(F.col("n") > HOT, F.col("mark"))).alias("hot"))
    packs = docs.select("text").mapInArrow(_distinct_packed, "sha binary, packed binary")
    held = packs.join(likely.withColumnRenamed("sha", "l_sha"), F.col("sha") == F.col("l_sha")).select("sha", "packed", "marks", "hot").dropDuplicates(["sha"])
    held = staged(held, "candidates")
    load = held.join(texts.select(F.col("sha").alias("t_sha"), "n_bytes"), F.col("sha") == F.col("t_sha")).agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(shuffle_width(spark), -(-load // SHARD_BYTES))
    settled = held.mapInArrow(_passages(length, shards), "shard int, entries binary").groupBy("shard").applyInPandas(_settle(length), "sha binary, first array<int>, last array<int>")
    spans = settled.groupBy("sha").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))
    spans = staged(spans.select(F.col("sha").alias("s_sha"), "first", "last"), "spans")
    cut = held.select("sha", "packed").join(spans, F.col("sha") == F.col("s_sha")).select("sha", "packed", "first", "last").mapInArrow(_cut(length), "sha binary, n_removed long, n_spans long, kept_sha binary")

    whole = texts.filter("copies > 1").select(F.col("sha").alias("w_sha"), F.lit(True).alias("copied"))
    found = cut.select(F.col("sha").alias("c_sha"), "n_removed", "n_spans", "kept_sha")
    rows = survey.select("doc_id", "n_bytes", "sha").join(whole, F.col("sha") == F.col("w_sha"), "left").join(found, F.col("sha") == F.col("c_sha"), "left")
    copied = F.coalesce("copied", F.lit(False))
    return rows.select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").digest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"),
    )
