"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct five-word shingles (A-Z lowered); a shorter one's whole word sequence is its only
shingle. Documents with one and the same set form a class, and classes are compared. Signatures of 128 minima give 32
bands of four; a pair at the threshold shares no band with a chance of 5e-6. Candidates are verified sequentially:
batches of 16 minima are compared, and a pair is pruned once the posterior chance (uniform prior) that its similarity
reaches the threshold falls below MISS. Survivors are verified exactly on their full sets.

Buckets are never expanded into all pairs. Each class is first held against the least of the least members of its
buckets, linked classes are merged, and only then are those that still stand apart held against the least members of
their other buckets. Buckets that hold several components after that are dealt to blocks of at most SIDE by SIDE members:
members outside the bucket's largest component meet the members of other components, in the first band that a pair
shares. Blocks are read twice: by signatures, which leaves the members that may have a partner, and with the texts of
these, compressed, for the exact test. A block gives back a spanning forest of its links and never more than that. A link
between two components of a bucket has an end outside the largest one, so no link between components is lost.

Defined cases: null and empty texts and texts without words have an empty set, are linked with nothing and stay; rows
without doc_id are linked with nothing, stay, and have no component_id; rows of one doc_id are linked with one another,
whatever their texts; repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm.graph import components
from tessera.llm.staging import staged

SHINGLE, HASHES, ROWS, BATCH = 5, 128, 4, 16
PERCENT, MISS = 75, 1e-6
SIDE, PAIRS = 512, 1 << 15
PROFILE = "doc_id long, th long, n_shingles long, set_id binary, signature binary"


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(10).integers(0, 1 << 32, (2, HASHES), dtype=np.uint32) | np.uint32(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending inside each row, and row pointers."""
    _, _, ptr, words = at.word_hashes(buf, off, lower=True)
    prefix = at.prefix_hash(words)
    starts = at.window_starts(ptr, SHINGLE)
    row = at.row_of(ptr)
    n = np.diff(ptr)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    first = np.concatenate([starts, ptr[short]])
    last = np.concatenate([starts + SHINGLE, ptr[short + 1]])
    hashes, owner = at.span_hash(prefix, first, last), row[first] if len(first) else first
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(off)))


def signatures(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Rows x HASHES 16-bit marks of the minima; rows without shingles keep zeros."""
    n = np.diff(ptr)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), HASHES), np.uint16)
    if len(some):
        low, high = hashes.astype(np.uint32), (hashes >> at.U64(32)).astype(np.uint32)
        a, b = _multipliers()
        for i in range(HASHES):
            least = np.minimum.reduceat(low * a[i] + high * b[i], ptr[some])
            out[some, i] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def text_hashes(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """A 64-bit hash of each text, which tells the texts of one doc_id apart."""
    text = buf.tobytes()
    return pa.array(np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64).view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in at.blocks(batches):
        hashes, ptr = shingle_sets(buf, off)
        n = np.diff(ptr)
        marks = signatures(hashes, ptr)
        totals = [np.concatenate([np.zeros(1, at.U64), np.cumsum(x)]) for x in (at.mix(hashes), at.mix(hashes ^ at.U64(0x5DEECE66D)))]
        sums = np.stack([t[ptr[1:]] - t[ptr[:-1]] for t in totals] + [n.astype(at.U64)], axis=1)
        some = n > 0
        yield pa.RecordBatch.from_arrays([
            rows.column(0), text_hashes(buf, off), pa.array(n, pa.int64()),
            pa.array([s.tobytes() if k else None for s, k in zip(sums, some, strict=True)], pa.binary()),
            pa.array([m.tobytes() if k else None for m, k in zip(marks, some, strict=True)], pa.binary()),
        ], names=["doc_id", "th", "n_shingles", "set_id", "signature"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = HASHES // ROWS
    salt = at.mix(np.arange(1, count + 1, dtype=np.uint64))
    for batch in batches:
        if batch.num_rows:
            buf, _ = at.raw(batch.column(1))
            keys = at.mix(buf.view(np.uint64).reshape(batch.num_rows, -1) ^ salt)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(count, dtype=np.int32), batch.num_rows))], names=["node", "band", "band_no"])


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest equal minima for which the similarity may still reach the threshold."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        # the posterior chance of a Beta(m + 1, n - m + 1) similarity above t is that of at most m of n + 1 trials
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def likely(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Indices of the pairs (row a of left, row b of right) of signatures that survive the sequential test."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(percent, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        got = got + (left[a[alive], part] == right[b[alive], part]).sum(axis=1)
        keep = got >= least
        alive, got = alive[keep], got[keep]
    return alive


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, HASHES)


def _surviving(percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pair = np.arange(batch.num_rows)
                keep = likely(_matrix(batch.column(2).to_pylist()), _matrix(batch.column(3).to_pylist()), pair, pair, percent, miss)
                yield batch.select([0, 1]).take(pa.array(keep))

    return run


# --- blocks of buckets ------------------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks one by one; rows come sorted by band, bx and by, the first three columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and tuple(keys[begin]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = tuple(keys[begin])
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(block: pa.Table, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block (one outside the largest component, one of its partners) that the sequential test keeps."""
    number = lambda name: block.column(name).to_numpy()
    comp, size, own, outside = number("comp"), number("n_shingles"), int(block.column("band_no")[0].as_py()), number("outside")
    marks = _matrix(block.column("signature").to_pylist())
    bands = marks.view(np.uint64)
    x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, PAIRS // max(1, len(y)))
    for begin in range(0, len(x), step):
        a, b = (v.ravel() for v in np.meshgrid(x[begin : begin + step], y, indexing="ij"))
        fits = (comp[a] != comp[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        a, b = a[fits], b[fits]
        fresh = ~(bands[a, :own] == bands[b, :own]).any(axis=1)  # the others met in an earlier band
        a, b = a[fresh], b[fresh]
        keep = likely(marks, marks, a, b, percent, miss)
        left.append(a[keep])
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def _promising(percent: int, miss: float):
    """The rows of blocks that have a partner by their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            a, b = _open_pairs(block, percent, miss)
            if len(a):
                yield from block.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()

    return run


def _forest(percent: int, miss: float):
    """Links of each block whose full sets reach the threshold, as a spanning forest of the components that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            a, b = _open_pairs(block, percent, miss)
            if not len(a):
                continue
            reach = _reach(block.column("packed").to_pylist(), a, b, percent)
            node, comp = block.column("node").to_numpy(), block.column("comp").to_numpy()
            up: dict[int, int] = {}

            def root(c: int, up: dict[int, int] = up) -> int:
                while c in up:
                    up[c] = c = up.get(up[c], up[c])
                return c

            left, right = [], []
            for i, j in zip(a[reach].tolist(), b[reach].tolist(), strict=True):
                r, s = root(int(comp[i])), root(int(comp[j]))
                if r != s:
                    up[max(r, s)] = min(r, s)
                    left.append(int(node[i]))
                    right.append(int(node[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _reach(texts: list[bytes], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of row numbers reach the threshold on their full sets; all pairs of a block by products of incidences."""
    open_ = zstandard.ZstdDecompressor().decompress
    used = np.unique(np.concatenate([a, b]))
    raw = [open_(texts[k]) for k in used]
    hashes, ptr = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
    owner, sizes = at.row_of(ptr), np.diff(ptr)
    _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
    rows_a, rows_b = np.unique(a), np.unique(b)
    at_a, at_b = np.full(len(used), -1), np.full(len(used), -1)
    at_a[np.searchsorted(used, rows_a)], at_b[np.searchsorted(used, rows_b)] = np.arange(len(rows_a)), np.arange(len(rows_b))
    common = np.zeros((len(rows_a), len(rows_b)), np.float32)
    for begin in range(0, int(number.max(initial=-1)) + 1, 4096):
        part = (number >= begin) & (number < begin + 4096)
        column, row = number[part] - begin, owner[part]
        left, right = np.zeros((len(rows_a), 4096), np.float32), np.zeros((len(rows_b), 4096), np.float32)
        on_a, on_b = at_a[row] >= 0, at_b[row] >= 0
        left[at_a[row][on_a], column[on_a]] = 1
        right[at_b[row][on_b], column[on_b]] = 1
        common += left @ right.T
    ia, ib = np.searchsorted(used, a), np.searchsorted(used, b)
    got = common[at_a[ia], at_b[ib]].astype(np.int64)
    return 100 * got >= percent * (sizes[ia] + sizes[ib] - got)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the second column, so that texts cross the network small."""
    press = zstandard.ZstdCompressor(level=1)
    for rows, buf, off in at.blocks(batches):
        data = memoryview(buf)
        texts = pa.array([press.compress(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column(0), text_hashes(buf, off), texts], names=["doc_id", "th", "packed"])


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, begin = [], 0
            while begin < batch.num_rows:
                a, b, size, end = [], [], 0, begin
                while end < batch.num_rows and size < at.BLOCK:
                    a.append(open_(left[end]))
                    b.append(open_(right[end]))
                    size, end = size + len(a[-1]) + len(b[-1]), end + 1
                texts = a + b
                off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                hashes, ptr = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), off)
                m = len(a)
                pair = at.row_of(ptr) % m
                order = np.lexsort((hashes, pair))
                same = (hashes[order][1:] == hashes[order][:-1]) & (pair[order][1:] == pair[order][:-1])
                common = np.bincount(pair[order][1:][same], minlength=m)
                sizes = np.diff(ptr)
                union = sizes[:m] + sizes[m:] - common
                keep.append(begin + np.flatnonzero(100 * common >= percent * union))
                begin = end
            if keep:
                yield batch.select([0, 1]).take(pa.array(np.concatenate(keep)))

    return run


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and compressed text of the wanted classes (node, least, th: id and text hash of a row that has the class's
    set; a table of nodes alone names ids that have one text). Both sides are shuffled, since their number grows with the data."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, "doc_id long, th long, packed binary")
    one = "least" not in wanted.columns
    wanted = wanted.select("node", F.col("node" if one else "least").alias("w_id"), *([] if one else [F.col("th").alias("w_th")]))
    met = texts.join(wanted.hint("merge"), (F.col("doc_id") == F.col("w_id")) & (F.lit(True) if one else F.col("th") == F.col("w_th")))
    return staged(met.groupBy("node").agg(F.first("packed").alias("packed")), "texts")


def linked(texts: DataFrame, classes: DataFrame, percent: int, miss: float, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets reach the threshold: first the sequential test, then the exact one.

    b is joined first: an a that many pairs share is then met where its pairs are, and its text is not sent again.
    """
    side = classes.select("node", "signature", "n_shingles")
    both = pairs.join(side.select(F.col("node").alias("b"), F.col("signature").alias("r"), F.col("n_shingles").alias("m")), "b")
    both = both.join(side.select(F.col("node").alias("a"), F.col("signature").alias("s"), F.col("n_shingles").alias("n")), "a")
    both = both.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = staged(both.select("a", "b", "s", "r").mapInArrow(_surviving(percent, miss), "a long, b long"), "likely")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("r")), "b").join(texts.select(F.col("node").alias("a"), F.col("packed").alias("s")), "a")
    return staged(both.select("a", "b", "s", "r").mapInArrow(_exact(percent), "a long, b long"), "links")


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with the component of each node."""
    named = comps.select(F.col("node").alias("c_node"), "comp")
    return members.join(named, F.col("node") == F.col("c_node"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("c_node")


def bucket_links(members: DataFrame, comps: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) that join components inside the buckets (members: band, band_no, node), block by block."""
    held = _apart(members, comps).select("band", "band_no", "node", "comp")
    parts = held.groupBy("band", "comp").agg(F.count("*").alias("in_comp"))
    open_ = parts.groupBy("band").agg(F.count("*").alias("n_comps"), F.max(F.struct("in_comp", "comp")).alias("top"), F.sum("in_comp").alias("size")).filter("n_comps > 1")
    open_ = open_.select("band", F.col("top.comp").alias("top"), (F.col("size") - F.col("top.in_comp")).alias("n_out"), "size")
    rest = held.join(open_, "band").withColumns({
        "outside": F.col("comp") != F.col("top"), "xs": F.ceil(F.col("n_out") / SIDE).cast("int"), "ys": F.ceil(F.col("size") / SIDE).cast("int"), "deal": F.abs(F.xxhash64("node")),
    })
    rest = rest.join(classes.select("node", "signature", "n_shingles"), "node")
    dealt = lambda n: (F.col("deal") % F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    own = ["band_no", "node", "comp", "n_shingles", "signature"]
    left = rest.filter("outside").select("band", dealt("xs").alias("bx"), every("ys").alias("by"), *own, F.lit(True).alias("outside"))
    right = rest.select("band", every("xs").alias("bx"), dealt("ys").alias("by"), *own, F.lit(False).alias("outside"))
    key = ["band", "bx", "by"]
    blocks = left.unionByName(right).repartition(*key).sortWithinPartitions(*key)
    kept = staged(blocks.mapInArrow(_promising(percent, miss), blocks.schema), "promising")
    with_text = kept.join(texts, "node").select(*blocks.columns, "packed").repartition(*key).sortWithinPartitions(*key)
    return staged(with_text.mapInArrow(_forest(percent, miss), "a long, b long").distinct(), "links")


def _same_ids(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that rows of one doc_id belong to."""
    several = usable.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("other")).filter("one != other").select("doc_id", "one")
    pairs = usable.select("doc_id", "set_id").join(several, "doc_id").filter("set_id != one").select("one", "set_id").distinct()
    number = classes.select(F.col("set_id").alias("c_set"), "node")
    pairs = pairs.join(number.withColumnRenamed("node", "b"), F.col("set_id") == F.col("c_set")).select("one", "b")
    return pairs.join(number.withColumnRenamed("node", "a"), F.col("one") == F.col("c_set")).select("a", "b")


def near_dedup(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    profiles = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_profile, PROFILE), "profiles")
    usable = profiles.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    # a class's node is a number of its own: rows of one doc_id may have several sets
    classes = usable.groupBy("set_id").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "set_id", F.col("least.doc_id").alias("least"), F.col("least.th").alias("th"), "signature", "n_shingles"), "classes")

    bands = classes.select("node", "signature").mapInArrow(_bands, "node long, band long, band_no int")
    full = bands.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1")
    members = staged(bands.join(full, "band").select("band", "band_no", "node", "least"), "members")
    texts = candidate_texts(docs, classes.join(members.select("node").distinct(), "node", "left_semi"))
    first = members.groupBy(F.col("node").alias("b")).agg(F.min("least").alias("a")).filter("a < b")
    edges = linked(texts, classes, percent, miss, first)
    comps = staged(components(edges), "components")
    others = _apart(members, comps).join(comps.select(F.col("node").alias("least"), F.col("comp").alias("l_comp")), "least", "left")
    others = others.filter(F.col("comp") != F.coalesce("l_comp", "least")).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    edges = edges.unionByName(linked(texts, classes, percent, miss, others.join(first, ["a", "b"], "left_anti")))
    comps = staged(components(edges), "components")
    edges = edges.unionByName(bucket_links(members, comps, classes, texts, percent, miss))

    final = components(edges.unionByName(_same_ids(usable, classes)))
    named = classes.select(F.col("set_id").alias("c_set"), "node", "least").join(final.select(F.col("node").alias("f_node"), F.col("comp").alias("f_comp")), F.col("node") == F.col("f_node"), "left")
    named = staged(named.select("c_set", "least", F.coalesce("f_comp", "node").alias("of")), "named")
    least = named.groupBy(F.col("of").alias("l_of")).agg(F.min("least").alias("comp"))
    by_set = named.join(least, F.col("of") == F.col("l_of")).select("c_set", "comp")
    rows = profiles.select("doc_id", "n_shingles", "set_id").join(by_set, F.col("set_id") == F.col("c_set"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but the least doc_id of each group, columns as they were."""
    gone = near_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
