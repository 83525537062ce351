"""Periodic runs of words: a harmonic grid of (period, place) pairs, extended by binary search over prefix hashes.

A run is a stretch of words with smallest period q and at least MIN_WORDS and REPEATS * q words, extended as far as the
period holds. In a run of period q at least (REPEATS - 1) * q consecutive places equal the place q words on, so a grid of
that spacing has a point in each run: over all periods, n log n pairs for n words. All pairs of a block of texts are
compared at once: first the two words, then half of the stretch that a run needs, by prefix hashes; the few that are left
are extended to both sides by binary searches that run together. What is found is compared word by word, as bytes, and
split where words differ, so that equal hashes of unequal words change nothing; of several periods of one stretch the
least stays. Pairs inside a long run already known, at multiples of its period, are passed over, since they can only
find it again.

Documents are independent, so the job is one pass without a shuffle; a block holds about a megabyte of texts, and a longer
text, read whole, forms a block of its own whose pairs are dealt to chunks.

Defined cases: null, empty and blank texts have no words and no runs; rows without doc_id are treated like others; repeated rows each get their row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at

MIN_WORDS, REPEATS = 6, 4
PAIRS = 1 << 20  # compared together; a single period of a long text may hold more
LONG_RUN = 1024  # words from which a run is remembered for passing over its multiples
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, start long, length long, period long, collapsed string"
Order = Callable[[list, np.ndarray], np.ndarray]


def _prefix(words: np.ndarray) -> np.ndarray:
    """Prefix sums of words[i] * BASE**i, chunk by chunk."""
    step = 1 << 16
    p = at.powers(step)[0][:step]
    out = np.zeros(len(words) + 1, at.U64)
    for i in range(0, len(words), step):
        part = words[i : i + step]
        np.cumsum(part * p[: len(part)] * at.U64(pow(at.BASE, i, 1 << 64)), out=out[i + 1 : i + 1 + len(part)])
        out[i + 1 : i + 1 + len(part)] += out[i]
    return out


class _Reach:
    """How far the words from g on, or before g, equal those q places later; answers for many (g, q) at once."""

    def __init__(self, words: np.ndarray):
        self.prefix = _prefix(words)

    def _equal(self, g: np.ndarray, q: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        p = self.prefix
        return (p[g + size] - p[g]) * shift == p[g + q + size] - p[g + q]

    def right(self, g, q, shift, size):
        return self._equal(g, q, shift, size)

    def left(self, g, q, shift, size):
        return self._equal(g - size, q, shift, size)

    def extent(self, test: Callable, g: np.ndarray, q: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            good = test(g, q, shift, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def _spacing(q: np.ndarray) -> np.ndarray:
    return np.maximum((REPEATS - 1) * q, MIN_WORDS - q)


def _same_words(buf: np.ndarray, s: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j are equal as bytes."""
    size = e[i] - s[i]
    same = size == e[j] - s[j]
    todo = np.flatnonzero(same)
    bytes_to = np.cumsum(size[todo])
    begin = 0
    while begin < len(todo):
        end = max(begin + 1, int(np.searchsorted(bytes_to, (bytes_to[begin - 1] if begin else 0) + PAIRS, side="right")))
        part = todo[begin:end]
        first = np.cumsum(size[part]) - size[part]
        inner = np.arange(int(size[part].sum())) - np.repeat(first, size[part])
        wrong = buf[np.repeat(s[i[part]], size[part]) + inner] != buf[np.repeat(s[j[part]], size[part]) + inner]
        same[part[np.repeat(np.arange(len(part)), size[part])[wrong]]] = False
        begin = end
    return same


def _verified(found: np.ndarray, same: Callable) -> np.ndarray:
    """Columns start, end, period of the stretches of the found ones that hold word by word."""
    out = []
    reach = found[:, 1] - found[:, 0] - found[:, 2]
    upto, begin = np.cumsum(reach), 0
    while begin < len(found):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
        part, size = found[begin:end], reach[begin:end]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first - part[:, 0], size)
        good = same(place, place + np.repeat(part[:, 2], size))
        edge = np.zeros(len(good) + 1, bool)  # a stretch ends where words differ or the next one begins
        edge[first] = edge[-1] = True
        opens = np.flatnonzero(good & (edge[:-1] | ~np.concatenate([[False], good[:-1]])))
        closes = np.flatnonzero(good & (edge[1:] | ~np.concatenate([good[1:], [False]])))
        q = np.repeat(part[:, 2], size)[opens]
        out.append(np.stack([place[opens], place[closes] + 1 + q, q], axis=1))
        begin = end
    held = np.concatenate(out) if out else found
    return held[held[:, 1] - held[:, 0] >= np.maximum(MIN_WORDS, REPEATS * held[:, 2])]


def find_runs(words: np.ndarray, ptr: np.ndarray, same: Callable) -> np.ndarray:
    """Runs of all texts of a block as rows (start, end, period), by start and period; places count over the block.

    words: a hash of each word; ptr: the first word of each text; same(i, j): whether words i and j are equal.
    """
    n = np.diff(ptr)
    periods = np.where(n >= MIN_WORDS, n // REPEATS, 0)
    base = np.repeat(ptr[:-1], periods)
    stop = np.repeat(ptr[1:], periods)
    q_of = np.arange(len(base)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (stop - base - 1 - q_of) // _spacing(q_of) + 1
    upto, begin = np.cumsum(points), 0
    reach = _Reach(words) if len(base) else None
    several = len(upto) and upto[-1] > PAIRS
    cover_end = np.zeros(len(words) if several else 0, np.int64)
    cover_q = np.zeros(len(words) if several else 0, np.int64)
    found = [np.zeros((0, 3), np.int64)]
    while begin < len(base):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
        q, count = q_of[begin:end], points[begin:end]
        entry = np.repeat(np.arange(end - begin), count)
        g = base[begin:end][entry] + (np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)) * _spacing(q)[entry]
        hit = words[g] == words[g + q[entry]]
        entry, g = entry[hit], g[hit]
        if several:
            known = (cover_q[g] > 0) & (g + q[entry] < cover_end[g])
            known &= q[entry] % np.maximum(cover_q[g], 1) == 0
            entry, g = entry[~known], g[~known]
        low, high, q = base[begin:end][entry], stop[begin:end][entry], q[entry]
        shift = at.powers(int(q.max()) + 1)[0][q] if len(q) else np.zeros(0, at.U64)
        after, before = high - g - q, g - low
        half = (_spacing(q) + 1) >> 1
        fits_right, fits_left = after >= half, before >= half
        good = fits_right & reach.right(g, q, shift, np.where(fits_right, half, 0))
        good |= fits_left & reach.left(g, q, shift, np.where(fits_left, half, 0))
        g, q, shift, after, before = (x[good] for x in (g, q, shift, after, before))
        start = g - reach.extent(reach.left, g, q, shift, before)
        finish = g + q + reach.extent(reach.right, g, q, shift, after)
        some = np.stack([start, finish, q], axis=1)
        some = np.unique(some[finish - start >= np.maximum(MIN_WORDS, REPEATS * q)], axis=0)
        some = _verified(some, same)
        if several:
            for a, b, p in some[some[:, 1] - some[:, 0] >= LONG_RUN]:
                longer = cover_end[a:b] < b
                cover_q[a:b][longer], cover_end[a:b][longer] = p, b
        found.append(some)
        begin = end
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    least = np.ones(len(runs), bool)
    least[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _joined(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """The words with one space between them."""
    parts, step = [], 1 << 16
    for i in range(0, len(s), step):
        a, size = s[i : i + step], e[i : i + step] - s[i : i + step]
        first = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(first, size) + inner] = buf[np.repeat(a, size) + inner]
        parts.append(out.tobytes())
    return b"".join(parts)[:-1]


def _block(ids: pa.Array, buf: np.ndarray, off: np.ndarray, order: Order | None) -> pa.RecordBatch:
    s, e, ptr, words = at.word_hashes(buf, off)
    if order is not None:
        read = order(ids.to_pylist(), ptr)
        s, e, words = s[read], e[read], words[read]
    runs = find_runs(words, ptr, lambda i, j: _same_words(buf, s, e, i, j))
    kept = ~at.intervals_mask(len(words), runs[:, 0] + runs[:, 2], runs[:, 1])
    owner = np.searchsorted(ptr, runs[:, 0], side="right") - 1
    start, length, period = runs[:, 0] - ptr[owner], runs[:, 1] - runs[:, 0], runs[:, 2]
    bounds = np.searchsorted(owner, np.arange(len(ptr)))
    best = np.lexsort((period, start, -length, owner))
    first = bounds[:-1][np.diff(bounds) > 0]
    top = np.full(len(ptr) - 1, -1)
    top[owner[best[first]]] = best[first]

    def of_top(values: np.ndarray) -> pa.Array:
        return pa.array(np.append(values, 0)[top], mask=top < 0)

    texts = []
    for a, b in zip(ptr[:-1], ptr[1:], strict=True):
        mine = np.flatnonzero(kept[a:b]) + a
        texts.append(_joined(buf, s[mine], e[mine]) if len(mine) else b"")
    items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items)
    collapsed = pa.Array.from_buffers(pa.string(), len(texts), pa.array(texts, pa.binary()).buffers())  # bytes of the texts as they are
    columns = [ids, pa.array(np.diff(ptr).astype(np.int64)), lists, of_top(start), of_top(length), of_top(period), collapsed]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"])


def periodic_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start and period), start, length and period of the longest run
    (ties: smallest start, then period; null without runs), collapsed (the text whose runs keep their first period only).

    order(ids, ptr), if given, names the words to read, in reading order and as many for each text, for a block of texts
    whose first words are ptr.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in at.blocks(batches):
            yield _block(rows.column(0), buf, off, order)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)
