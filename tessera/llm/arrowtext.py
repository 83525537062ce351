"""Vectorised text primitives over Arrow batches: bytes, words and rolling hashes as numpy arrays.

Texts are processed in blocks of about BLOCK bytes so that temporaries stay small whatever the batch size;
a text longer than a block forms a block of its own and is still processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U64 = np.uint64
BASE = 0xD1B54A32D192ED03
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=4)
def _symbol_table(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(m, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbols[i] * BASE**i; differences identify substrings."""
    p, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * p[: len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def byte_prefix(buf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Prefix sums of bytes; those of another seed give hashes that are independent."""
    return prefix_hash(_symbol_table(seed)[buf])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with about limit bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, per row, the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    first = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def row_of(ptr: np.ndarray) -> np.ndarray:
    """Row index of each element, from row pointers."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool = False, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word spans, row pointers and a 64-bit hash of each word; temporaries stay at a few blocks however long a text is.

    Hashes of another seed are independent.
    """
    if len(buf) <= 4 * BLOCK:
        if lower:
            buf = LOWER[buf]
        s, e, ptr = word_spans(buf, off)
        return s, e, ptr, span_hash(byte_prefix(buf, seed), s, e)
    parts = []
    at = 0
    while at < len(buf):
        to = _word_end(buf, off, at + BLOCK) if at + BLOCK < len(buf) else len(buf)
        if to - at > 4 * BLOCK:  # a word of several blocks: first what stands before it, then itself
            last = np.flatnonzero(SPACE[buf[at : at + BLOCK]])
            begin = max(at + (int(last[-1]) + 1 if len(last) else 0), int(off[np.searchsorted(off, at + BLOCK, side="right") - 1]))
            if begin == at:
                parts.append((np.array([at]), np.array([to]), np.array([_long_hash(buf[at:to], lower, seed)], U64)))
                at = to
                continue
            to = begin
        piece = LOWER[buf[at:to]] if lower else buf[at:to]
        s, e, _ = word_spans(piece, np.unique(np.clip(off - at, 0, to - at)))
        parts.append((s + at, e + at, span_hash(byte_prefix(piece, seed), s, e)))
        at = to
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return s, e, np.searchsorted(s, off), h


def _word_end(buf: np.ndarray, off: np.ndarray, at: int) -> int:
    """The first place from at on where a space stands or a row ends."""
    stop = int(off[np.searchsorted(off, at)])
    for begin in range(at, stop, BLOCK):
        found = SPACE[buf[begin : min(begin + BLOCK, stop)]]
        if found.any():
            return begin + int(found.argmax())
    return stop


def _long_hash(word: np.ndarray, lower: bool, seed: int) -> int:
    """What span_hash gives for one word, summed block by block."""
    p, total = powers(BLOCK)[0], 0
    for at in range(0, len(word), BLOCK):
        piece = word[at : at + BLOCK]
        symbols = _symbol_table(seed)[LOWER[piece] if lower else piece]
        total += int(np.sum(symbols * p[: len(piece)], dtype=U64)) * pow(BASE, at, 1 << 64)
    return int(mix(np.array([(total + len(word)) % (1 << 64)], U64))[0])


def window_starts(ptr: np.ndarray, length: int) -> np.ndarray:
    """First elements of all windows of so many consecutive elements of one row."""
    n = int(ptr[-1])
    ok = np.zeros(n + 1, np.int32)
    counts = np.maximum(np.diff(ptr) - length + 1, 0)
    np.add.at(ok, ptr[:-1], counts > 0)
    np.add.at(ok, ptr[:-1] + counts, -(counts > 0).astype(np.int32))
    return np.flatnonzero(np.cumsum(ok)[:n] > 0)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width consecutive values (block-wise prefix and suffix minima)."""
    n = len(values)
    if width <= 1 or n == 0:
        return values
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(hashes: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Content-chosen sample of windows: of each width consecutive windows of one row, those with the least hash.

    The windows are in text order and row gives each window's row; every run of width windows contains an anchor, and
    equal texts choose equal anchors. Rows with fewer windows choose none.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = sliding_min(hashes, width)
    same = row[: len(least)] == row[width - 1 :]
    # a hash is an anchor if it equals the minimum of a run that contains it
    bound = np.where(same, least, U64(0))
    top = np.zeros(len(hashes) + width - 1, U64)
    top[width - 1 : width - 1 + len(bound)] = bound
    highest = ~sliding_min(~top, width)
    return np.flatnonzero(hashes <= highest[: len(hashes)])


def distinct_lists(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """List offsets, distinct values of each row, and how often each occurs there; periodic texts repeat few values often."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])[: len(values)])
    times = np.diff(np.append(first, len(values)))
    return pa.array(np.searchsorted(row[first], np.arange(rows + 1)), pa.int32()), pa.array(values[first].view(np.int64)), times


def intervals_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n elements lie in one of the half-open intervals."""
    edge = np.bincount(start, minlength=n + 1).astype(np.int64) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0
