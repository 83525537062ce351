"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

Every text is reduced to a fixed set of statistics of all its bytes and words. Random cosines of the standardised
statistics approximate a Gaussian kernel. Each partition sums its own normal equations, separately for FOLDS parts of
the labelled rows; Spark adds them up row by row of the matrix, and the driver solves one small system for each fold
left out and one for all. Scores from the models that have not seen a row are pooled in bins, and isotonic regression
over the bins turns raw scores into chances. All labelled rows are used; only matrices and bins, of sizes that are
parameters, reach the driver.

Defined cases: null text counts as empty, and empty texts get statistics of zero and a score like others; null labels
and labels of unknown documents are ignored; several labels of one doc_id are averaged; without labels every score is
0.5; repeated documents each get their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at
from tessera.llm.staging import numbered, staged

FEATURES, RIDGE, WIDTH, FOLDS, BINS = 192, 1e-3, 0.35, 4, 400
THRESHOLD = 0.3
NAMES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "lower", "digits", "spaces", "lines", "stops", "commas", "symbols", "bangs", "wide",
    "upper_words", "symbol_ends", "bars", "repeated_words", "repeated_pairs", "repeated_lines", "long_words", "byte_entropy", "line_bytes", "brackets",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), at.SPACE, _class(b"\n"), _class(b"."), _class(b",;:"),
    _class(b"#$%&*@^~+=_"), _class(b"!?"), _class(bytes(range(128, 256))), _class(b"|"), _class(b"<>[](){}"),
])


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _repeated(hashes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Per row, how many elements are not the first of their kind."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][again], minlength=rows).astype(float)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x NAMES: shares of bytes, words and lines of each whole text."""
    rows = len(off) - 1
    size = np.diff(off).astype(float)
    shares = np.maximum(size, 1)
    counts = np.zeros((rows, 256))
    np.add.at(counts.ravel(), at.row_of(off) * 256 + buf, 1)
    by_class = counts @ CLASSES.T.astype(float)
    upper, lower, digits, spaces, newlines, stops, commas, symbols, bangs, wide, bars, brackets = (by_class / shares[:, None]).T
    p = counts / shares[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)
    starts, ends, ptr, words = at.word_hashes(buf, off)
    n = np.maximum(np.diff(ptr), 1).astype(float)
    owner, length = at.row_of(ptr), (ends - starts).astype(float)
    mean = _sums(length, ptr) / n
    spread = np.sqrt(np.maximum(_sums(length**2, ptr) / n - mean**2, 0))
    capital = np.concatenate([[0], np.cumsum(CLASSES[0][buf] | CLASSES[9][buf])])
    small = np.concatenate([[0], np.cumsum(CLASSES[1][buf])])
    shout = (capital[ends] - capital[starts] > 1) & (small[ends] == small[starts])
    odd_end = (CLASSES[7] | CLASSES[8])[buf[ends - 1]] if len(ends) else np.zeros(0, bool)
    pairs = at.mix(words[:-1] ^ (words[1:] * at.U64(3))) if len(words) else words
    inside = owner[:-1] == owner[1:]
    breaks = np.flatnonzero(buf == 10)
    edges = np.unique(np.concatenate([off[:-1][size > 0], breaks + 1]))
    edges = edges[edges < len(buf)]
    line_end = np.append(edges[1:], len(buf)) if len(edges) else edges
    line_row = np.searchsorted(off, edges, side="right") - 1
    line_hash = at.span_hash(at.byte_prefix(buf), edges, line_end)
    lines = np.maximum(np.bincount(line_row, minlength=rows), 1).astype(float)
    return np.stack([
        np.log1p(size), np.log1p(np.diff(ptr)), np.log1p(mean), np.log1p(spread), upper, lower, digits, spaces, newlines, stops, commas, symbols, bangs, wide,
        _sums(shout, ptr) / n, _sums(odd_end, ptr) / n, bars * shares / n, _repeated(words, owner, rows) / n,
        _repeated(pairs[inside], owner[:-1][inside], rows) / n, _repeated(line_hash, line_row, rows) / lines, _sums(length > 20, ptr) / n, entropy,
        np.log1p(size / lines), brackets,
    ], axis=1)


def document_statistics(docs: DataFrame, row_no: Column | None = None) -> DataFrame:
    """row_no, doc_id and stats (array of NAMES) of each row, written once; rows without a row_no are numbered here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in at.blocks(batches):
            stats = statistics(buf, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=["row_no", "doc_id", "stats"])

    rows = docs.select((F.monotonically_increasing_id() if row_no is None else row_no).alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(run, "row_no long, doc_id long, stats array<double>"), "statistics")


class Scorer:
    """Standardisation, random features, ridge weights and calibration; everything is small and of fixed size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, WIDTH, (len(mean), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        wave = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([np.ones((len(z), 1)), wave], axis=1)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.features(stats) @ self.weights, *self.knots), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators fit of y, non-decreasing in the ascending x."""
    held: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        held.append([value, w, 1])
        while len(held) > 1 and held[-2][0] >= held[-1][0]:
            b, a = held.pop(), held.pop()
            held.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([v for v, _, _ in held], [int(n) for _, _, n in held])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, usable: Callable, features: int = FEATURES, ridge: float = RIDGE) -> Scorer:
    """A scorer learnt from the labelled rows for which usable(doc_id column) holds; labels: doc_id, quality."""
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("double").alias("y")).filter("l_id is not null and y is not null")
    marks = marks.groupBy("l_id").agg(F.avg("y").alias("y"))
    train = stats.filter(usable(F.col("doc_id"))).join(marks, F.col("doc_id") == F.col("l_id"))
    train = staged(train.select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "training")

    k = len(NAMES)
    column = [F.col("stats")[i] for i in range(k)]
    moments = train.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(column)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(column)]).first()
    if not moments["n"]:
        return Scorer(np.zeros(k), np.ones(k), features)
    scale = np.array([moments[f"s{i}"] for i in range(k)])
    scorer = Scorer(np.array([moments[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0), features)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FOLDS, features + 1, features + 2))
        for batch in batches:
            z, y, fold = scorer.features(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            zy = np.concatenate([z, y[:, None]], axis=1)
            for f in range(FOLDS):
                sums[f] += z[fold == f].T @ zy[fold == f]
        for f in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(features + 1, f, np.int32)), pa.array(np.arange(features + 1, dtype=np.int32)), pa.array(list(sums[f]), pa.list_(pa.float64()))], names=["fold", "i", "sums"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": rows["fold"].iloc[:1], "i": rows["i"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})

    parts = train.mapInArrow(equations, "fold int, i int, sums array<double>").groupBy("fold", "i").applyInPandas(added, "fold int, i int, sums array<double>")
    total = np.zeros((FOLDS, features + 1, features + 2))
    for row in parts.collect():  # FOLDS x features rows, whatever the data
        total[row["fold"], row["i"]] = row["sums"]

    def solved(m: np.ndarray) -> np.ndarray:
        left = m[:, :-1] + ridge * max(m[0, 0], 1) / features * np.diag([0.0] + [1.0] * features)
        return np.linalg.solve(left + 1e-9 * np.eye(len(left)), m[:, -1])

    unseen = [solved(total.sum(axis=0) - total[f]) for f in range(FOLDS)]
    scorer.weights = solved(total.sum(axis=0))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = scorer.features(_matrix(batch.column(0))), batch.column(2).to_numpy()
            s = np.einsum("ij,ij->i", z, np.stack(unseen)[fold])
            bin_ = np.floor(np.clip(s, -0.5, 1.5) * BINS / 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(s), batch.column(1)], names=["bin", "s", "y"])

    bins = train.mapInArrow(raw, "bin int, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    s, y, n = (bins[c].to_numpy(float) for c in ("s", "y", "n"))
    scorer.knots = (s, isotonic(s, y, n))
    return scorer


def scored(stats: DataFrame, scorer: Scorer) -> DataFrame:
    """row_no, doc_id, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scorer.scores(_matrix(batch.column(2))))], names=["row_no", "doc_id", "score"])

    return stats.mapInArrow(run, "row_no long, doc_id long, score double")


def held_out(doc_id, parts: int = 5, part: int = 0):
    """Whether crc32 of the id as text falls into the held-out part."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, row_no: Column | None = None) -> DataFrame:
    """One row per document: row_no, doc_id, held_out, score, predicted."""
    stats = document_statistics(docs, row_no)
    scorer = fit(stats, labels, lambda i: ~held_out(i))
    return scored(stats, scorer).select("row_no", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted 0, columns as they were.

    The rows are numbered in one staged table, which both the decision and the kept rows are read from.
    """
    rows = numbered(docs, "numbered")
    poor = quality(rows, labels, row_no=F.col("__row")).filter("predicted = 0").select(F.col("row_no").alias("__poor"))
    return rows.join(poor, F.col("__row") == F.col("__poor"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
