"""Weighted random forests on counted cells: rows of one label, weight and bins meet before any tree is grown.

A tree sees a row only by its bins, and the sum of n draws of a Poisson(1) is one draw of a Poisson(n). So a cell of n rows
has the same bags as its rows had one by one, and work after the counting does not grow with the rows once all cells are
filled. Where all rows differ, cells are the rows, and stay as many rows of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.lineage import cut

#: Trees of a forest, splits above a leaf, bins of a feature; quantiles from which bins are made; bytes of a task's sums.
TREES, DEPTH, BINS, POINTS, ROOM = 50, 6, 32, 255, 1 << 28
#: Share of a node's weight by which gains must differ beyond rounding.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Forests:
    """Forests x trees x nodes; node i has the children 2i + 1 (bins up to `last`) and 2i + 2. Leaves have feature -1."""

    feature: np.ndarray
    last: np.ndarray
    share: np.ndarray  # of each label, in nodes that rows reach

    def reached(self, of: int, trees: slice, bins: np.ndarray, splits: int = DEPTH) -> np.ndarray:
        """Rows x trees: the node that a row of bins reaches in at most so many splits."""
        feature, last = self.feature[of, trees], self.last[of, trees]
        every, at = np.arange(len(feature)), np.zeros((len(bins), len(feature)), dtype=np.int64)
        for _ in range(splits):
            f = feature[every, at]
            right = np.take_along_axis(bins, np.maximum(f, 0), axis=1) > last[every, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


def few_valued(rows: DataFrame, features: tuple[str, ...]) -> set[str]:
    """The features that may have no more values than bins."""
    n = rows.agg(*[F.approx_count_distinct(F.col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(features)]).first()
    return {c for i, c in enumerate(features) if n[i] <= BINS + 8}


def sketched(weighted: DataFrame, fold: str, features: tuple[str, ...], few: set[str]) -> list:
    """Per fold and size of the training weight, to about a fifth: its sum, and each feature's quantiles, greatest and few values."""
    held = weighted.filter("training_weight > 0").select(F.col(fold).alias("fold"), F.col("training_weight").cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    shares = F.array(*[F.lit(k / (POINTS + 1)) for k in range(1, POINTS + 1)])
    asked = [F.sum("w").alias("mass")]
    for i, c in enumerate(features):
        asked += [F.percentile_approx(f"x{i}", shares, 4096).alias(f"q{i}"), F.max(f"x{i}").alias(f"high{i}")]
        asked += [F.collect_set(f"x{i}").alias(f"set{i}")] if c in few else []
    return held.groupBy("fold", F.floor(4 * F.log2("w")).alias("size")).agg(*asked).collect()  # a few rows of few points


def cut_points(sketches: list, features: tuple[str, ...], few: set[str]) -> list[list[float]]:
    """Per feature, the values up to which its bins but the last go: between all values if they are few, else at quantiles by weight."""
    if not sketches:
        raise ValueError("a fold leaves no training rows of positive weight")
    mass = np.repeat([r["mass"] for r in sketches], POINTS) / POINTS
    found = []
    for i, c in enumerate(features):
        values = sorted({v for r in sketches for v in r[f"set{i}"]}) if c in few else []
        if values and len(values) <= BINS:
            between = [(a, a / 2 + b / 2, b) for a, b in zip(values, values[1:])]
            found.append([mid if a < mid < b else a for a, mid, b in between])
            continue
        points = np.concatenate([r[f"q{i}"] for r in sketches])
        order = np.argsort(points, kind="stable")
        below = np.cumsum(mass[order]) * (1 + LEAST_GAIN)
        at = np.searchsorted(below, np.arange(1, BINS) / BINS * mass.sum())
        high = max(r[f"high{i}"] for r in sketches)
        found.append(sorted({float(v) for v in points[order][np.minimum(at, len(points) - 1)] if v < high}))
    return found


def binned(rows: DataFrame, features: tuple[str, ...], cuts: list[list[float]]) -> DataFrame:
    """The rows with columns __b0, __b1, ... of bins: how many cuts of a feature its value exceeds."""
    rows = rows.withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(features)})
    cutting = [i for i, c in enumerate(cuts) if c]
    if cutting:  # a bucket holds its lower end, a bin its upper one
        ends = [[float("-inf"), *np.nextafter(cuts[i], np.inf).tolist(), float("inf")] for i in cutting]
        rows = Bucketizer(inputCols=[f"__x{i}" for i in cutting], outputCols=[f"__y{i}" for i in cutting], splitsArray=ends).transform(rows)
    return rows.withColumns({f"__b{i}": F.col(f"__y{i}").cast("byte") if cuts[i] else F.lit(0).cast("byte") for i in range(len(features))})


def _bagged(cells: DataFrame, d: int, seed: int) -> DataFrame:
    """The cells without their weights, with columns t0, t1, ...: the weight of their rows in the bag of each tree."""
    bins, trees = [f"__b{i}" for i in range(d)], [f"t{t}" for t in range(TREES)]

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = np.random.Philox(key=0)
        fresh, generator = source.state, np.random.Generator(source)
        for batch in batches:
            bags = np.empty((len(batch), TREES))
            for row, (key, n) in enumerate(zip(batch["key"].to_numpy().view(np.uint64), batch["__n"].to_numpy())):
                fresh["state"]["key"][0] = key  # a cell's draws are its own, whichever task makes them
                source.state = fresh
                bags[row] = generator.poisson(n, TREES)
            bags *= batch["training_weight"].to_numpy()[:, None]
            yield pd.concat([batch[["__of", "__label", *bins]], pd.DataFrame(bags, columns=trees, index=batch.index)], axis=1)

    kinds = ", ".join(["__of int", "__label int", *[f"{b} byte" for b in bins], *[f"{t} double" for t in trees]])
    keyed = cells.withColumn("key", F.xxhash64(F.lit(seed), "__of", "__label", "training_weight", *bins))
    return keyed.mapInPandas(drawn, kinds).groupBy("__of", "__label", *bins).agg(*[F.sum(t).alias(t) for t in trees])


def _best_splits(sums: np.ndarray, chosen: np.ndarray) -> Iterable[tuple]:
    """(node of the level, feature or -1, last bin of the left, labels' weights left and right) from nodes x features x bins x labels."""
    left, right = sums.cumsum(axis=2)[:, :, :-1], sums[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]
    purity = lambda c: (c * c).sum(axis=-1) / np.maximum(c.sum(axis=-1), np.finfo(float).tiny)
    whole = sums[:, 0].sum(axis=1)
    gain = purity(left) + purity(right) - purity(whole)[:, None, None]
    for node in np.flatnonzero(whole.sum(axis=1) > 0):
        least = LEAST_GAIN * whole[node].sum()
        # of splits that gain the same the first: sums in another order must not decide
        slot, last = np.unravel_index((gain[node] >= gain[node].max() - least).argmax(), gain[node].shape)
        splits = gain[node, slot, last] > least
        yield int(node), int(chosen[node, slot]) if splits else -1, int(last), (left[node, slot, last] if splits else whole[node]).tolist(), (right[node, slot, last] if splits else 0 * whole[node]).tolist()


def _level(bagged: DataFrame, forests: Forests, chosen: np.ndarray, level: int, trees: slice) -> list:
    """The best splits of a level's nodes in some trees of all forests."""
    first, width, labels = 2**level - 1, 2**level, forests.share.shape[-1]
    m = chosen.shape[-1]
    names, bags = [f"__b{i}" for i in range(sum(c.startswith("__b") for c in bagged.columns))], [f"t{t}" for t in range(TREES)[trees]]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for of, part in batch.groupby("__of"):
                bins, label = part[names].to_numpy().astype(np.int64), part["__label"].to_numpy()
                at, weight = forests.reached(of, trees, bins, level) - first, part[bags].to_numpy()
                for j, tree in enumerate(range(TREES)[trees]):
                    live = np.flatnonzero((at[:, j] >= 0) & (weight[:, j] > 0))  # others are in leaves, or not in the bag
                    node = at[live, j]
                    seen = np.take_along_axis(bins[live], chosen[of, tree, first + node], axis=1)
                    place = ((node[:, None] * m + np.arange(m)) * BINS + seen) * labels + label[live, None]
                    one = np.bincount(place.ravel(), np.repeat(weight[live, j], m), minlength=width * m * BINS * labels)
                    total[of, tree] = total.get((of, tree), 0) + one
        yield pd.DataFrame([(of, tree, s.tobytes()) for (of, tree), s in total.items()], columns=["__of", "tree", "sums"])

    def best(part: pd.DataFrame) -> pd.DataFrame:
        of, tree = int(part["__of"].iloc[0]), int(part["tree"].iloc[0])
        sums = np.sum([np.frombuffer(s) for s in part["sums"]], axis=0).reshape(width, m, BINS, labels)
        found = _best_splits(sums, chosen[of, tree, first : first + width])
        return pd.DataFrame([(of, tree, *s) for s in found], columns=["__of", "tree", "node", "feature", "last", "left", "right"])

    parts = bagged.select("__of", "__label", *names, *bags).mapInPandas(summed, "__of int, tree int, sums binary")
    return parts.groupBy("__of", "tree").applyInPandas(best, "__of int, tree int, node int, feature int, last int, left array<double>, right array<double>").collect()  # nodes of a level


def grown(cells: DataFrame, n_forests: int, d: int, n_labels: int, seed: int) -> Forests:
    """A forest for each __of from cells of __label, training_weight, bins and __n: one job for a level of all trees.

    Splits are by weighted Gini impurity over all bins of about the square root of d features, drawn for each node.
    """
    bagged, nodes, m = cut(_bagged(cells, d, seed)), 2 ** (DEPTH + 1) - 1, int(np.ceil(np.sqrt(d)))
    shape = (n_forests, TREES, nodes)
    chosen = np.random.default_rng(seed).random((*shape, d)).argsort(axis=-1)[..., :m]
    forests = Forests(np.full(shape, -1), np.zeros(shape, dtype=np.int64), np.zeros((*shape, n_labels)))
    for level in range(DEPTH):
        step = int(max(1, min(TREES, ROOM // (8 * n_forests * 2**level * m * BINS * n_labels))))
        splits = 0
        for start in range(0, TREES, step):
            for r in _level(bagged, forests, chosen, level, slice(start, min(start + step, TREES))):
                node, left, right = 2**level - 1 + r["node"], np.array(r["left"]), np.array(r["right"])
                forests.share[r["__of"], r["tree"], node] = (left + right) / (left + right).sum()
                if r["feature"] >= 0:
                    splits += 1
                    forests.feature[r["__of"], r["tree"], node], forests.last[r["__of"], r["tree"], node] = r["feature"], r["last"]
                    forests.share[r["__of"], r["tree"], 2 * node + 1 : 2 * node + 3] = left / left.sum(), right / right.sum()
        if not splits:
            break
    return forests


def predicted(cells: DataFrame, forests: Forests, d: int) -> DataFrame:
    """The cells with p_model: the mean share of their label in the leaves that they reach in their forest."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(TREES)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            bins, label, of = np.stack([column(f"__b{i}") for i in range(d)], axis=1).astype(np.int64), column("__label"), column("__of")
            p = np.zeros(len(label))
            for k in np.unique(of):
                mine = np.flatnonzero(of == k)
                at = forests.reached(k, slice(None), bins[mine])
                grew = (forests.share[k, :, 0].sum(axis=-1) > 0).sum()  # a bag may be empty
                p[mine] = forests.share[k][every, at, label[mine, None]].sum(axis=1) / max(grew, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p_model"])

    return cells.mapInArrow(scored, StructType([*cells.schema, StructField("p_model", DoubleType())]))


def cross_fitted(rows: DataFrame, trains: dict, weighted: DataFrame | None, states: list, state: str, fold: str, by: tuple[str, ...], features: tuple[str, ...], seed: int) -> DataFrame:
    """Cells of the rows by fold, `by` and state, with their weight w and p_model of the forest of trains[fold].

    trains: for each fold, its training rows with a column training_weight; weighted: all rows with that column, if it is
    the same for every fold; states: all of them. Weightless rows have cells of their own.
    """
    label = (F.array_position(F.array(*[F.lit(s) for s in states]), F.col(state)) - 1).cast("int").alias("__label")
    few, bins = few_valued(rows, features), [f"__b{i}" for i in range(len(features))]
    learned = asked = None
    shared = None if weighted is None else sketched(weighted, fold, features, few)
    for of, (held, train) in enumerate(trains.items()):
        sketches = sketched(train, fold, features, few) if shared is None else [r for r in shared if r["fold"] != held]
        cuts = cut_points(sketches, features, few)
        one = binned(train.filter("training_weight > 0").withColumn("training_weight", F.col("training_weight").cast("double")), features, cuts)
        one = one.groupBy(state, "training_weight", *bins).agg(F.count("*").alias("__n")).select(F.lit(of).alias("__of"), label, "training_weight", *bins, "__n")
        test = binned(rows.filter(F.col(fold) == held), features, cuts).groupBy(fold, *by, state, (F.col("w") > 0).alias("__weighs"), *bins).agg(F.sum("w").alias("w"))
        test = test.select(fold, *by, state, "w", F.lit(of).alias("__of"), label, *bins)
        learned, asked = (one, test) if learned is None else (learned.unionByName(one), asked.unionByName(test))
    forests = grown(learned, len(trains), len(features), len(states), seed)
    return predicted(asked, forests, len(features)).select(fold, *by, state, "w", "p_model")
