"""Environmental novelty: distance of queries to their nearest reference, in standardised space, and range exceedance.

The nearest reference is found exactly, with pruning by the triangle inequality. Some references, chosen by a hash of
their ids, are pivots; every reference belongs to the cell of its nearest pivot. A query first searches its own cell,
which gives a bound, and then only those cells that a ball of that size around it can reach. Neighbouring cells are bundled
up to SIDE references, and bundles and their queries are searched in blocks of at most about SIDE by SIDE, so that a cell of
any size is many tasks, and vectors without structure, which reach all cells, are sent once for each block and not for each cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.order import order_statistic

SIDE, PIVOTS = 8192, 256
ASKING = 1024  # queries whose ways are told at a time
SLACK = 1e-9  # of the distances compared, against rounding


def standardised(rows: DataFrame, reference: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and z: the vector in units of the reference's population spread; constant dimensions keep a scale of 1."""
    parts = reference.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    scale = parts.select("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"), "lo", "hi")
    ranges = scale.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s", "lo", "hi"))).alias("__r"))  # one row, an entry for each dimension
    held = rows.select(F.col(id_).alias("id"), F.col(vector).alias("__v")).crossJoin(F.broadcast(ranges))
    beyond = F.transform("__v", lambda v, i: (v < F.get("__r", i)["lo"]) | (v > F.get("__r", i)["hi"]))
    return held.select("id", F.transform("__v", lambda v, i: (v - F.get("__r", i)["m"]) / F.get("__r", i)["s"]).alias("z"), F.exists(beyond, lambda x: F.coalesce(x, F.lit(False))).alias("outside"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, by subtraction (free of cancellation), some rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 22) // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None] - y[None]) ** 2).sum(axis=2))
    return out


def _least(x: np.ndarray, y: np.ndarray, qid: np.ndarray, rid: np.ndarray, skip_same_id: bool) -> np.ndarray:
    """Per row of x the least squared distance to a row of y; infinity if none is left."""
    # |x - y|^2 by one matrix product leaves the few that rounding can't tell from the nearest; those are measured
    nx, ny = (x**2).sum(axis=1), (y**2).sum(axis=1)
    squared = nx[:, None] - 2 * (x @ y.T) + ny
    if skip_same_id:
        squared[qid[:, None] == rid] = np.inf
    room = 1e-12 * (nx + ny.max())
    i, j = np.nonzero((squared <= (squared.min(axis=1) + room)[:, None]) & np.isfinite(squared))
    if len(i) > 4 * len(x):  # copies of a reference are measured once
        first = pd.factorize(np.array([v.tobytes() for v in y], object))[0]
        i, kind = np.divmod(np.unique(i * len(y) + first[j]), len(y))
        j = np.unique(first, return_index=True)[1][kind]
    d, step = np.full(len(x), np.inf), max(1, (1 << 20) // x.shape[1])
    for k in range(0, len(i), step):
        np.minimum.at(d, i[k : k + step], ((x[i[k : k + step]] - y[j[k : k + step]]) ** 2).sum(axis=1))
    return d


class Cells:
    """The references dealt to cells: pivots (a bounded number, on the driver), and radius, size and bundle of each cell."""

    def __init__(self, reference: DataFrame, pivots: int = PIVOTS):
        chosen = reference.select("id", "z").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
        self.ids, self.pivots = np.array([r["id"] for r in chosen], np.int64), np.array([r["z"] for r in chosen], float)
        if not len(self.ids):
            return
        self.rows = cut(self._placed(reference.select("id", "z")))
        facts = {r["cell"]: (r["radius"], r["n"]) for r in self.rows.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}  # at most as many as pivots
        self.radius = np.array([facts.get(k, (-1.0, 0))[0] for k in range(len(self.ids))])
        self.size = np.array([facts.get(k, (-1.0, 0))[1] for k in range(len(self.ids))])
        self.bundle = self._bundled()

    def _bundled(self) -> np.ndarray:
        """Per cell the number of its bundle: neighbouring cells of at most SIDE references together, or one larger cell; -1 if it is empty."""
        bundle, left, room, number = np.full(len(self.ids), -1), self.size > 0, 0, -1
        k = int(np.argmax(left))
        while True:
            if self.size[k] > room:
                number, room = number + 1, SIDE
            bundle[k], room, left[k] = number, room - int(self.size[k]), False
            if not left.any():
                return bundle
            k = int(np.argmin(np.where(left, _distances(self.pivots[k : k + 1], self.pivots)[0], np.inf)))

    def _placed(self, rows: DataFrame, skip_same_id: bool = False) -> DataFrame:
        """id, z, cell (of the nearest pivot), gap (its distance), bound (distance of the nearest pivot that is not the row itself)."""
        ids, pivots = self.ids, self.pivots

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    d = _distances(np.stack(rows["z"].to_list()), pivots)
                    other = np.where(rows["id"].to_numpy()[:, None] == ids, np.inf, d) if skip_same_id else d
                    yield rows.assign(cell=d.argmin(axis=1).astype(np.int32), gap=d.min(axis=1), bound=other.min(axis=1))

        return rows.mapInPandas(place, "id long, z array<double>, cell int, gap double, bound double")

    def _asked(self, rows: DataFrame, reach: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
        """id, z, bundle, reach (the cells asked for, a bit each): a row for each bundle that holds a cell asked for.

        A query's vector so travels once for each SIDE references, not once for each cell.
        """
        of = (self.bundle[:, None] == np.arange(self.bundle.max() + 1)).astype(np.float32)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ASKING):
                    rows = batch.iloc[at : at + ASKING]
                    near = reach(rows)
                    i, k = np.nonzero(near.astype(np.float32) @ of)
                    bits = np.array([b.tobytes() for b in np.packbits(near, axis=1)], object)
                    ids, z = rows["id"].to_numpy(), rows["z"].to_numpy()
                    for j in range(0, len(i), 16 * ASKING):
                        part = slice(j, j + 16 * ASKING)
                        yield pd.DataFrame({"id": ids[i[part]], "z": z[i[part]], "bundle": k[part].astype(np.int32), "reach": bits[i[part]]})

        return rows.select("id", "z", "cell", "gap", "bound").mapInPandas(ask, "id long, z array<double>, bundle int, reach binary")

    def _search(self, asked: DataFrame, skip_same_id: bool) -> DataFrame:
        """asked, as of _asked -> id, distance to the nearest reference of the cells asked for."""
        sizes = {r["bundle"]: r["n"] for r in asked.groupBy("bundle").agg(F.count("*").alias("n")).collect()}  # at most as many as pivots
        cells, held = len(self.ids), np.bincount(self.bundle[self.bundle >= 0], self.size[self.bundle >= 0])
        table = [(k, max(1, -(-n // SIDE)), max(1, -(-int(held[k]) // SIDE))) for k, n in sizes.items()]
        spark = asked.sparkSession
        blocks = F.broadcast(spark.createDataFrame(table, "bundle int, nq int, nr int"))
        bundles = F.broadcast(spark.createDataFrame([(k, int(b)) for k, b in enumerate(self.bundle)], "cell int, bundle int"))
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
        q = asked.join(blocks, "bundle").select("id", "z", F.lit(-1).alias("cell"), "reach", "bundle", dealt("nq").alias("qb"), every("nr").alias("rb"))
        r = self.rows.join(bundles, "cell").join(blocks, "bundle").select("id", "z", "cell", F.lit(None).cast("binary").alias("reach"), "bundle", every("nq").alias("qb"), dealt("nr").alias("rb"))

        def block(rows: pd.DataFrame) -> pd.DataFrame:
            cell = rows["cell"].to_numpy()
            a, b = rows[cell < 0], rows[cell >= 0]
            if not len(a) or not len(b):
                return pd.DataFrame({"id": [], "distance": []})
            x, y = np.stack(a["z"].to_list()), np.stack(b["z"].to_list())
            near = np.unpackbits(np.frombuffer(b"".join(a["reach"]), np.uint8).reshape(len(a), -1), axis=1, count=cells)
            own, qid, rid, d = b["cell"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy(), np.full(len(x), np.inf)
            for k in np.unique(own):
                j = np.flatnonzero(own == k)
                i = np.flatnonzero(near[:, k])
                step = max(1, (1 << 20) // len(j))
                for at in range(0, len(i), step):
                    part = i[at : at + step]
                    d[part] = np.minimum(d[part], _least(x[part], y[j], qid[part], rid[j], skip_same_id))
            return pd.DataFrame({"id": qid, "distance": np.sqrt(d)})

        return q.unionByName(r).groupBy("bundle", "qb", "rb").applyInPandas(block, "id long, distance double").groupBy("id").agg(F.min("distance").alias("distance"))

    def _own(self, rows: pd.DataFrame) -> np.ndarray:
        near = np.zeros((len(rows), len(self.ids)), bool)
        near[np.arange(len(rows)), rows["cell"].to_numpy()] = True
        return near & (self.size > 0)

    def _further(self, rows: pd.DataFrame) -> np.ndarray:
        """The cells, apart from the own one, that the bound reaches."""
        d, bound, cell = _distances(np.stack(rows["z"].to_list()), self.pivots), rows["bound"].to_numpy()[:, None], rows["cell"].to_numpy()
        slack = SLACK * (1 + d)
        near = (d - self.radius <= bound + slack) & ((d - rows["gap"].to_numpy()[:, None]) / 2 <= bound + slack) & (self.size > 0)
        near[np.arange(len(rows)), cell] = False
        return near

    def _local(self) -> Cells:
        """What tasks need of it."""
        out = object.__new__(Cells)
        out.ids, out.pivots, out.radius, out.size, out.bundle = self.ids, self.pivots, self.radius, self.size, self.bundle
        return out

    def reached(self, queries: DataFrame, skip_same_id: bool = False) -> tuple[DataFrame, DataFrame]:
        """(bounds: id, bound after the own cell; asked: id, z, bundle, reach of the further cells that the bound reaches)."""
        local = self._local()
        placed = cut(self._placed(queries.select("id", "z"), skip_same_id))
        own = self._search(self._asked(placed, local._own), skip_same_id).withColumnRenamed("distance", "own")
        bounds = cut(placed.join(own, "id", "left").withColumn("bound", F.least("bound", F.coalesce("own", "bound"))).drop("own"))
        return bounds, self._asked(bounds, local._further)

    def compared(self, queries: DataFrame, skip_same_id: bool = False) -> int:
        """How many pairs of a query and a reference are compared (pivots left out), of all len(queries) * len(reference)."""
        local, (bounds, _) = self._local(), self.reached(queries, skip_same_id)

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    yield pd.DataFrame({"n": ((local._own(rows) | local._further(rows)) @ local.size).astype(np.int64)})

        return bounds.mapInPandas(pairs, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def nearest(self, queries: DataFrame, skip_same_id: bool = False) -> DataFrame:
        if not len(self.ids):
            return queries.select("id").distinct().withColumn("distance", F.lit(float("inf")))
        bounds, asked = self.reached(queries, skip_same_id)
        found = bounds.select("id", F.col("bound").alias("distance")).unionByName(self._search(asked, skip_same_id))
        return found.groupBy("id").agg(F.min("distance").alias("distance"))


def nearest(queries: DataFrame, reference: DataFrame, skip_same_id: bool = False) -> DataFrame:
    """id, z in both -> per query id its least Euclidean distance to a reference (another one, if skip_same_id); infinity if there is none."""
    return Cells(reference).nearest(queries, skip_same_id)


def novelty(queries: DataFrame, reference: DataFrame, id_: str, vector: str, level: float = 0.95) -> DataFrame:
    """Per query: distance to the nearest reference, the reference's own "higher" quantile of nearest distances, and a label."""
    zq, zr = cut(standardised(queries, reference, id_, vector)), cut(standardised(reference, reference, id_, vector))
    cells = Cells(zr)
    own = cut(cells.nearest(zr, skip_same_id=True))
    limit = order_statistic(own, "distance", (), level, lambda n: F.ceil((n - 1) * level) + 1).select(F.col("value").alias("limit"))
    rows = cells.nearest(zq).join(zq.select("id", "outside"), "id").crossJoin(F.broadcast(limit))
    label = F.when((F.col("distance") > F.col("limit")) & F.col("outside"), "novel").when(F.col("distance") > F.col("limit"), "distant").when(F.col("outside"), "out_of_range").otherwise("familiar")
    return rows.select("id", "distance", "limit", "outside", label.alias("label"))
