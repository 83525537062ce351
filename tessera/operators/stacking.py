"""Log-score stacking: mixture weights of fixed forecasts that maximise the mean log density of the mixture.

The problem is concave in a few weights. One pass over the rows gives, at the present weights, the step of expectation
maximisation, and the second moments of the responsibilities, which are all that a quadratic model of the objective
needs. The model's best point on the simplex is found on the driver, over as many numbers as there are forecasts; a
second pass scores the whole of that step, parts of it and the plain step together, and the best is taken. Rounds grow
neither with the rows nor with how flat the objective is, as those of plain expectation maximisation do; weights that
belong on the boundary get there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = (1.0, 0.5, 0.25, 0.0625, 0.0)  # of the model's step; 0 stands for the plain step


def _simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex."""
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)


def _best_of_model(s: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The point x of the simplex with the least -g(x - s) + (x - s)h(x - s) / 2; h is positive semidefinite."""
    step = 1 / max(np.linalg.eigvalsh(h)[-1], 1e-300)
    x, y, t = s, s, 1.0
    for _ in range(2000):
        new = _simplex(y - step * (h @ (y - s) - g))
        again = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / again * (new - x), again
    free = np.flatnonzero(x > 1e-9)
    left = np.block([[h[np.ix_(free, free)], np.ones((len(free), 1))], [np.ones((1, len(free))), np.zeros((1, 1))]])
    right = np.append((g + h @ s)[free], 1.0)
    exact = np.linalg.lstsq(left, right, rcond=None)[0][:-1]
    if (exact >= 0).all() and abs(exact.sum() - 1) < 1e-9:  # on its face the model's optimum solves equations
        x = np.zeros(len(s))
        x[free] = exact
    return x


def stack(scores: DataFrame, models: Sequence[str], weight: str | None = None, tolerance: float = 1e-12, rounds: int = 100) -> DataFrame:
    """scores: one log density column per model. One row per model: model, weight (on the simplex; starts from equal
    weights), converged, rounds, mean_log_density of the mixture and equal_log_density of equal weights.

    converged: a further step of expectation maximisation would move no weight by more than the tolerance, and none that
    is 0 would gain by leaving it. Rows without weight, and rows to which every model gives no density (which no mixture can mend), do not take
    part in the fit; the latter make both mean densities minus infinity. Without rows the weights stay equal.
    """
    k = len(models)
    top = F.greatest(*models) if k > 1 else F.col(models[0])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = scores.select(w.alias("w"), top.alias("top"), *[F.col(m).alias(f"m{i}") for i, m in enumerate(models)]).filter("w > 0")
    dead = rows.filter(F.col("top") == float("-inf")).limit(1).count() > 0
    rows = rows.filter(F.col("top") > float("-inf")).select("w", "top", *[F.exp(F.col(f"m{i}") - F.col("top")).alias(f"m{i}") for i in range(k)]).cache()
    mixed = lambda s: sum((F.lit(float(x)) * F.col(f"m{i}") for i, x in enumerate(s)), F.lit(0.0))
    gain = lambda s: F.sum(F.col("w") * F.when(mixed(s) > 0, F.ln(mixed(s))).otherwise(float("-inf")))

    def at(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean responsibilities per unit of weight and their second moments."""
        ratio: list[Column] = [F.col(f"m{i}") / mixed(s) for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = rows.agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * r) for r in ratio], *[F.sum(F.col("w") * ratio[i] * ratio[j]) for i, j in pairs]).first()
        n = got[0]
        if n is None:
            return np.ones(k), np.zeros((k, k))
        h = np.zeros((k, k))
        for (i, j), value in zip(pairs, got[k + 1 :], strict=True):
            h[i, j] = h[j, i] = value / n
        return np.array(got[1 : k + 1]) / n, h

    share, done, used = np.full(k, 1 / k), False, 0
    g, h = at(share)
    while not done and used < rounds:
        used += 1
        plain = share * g / np.sum(share * g)
        done = bool(np.max(np.abs(plain - share)) <= tolerance and np.all(g[share == 0] <= 1 + 1e-9))
        if done:
            break
        target = _best_of_model(share, g, h)
        tried = [plain if p == 0 else share + p * (target - share) for p in PARTS]
        found = rows.agg(*[gain(s) for s in tried]).first()
        share = tried[int(np.argmax([-np.inf if x is None else x for x in found]))]
        share = np.maximum(share, 0) / np.maximum(share, 0).sum()
        g, h = at(share)
    both = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("top")), gain(share), gain(np.full(k, 1 / k))).first()
    rows.unpersist()
    means = [None if both[0] is None else (float("-inf") if dead else (both[1] + x) / both[0]) for x in both[2:]]
    out = [(m, float(x), done, used, *means) for m, x in zip(models, share, strict=True)]
    return scores.sparkSession.createDataFrame(out, "model string, weight double, converged boolean, rounds int, mean_log_density double, equal_log_density double")


def mixture_gain(scores: DataFrame, weights: DataFrame, models: Sequence[str], group: str) -> DataFrame:
    """Per group: mean log density of the mixture and its gain over the best single model of the group."""
    w = {r["model"]: r["weight"] for r in weights.collect()}  # one row per model
    top = F.greatest(*models) if len(models) > 1 else F.col(models[0])
    mixed = top + F.ln(sum((w[m] * F.exp(F.col(m) - top) for m in models), F.lit(0.0)))
    best = F.greatest(*[F.avg(m) for m in models]) if len(models) > 1 else F.avg(models[0])
    return scores.groupBy(group).agg(F.avg(mixed).alias("mixture_score"), (F.avg(mixed) - best).alias("gain_over_best"))
