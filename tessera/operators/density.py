"""Continuous and circular state densities fitted from sums; only systems of a few unknowns reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.algebra import log_bessel_i0
from tessera.operators.conformal import circular_distance
from tessera.operators.order import weighted_quantiles


def least_squares(rows: DataFrame, features: Sequence[Column], targets: Sequence[Column], weight: Column) -> tuple[np.ndarray, float]:
    """Weighted least squares with an intercept, by normal-equation sums in one aggregate; (features + 1) x targets, and the weight."""
    x = [F.lit(1.0), *features]
    k, m = len(x), len(targets)
    sums = [F.sum(weight * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(weight * x[i] * t).alias(f"b{i}_{j}") for i in range(k) for j, t in enumerate(targets)]
    got = rows.agg(*sums).first()
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([[got[f"b{i}_{j}"] for j in range(m)] for i in range(k)])
    return np.linalg.lstsq(a, b, rcond=None)[0], float(a[0, 0])


def linear(coefficients: np.ndarray, features: Sequence[Column]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, x in zip(coefficients[1:], features, strict=True):
        out = out + float(c) * x
    return out


def gaussian_log_density(y: Column, mu: Column, sd: float) -> Column:
    z = (y - mu) / sd
    return -0.5 * z * z - math.log(sd * math.sqrt(2 * math.pi))


class GaussianModel:
    """y given features, and y alone; the spread has a floor."""

    def __init__(self, rows: DataFrame, y: Column, features: Sequence[Column], weight: Column | None = None, floor: float = 1e-6):
        w = F.lit(1.0) if weight is None else weight
        beta, total = least_squares(rows, features, [y], w)
        self.features, self.mu = features, linear(beta[:, 0], features)
        got = rows.agg((F.sum(w * y) / F.sum(w)).alias("m"), (F.sum(w * (y - self.mu) * (y - self.mu)) / F.sum(w)).alias("v")).first()
        plain = rows.agg((F.sum(w * (y - got["m"]) * (y - got["m"])) / F.sum(w)).alias("v")).first()
        self.sd, self.plain_mu, self.plain_sd = max(math.sqrt(got["v"]), floor), F.lit(float(got["m"])), max(math.sqrt(plain["v"]), floor)

    def log_density(self, y: Column) -> Column:
        return gaussian_log_density(y, self.mu, self.sd)

    def plain_log_density(self, y: Column) -> Column:
        return gaussian_log_density(y, self.plain_mu, self.plain_sd)


def concentration(r: float) -> float:
    """von Mises concentration from the mean resultant length, by the usual piecewise approximation."""
    # fixed values: coefficients and bounds of the public approximation
    r = min(max(r, 0.0), 1 - 1e-12)
    if r < 0.53:
        return 2 * r + r**3 + 5 * r**5 / 6
    if r < 0.85:
        return -0.4 + 1.39 * r + 0.43 / (1 - r)
    return min(1 / (r**3 - 4 * r**2 + 3 * r), 1e6)


class VonMisesModel:
    """Direction of a circular state given features (least squares of its cosine and sine), and alone."""

    def __init__(self, rows: DataFrame, y: Column, features: Sequence[Column], period: float = 24.0, weight: Column | None = None):
        w = F.lit(1.0) if weight is None else weight
        self.scale = 2 * math.pi / period
        angle = y * self.scale
        beta, _ = least_squares(rows, features, [F.cos(angle), F.sin(angle)], w)
        self.direction = F.atan2(linear(beta[:, 1], features), linear(beta[:, 0], features))
        c, s = F.sum(w * F.cos(angle)) / F.sum(w), F.sum(w * F.sin(angle)) / F.sum(w)
        got = rows.agg(c.alias("c"), s.alias("s"), (F.sum(w * F.cos(angle - self.direction)) / F.sum(w)).alias("r")).first()
        self.kappa = concentration(got["r"])
        self.plain_direction, self.plain_kappa = F.lit(math.atan2(got["s"], got["c"])), concentration(math.hypot(got["c"], got["s"]))

    def _density(self, y: Column, direction: Column, kappa: float) -> Column:
        return kappa * F.cos(y * self.scale - direction) - math.log(2 * math.pi) - log_bessel_i0(F.lit(kappa)) + math.log(self.scale)

    def residual_quantiles(self, rows: DataFrame, y: Column, shares: tuple[float, ...], weight: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
        """keys, share, value, n, weight: weighted quantiles of the distance between y and the predicted direction, in units of y."""
        gap = circular_distance(y, self.direction / self.scale, 2 * math.pi / self.scale)
        return weighted_quantiles(rows.withColumns({"__gap": gap, "__w": F.lit(1.0) if weight is None else weight}), "__gap", "__w", keys, shares)

    def log_density(self, y: Column) -> Column:
        return self._density(y, self.direction, self.kappa)

    def plain_log_density(self, y: Column) -> Column:
        return self._density(y, self.plain_direction, self.plain_kappa)


def joint_gain(train: DataFrame, test: DataFrame, circular: Column, value: Column, features: Sequence[Column], group: str, period: float = 24.0) -> DataFrame:
    """Per group: gain of p(t | x) p(z | x, t) over both alone, and of the coupling over p(t | x) p(z | x)."""
    angle = circular * (2 * math.pi / period)
    time = VonMisesModel(train, circular, features, period)
    coupled = GaussianModel(train, value, [*features, F.cos(angle), F.sin(angle)])
    loose = GaussianModel(train, value, features)
    joint = time.log_density(circular) + coupled.log_density(value)
    plain = time.plain_log_density(circular) + loose.plain_log_density(value)
    return test.groupBy(group).agg(F.avg(joint - plain).alias("joint_gain"), F.avg(coupled.log_density(value) - loose.log_density(value)).alias("coupling_gain"), F.count("*").alias("n"))
