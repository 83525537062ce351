"""Column algebra for scores and masses, with the rules for zero mass and minus infinity in one place."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_INFINITY = float("-inf")


def rounded(column: Column, digits: int = 9) -> Column:
    return F.round(column, digits)


def entropy(mass: Column) -> Column:
    """Aggregate: entropy in nats of masses that need not be normalised; cells without mass add nothing."""
    total = F.sum(mass)
    inner = F.sum(F.when(mass > 0, mass * F.ln(mass)).otherwise(0.0))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.ln(total) - inner / total))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: minus infinity if any row of positive weight has it; rows of zero weight are ignored."""
    live = weight > 0
    total = F.sum(F.when(live, weight).otherwise(0.0))
    poisoned = F.max(F.when(live & (value == MINUS_INFINITY), 1).otherwise(0)) == 1
    finite = F.sum(F.when(live & (value != MINUS_INFINITY), weight * value).otherwise(0.0))
    return F.when(total <= 0, F.lit(None).cast("double")).when(poisoned, F.lit(MINUS_INFINITY)).otherwise(finite / total)


def log_or_failure(probability: Column) -> Column:
    """ln p, with minus infinity where p is 0: a legal predictive failure, never null."""
    return F.when(probability > 0, F.ln(probability)).otherwise(F.lit(MINUS_INFINITY))


def gain_category(gain: Column, tolerance: float = 1e-9) -> Column:
    """Aggregate over groups: generalizing if all gains exceed the tolerance, non_generalizing if none does, else mixed."""
    return F.when(F.min(gain) > tolerance, "generalizing").when(F.max(gain) <= tolerance, "non_generalizing").otherwise("mixed")


def interval_status(lower: Column, upper: Column, tolerance: float = 0.0) -> Column:
    """Sign of an interval; one without bounds (null, or NaN as of infinity less infinity) is unavailable."""
    unknown = lower.isNull() | upper.isNull() | F.isnan(lower) | F.isnan(upper)
    return F.when(unknown, "unavailable").when(lower > tolerance, "robust_positive").when(upper <= tolerance, "robust_nonpositive").otherwise("uncertain")


def counter_draw(size: Column, *parts: Column | str) -> Column:
    """A pick in 0..size-1 that any engine can repeat: 48 bits of the MD5 of the parts, modulo size."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 12), 16, 10).cast("long")
    return F.pmod(bits, size)


def log_bessel_i0(x: Column) -> Column:
    """ln I0(x) by the standard two-range polynomial approximation (absolute error below 2e-7)."""
    # fixed values: coefficients of the public approximation in handbooks of mathematical functions
    small = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
    large = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)
    t, u = x / 3.75, F.lit(3.75) / F.greatest(x, F.lit(3.75))
    low = sum((F.lit(c) * F.pow(t, F.lit(2 * k)) for k, c in enumerate(small)), F.lit(0.0))
    high = sum((F.lit(c) * F.pow(u, F.lit(k)) for k, c in enumerate(large)), F.lit(0.0))
    return F.when(x <= 3.75, F.ln(low)).otherwise(x - 0.5 * F.ln(F.greatest(x, F.lit(3.75))) + F.ln(high))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution, by bisection of erf."""
    low, high = -12.0, 12.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (low, mid)
    return (low + high) / 2


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    term = total = 1.0
    n = 0
    while abs(term) > 1e-17 * abs(total) and n < 10_000:
        term *= (a + b + n) * x / (a + 1 + n)
        total += term
        n += 1
    return front * total


def t_quantile(p: float, df: float) -> float:
    """Inverse of Student's t distribution, by bisection of its cumulative form."""

    def below(t: float) -> float:
        tail = 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t))
        return 1 - tail if t > 0 else tail

    low, high = -1e6, 1e6
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2
