"""Distribution functions as columns and as numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_STANDARD = NormalDist()

#: Chebyshev coefficients of the complementary error function,
#: constant term first; fractional error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

#: 95% points of chi-square with 1 and 2 degrees of freedom.
CHI2_95 = {1: 3.841458820694124, 2: 5.991464547107979}


def z(alpha: float) -> float:
    return _STANDARD.inv_cdf(alpha)


def tail_density(alpha: float) -> float:
    """phi(z_alpha) / alpha."""
    return _STANDARD.pdf(z(alpha)) / alpha


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi-square with 1 or 2 degrees of freedom > x); null and infinity as
    they come (infinity: 0)."""
    if df == 2:
        return F.exp(-x / 2)
    v = F.sqrt(x / 2)
    t = 1 / (1 + 0.5 * v)
    p = F.lit(0.0)
    for c in reversed(ERFC):
        p = p * t + F.lit(c)
    return F.when(x == float("inf"), 0.0).otherwise(t * F.exp(-v * v + p))


def chi2_tail_number(x: float, df: int) -> float:
    return math.exp(-x / 2) if df == 2 else math.erfc(math.sqrt(x / 2))


def log_or_floor(x: Column) -> Column:
    """ln x, or -1e10 where x is not positive."""
    return F.when(x > 0, F.log(x)).otherwise(F.lit(-1e10))


def skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected from the population moment; null under 3 rows."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def excess_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected from the population moment; null under 4 rows."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
