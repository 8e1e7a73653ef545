"""Scalar expressions that Spark SQL has no function for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26, an approximation of erfc to 1.5e-7.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc_positive(x: Column) -> Column:
    """erfc of x >= 0."""
    t = 1 / (1 + F.lit(ERFC_P) * x)
    poly = F.lit(ERFC_A[4])
    for a in reversed(ERFC_A[:4]):
        poly = poly * t + F.lit(a)
    return poly * t * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return erfc_positive(F.abs(z) / F.lit(math.sqrt(2.0)))


def one_sided_p(z: Column) -> Column:
    """Upper tail of a standard normal statistic."""
    return F.when(z >= 0, two_sided_p(z) / 2).otherwise(1 - two_sided_p(z) / 2)


def safe_divide(a: Column, b: Column, otherwise: float | None = None) -> Column:
    out = a / F.when(b != 0, b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def kernel(name: str, dist: Column, bandwidth: Column) -> Column:
    """Weight of a distance; compact kernels are 0 beyond the bandwidth. A bandwidth of 0 leaves weight at distance 0 only, as large as any."""
    z = F.coalesce(F.try_divide(dist, bandwidth), F.when(dist == 0, 0.0).otherwise(float("inf")))
    compact = {"triangular": 1 - z, "uniform": F.lit(0.5), "quadratic": F.lit(0.75) * (1 - z * z), "bisquare": (1 - z * z) * (1 - z * z)}
    if name in compact:
        return F.when(z <= 1, compact[name]).otherwise(0.0)
    if name == "gaussian":
        return F.exp(F.lit(-0.5) * z * z)
    if name == "exponential":
        return F.exp(-z)
    raise ValueError(f"unknown kernel {name!r}")


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def significance_stars(q: Column) -> Column:
    return F.when(q < 0.0001, "****").when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("ns")


def moments_to_nb(mean: Column, var: Column) -> tuple[Column, Column, Column]:
    """(r, theta, lambda) of a negative binomial with this mean and variance."""
    r, theta = safe_divide(mean * mean, var - mean), safe_divide(mean, var)
    return r, theta, -r * F.ln(theta)


def nb_to_moments(lam: Column, theta: Column) -> tuple[Column, Column]:
    """(mean, variance) from lambda and theta."""
    r = safe_divide(-lam, F.ln(theta))
    mean = safe_divide(r * (1 - theta), theta)
    return mean, safe_divide(mean, theta)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series after shifting the argument by 8."""
    y = x + 8
    shift = sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - shift


def nb_pmf(r: Column, p: Column, k: Column) -> Column:
    """Probability of k under a negative binomial with size r and success probability p."""
    return F.exp(log_gamma(k + r) - log_gamma(r) - log_gamma(k + 1.0) + r * F.ln(p) + k * F.log1p(-p))
