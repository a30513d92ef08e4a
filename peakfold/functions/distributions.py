"""Densities and cumulative functions as expressions; Spark has no erf, so it is a fixed rational approximation here."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev coefficients of erfc (Press et al., Numerical Recipes), lowest power first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(z))
    inner = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        inner = c + t * inner
    tail = t * F.exp(-z * z + inner)
    return F.when(z >= 0, tail).otherwise(2 - tail)


def gaussian_pdf(x: Column, mean=0.0, stdev=1.0) -> Column:
    z = (x - mean) / stdev
    return F.exp(-0.5 * z * z) / (stdev * math.sqrt(2 * math.pi))


def gaussian_sf(x: Column, mean=0.0, stdev=1.0) -> Column:
    """Share of the distribution above x."""
    return 0.5 * erfc((x - mean) / stdev / math.sqrt(2))


def gaussian_cdf(x: Column, mean=0.0, stdev=1.0) -> Column:
    return 1 - gaussian_sf(x, mean, stdev)


def laplace_pdf(x: Column, mean: float = 0.0, scale: float = 1.0) -> Column:
    return F.exp(-F.abs(x - mean) / scale) / (2 * scale)


def laplace_cdf(x: Column, mean: float = 0.0, scale: float = 1.0) -> Column:
    e = 0.5 * F.exp(-F.abs(x - mean) / scale)
    return F.when(x < mean, e).otherwise(1 - e)


def cauchy_pdf(x: Column, centre: float = 0.0, width: float = 1.0) -> Column:
    z = (x - centre) / width
    return 1 / (math.pi * width * (1 + z * z))


def cauchy_cdf(x: Column, centre: float = 0.0, width: float = 1.0) -> Column:
    return F.atan((x - centre) / width) / math.pi + 0.5


def gumbel_pdf(x: Column, mode: float = 0.0, scale: float = 1.0) -> Column:
    z = (x - mode) / scale
    return F.exp(-z - F.exp(-z)) / scale


def gumbel_cdf(x: Column, mode: float = 0.0, scale: float = 1.0) -> Column:
    return F.exp(-F.exp(-(x - mode) / scale))


def uniform_pdf(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.between(low, high), F.lit(1 / (high - low))).otherwise(F.lit(0.0))


def uniform_cdf(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def gamma_pdf(x: Column, shape: float, scale: float = 1.0) -> Column:
    k = 1 / (math.gamma(shape) * scale**shape)
    return F.when(x > 0, k * F.pow(x, F.lit(shape - 1)) * F.exp(-x / scale)).otherwise(F.lit(0.0))


def cosine_gaussian_pdf(x: Column, mean: float = 0.0, stdev: float = 1.0) -> Column:
    """Cosine bell that stands in for a Gaussian; 0 beyond two standard deviations."""
    return F.when(F.abs(x - mean) <= 2 * stdev, math.pi / (8 * stdev) * F.cos((mean - x) * math.pi / (4 * stdev))).otherwise(F.lit(0.0))


def cosine_gaussian_cdf(x: Column, mean: float = 0.0, stdev: float = 1.0) -> Column:
    z = F.greatest(F.lit(-2 * stdev), F.least(F.lit(2 * stdev), x - mean))
    return 0.5 * (1 + F.sin(z * math.pi / (4 * stdev)))


def binomial_tail(n: int, p: float, x: int) -> float:
    """P(X > x) for a binomial variable, from log factorials: 1 below 0, 0 from n on."""
    if x < 0:
        return 1.0
    if x >= n:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1, n + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(v - top) for v in logs)
