"""Scalar column functions. Undefined results are null: no infinities, no NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN read as null."""
    return F.when(~F.isnan(x), x)


def ratio(num: Column, den: Column, floor: float = 0.0) -> Column:
    """num / den where abs(den) is over the floor."""
    return F.when(F.abs(den) > floor, F.try_divide(num, den))


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """x held in [lo, hi]; null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def nearest(x: Column, digits: int = 6) -> Column:
    """x rounded half away from zero as the SQL does, in doubles; ``round`` goes through a decimal for each row."""
    y = x * 10.0**digits
    whole = F.when(y < 0, -F.floor(0.5 - y)).otherwise(F.floor(y + 0.5))
    return F.when(F.abs(y) < 2.0**52, whole / 10.0**digits).otherwise(x)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


# Coefficients of the usual polynomial for the normal distribution (Abramowitz and Stegun 26.2.17, error
# below 7.5e-8) and of Acklam's rational functions for its inverse (relative error below 1.2e-9), highest power first.
CDF_STEP = 0.2316419
CDF = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0)
MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
EDGE = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, to 7.5e-8."""
    t = 1 / (1 + CDF_STEP * F.abs(x))
    tail = normal_pdf(x) * _poly(t, CDF)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution for a number in (0, 1)."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def normal_quantile_column(p: Column) -> Column:
    """The same for a column; null outside (0, 1)."""
    low = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.ln(low))
    tail = _poly(q, TAIL[0]) / _poly(q, TAIL[1])
    m = p - 0.5
    middle = m * _poly(m * m, MIDDLE[0]) / _poly(m * m, MIDDLE[1])
    return F.when((p > 0) & (p < 1), F.when(low >= EDGE, middle).when(p < 0.5, tail).otherwise(-tail))
