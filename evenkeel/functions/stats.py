"""p-values for the association scans (T1, T2) without scipy.

These run as Arrow-batched pandas UDFs over the already-aggregated
statistics (one row per feature), never over raw rows.

Algorithms: regularised incomplete gamma by series / Lentz continued
fraction, regularised incomplete beta by continued fraction (standard
numerical-analysis forms).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


def _steps(size: float) -> int:
    """Enough terms: near x = a both forms need a small multiple of sqrt(a)."""
    return 500 + int(40 * math.sqrt(max(size, 1.0)))


def _power_over_gamma(a: float, x: float) -> float:
    """x^a e^-x / Gamma(a); for large a through Stirling, so that nothing large cancels."""
    if a < 50:
        return math.exp(-x + a * math.log(x) - math.lgamma(a))
    mu = (x - a) / a
    small = 1 / (12 * a) - 1 / (360 * a ** 3) + 1 / (1260 * a ** 5)
    return math.exp(a * _log1p_minus(mu) - small) * math.sqrt(a / (2 * math.pi))


def _log1p_minus(u: float) -> float:
    """log(1 + u) - u without cancellation near 0."""
    if abs(u) > 0.01:
        return math.log1p(u) - u
    total, power = 0.0, u
    for k in range(2, 12):
        power *= u
        total += -power / k if k % 2 == 0 else power / k
    return total


def _gamma_p_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(_steps(a)):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            return total * _power_over_gamma(a, x)
    raise ArithmeticError(f"incomplete gamma series did not converge for a={a}, x={x}")


def _gamma_q_fraction(a: float, x: float) -> float:
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _steps(a)):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return _power_over_gamma(a, x) * h
    raise ArithmeticError(f"incomplete gamma fraction did not converge for a={a}, x={x}")


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_p_series(a, x)
    return _gamma_q_fraction(a, x)


def chi2_sf(x: float, dof: float) -> float:
    """Survival function of the chi-squared distribution."""
    if x is None or dof is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if dof <= 0:
        return 1.0
    if dof == 1:
        return math.erfc(math.sqrt(max(x, 0.0) / 2.0))
    return gamma_q(dof / 2.0, x / 2.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _steps(a + b)):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return h
    raise ArithmeticError(f"incomplete beta fraction did not converge for a={a}, b={b}, x={x}")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(lbt) * _beta_fraction(b, a, 1.0 - x) / b


def corr_p_value(r: float, n: float) -> float:
    """Two-sided p-value of a Pearson / point-biserial r from n pairs."""
    if r is None or n is None or n < 3 or (isinstance(r, float) and math.isnan(r)):
        return float("nan")
    r = max(min(r, 1.0), -1.0)
    dof = n - 2.0
    if abs(r) >= 1.0:
        return 0.0
    t2 = r * r * dof / (1.0 - r * r)
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t2))


@F.pandas_udf(T.DoubleType())
def chi2_p_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def corr_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([corr_p_value(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(r, n)], dtype="float64")
