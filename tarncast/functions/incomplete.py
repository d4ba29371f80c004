"""CRPS of the gamma, beta and Poisson families.

These need incomplete gamma and beta functions, which have no Spark expression. They are
evaluated on Arrow batches: one vectorised pandas UDF for each family, over rows that Spark
has already reduced to one per forecast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tarncast.functions.special import LANCZOS, LANCZOS_G

STEPS = 500
TINY = 1e-300
#: A continued fraction whose last term still moved it by more than this share has no value: the score is NULL.
SETTLED = 1e-12


def _lgamma(x: np.ndarray) -> np.ndarray:
    s = np.asarray(x, float) - 1
    t = s + LANCZOS_G + 0.5
    series = LANCZOS[0] + sum(c / (s + i) for i, c in enumerate(LANCZOS[1:], 1))
    return 0.5 * np.log(2 * np.pi) + (s + 0.5) * np.log(t) - t + np.log(series)


def _continued_fraction(b0, terms):
    """Modified Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...)) for arrays; NaN where the terms end before it settles."""
    f = np.where(b0 == 0, TINY, b0)
    c, d = f.copy(), np.zeros_like(f)
    moved = np.full(f.shape, np.inf)
    for a, b in terms:
        d = b + a * d
        d = 1 / np.where(d == 0, TINY, d)
        c = b + a / c
        c = np.where(c == 0, TINY, c)
        step = c * d
        f = f * step
        moved = np.abs(step - 1)
        if np.all(moved < 1e-15):
            break
    return np.where(moved < SETTLED, f, np.nan)


def gamma_cdf(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function."""
    shape, x = np.broadcast_arrays(np.asarray(shape, float), np.maximum(np.asarray(x, float), 0))
    out = np.zeros(shape.shape)
    positive = x > 0
    scale = np.exp(shape * np.log(np.where(positive, x, 1)) - x - _lgamma(shape))
    by_series = positive & (x < shape + 1)
    if by_series.any():
        k, v = shape[by_series], x[by_series]
        term = total = 1 / k
        n = 0
        while np.any(term > 1e-17 * total):
            n += 1
            term = term * v / (k + n)
            total = total + term
        out[by_series] = total * scale[by_series]
    by_fraction = positive & ~by_series
    if by_fraction.any():
        k, v = shape[by_fraction], x[by_fraction]
        terms = ((-n * (n - k), v + 2 * n + 1 - k) for n in range(1, 20 * STEPS))
        out[by_fraction] = 1 - scale[by_fraction] / _continued_fraction(v + 1 - k, terms)
    return out


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(x, 0.0, 1.0))
    swap = x > (a + 1) / (a + b + 2)
    p, q, v = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)

    def terms():
        for n in range(1, 20 * STEPS):
            m = n // 2
            if n % 2:
                yield -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1)), np.ones_like(v)
            else:
                yield m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m)), np.ones_like(v)

    with np.errstate(divide="ignore"):
        front = p * np.log(v) + q * np.log1p(-v) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))
    tail = np.exp(front) / p / _continued_fraction(np.ones_like(v), terms())
    return np.where(swap, 1 - tail, tail)


def _scaled_bessel_sum(x: np.ndarray) -> np.ndarray:
    """exp(-x) (I0(x) + I1(x)) by the trapezoid rule on its integral, exact to rounding."""
    nodes = int(64 + 8 * np.sqrt(x.max(initial=0.0)))
    theta = np.pi * (np.arange(nodes) + 0.5) / nodes
    total = np.zeros_like(x)
    for angle in theta:
        total += np.exp(x * (np.cos(angle) - 1)) * (1 + np.cos(angle))
    return total / nodes


def _on_valid(valid: np.ndarray, compute) -> pd.Series:
    out = np.full(valid.shape, np.nan)
    if valid.any():
        out[valid] = compute(valid)
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


@pandas_udf(DoubleType())
def crps_gamma(y: pd.Series, shape: pd.Series, rate: pd.Series) -> pd.Series:
    y, k, r = (s.to_numpy(float, na_value=np.nan) for s in (y, shape, rate))

    def compute(ok):
        v, a, b = y[ok], k[ok], r[ok]
        spread = np.exp(_lgamma(a + 0.5) - _lgamma(np.full_like(a, 0.5)) - _lgamma(a))
        return (
            v * (2 * gamma_cdf(a, b * v) - 1)
            - a / b * (2 * gamma_cdf(a + 1, b * v) - 1)
            - spread / b
        )

    return _on_valid((k > 0) & (r > 0) & ~np.isnan(y), compute)


@pandas_udf(DoubleType())
def crps_beta(y: pd.Series, shape1: pd.Series, shape2: pd.Series) -> pd.Series:
    y, s1, s2 = (s.to_numpy(float, na_value=np.nan) for s in (y, shape1, shape2))

    def compute(ok):
        v, a, b = y[ok], s1[ok], s2[ok]
        ratio = np.exp(
            _lgamma(2 * a) + _lgamma(2 * b) - _lgamma(2 * (a + b)) - 2 * (_lgamma(a) + _lgamma(b) - _lgamma(a + b))
        )
        return v * (2 * beta_cdf(a, b, v) - 1) + a / (a + b) * (
            1 - 2 * beta_cdf(a + 1, b, v) - 2 * ratio / a
        )

    return _on_valid((s1 > 0) & (s2 > 0) & ~np.isnan(y), compute)


@pandas_udf(DoubleType())
def crps_poisson(y: pd.Series, rate: pd.Series) -> pd.Series:
    y, lam = (s.to_numpy(float, na_value=np.nan) for s in (y, rate))

    def compute(ok):
        v, m = y[ok], lam[ok]
        whole = np.maximum(np.floor(v), 0)
        inside = v >= 0
        below = np.where(inside, 1 - gamma_cdf(whole + 1, m), 0.0)
        mass = np.where(inside, np.exp(whole * np.log(m) - m - _lgamma(whole + 1)), 0.0)
        return (v - m) * (2 * below - 1) + 2 * m * mass - m * _scaled_bessel_sum(2 * m)

    return _on_valid((lam > 0) & ~np.isnan(y), compute)
