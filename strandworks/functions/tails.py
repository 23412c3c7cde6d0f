"""Tails of the usual distributions and the polygamma functions, vectorised in numpy.

Spark has no error function, log-gamma or incomplete beta; these helpers run on whole Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """P(|Z| >= |z|)."""
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2)).astype(float)


def chi2_sf_1(x: np.ndarray) -> np.ndarray:
    """Upper tail of chi-squared with one degree of freedom."""
    return _erfc(np.sqrt(np.maximum(np.asarray(x, float), 0) / 2)).astype(float)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-squared with a whole number of degrees of freedom, by its finite sum."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) / math.sqrt(math.pi * half) * half * 2 if df > 1 else 0.0
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return min(1.0, total)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by the continued fraction on its quickly converging side."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(t) + q * np.log1p(-t)) / p
    tiny = 1e-300
    c = np.ones_like(t)
    d = 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for k in (0, 1):
            num = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)) if k == 0 else -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    low = np.where(t <= 0, 0.0, np.where(t >= 1, 1.0, front * h))
    return np.clip(np.where(swap, 1 - low, low), 0, 1)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) with df degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def inverse_trigamma(value: float) -> float:
    """The x whose trigamma is the value; bisection on the logarithm, as trigamma falls steadily."""
    low, high = math.log(1e-8), math.log(1e12)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if trigamma(math.exp(mid)) > value else (low, mid)
    return math.exp((low + high) / 2)


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=t.index)
    ok = t.notna() & df.notna() & (df > 0)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=z.index)
    ok = z.notna()
    if ok.any():
        out[ok] = normal_two_sided(z[ok].to_numpy())
    return out.where(out.notna(), None)


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; null for a null statistic."""
    return F.when(t.isNotNull() & df.isNotNull(), F.nanvl(_t_p(t, df), F.lit(None)))


def normal_pvalue(z: Column) -> Column:
    """Two-sided p of a z statistic; null for a null statistic."""
    return F.when(z.isNotNull(), F.nanvl(_normal_p(z), F.lit(None)))


def chi2_pvalue(chi2: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom."""
    return normal_pvalue(F.sqrt(F.greatest(chi2, F.lit(0.0))))
