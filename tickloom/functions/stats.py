"""Tail probabilities for test statistics, vectorised over one row per test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def log_beta(a, b):
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(np.add(a, b))


def incomplete_beta(x, a, b, terms: int = 400):
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    x, a, b = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    xx, aa, bb = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - log_beta(aa, bb)) / aa
        tiny = 1e-300
        c, d = np.ones_like(xx), 1 - (aa + bb) * xx / (aa + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, terms):
            for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
                        -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-15:
                break
        value = np.clip(front * h, 0.0, 1.0)
    value = np.where(xx <= 0, 0.0, value)
    return np.where(swap, 1 - value, value)


def f_tail(f, d1, d2):
    """P(F(d1, d2) > f)"""
    f = np.asarray(f, dtype=float)
    return incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_two_sided(t, dof):
    t = np.asarray(t, dtype=float)
    return incomplete_beta(dof / (dof + t * t), np.asarray(dof, dtype=float) / 2, 0.5)


def normal_tail(z):
    """P(N(0, 1) > z)"""
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(z, dtype=float) / math.sqrt(2))


def student_t_two_sided(t: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def udf(tt: pd.Series, dd: pd.Series) -> pd.Series:
        ok = tt.notna() & (dd > 0)
        out = pd.Series(np.nan, index=tt.index)
        out[ok] = t_two_sided(tt[ok].to_numpy(), dd[ok].to_numpy(dtype=float))
        return out
    return udf(t, dof.cast("double"))


def standard_normal_tail(z: Column) -> Column:
    @F.pandas_udf("double")
    def udf(zz: pd.Series) -> pd.Series:
        return pd.Series(normal_tail(zz.to_numpy(dtype=float)), index=zz.index)
    return udf(z)
