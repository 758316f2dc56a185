"""Tails of the t and F distributions by the regularised incomplete beta function, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOG_GAMMA = np.frompyfunc(math.lgamma, 1, 1)
_TINY = 1e-300


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b), to some 13 digits; NaN where x isn't in [0, 1] or a or b isn't positive and finite.

    A continued fraction by Lentz's method, on the side of x where it
    converges fast; the steps needed grow with the root of a and b.
    """
    x, a, b = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (x, a, b)))
    out = np.full(x.shape, np.nan)
    good = (x >= 0) & (x <= 1) & (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b)
    out[good & (x == 0)], out[good & (x == 1)] = 0.0, 1.0
    inner = good & (x > 0) & (x < 1)
    x, a, b = x[inner], a[inner], b[inner]
    if not len(x):
        return out
    other = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(other, 1 - x, x), np.where(other, b, a), np.where(other, a, b)
    front = np.exp((_LOG_GAMMA(a + b) - _LOG_GAMMA(a) - _LOG_GAMMA(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)) / a
    off_zero = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones(len(x)), 1 / off_zero(1 - (a + b) * x / (a + 1))
    value, m = d.copy(), 1
    while m < 100_000:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = np.ones(len(x))
        for term in (even, odd):
            d, c = 1 / off_zero(1 + term * d), off_zero(1 + term / c)
            change = change * c * d
        value = value * change
        if (np.abs(change - 1) < 1e-15).all():
            break
        m += 1
    out[inner] = np.where(other, 1 - front * value, front * value)
    return out


def _beta(x: Column, a: Column, b: Column) -> Column:
    def values(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        found = pd.Series(incomplete_beta(x.to_numpy(np.float64), a.to_numpy(np.float64), b.to_numpy(np.float64)))
        return found.where(found.notna(), None)

    return F.pandas_udf(values, "double")(x.cast("double"), a.cast("double"), b.cast("double"))


def t_tail(t: Column, dof: Column) -> Column:
    """Probability of a t at least as far from 0; null where t or dof is null or NaN, or dof isn't positive."""
    return _beta(dof / (dof + t * t), dof / 2, F.lit(0.5))


def f_tail(f: Column, above: Column, below: Column) -> Column:
    """Probability of an F at least as large; 1 for a negative one, null as t_tail."""
    f = F.when(f.isNotNull(), F.greatest(f, F.lit(0.0)))
    return _beta(below / (below + above * f), below / 2, above / 2)


def t_tail_sql(t: str, dof: str) -> str:
    """The same for whole degrees of freedom, by the finite sums of sines and cosines."""
    angle = f"atan(abs({t}) / sqrt({dof}))"
    square = f"pow(cos({angle}), 2)"
    even = f"1 - sin({angle}) * list_sum(list_transform(range(0, ({dof}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({square}, k)))"
    odd = f"1 - 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow({square}, k))), 0))"
    return f"CASE WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END"
