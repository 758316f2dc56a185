"""Tails against known values and closed forms."""

import math

import numpy as np
from pyspark.sql import functions as F

from pitloom.functions.tails import f_tail, incomplete_beta, t_tail


def test_incomplete_beta():
    x = np.linspace(0, 1, 101)
    assert np.allclose(incomplete_beta(x, 1.0, 1.0), x, atol=1e-13)
    assert np.allclose(incomplete_beta(x, 3.0, 1.0), x**3, atol=1e-13)
    assert np.allclose(incomplete_beta(x, 0.5, 0.5), 2 / math.pi * np.arcsin(np.sqrt(x)), atol=1e-13)
    a, b = 7, 5  # a sum of binomial terms
    want = [sum(math.comb(a + b - 1, j) * v**j * (1 - v) ** (a + b - 1 - j) for j in range(a, a + b)) for v in x]
    assert np.allclose(incomplete_beta(x, a, b), want, atol=1e-13)
    assert np.isnan(incomplete_beta([-0.1, 1.1, np.nan, 0.5, 0.5], [1, 1, 1, 0, np.inf], 1.0)).all()
    assert np.isclose(incomplete_beta(0.5, 5e5, 5e5), 0.5, atol=1e-9)


def test_tails(spark):
    rows = [(1.0, 1), (0.0, 7), (-2.0, 2), (12.706204736432095, 1), (2.2281388519649385, 10), (1.9599639845, 10**9), (None, 5), (float("nan"), 5), (1.0, 0)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, v long").coalesce(1).select(t_tail(F.col("t"), F.col("v")).alias("p")).collect()]
    assert np.allclose(got[:5], [0.5, 1.0, 1 - 2 / math.sqrt(6), 0.05, 0.05], atol=1e-9) and abs(got[5] - 0.05) < 1e-7
    assert got[6:] == [None] * 3
    f = [(3.0, 2, 8), (4.0, 1, 9), (0.0, 3, 3), (-1.0, 3, 3)]
    got = [r.p for r in spark.createDataFrame(f, "f double, a int, b int").coalesce(1).select(f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert np.allclose(got, [(1 + 6 / 8) ** -4, 0.07655320783, 1, 1], atol=1e-7)
