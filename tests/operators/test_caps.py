"""Capped weights on hostile books, against the fixed point of handing on the excess."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitloom.operators.caps import proportional, two_level


def handed_on(w, cap, budget):
    w = np.where(np.isfinite(w) & (w > 0), w, 0.0)
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2 if lo else hi / 2 if hi > 1e-12 else 0
        lo, hi = (mid, hi) if np.minimum(cap * (w > 0), mid * w).sum() < budget else (lo, mid)
    return np.minimum(cap * (w > 0), hi * w)


BOOKS = {"steep": [2.0**-i for i in range(30)], "flat": [1.0] * 20, "one": [1.0], "few": [5.0, 1.0, 1.0], "ties": [3.0] * 10 + [1.0] * 15, "zero": [0.0] * 4, "odd": [float("nan"), -1.0, 0.0] + [1.0 + i for i in range(20)]}


def test_name_caps(spark):
    rows = [(b, i, w) for b, ws in BOOKS.items() for i, w in enumerate(ws)] + [("steep", 99, None), (None, 1, 1.0)]
    out = proportional(spark.createDataFrame(rows, "b string, i int, w double"), ["b"], "w", F.lit(0.06), 1.0, "v").collect()
    assert len(out) == len(rows)
    for b, ws in BOOKS.items():
        got = [r.v for r in sorted((r for r in out if r.b == b and r.i != 99), key=lambda r: r.i)]
        assert np.allclose(got, handed_on(np.array(ws), 0.06, 1.0), atol=1e-9) and max(got) <= 0.06
    assert [r.v for r in out if r.i == 99] == [0.0]


@pytest.mark.parametrize("seed", range(4))
def test_names_and_sectors(spark, seed):
    rng = np.random.default_rng(seed)
    w = np.exp(3 * rng.normal(size=60)) if seed else np.array([2.0**-i for i in range(60)])
    sector = rng.integers(0, 6, 60) if seed else np.arange(60) // 10
    df = spark.createDataFrame([("d", int(s), i, float(x)) for i, (s, x) in enumerate(zip(sector, w))], "d string, s int, i int, w double")
    got = np.array([r.v for r in two_level(df, ["d"], "s", "w", 0.06, 0.25, 1.0, "v").orderBy("i").collect()])
    totals = np.bincount(sector, got)
    assert got.max() <= 0.06 + 1e-12 and totals.max() <= 0.25 + 1e-12 and np.isclose(got.sum(), 1.0)
    free = (got < 0.06 - 1e-9) & (totals[sector] < 0.25 - 1e-9)
    assert np.ptp(got[free] / w[free]) < 1e-6 * (got[free] / w[free]).max() if free.any() else True  # one factor for all that no cap holds
    assert two_level(df.limit(0), ["d"], "s", "w", 0.06, 0.25, 1.0, "v").count() == 0
