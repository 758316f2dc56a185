"""Regressions against plain numpy: hot and small groups, ranges that cut a group, ridge, Granger tests."""

import numpy as np
from pyspark.sql import functions as F

from pitloom.operators.regression import by_term, granger, joined_products, regressions


def reference(y, x, lags):
    x = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    u = y - x @ b
    if lags is None:
        v = u @ u / (len(y) - x.shape[1]) * inv
    else:
        s = x * u[:, None]
        m = s.T @ s
        for lag in range(1, lags + 1):
            g = s[lag:].T @ s[:-lag]
            m += (1 - lag / (lags + 1)) * (g + g.T)
        v = inv @ m @ inv
    return b, np.sqrt(np.diag(v)), 1 - u @ u / ((y - y.mean()) ** 2).sum()


def made(rng, n):
    x = rng.normal(size=(n, 4)) + np.array([0, 5, -2, 0])
    u = np.convolve(rng.normal(size=n + 2), [1, 0.7, 0.4], "valid")
    return x, x @ np.array([1.0, -0.5, 0.0, 0.2]) + 3 + u


def test_groups_and_ranges(spark):
    """A hot group over all ranges, small ones, a null key, too few rows; nulls, NaN and infinities take no part; an input column is called n."""
    rng, rows, want = np.random.default_rng(1), [], {}
    for key, n in (("hot", 30_000), ("a", 60), ("b", 41), (None, 200), ("few", 29)):
        x, y = made(rng, n)
        want[key] = x, y
        rows += [(key, i * 2, float(y[i]), *map(float, x[i]), 1) for i in range(n)]
        rows += [(key, 3, None, 1.0, 1.0, 1.0, 1.0, 1), (key, 5, 1.0, float("nan"), 1.0, 1.0, 1.0, 1), (key, 7, 1.0, 1.0, float("inf"), 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, t int, y double, a double, b double, c double, d double, n int").repartition(5)
    for lags in (4, 0, None):
        got = {r.k: r for r in regressions(df, ["k"], "y", ["a", "b", "c", "d"], "t", lags).collect()}
        assert set(got) == {"hot", "a", "b", None}
        for k, r in got.items():
            x, y = want[k]
            b, se, r2 = reference(y, x, lags)
            assert r.n == len(y) and not r.ridge and r.terms == ["const", "a", "b", "c", "d"]
            assert np.allclose(r.beta, b, rtol=1e-9) and np.allclose(r.se, se, rtol=1e-8) and np.isclose(r.r2, r2, rtol=1e-9)
            assert np.allclose(r.t, np.clip(b / se, -50, 50), rtol=1e-8)
    long = by_term(regressions(df, ["k"], "y", ["a"], "t")).where("k = 'a'").collect()
    assert [r.term for r in long] == ["const", "a"] and all(0 <= r.p <= 1 for r in long)
    assert regressions(df.limit(0), ["k"], "y", ["a"], "t").count() == 0


def test_parts_shorter_than_the_lags():
    s = np.random.default_rng(2).normal(size=(11, 2))
    want = np.array([sum(np.outer(s[t], s[t - lag]) for t in range(lag, 11)) for lag in range(5)])
    parts = []
    for a, b in ((0, 1), (1, 3), (3, 4), (4, 10), (10, 11)):
        p = s[a:b]
        own = np.array([sum((np.outer(p[t], p[t - lag]) for t in range(lag, len(p))), np.zeros((2, 2))) for lag in range(5)])
        parts.append((len(p), own, p[:4], p[-4:]))
    assert np.allclose(joined_products(parts), want)


def test_ridge_and_constants(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=50)
    rows = [("twin", i, float(v + 0.1 * rng.normal()), float(v), float(v)) for i, v in enumerate(a)] + [("flat", i, 2.0, float(v), float(-v * v)) for i, v in enumerate(a)]
    got = {r.k: r for r in regressions(spark.createDataFrame(rows, "k string, t int, y double, a double, b double"), ["k"], "y", ["a", "b"], "t").collect()}
    assert got["twin"].ridge and np.isclose(got["twin"].beta[1], got["twin"].beta[2], rtol=1e-4) and np.isclose(sum(got["twin"].beta[1:]), 1, atol=0.1)
    flat = got["flat"]
    assert not flat.ridge and np.isclose(flat.beta[0], 2) and flat.r2 == 0 and flat.se == [None] * 3 and flat.p == [1.0] * 3 and flat.t == [0.0] * 3


def test_granger(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for k, n, effect in (("led", 120, 0.8), ("free", 90, 0.0), (None, 40, 0.3), ("few", 22, 0.5)):
        x, e = rng.normal(size=n), rng.normal(size=n)
        y = e.copy()
        y[2:] += effect * x[:-2]
        rows += [(k, i, float(y[i]), float(x[i])) for i in range(n)]
        for lag in (1, 2, 3):
            past = lambda v: np.column_stack([v[lag - j : n - j] for j in range(1, lag + 1)])  # noqa: B023, E731
            rest = lambda m: np.linalg.lstsq(m, y[lag:], rcond=None)[1][0]  # noqa: B023, E731
            one = np.ones((n - lag, 1))
            small, large = rest(np.hstack([one, past(y)])), rest(np.hstack([one, past(y), past(x)]))
            want[k, lag] = n - lag, ((small - large) / lag) / (large / (n - lag - 2 * lag - 1))
    rows.append(("free", 1000, None, 1.0))
    df = spark.createDataFrame(rows, "k string, t int, y double, x double").repartition(3)
    got = granger(df, ["k"], "y", "x", "t", 3).collect()
    assert {(r.k, r.lag) for r in got} == {(k, lag) for k in ("led", "free", None) for lag in (1, 2, 3)}
    for r in got:
        n, f = want[r.k, r.lag]
        assert r.n == n and np.isclose(r.f, f, rtol=1e-8)
    led = [r for r in got if r.k == "led"]
    assert led[0].best in (2, 3) and min(r.p for r in led) < 1e-6
    assert granger(df.where(F.lit(False)), ["k"], "y", "x", "t", 3).count() == 0
