"""Segmented scans and sliding order statistics against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitloom.operators.scans import compose, recursive, span, wilder, numbered_values
from pitloom.operators.sliding import frame_statistics, sliding_order


def loop(x, alpha):
    out, s = [], None
    for v in x:
        s = v if s is None else s if v is None else alpha * v + (1 - alpha) * s
        out.append(s)
    return out


def test_compose():
    rng = np.random.default_rng(1)
    d, a = rng.random(100), rng.random(100)
    s, want = 0.0, []
    for x, y in zip(d, a):
        s = x * s + y
        want.append(s)
    weight, got = compose(d, a)
    assert np.allclose(got, want, rtol=1e-12) and np.allclose(weight, np.cumprod(d))


def test_long_series_in_many_tasks(spark):
    """A million rows of one key: a constant stays constant, others follow the loop."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), "id", F.lit(10.0).alias("c"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("x"))
    out = recursive(df, "k", "id", {"flat": span(F.col("c"), 12), "s": span(F.col("x"), 26)})
    got = out.select("id", "x", "flat", "s", F.spark_partition_id().alias("p")).toPandas().sort_values("id")
    assert len(got) == n and np.allclose(got["flat"], 10.0, rtol=1e-12)
    assert np.allclose(got["s"], loop(got["x"], 2 / 27), rtol=1e-9)
    assert got["p"].nunique() > 1


def test_keys_nulls_and_resets(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, None if rng.random() < 0.2 and i else float(rng.normal())) for k in ("a", "b", None) for i in range(rng.integers(1, 90))]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(7)
    terms = {"s": span(F.col("x"), 5)}
    got = {(r.k, r.t): r.s for r in recursive(df, "k", "t", terms).collect()}
    for k in ("a", "b", None):
        want = loop([x for q, _, x in rows if q == k], 1 / 3)
        assert np.allclose([got[k, i] for i in range(len(want))], want)
    assert recursive(df.limit(0), "k", "t", terms).count() == 0


def test_wilder_means(spark):
    x = np.random.default_rng(3).random(60)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t int, x double").withColumn("n", numbered_values(F.col("x"), "k", "t"))
    got = [r.s for r in recursive(df, "k", "t", {"s": wilder(F.col("x"), F.col("n"), 14, "k", "t")}).orderBy("t").collect()]
    s = x[:14].mean()
    assert got[:13] == [0.0] * 13 and np.isclose(got[13], s)
    for i in range(14, 60):
        s = (13 * s + x[i]) / 14
        assert np.isclose(got[i], s)


@pytest.mark.parametrize("rows", [1, 3, 40])
def test_frame_statistics(rows):
    rng = np.random.default_rng(rows)
    x = np.where(rng.random(200) < 0.1, np.nan, rng.integers(0, 9, 200).astype(float))
    x[50:52] = np.inf, -np.inf
    n, below, (median,) = frame_statistics(x, 5, rows, [0.5])
    for i in range(5, 200):
        f = x[max(0, i - rows + 1):i + 1]
        f = np.sort(f[~np.isnan(f)])
        assert n[i - 5] == len(f)
        if not np.isnan(x[i]):
            assert below[i - 5] == (f < x[i]).sum()
        if len(f):
            a, b = f[(len(f) - 1) // 2], f[len(f) // 2]
            assert np.isclose(median[i - 5], a if a == b else (a + b) / 2, equal_nan=True)


def test_sliding_order_over_blocks(spark):
    """One key of three blocks, a short one, a null one, nulls and an empty table; n, below and quantiles clash with nothing of the input."""
    rng = np.random.default_rng(5)
    series = {"hot": rng.integers(0, 50, 20_000).astype(float), "b": rng.random(3), None: rng.random(40)}
    rows = [(k, i, None if i % 11 == 3 else float(v), "kept") for k, xs in series.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, t int, x double, _place string").withColumnRenamed("_place", "place").repartition(6)
    got = {(r.k, r.t): r for r in sliding_order(df, "k", "t", "x", 252, [0.25]).collect()}
    assert len(got) == len(rows) and {r.place for r in got.values()} == {"kept"}
    for k, xs in series.items():
        x = np.array([np.nan if i % 11 == 3 else v for i, v in enumerate(xs)])
        for i in range(0, len(x), 1 if len(x) < 100 else 37):
            f = x[max(0, i - 251):i + 1]
            f = f[~np.isnan(f)]
            r = got[k, i]
            assert r.n == len(f) and r.below == (None if np.isnan(x[i]) else (f < x[i]).sum())
            assert r.quantiles[0] is None if not len(f) else np.isclose(r.quantiles[0], np.quantile(f, 0.25))
    assert sliding_order(df.limit(0), "k", "t", "x", 5).count() == 0
