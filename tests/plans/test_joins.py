"""As-of joins and upserts on hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitloom.operators.joins import asof_join, keep_last, replace_by_key
from pitloom.operators.quantiles import exact_quantiles


def d(n):
    return dt.date(2024, 1, n)


def test_asof_join(spark):
    left = spark.createDataFrame([("a", d(1), 1), ("a", d(5), 2), ("a", d(9), 3), ("b", d(5), 4), (None, d(5), 5)], "k string, t date, x int")
    right = spark.createDataFrame([("a", d(2), 10.0, 1), ("a", d(5), 20.0, 1), ("a", d(5), 21.0, 2), ("a", d(7), None, 1), ("c", d(1), 9.0, 1)], "k string, at date, v double, n int")
    got = {r.x: r.v for r in asof_join(left, right, "k", "t", "at", ["v"], "n").collect()}
    assert got == {1: None, 2: 21.0, 3: None, 4: None, 5: None}
    assert asof_join(left, right.limit(0), "k", "t", "at", ["v"], "n").count() == 5
    no_key = {r.x: r.v for r in asof_join(left, right.drop("k"), None, "t", "at", ["v"], "n").collect()}
    assert no_key == {1: 9.0, 2: 21.0, 3: None, 4: 21.0, 5: 21.0}


def test_future_rows_change_nothing(spark):
    left = spark.createDataFrame([("a", d(3), 1), ("a", d(4), 2)], "k string, t date, x int")
    right = spark.createDataFrame([("a", d(2), 1.0, 1), ("a", d(8), 9.0, 1)], "k string, at date, v double, n int")
    one = asof_join(left, right, "k", "t", "at", ["v"], "n").collect()
    two = asof_join(left, right.where("v < 5"), "k", "t", "at", ["v"], "n").collect()
    assert sorted(one) == sorted(two)


def test_replace_and_keep_last(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, replace_by_key(a, b, ["k"]).collect())) == [(1, "x"), (2, "new"), (3, "w")]
    assert sorted(map(tuple, keep_last(a, ["k"], ["v"]).collect())) == [(1, "x"), (2, "z")]


@pytest.mark.parametrize("span", [1, 3, 400])
def test_asof_join_in_spans(spark, span):
    left = spark.createDataFrame([("a" if i % 3 else None, d(1 + i % 28), i) for i in range(60)] + [("a", None, 99)], "k string, t date, x int")
    right = spark.createDataFrame([("a" if i % 2 else None, d(2 + i * 5 % 27), None if i % 4 == 1 else float(i), i % 3) for i in range(9)] + [("a", None, 7.0, 1)], "k string, at date, v double, n int")
    whole = asof_join(left, right, "k", "t", "at", ["v"], "n").collect()
    assert [r.v for r in whole if r.k is None] == [None] * 20
    cut = asof_join(left, right, "k", "t", "at", ["v"], "n", span).collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    assert asof_join(left, right.limit(0), "k", "t", "at", ["v"], "n", span).where("v is null").count() == 61


@pytest.mark.parametrize("n", [1, 2, 7, 40, 3000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    groups = {"smooth": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "tail": np.exp(9 * rng.normal(size=n)), None: np.ones(n)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("smooth", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], F.col("v"), probs).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert np.allclose(got[k], np.quantile(xs, probs), rtol=1e-12)
    everything = exact_quantiles(df, [], F.col("v"), [0.5]).collect()
    assert np.isclose(everything[0].q[0], np.median(np.concatenate(list(groups.values()))))
    assert exact_quantiles(df.where("k = 'empty'"), ["k"], F.col("v"), probs).count() == 0


def test_quantiles_of_infinite_and_nan_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("top", x) for x in (1.0, 2.0, inf)] + [("nan", float(i)) for i in range(10)] + [("nan", nan)] + [("both", -inf), ("both", inf)] + [("low", -inf), ("low", 4.0)] + [("none", nan)]
    got = {r.k: r.q for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), [0.0, 0.5, 0.75, 1.0]).collect()}
    assert set(got) == {"top", "nan", "both", "low"}
    assert got["top"] == [1.0, 2.0, inf, inf] and got["nan"] == [0.0, 4.5, 6.75, 9.0] and got["low"] == [-inf, -inf, -inf, 4.0]
    assert got["both"][0] == -inf and np.isnan(got["both"][1]) and got["both"][3] == inf
