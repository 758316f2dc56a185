"""Correlations by blocks against numpy: several blocks and chunks, nulls, repeats, parts."""

import numpy as np
from pyspark.sql import functions as F

from pitloom.operators.correlations import pair_correlations


def test_blocks_and_chunks(spark):
    rng, rows = np.random.default_rng(1), []
    x = rng.normal(size=(60, 23)) + 1000
    x[:, 3] = 5.0
    x[rng.random(x.shape) < 0.3] = np.nan
    for t in range(60):
        rows += [(t, f"s{i:02d}", None if np.isnan(x[t, i]) and i % 2 else float(x[t, i]), "late" if t >= 40 else "early", 1) for i in range(23)]
    rows += [(None, "s01", 1.0, "late", 1), (1, None, 1.0, "late", 1), (2, "s01", float("inf"), "late", 1)]
    df = spark.createDataFrame(rows, "t int, s string, v double, half string, n int").repartition(5)
    for part, halves in ((None, {None: slice(0, 60)}), ("half", {"early": slice(0, 40), "late": slice(40, 60)})):
        got = {(r.half if part else None, r.a, r.b): r for r in pair_correlations(df, "t", "s", "v", 5, part, block=6, chunk=13).collect()}
        want = 0
        for half, rows_ in halves.items():
            for i in range(23):
                for j in range(i + 1, 23):
                    both = ~np.isnan(x[rows_, i]) & ~np.isnan(x[rows_, j])
                    if both.sum() < 5:
                        continue
                    want += 1
                    r = got[half, f"s{i:02d}", f"s{j:02d}"]
                    assert r.n == both.sum()
                    assert r.corr is None if 3 in (i, j) else np.isclose(r.corr, np.corrcoef(x[rows_, i][both], x[rows_, j][both])[0, 1], rtol=1e-9)
        assert want == len(got)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(t, s, float(v)) for t in range(4) for s, v in ((1, t), (1, t + 2), (2, -t))], "t int, s long, v double")
    (r,) = pair_correlations(df, "t", "s", "v").collect()
    assert (r.a, r.b, r.n) == (1, 2, 4) and np.isclose(r.corr, -1)
    assert pair_correlations(df.where(F.lit(False)), "t", "s", "v").count() == 0
