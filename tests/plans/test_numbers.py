"""Regressions of large values against the same in deviations."""

import numpy as np

from pitloom.plans.ingest import interactions


def test_interactions_of_large_values(spark):
    """Volumes of hundreds of millions over a spread that hardly moves: the products' coefficients are those of the regression in deviations."""
    rng = np.random.default_rng(3)
    n = 3000
    a, b, c = rng.normal(0, 1, n), rng.normal(30, 0.5, n), rng.normal(3e8, 6e6, n)
    y = 0.1 * a + 0.02 * (b - 30) * (c - 3e8) / 6e6 + rng.normal(0, 0.1, n)
    row = interactions(spark.createDataFrame(list(zip(*(v.tolist() for v in (y, a, b, c)))), "y double, a double, b double, c double")).first()
    for k, (p, q) in enumerate(((a, b), (a, c), (b, c))):
        # the product of deviations has the product's own coefficient and t
        u, v = ((w - w.mean()) / w.std() for w in (p, q))
        x = np.stack([np.ones(n), u, v, u * v], 1)
        beta = np.linalg.solve(x.T @ x, x.T @ y)
        error = ((y - x @ beta) ** 2).sum() / (n - 4)
        t = beta[3] / np.sqrt(error * np.linalg.inv(x.T @ x)[3, 3])
        coef = beta[3] / (p.std() * q.std())
        assert np.allclose([row.coef[k], row.t[k], row.part[k]], [coef, t, coef * (p * q).mean()], rtol=1e-5)
