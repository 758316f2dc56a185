"""Small matrices of a fixed set of columns: entries come from one aggregate over all rows, the algebra runs on that one row in a task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, columns: Sequence[str], entry: Callable[[str, str], Column], work: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """One row: what `work` makes of the symmetric matrix of `entry` over pairs of columns; a null entry is 0."""
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.agg(F.array(*(F.coalesce(entry(columns[i], columns[j]), F.lit(0.0)) for i, j in pairs)).alias("flat"))
    k = len(columns)

    def run(batches):
        for batch in batches:
            for flat in batch["flat"]:
                m = np.zeros((k, k))
                for (i, j), x in zip(pairs, flat):
                    m[i, j] = m[j, i] = x
                yield pd.DataFrame({name: [np.asarray(v).ravel().tolist()] for name, v in work(m).items()})

    return row.mapInPandas(run, schema)


def shrunk(s: np.ndarray, floor: float = 1e-4) -> tuple[np.ndarray, float]:
    """s drawn towards its mean variance, by the share that its distance from it is of its size, within 0.2 and 0.6; eigenvalues reach `floor`."""
    target = np.eye(len(s)) * np.trace(s) / len(s)
    size = (s * s).sum()
    share = 0.6 if size <= 1e-12 else float(np.clip(((s - target) ** 2).sum() / (size + 1e-12), 0.2, 0.6))
    values, vectors = np.linalg.eigh((1 - share) * s + share * target)
    return (vectors * np.maximum(values, floor)) @ vectors.T, share


def decorrelated(corr: np.ndarray, base: np.ndarray, shrinkage: float = 0.15) -> np.ndarray:
    """Weights solved against the shrunk correlation; the sum of absolute weights stays."""
    w = np.linalg.pinv((1 - shrinkage) * corr + shrinkage * np.eye(len(base))) @ base
    total = np.abs(w).sum()
    return w * (np.abs(base).sum() / total) if total > 1e-12 else base


def first_component(corr: np.ndarray) -> np.ndarray:
    """Unit eigenvector of the largest eigenvalue; its largest loading is positive."""
    v = np.linalg.eigh(corr)[1][:, -1]
    return v * (1.0 if v[np.argmax(np.abs(v))] >= 0 else -1.0)
