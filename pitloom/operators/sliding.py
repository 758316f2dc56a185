"""Order statistics over sliding frames, exact, at a logarithm of the frame for each row.

Each key's rows are numbered by a segmented scan and cut into blocks; a block
also gets the rows before it that its frames reach.  Within a block values
become ranks, and a wavelet matrix over the ranks answers all frames together,
one bit of the ranks at a time: how many values of a frame lie below its
current one, and which value has a given place in its order.  A key that holds
much of the rows is many blocks, and no row carries its frame.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import recursive

#: Rows of a block; a frame makes it larger if it must.
BLOCK_ROWS = 8192


class WaveletMatrix:
    """Ranks of a sequence, bit by bit from the highest; each level keeps how many zeros come before each place."""

    def __init__(self, ranks: np.ndarray):
        self.bits = max(1, int(ranks.max()).bit_length()) if len(ranks) else 1
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (ranks >> bit & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of the entries lo, ..., hi - 1 are less than rank."""
        lo, hi, out = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (rank >> (self.bits - 1 - level) & 1) == 1
            a, b, total = zeros[lo], zeros[hi], zeros[-1]
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return out

    def at(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rank at a place, from 0, in the order of the entries lo, ..., hi - 1."""
        lo, hi, place, out = lo.copy(), hi.copy(), place.copy(), np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            a, b, total = zeros[lo], zeros[hi], zeros[-1]
            one = place >= b - a
            place -= np.where(one, b - a, 0)
            out = out * 2 + one
            lo, hi = np.where(one, total + lo - a, a), np.where(one, total + hi - b, b)
        return out


def frame_statistics(value: np.ndarray, first: int, rows: int, probs: Sequence[float]) -> tuple[np.ndarray, ...]:
    """Of each row from `first` on, over it and the rows - 1 before: count of values, of those below its own, and quantiles; NaN is no value."""
    known = ~np.isnan(value)
    upto = np.concatenate([[0], np.cumsum(known)])
    i = np.arange(first, len(value))
    lo, hi = upto[np.maximum(i - rows + 1, 0)], upto[i + 1]
    distinct, ranks = np.unique(value[known], return_inverse=True)
    n = hi - lo
    if not len(distinct):
        return n, np.full(len(i), np.nan), [np.full(len(i), np.nan) for _ in probs]
    tree = WaveletMatrix(ranks)
    below = np.where(known[i], tree.below(lo, hi, ranks[np.minimum(upto[i], len(ranks) - 1)]), np.nan)
    quantiles = []
    for p in probs:
        place = p * np.maximum(n - 1, 0)
        a, b = (distinct[tree.at(lo, np.maximum(hi, lo + 1), f(place).astype(np.int64))] if len(distinct) else None for f in (np.floor, np.ceil))
        with np.errstate(invalid="ignore"):
            q = np.where(a == b, a, a + (place - np.floor(place)) * (b - a))
        quantiles.append(np.where(n > 0, q, np.nan))
    return n, below, quantiles


def sliding_order(df: DataFrame, key: str, order: str, value: str, rows: int, probs: Sequence[float] = ()) -> DataFrame:
    """df with `n`, `below` and `quantiles` of value over each row and the rows - 1 before it, by key.

    n counts the frame's values, below those that are less than the row's own
    (null without one), quantiles are interpolated between neighbours (null
    for an empty frame).  Null and NaN are no values; infinite ones are.  Rows
    of a null key are one series.  An empty table stays empty.
    """
    size = max(BLOCK_ROWS, rows)
    numbered = recursive(df, key, order, {"_place": (F.lit(1.0), F.lit(1.0), F.lit(0.0))}).withColumn("_place", F.col("_place").cast("long") - 1)
    block = F.floor(F.col("_place") / size)
    near = F.when(F.col("_place") % size > size - rows, F.array(block, block + 1)).otherwise(F.array(block))  # the next block's first frames reach it
    dealt = numbered.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), "_place", F.col(value).cast("double").alias("_v"), F.explode(near).alias("_block"))
    schema = T.StructType([dealt.schema["_row"], T.StructField("n", T.LongType()), T.StructField("below", T.LongType()), T.StructField("quantiles", T.ArrayType(T.DoubleType()))])

    def run(keys, table):
        table = table.sort_by("_place")
        place = table.column("_place").to_numpy()
        x = table.column("_v").to_numpy().astype(np.float64)  # null becomes NaN
        first = int(np.searchsorted(place, keys[1].as_py() * size))
        n, below, quantiles = frame_statistics(x, first, rows, probs)
        found = np.stack(quantiles, 1) if quantiles else np.zeros((len(n), 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(probs), pa.int32()), pa.array(found.ravel(), mask=np.isnan(found.ravel()) | np.repeat(n == 0, len(probs))))
        return pa.table([table.column("_row").slice(first).combine_chunks(), pa.array(n, pa.int64()), pa.array(np.nan_to_num(below), pa.int64(), mask=np.isnan(below)), lists], names=schema.names)

    out = dealt.groupBy("_key", "_block").applyInArrow(run, schema)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns), "n", "below", "quantiles")
