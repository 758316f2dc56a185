"""Recursions s = decay * s + add along a series, as a segmented scan of blocks.

A row is the pair (decay, add); pairs of neighbouring rows compose to a pair
of the same kind, (d1 * d2, a1 * d2 + a2), so a batch is scanned in a number of
steps that is the logarithm of its size, and a key that holds much of the rows
is cut into many tasks.  Rows are dealt to ranges of (key, order).  A task
returns each row's sum since the start of its range, and the weight with which
the state before the range enters it; one pair for each range reaches the
driver, where the ranges are joined.  Weights only shrink, so nothing
overflows however long a series is.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import by, frame
from ..sources.storage import stored


def compose(decay: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the product of the decays so far and the state so far from 0."""
    decay, add, step = decay.copy(), add.copy(), 1
    while step < len(add):
        add[step:] += decay[step:] * add[:-step]
        decay[step:] *= decay[:-step]
        if not decay[step:].any():  # all rows have met a reset
            break
        step *= 2
    return decay, add


def recursive(df: DataFrame, key: str, order: str, terms: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """df with a column for each term, name: (decay, add, start), the state after each row of a key.

    The state before a key's first row is `start` of that row.  Decays lie
    between 0 and 1.  A row whose decay or add is null leaves the state as it
    is; a null start is 0.  Rows of a null key are one series.  Rows of a key
    that have the same order are taken in no stated order.  An empty table
    stays empty.
    """
    names, spark = list(terms), df.sparkSession
    k = len(names)
    pairs = {}
    for i, (decay, add, start) in enumerate(terms.values()):
        known = decay.isNotNull() & add.isNotNull()
        pairs |= {f"_d{i}": F.when(known, decay.cast("double")).otherwise(1.0), f"_a{i}": F.when(known, add.cast("double")).otherwise(0.0), f"_s{i}": F.coalesce(start.cast("double"), F.lit(0.0))}
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.struct(*df.columns).alias("_row"), F.xxhash64(key).alias("_key"), F.col(key).alias("_by"), F.col(order).alias("_at"), *(c.alias(n) for n, c in pairs.items()))
    rows = rows.repartitionByRange(width, "_by", "_at").sortWithinPartitions("_by", "_at").drop("_by", "_at")
    extra = [T.StructField(n, T.LongType()) for n in ("_range", "_n", "_first")] + [T.StructField(f"_{c}{i}", T.DoubleType()) for c in "wxs" for i in range(k)]
    schema = T.StructType([rows.schema["_row"], *extra])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, last = TaskContext.get().partitionId(), 0, None
        first, weights, states = 0, np.ones(k), np.zeros(k)
        for batch in (b for b in batches if b.num_rows):
            keys = batch.column("_key").to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            new[0] = last is not None and keys[0] != last
            if last is None:
                first = keys[0]
            w, x, s = [], [], []
            for i in range(k):
                d, a, start = (batch.column(f"_{c}{i}").to_numpy().copy() for c in "das")
                a[new] += d[new] * start[new]
                d[new] = 0.0
                a[0] += d[0] * states[i]
                d[0] *= weights[i]
                d, a = compose(d, a)
                weights[i], states[i] = d[-1], a[-1]
                w, x, s = [*w, pa.array(d)], [*x, pa.array(a)], [*s, pa.array(start)]
            columns = [pa.array(np.full(len(keys), place)), pa.array(n + np.arange(len(keys))), pa.array(np.full(len(keys), first))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns, *w, *x, *s], names=schema.names)
            n, last = n + len(keys), keys[-1]

    done = stored(rows.mapInArrow(scan, schema).withColumn("_key", F.xxhash64(f"_row.{key}")))
    ends = done.groupBy("_range").agg(
        F.first("_first").alias("first"), F.max_by("_key", "_n").alias("last"), F.min_by(F.array(*(f"_s{i}" for i in range(k))), "_n").alias("start"),
        F.max_by(F.array(*(f"_w{i}" for i in range(k))), "_n").alias("w"), F.max_by(F.array(*(f"_x{i}" for i in range(k))), "_n").alias("x"),
    )
    carried, state, last = [], [0.0] * k, None
    for r in sorted(ends.collect(), key=lambda r: r["_range"]):
        before = state if last is not None and r["first"] == last else list(r["start"])
        carried.append((r["_range"], before))
        state, last = [x + w * s for x, w, s in zip(r["x"], r["w"], before)], r["last"]
    carry = spark.createDataFrame(carried, "_range long, _c array<double>")  # one row for each range
    out = done.join(F.broadcast(carry), "_range")
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in terms), *((F.col(f"_x{i}") + F.col(f"_w{i}") * F.col("_c")[i]).alias(n) for i, n in enumerate(names)))


def exponential(x: Column, alpha: float) -> tuple[Column, Column, Column]:
    """s = alpha * x + (1 - alpha) * s from the first x on."""
    return F.lit(1 - alpha), alpha * x, x


def span(x: Column, n: int) -> tuple[Column, Column, Column]:
    return exponential(x, 2 / (n + 1))


def wilder(x: Column, place: Column, n: int, key: str, order: str = "date") -> tuple[Column, Column, Column]:
    """The mean of the first n values, then a share of 1/n of each further one; 0 before.  place numbers the values of a key from 1."""
    first = F.avg(x).over(frame(key, n, order))
    decay = F.when(place <= n, 0.0).otherwise((n - 1) / n)
    return decay, F.when(place < n, 0.0).when(place == n, first).otherwise(x / n), F.lit(0.0)


def numbered_values(x: Column, key: str, order: str = "date") -> Column:
    """The place of each non-null x among those of its key."""
    return F.count(x).over(by(key, order).rowsBetween(-(2**63), 0))
