"""Which keys occur with several ids, counted in packed rows.

A task sorts the keys of a group of texts and writes one row for each bucket
of the key space that has any, some ten to sixteen bytes for each key.  A key
that several ids of the group share is written once for the count, and its ids
go along in a row of their own, so a key that many texts share is gathered
before the shuffle.  A bucket holds about as many keys whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix

#: Keys that one task sorts at a time, about.
BUCKET_KEYS = 500_000

SCHEMA = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("local", T.BooleanType()), T.StructField("short", T.BooleanType()), *(T.StructField(c, T.BinaryType()) for c in ("keys", "check", "ids", "which"))])


def buckets_for(spark: SparkSession, keys: float) -> int:
    """Equal parts of the key space: one for each shuffle partition at least."""
    return min(1 << 30, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys / BUCKET_KEYS)))


def _same(*columns: np.ndarray) -> np.ndarray:
    """Which entries equal the one before in all columns."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def pack(keys: np.ndarray, ids: np.ndarray, buckets: int, again: bool = False, check: np.ndarray | None = None, short: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA.

    again: a key that one id has twice also counts as shared.  check: a second
    hash, in which keys must agree as well.  short: six bytes of a key are
    kept, enough to make chance agreements rare within a bucket; for keys that
    only propose candidates.
    """
    more = () if check is None else (check,)
    order = np.lexsort((ids, *more, keys))
    keys, ids, more = keys[order], ids[order], tuple(c[order] for c in more)
    new = ~_same(keys, *more, ids)
    twice = np.zeros(len(keys), bool)
    if again:
        twice[:-1] = ~new[1:]  # a first row whose next one repeats it
        twice = twice[new]
    keys, ids, more = keys[new], ids[new], tuple(c[new] for c in more)
    lead = ~_same(keys, *more)
    several = ~lead
    several[:-1] |= several[1:]
    if again:
        several |= twice
    rows = []
    for local, pick in ((False, lead), (True, several)):
        k, i, c = keys[pick], ids[pick], tuple(x[pick] for x in more)
        bucket = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edge = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(k)] if len(k) else [0]
        for x, y in zip(edge[:-1], edge[1:]):
            table, which = np.unique(i[x:y], return_inverse=True)
            kept = np.ascontiguousarray(k[x:y].view(np.uint8).reshape(-1, 8)[:, :6]) if short else k[x:y]
            rows.append((int(bucket[x]), local, short, kept.tobytes(), c[0][x:y].tobytes() if c else None, table.tobytes(), which.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32).tobytes()))
    if rows:
        types = (pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=SCHEMA.names)


def _long(bucket: int, kept: bytes) -> np.ndarray:
    """Keys of six bytes as 64-bit keys that differ between buckets; the lowest byte stays."""
    whole = np.zeros((len(kept) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(kept, np.uint8).reshape(-1, 6)
    return whole.view(np.uint64)[:, 0] ^ (mix(np.array([bucket], np.uint64)) << np.uint64(8))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, parts = None, []

    def out(k, i):
        for at in range(0, len(k), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 17)].view(np.int64)), pa.array(i[at : at + (1 << 17)].view(np.int64))], names=["key", "id"])

    def flush():
        columns = [np.concatenate(x) for x in zip(*parts)]  # keys, second hashes if there are any, ids
        parts.clear()
        order = np.lexsort(columns[::-1])
        columns = [x[order] for x in columns]
        new = ~_same(*columns)
        k, *c, i = (x[new] for x in columns)
        same = _same(k, *c)
        same[:-1] |= same[1:]
        yield from out(k[same], i[same])

    for batch in batches:
        for b, local, short, k, check, table, which in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                if parts:
                    yield from flush()
                bucket, parts = b, []
            k, table = _long(b, k) if short else np.frombuffer(k, np.uint64), np.frombuffer(table, np.uint64)
            i = table[np.frombuffer(which, np.uint16 if len(which) == 2 * len(k) else np.uint32)]
            if local:
                yield from out(k, i)
            else:
                parts.append((k, i) if check is None else (k, np.frombuffer(check, np.uint64), i))
    if parts:
        yield from flush()


def shared(rows: DataFrame) -> DataFrame:
    """(key, id) for every id of the keys that several ids share, of rows made by pack.

    A key's ids may come more than once.
    """
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionById(width, F.col("bucket") % width).sortWithinPartitions("bucket").mapInArrow(_shared, "key long, id long")
