"""Removal of word windows that occur more than once in a corpus, by level-wise doubling.

The first level takes, of every window of the wanted length, only its smallest
run of a quarter of that length (a minimizer): equal windows have equal ones,
and some one in ten of the runs is such.  Runs that occur once are dropped;
the rest are extended to twice the length, to the right and to the left, and
counted again; windows that hold a run still repeated, and only they, are
hashed at the full length, by 128 bits in two independent halves.  A level without repeats ends the work.  Equal
texts count once, with their number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, words
from .session import checkpointed, forget

_RIGHT, _LEFT = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def _hashes(buf: np.ndarray, offsets: np.ndarray, lane: int = 0):
    starts, ends, first = words.spans(buf, offsets)
    return words.span_hashes(buf, starts, ends, lane), first


def _anchors(hashes: np.ndarray, first: np.ndarray, length: int, run: int):
    """Starts of the windows, each one's minimizer's start, and the run hashes by start."""
    at, h = words.windows(hashes, first, run)
    by_start = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    by_start[at] = h
    starts, _ = words.windows(hashes, first, length)
    width = length - run + 1
    if not len(starts):
        return starts, starts, by_start
    # sliding minimum by doubling; the leftmost of equal runs is taken
    low, where, reach = by_start.copy(), np.arange(len(by_start)), 1
    while 2 * reach <= width:
        other, other_at = low[reach:], where[reach:]
        take = other < low[:-reach]
        low[:-reach] = np.where(take, other, low[:-reach])
        where[:-reach] = np.where(take, other_at, where[:-reach])
        reach *= 2
    second = starts + width - reach
    return starts, np.where(low[second] < low[starts], where[second], where[starts]), by_start


def _extended(hashes: np.ndarray, first: np.ndarray, at: np.ndarray, run: int):
    """Keys of the runs extended to twice their length, to the right and to the left (0 where the text ends)."""
    where, h = words.windows(hashes, first, 2 * run)
    by_start = np.zeros(len(hashes) + 1, np.uint64)
    by_start[where] = h
    owner = np.searchsorted(first, at, "right") - 1
    right = np.where(by_start[at] != 0, words.mix(by_start[at] ^ _RIGHT), 0)
    back = at - run
    inside = back >= first[owner]
    left = np.where(inside & (by_start[np.maximum(back, 0)] != 0), words.mix(by_start[np.maximum(back, 0)] ^ _LEFT), 0)
    return right, left


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    of = np.sort(of)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def _per_text(owner_ids: np.ndarray, hashes: np.ndarray, keep: list[np.ndarray], first: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the values are kept by their own text."""
    out = np.zeros(len(of), bool)
    edge = np.searchsorted(owner_ids, np.arange(len(keep) + 1))
    for t, mine in enumerate(keep):
        x, y = edge[t], edge[t + 1]
        if y > x and len(mine):
            out[x:y] = _member(of[x:y], mine)
    return out


def _seen(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) if x else np.zeros(0, np.uint64) for x in batch.column(column).to_pylist()]


def _level_one(length: int, run: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, buf, offsets in words.texts(batch.column(1)):
                hashes, first = _hashes(buf, offsets)
                starts, anchor, by_start = _anchors(hashes, first, length, run)
                at = np.unique(anchor)
                yield from packed.pack(by_start[at], ids[lo:hi][np.searchsorted(first, at, "right") - 1], buckets, again=True)

    return work


def _level_two(length: int, run: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keep = batch.column("k1").to_numpy(zero_copy_only=False).view(np.uint64), _seen(batch, "seen")
            for lo, hi, buf, offsets in words.texts(batch.column("text")):
                hashes, first = _hashes(buf, offsets)
                _, anchor, by_start = _anchors(hashes, first, length, run)
                at = np.unique(anchor)
                owner = np.searchsorted(first, at, "right") - 1
                at = at[_per_text(owner, hashes, keep[lo:hi], first, by_start[at])]
                owner = ids[lo:hi][np.searchsorted(first, at, "right") - 1]
                right, left = _extended(hashes, first, at, run)
                keys, who = np.concatenate([right, left]), np.concatenate([owner, owner])
                yield from packed.pack(keys[keys != 0], who[keys != 0], buckets, again=True)

    return work


def _candidates(hashes, first, keep, length, run):
    """Starts of the windows that hold a run whose extension inside the window is kept."""
    starts, anchor, _ = _anchors(hashes, first, length, run)
    right, left = _extended(hashes, first, anchor, run)
    owner = np.searchsorted(first, starts, "right") - 1
    offset = anchor - starts
    ok = (offset > length - 2 * run) | _per_text(owner, hashes, keep, first, right)
    ok &= (offset < run) | _per_text(owner, hashes, keep, first, left)
    return starts[ok]


def _level_three(length: int, run: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keep = batch.column("k1").to_numpy(zero_copy_only=False).view(np.uint64), _seen(batch, "wide")
            for lo, hi, buf, offsets in words.texts(batch.column("text")):
                hashes, first = _hashes(buf, offsets)
                at = _candidates(hashes, first, keep[lo:hi], length, run)
                where, h = words.windows(hashes, first, length)
                _, check = words.windows(_hashes(buf, offsets, 1)[0], first, length)
                pick = np.searchsorted(where, at)
                yield from packed.pack(h[pick], ids[lo:hi][np.searchsorted(first, at, "right") - 1], buckets, again=True, check=check[pick])

    return work


def _cut(length: int):
    """Rows of a text and its repeated windows to what is left of the text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = _seen(batch, "found"), []
            for lo, hi, buf, offsets in words.texts(batch.column("text")):
                starts, ends, first = words.spans(buf, offsets)
                where, h = words.windows(words.span_hashes(buf, starts, ends), first, length)
                owner = np.searchsorted(first, where, "right") - 1
                gone = words.covered(where[_per_text(owner, h, keep[lo:hi], first, h)], length, len(starts))
                data = buf.tobytes()
                for t in range(hi - lo):
                    x, y = first[t], first[t + 1]
                    left = np.flatnonzero(~gone[x:y]) + x
                    text = b" ".join([data[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())])
                    out.append((int(y - x - len(left)), text))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()).cast(pa.string())], names=["k1", "k2", "n_removed", "kept"])

    return work


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = [b" ".join(x.split()) if x else b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.count(b" ") + 1 if x else 0 for x in joined], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined])], names=[*batch.schema.names[:-1], "n_words", "whole_sha256"])


def _by_text(rows: DataFrame, name: str) -> DataFrame:
    """A text's own keys as one binary value; they are no more than its words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, parts = None, []
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out, edge = [], [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for x, y in zip(edge[:-1], edge[1:]):
                if y == x:
                    continue
                if have is not None and ids[x] != have:
                    out.append((have, np.concatenate(parts).tobytes()))
                    parts = []
                have = ids[x]
                parts.append(keys[x:y])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["k1", name])
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array([have], pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["k1", name])

    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(F.col("id").alias("k1"), "key").repartition(width, "k1").sortWithinPartitions("k1", "key")
    return dealt.mapInArrow(work, f"k1 long, {name} binary")


def _keys(seed: int) -> list[F.Column]:
    return [F.xxhash64(F.lit(seed), F.col("text")).alias("k1"), F.xxhash64(F.lit("second"), F.col("text")).alias("k2")]


def repeated_windows_removed(docs: DataFrame, length: int = 35, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row of docs.

    A word goes if it lies in a window of so many words whose sequence also
    starts anywhere else in docs, the same text included; windows are judged
    on the input.  A null text has no words.  Texts shorter than a window stay
    whole.  Every copy of a repeated text loses all windows, the first too.
    with_text adds the kept words, joined by one space.
    """
    run = max(1, (length + 1) // 4)
    docs = docs.select("doc_id", "text")
    # equal texts are one text with a number of copies
    seed = 0
    while True:
        light = checkpointed(docs.select("doc_id", *_keys(seed), "text").mapInArrow(_whole, "doc_id long, k1 long, k2 long, n_words long, whole_sha256 string"))
        # two texts under one k1: take another hash
        if light.groupBy("k1").agg((F.min("k2") != F.max("k2")).alias("x")).where("x").isEmpty():
            break
        seed += 1
    copies = light.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"))
    total = light.agg(F.sum("n_words")).first()[0] or 0
    buckets = packed.buckets_for(docs.sparkSession, total / 8)
    texts = docs.where("text is not null").select(*_keys(seed), "text")
    one = packed.shared(texts.select("k1", "text").mapInArrow(_level_one(length, run, buckets), packed.SCHEMA)).distinct()
    seen = _by_text(one, "seen").join(copies.select("k1", "k2"), "k1")
    # text of a repeated run's texts, once for each
    first = texts.groupBy("k1", "k2").agg(F.min("text").alias("text")).join(seen, ["k1", "k2"])
    held = checkpointed(first)
    two = packed.shared(held.mapInArrow(_level_two(length, run, buckets), packed.SCHEMA)).distinct()
    wide = held.drop("seen").join(_by_text(two, "wide"), "k1")
    three = packed.shared(wide.mapInArrow(_level_three(length, run, packed.buckets_for(docs.sparkSession, total / 4)), packed.SCHEMA))
    found = _by_text(three, "found")
    cut = held.drop("seen").join(found, "k1").mapInArrow(_cut(length), "k1 long, k2 long, n_removed long, kept string")
    cut = checkpointed(cut.select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("sha"), *(["kept"] if with_text else [])))
    forget(held)
    # a text with copies repeats every window of its own
    gone = (F.col("copies") > 1) & (F.col("n_words") >= length)
    answer = copies.join(cut, ["k1", "k2"], "left").select(
        "k1", "k2",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("sha"),
        *([F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    ).where("n_removed > 0")
    out = light.join(answer, ["k1", "k2"], "left")
    cols = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole_sha256").alias("kept_sha256")]
    return out.select(*cols, *(["kept"] if with_text else []))
