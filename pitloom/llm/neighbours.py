"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Principal axes and a rotation (ITQ) are fitted on a bounded sample; every
vector gets a code of up to 64 bits.  Codes are cut into substrings of eight
bits, and a block of vectors has an index from each substring's value to its
rows.  If two codes differ in r bits at most, r = m*s + a over m substrings,
one of the first a+1 differs in s bits at most or one of the others in s-1
(pigeonhole); probing those values finds every code within r.  The codes found
are reranked by the cosine of the vectors.  The radius is that which holds
nearly all true neighbours of a sample; a block that yields too few codes is
probed again further out.

The queries are a stated set that grows with the table: queries and rows are
dealt to blocks, each pair of blocks meets in one group of bounded size and
returns a few rows for each query.  Equal vectors are one entry with their
smallest ids, so many copies of one vector are no hot group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import checkpointed

#: Vectors that the axes, the rotation and the radius are fitted on, at most.
SAMPLE_ROWS = 16_000
SAMPLE_VALUES = 4_000_000
#: Share of the sample's true neighbours that the radius holds.
COVER = 0.985
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048

_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fit(sample: np.ndarray, k: int, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, axes (rotated) and radius of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    bits = min(64, max(8, sample.shape[1] // 8 * 8))
    if sample.shape[1] < bits:  # few dimensions: random directions beside the axes
        extra = rng.normal(size=(bits - sample.shape[1], sample.shape[1]))
        axes = np.concatenate([axes, extra / np.linalg.norm(extra, axis=1, keepdims=True)])
    axes = axes[:bits].T
    projected = centred @ axes
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(projected @ rotation).T @ projected)
        rotation = (u @ v).T
    axes = axes @ rotation
    codes = np.packbits(centred @ axes > 0, axis=1)
    asked = rng.permutation(len(sample))[:400]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -9
    top = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    far = [_BITS[codes[i] ^ codes[t]].sum(1) for i, t in zip(asked, top)]
    radius = int(np.quantile(np.concatenate(far), COVER, method="higher")) if top.size else bits
    return mean, axes, radius


class Index:
    """Multi-index hashing over the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.order = [np.argsort(codes[:, i], kind="stable") for i in range(self.m)]
        self.edge = [np.searchsorted(codes[o, i], np.arange(257)) for i, o in enumerate(self.order)]
        self.near = [np.flatnonzero(_BITS <= s) for s in range(9)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from this one in so many bits at most."""
        hit = np.zeros(len(self.codes), bool)
        s, a = divmod(radius, self.m)
        for i in range(self.m):
            flips = min(s if i <= a else s - 1, 8)
            if flips < 0:
                continue
            values = self.near[flips] ^ code[i]
            start, size = self.edge[i][values], self.edge[i][values + 1] - self.edge[i][values]
            pick = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            hit[self.order[i][pick]] = True
        found = np.flatnonzero(hit)
        return found[_BITS[self.codes[found] ^ code].sum(1) <= radius]


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """(embedding, ids): equal vectors once, with their smallest ids; gathered in two steps of bounded groups."""
    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, keep).alias("ids")
    part = vectors.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), 256).alias("part")).agg(ids)
    return part.groupBy("embedding").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every query, of vectors (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by `every`; candidates are
    all rows with another vec_id.  score is the cosine in double precision;
    ties go to the smaller vec_id.  Vectors that are null or zero, hold a null
    or non-finite component, or have another length than most, and null
    vec_ids, take no part.  Repeated rows are one.
    """
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = raw.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("embedding") == sizes["d"])
    rows = checkpointed(_distinct(good, k + 1))
    n = rows.count()
    want = min(SAMPLE_ROWS, max(64, SAMPLE_VALUES // sizes["d"]))
    share = min(1.0, 1.2 * want / n)
    picked = rows.where(F.pmod(F.xxhash64("embedding"), 1_000_000) < int(share * 1_000_000)).orderBy(F.xxhash64("embedding"), "embedding").select("embedding").limit(want)
    sample = np.array([r[0] for r in picked.collect()], np.float64).reshape(-1, sizes["d"])
    sample /= np.abs(sample).max(1, keepdims=True)
    mean, axes, radius = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), k)

    query = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    blocks, asks = -(-n // BLOCK_ROWS), max(1, -(-query.count() // BLOCK_QUERIES))
    place = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    data = rows.withColumns({"block": place("embedding", blocks), "ask": F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))})
    query = query.withColumns({"ask": place("query_id", asks), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            data, asked = np.stack(x["embedding"].to_numpy()).astype(np.float64), np.stack(q["embedding"].to_numpy()).astype(np.float64)
            scale, asked_scale = np.abs(data).max(1, keepdims=True), np.abs(asked).max(1, keepdims=True)
            norm, asked_norm = np.linalg.norm(data / scale, axis=1), np.linalg.norm(asked / asked_scale, axis=1)
            unit, asked_unit = data / scale / norm[:, None], asked / asked_scale / asked_norm[:, None]
            index = Index(np.packbits((unit - mean) @ axes > 0, axis=1))
            codes = np.packbits((asked_unit - mean) @ axes > 0, axis=1)
            lead = np.array([ids[0] for ids in x["ids"]])
            for i, query_id in enumerate(q["query_id"]):
                r = radius
                found = index.within(codes[i], r)
                while len(found) < min(k + 1, len(data)):
                    r += 4
                    found = index.within(codes[i], r)
                score = (data[found] / scale[found]) @ (asked[i] / asked_scale[i]) / (norm[found] * asked_norm[i])
                best = np.lexsort((lead[found], -score))[: k + 1]
                out += [(query_id, float(score[b]), x["ids"].iloc[found[b]]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "score", "ids"])

    met = query.groupBy("ask", "block").cogroup(data.groupBy("ask", "block")).applyInPandas(search, "query_id long, score double, ids array<long>")
    each = met.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
