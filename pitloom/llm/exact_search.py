"""Exact largest inner products through a vector-approximation file.

Each component of a vector is kept as one of up to CELLS cells, one byte.  A
query's product with a cell's ends bounds its product with any vector in it.
First the approximations are scanned: the bounds of all vectors give each query
a floor that the wanted products reach, and vectors whose upper bound lies
below it go.  Then exact vectors are read in the order of their bounds, in two
waves: the most promising few of each query, whose exact products raise the
floor, and those whose bounds still reach it.  What is left out lies below a
product already known, so the result is exact whatever the cells.

Queries are a stated set that grows with the table: blocks of approximations
meet blocks of queries, in groups of bounded size.  Equal vectors are one entry
with their smallest ids, so copies of a vector are no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .neighbours import _distinct
from .session import checkpointed, forget

#: Cells of a component, at most 256.
CELLS = 64
#: Vectors that the cells' inner edges are read off, at most; their ends come from all vectors.
SAMPLE_ROWS = 16_000
SAMPLE_VALUES = 4_000_000
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
#: Blocks of approximations that one group holds.
STRIPE = 8
#: Entries of the first wave, as a multiple of those wanted.
FIRST = 2

_EXACT = 2.0**53
_MOST = 2**63 - 1


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact; what a long can't hold is held at its ends."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    bound = float(np.abs(x.astype(np.float64)).max()) * float(np.abs(y.astype(np.float64)).max()) * x.shape[1]
    if bound < 2.0**62:
        return np.einsum("ij,ij->i", x, y)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(p, q)), -_MOST - 1), _MOST) for p, q in zip(x, y)], np.int64)


def cells(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner edges, and each cell's least and greatest value, of each component; edges are quantiles of the sample.

    Cell i holds the values from edge i - 1 on and below edge i.
    """
    edges = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="higher").astype(np.int64)  # one value may be several edges; cells between are empty
    least = np.vstack([low, edges])
    greatest = np.vstack([edges - 1, high])
    return edges, np.minimum(least, high), np.maximum(np.minimum(greatest, high), least)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _packed(entries: DataFrame, width: int, edges: np.ndarray | None, rows: int) -> DataFrame:
    """(block, e, data): entries in blocks; data are their cells, or without edges their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = _matrix(batch.column("embedding"), np.int64, width)
            if edges is not None:
                x = np.stack([np.searchsorted(edges[:, j], x[:, j], "right") for j in range(width)], 1).astype(np.uint8)
            e = batch.column("e").to_numpy()
            for at in range(0, len(e), rows):
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), pa.array([e[at : at + rows].tobytes()]), pa.array([x[at : at + rows].tobytes()])], names=["block", "e", "data"])
                n += 1

    return entries.select("e", "embedding").mapInArrow(run, "block long, e binary, data binary")


def _scanned(files: DataFrame, queries: DataFrame, least: np.ndarray, greatest: np.ndarray, want: int) -> DataFrame:
    """(q, e, lower, upper): the entries of each group of blocks that may be among the `want` best of a query."""
    width = least.shape[1]
    whole = np.arange(width)

    def scan(q: pa.Table, x: pa.Table) -> pa.Table:
        asks = [(np.frombuffer(i.as_py(), np.int64), np.frombuffer(v.as_py(), np.int64).reshape(-1, width)) for i, v in zip(q["e"], q["data"])]
        found: list[tuple] = []
        if asks and len(x):
            ids = np.concatenate([np.frombuffer(i.as_py(), np.int64) for i in x["e"]])
            code = np.concatenate([np.frombuffer(v.as_py(), np.uint8).reshape(-1, width) for v in x["data"]])
            for query, vectors in asks:
                v = vectors.astype(np.float64)
                slack = np.abs(v) @ np.maximum(np.abs(least), np.abs(greatest)).max(0) * width * 2.0**-51  # rounding of the sums; none where they are exact
                slack[slack < 2.0 * width] = 0
                above, below = np.maximum(v, 0), np.minimum(v, 0)
                upper, lower = np.empty((len(query), len(ids))), np.empty((len(query), len(ids)))
                for at in range(0, len(ids), 2048):
                    low, high = least[code[at : at + 2048], whole].astype(np.float64), greatest[code[at : at + 2048], whole].astype(np.float64)
                    upper[:, at : at + 2048] = above @ high.T + below @ low.T
                    lower[:, at : at + 2048] = above @ low.T + below @ high.T
                upper += slack[:, None]
                lower -= slack[:, None]
                if len(ids) > want:
                    floor = np.partition(lower, len(ids) - want, axis=1)[:, len(ids) - want]
                    i, j = np.nonzero(upper >= floor[:, None])
                else:
                    i, j = (a.ravel() for a in np.indices(upper.shape))
                found.append((query[i], ids[j], lower[i, j], upper[i, j]))
        out = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, k) for k in (np.int64, np.int64, np.float64, np.float64)]
        return pa.table(dict(zip(("q", "e", "lower", "upper"), out)))

    return queries.groupBy("ask", "stripe").cogroup(files.groupBy("ask", "stripe")).applyInArrow(scan, "q long, e long, lower double, upper double")


def _scores(pairs: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """(q, e, lead, score) of pairs (q, e): exact vectors are read for them alone."""
    rows = pairs.join(entries.select("e", F.element_at("ids", 1).alias("lead"), "embedding"), "e").join(entries.select(F.col("e").alias("q"), F.col("embedding").alias("ask")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = products(_matrix(batch.column("ask"), np.int64, width), _matrix(batch.column("embedding"), np.int64, width))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("e"), batch.column("lead"), pa.array(score)], names=["q", "e", "lead", "score"])

    return rows.select("q", "e", "lead", "ask", "embedding").mapInArrow(run, "q long, e long, lead long, score long")


def largest_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest products of every query, of vectors (vec_id, embedding).

    A component x counts as floor(scale * x).  Queries are the rows whose
    vec_id is divisible by `every`; candidates are all rows but the query's
    own; ties go to the smaller vec_id.  Vectors that are null, hold a null or
    non-finite component or have another length than most (than the shorter of
    equally frequent ones), empty ones and null vec_ids, take no part; zero
    vectors do.  A row is its vec_id and its vector in whole numbers: what
    repeats both is one row, and rows that share an id are rows of their own.
    Components and products that a long can't hold are held at its ends.  An
    empty table gives none; other columns are not read.
    """
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * float(scale), F.lit(9.2e18)), F.lit(-9.2e18))), F.lit(_MOST)), F.lit(-_MOST)))
    good = raw.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", whole.alias("embedding"))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, want = sizes["d"], k + 1
    good = good.where(F.size("embedding") == width)
    entries = checkpointed(_distinct(good, want).withColumn("e", F.monotonically_increasing_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x = _matrix(batch.column("embedding"), np.int64, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0)), pa.array([len(x)] * width, pa.int64())], names=["i", "low", "high", "n"])

    span = sorted(entries.select("embedding").mapInArrow(ends, "i int, low long, high long, n long").groupBy("i").agg(F.min("low"), F.max("high"), F.sum("n")).collect())
    n = span[0][3]
    low, high = (np.array([r[i] for r in span], np.int64) for i in (1, 2))
    take = min(SAMPLE_ROWS, max(64, SAMPLE_VALUES // width))
    share = min(1.0, 1.2 * take / n)
    sample = entries.where(F.pmod(F.xxhash64("embedding"), 1_000_000) < int(share * 1_000_000) + 1).select("embedding").limit(take).collect()
    edges, least, greatest = cells(np.array([r[0] for r in sample] or [low], np.int64).reshape(-1, width), low, high)

    asked = checkpointed(good.where(F.col("vec_id") % every == 0).distinct().join(entries.select("e", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")))
    queries = _packed(entries.join(asked.select(F.col("q").alias("e")).distinct(), "e", "left_semi"), width, None, BLOCK_QUERIES)
    files, queries = checkpointed(_packed(entries, width, edges, BLOCK_ROWS)), checkpointed(queries)
    n_queries = queries.count()
    stripes = max(1, -(-files.count() // STRIPE))
    number = lambda df, m: F.pmod(F.xxhash64("block"), m).cast("int")
    every_one = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    met = _scanned(files.withColumns({"stripe": number(files, stripes), "ask": every_one(max(1, n_queries))}), queries.withColumns({"ask": number(queries, max(1, n_queries)), "stripe": every_one(stripes)}), least, greatest, want)
    of_query = Window.partitionBy("q")
    floor = F.nth_value("lower", want).over(of_query.orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hope = met.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    hope = checkpointed(hope.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("upper"), "e"))).select("q", "e", "upper", "place"))
    forget(files, queries)

    first = checkpointed(_scores(hope.where(F.col("place") <= FIRST * want).select("q", "e"), entries, width))
    known = first.withColumn("n", F.row_number().over(of_query.orderBy(F.desc("score")))).where(F.col("n") == want).select("q", F.col("score").alias("floor"))
    rest = hope.where(F.col("place") > FIRST * want).join(known, "q").where(F.col("upper") >= F.col("floor")).select("q", "e")
    scored = first.unionByName(_scores(rest, entries, width))
    best = scored.withColumn("n", F.row_number().over(of_query.orderBy(F.desc("score"), "lead"))).where(F.col("n") <= want)
    each = asked.join(best.join(entries.select("e", "ids"), "e"), "q")
    each = each.select("query_id", "q", "e", "score", F.explode("ids").alias("vec_id")).where("not (e = q and vec_id = query_id)")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
