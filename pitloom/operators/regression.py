"""Least squares for each group: any number of regressors, Newey-West errors, Granger tests.

A group's moments (count, means, covariances) are one aggregate that merges
map-side, so its rows are never gathered.  The errors need the products of
neighbouring scores x * u: rows are dealt to ranges of (key, order), so that a
group which holds much of the rows is many tasks; each task sums its own
products and keeps the first and last scores of a group, and where ranges meet
the missing products come from those.  What is solved for a group is a matrix
as wide as its regressors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import by
from ..functions.tails import f_tail, incomplete_beta

#: From this condition number of the cross products on a ridge is added, of this share of their mean diagonal and at least this much; t-values end at this bound; a smaller error counts as none.
CONDITION, RIDGE, LEAST_RIDGE, LARGEST_T, LEAST_ERROR = 1e10, 1e-6, 1e-8, 50.0, 1e-8
_FIT = "inter double, beta array<double>, bread array<double>, rest double, total double, condition double, ridge boolean"


def _rows(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    z = [F.col(f"`{c}`").cast("double").alias(f"_z{i}") for i, c in enumerate(columns)]
    rows = df.select(F.struct(*(F.col(f"`{k}`") for k in keys)).alias("_key"), F.col(f"`{order}`").alias("_at"), *z)
    for i in range(len(columns)):
        rows = rows.where((F.abs(F.col(f"_z{i}")) < float("inf")))  # drops null, NaN (the largest) and infinite values
    return rows


def _moments(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    pairs = [F.covar_samp(f"_z{i}", f"_z{j}") for i in range(k) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(f"_z{i}") for i in range(k))).alias("_mean"), F.array(*pairs).alias("_cov"))


def _square(flat: pd.Series) -> np.ndarray:
    flat = np.array([np.asarray(x, np.float64) for x in flat])
    k = int(np.sqrt(2 * flat.shape[1]))
    i, j = np.tril_indices(k)
    out = np.empty((len(flat), k, k))
    out[:, i, j] = out[:, j, i] = flat
    return out


def fit(n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients (the constant first) of the first variable on the others, the inverse of the cross products, sums of squares."""
    n, m, y = n.astype(float), mean[:, 1:], mean[:, 0]
    c, cy, k = (n - 1)[:, None, None] * cov[:, 1:, 1:], (n - 1)[:, None] * cov[:, 1:, 0], mean.shape[1]
    cross = np.empty((len(n), k, k))
    cross[:, 0, 0], cross[:, 0, 1:], cross[:, 1:, 0] = n, n[:, None] * m, n[:, None] * m
    cross[:, 1:, 1:] = c + n[:, None, None] * m[:, :, None] * m[:, None, :]
    condition = np.linalg.cond(cross)
    ridge = ~(condition <= CONDITION)
    bread, beta = np.empty((len(n), k, k)), np.empty((len(n), k))
    if (~ridge).any():  # about the means, which loses fewer digits
        g = ~ridge
        inner = np.linalg.inv(c[g])
        slope = np.einsum("gij,gj->gi", inner, cy[g])
        mi = np.einsum("gi,gij->gj", m[g], inner)
        bread[g, 0, 0], bread[g, 1:, 1:] = 1 / n[g] + np.einsum("gj,gj->g", mi, m[g]), inner
        bread[g, 0, 1:] = bread[g, 1:, 0] = -mi
        beta[g, 1:], beta[g, 0] = slope, y[g] - (m[g] * slope).sum(1)
    if ridge.any():
        add = np.maximum(RIDGE * np.trace(cross[ridge], axis1=1, axis2=2) / k, LEAST_RIDGE)
        bread[ridge] = np.linalg.inv(cross[ridge] + add[:, None, None] * np.eye(k))
        right = np.concatenate([(n * y)[:, None], cy + (n * y)[:, None] * m], 1)[ridge]
        beta[ridge] = np.einsum("gij,gj->gi", bread[ridge], right)
    b, total = beta[:, 1:], (n - 1) * cov[:, 0, 0]
    off = y - beta[:, 0] - (m * b).sum(1)
    rest = total - 2 * (b * cy).sum(1) + np.einsum("gi,gij,gj->g", b, c, b) + n * off * off
    return {"beta": beta, "bread": bread, "rest": np.maximum(rest, 0.0), "total": total, "condition": condition, "ridge": ridge}


def _fitted(n: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
    if not len(n):
        return pd.DataFrame({c.split()[0]: [] for c in _FIT.split(", ")})
    f = fit(n.to_numpy(), np.array([np.asarray(x) for x in mean]), _square(cov))
    return pd.DataFrame({"inter": f["beta"][:, 0], "beta": list(f["beta"][:, 1:]), "bread": list(f["bread"].reshape(len(n), -1)), **{c: f[c] for c in ("rest", "total", "condition", "ridge")}})


def _lag_products(ahead: np.ndarray, scores: np.ndarray, same: np.ndarray, starts: np.ndarray, lags: int) -> np.ndarray:
    """Sums of s_t s_{t-l}' over the runs that begin at starts; `ahead` are the scores just before the first row, same[t] counts the rows of t's run before t, those ahead included."""
    p, n, k = len(ahead), *scores.shape
    line, out = np.concatenate([ahead, scores]), np.zeros((len(starts), lags + 1, k, k))
    for lag in range(lags + 1):
        skip = max(0, lag - p)
        if skip < n:
            product = np.zeros((n, k, k))
            product[skip:] = scores[skip:, :, None] * line[p + skip - lag : p + n - lag, None, :] * (same[skip:] >= lag)[:, None, None]
            out[:, lag] = np.add.reduceat(product, starts, axis=0)
    return out


def joined_products(parts: Sequence[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The lag products of a series from those of its parts in order: (rows, products, first scores, last scores)."""
    total, last = np.zeros_like(parts[0][1]), parts[0][2][:0]
    lags = len(total) - 1
    for n, products, head, tail in parts:
        total = total + products
        p = len(last)
        for lag in range(1, lags + 1):
            for j in range(max(0, lag - p), min(lag, len(head))):
                total[lag] += np.outer(head[j], last[p + j - lag])
        last = np.concatenate([last, tail])[-lags:] if lags else last
    return total


def _score_parts(rows: DataFrame, k: int, lags: int) -> DataFrame:
    """For each group `_parts`: lag products, first and last scores of its ranges.  rows have _z0 to _z{k-1} and the fit."""
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = F.col("_z0") - F.col("_fit.inter")
    for i in range(1, k):
        rest = rest - F.col(f"_z{i}") * F.col("_fit.beta")[i - 1]
    rows = rows.select("_key", "_at", rest.alias("_u"), *(f"_z{i}" for i in range(1, k)))
    rows = rows.repartitionByRange(width, "_key", "_at").sortWithinPartitions("_key", "_at").withColumn("_h", F.xxhash64("_key")).drop("_at")
    parts = T.StructType([rows.schema["_key"]] + [T.StructField(c, T.LongType()) for c in ("place", "rows")] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("products", "head", "tail")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_ = TaskContext.get().partitionId(), None

        def emitted(done: list) -> pa.RecordBatch:
            flat = lambda c: pa.array([d[c].reshape(-1) for d in done], pa.list_(pa.float64()))
            keys = pa.concat_arrays([d["key"] for d in done])
            return pa.RecordBatch.from_arrays([keys, pa.array([place] * len(done), pa.int64()), pa.array([d["n"] for d in done], pa.int64()), flat("products"), flat("head"), flat("tail")], names=parts.names)

        for batch in (b for b in batches if b.num_rows):
            h, u, done = batch.column("_h").to_numpy(), batch.column("_u").to_numpy(), []
            scores = np.stack([u, *(u * batch.column(f"_z{i}").to_numpy() for i in range(1, k))], 1)
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(starts, len(h)))
            goes_on = open_ is not None and open_["h"] == h[0]
            ahead = open_["tail"] if goes_on else scores[:0]
            same = np.arange(len(h)) - np.repeat(starts, sizes)
            same[: sizes[0]] += len(ahead)
            products = _lag_products(ahead, scores, same, starts, lags)
            for r, (a, size) in enumerate(zip(starts, sizes)):
                own = scores[a : a + size]
                if r == 0 and goes_on:
                    open_["n"] += size
                    open_["products"] = open_["products"] + products[0]
                    open_["head"] = np.concatenate([open_["head"], own])[:lags]
                    open_["tail"] = np.concatenate([open_["tail"], own])[-lags:] if lags else own[:0]
                    continue
                if open_ is not None:
                    done.append(open_)
                open_ = {"key": batch.column("_key").slice(a, 1), "h": h[a], "n": int(size), "products": products[r], "head": own[:lags].copy(), "tail": own[-lags:].copy() if lags else own[:0]}
            if done:
                yield emitted(done)
        if open_ is not None:
            yield emitted([open_])

    found = rows.mapInArrow(run, parts)
    return found.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("place", "rows", "products", "head", "tail"))).alias("_parts"))  # at most one for each range


def regressions(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], order: str, lags: int | None = 4, least: int = 30) -> DataFrame:
    """One row for each group of keys: y on xs and a constant.

    Columns beside the keys: n; terms ('const', then xs) and in their order
    beta, se, t, p; r2, adjusted_r2, condition (of the cross products) and
    ridge.  Errors are Newey-West's with so many lags and Bartlett weights,
    along `order`; lags None gives those of equal variances.  Groups of fewer
    than `least` rows, or with no more than ten rows beyond their terms, give
    no row.  Rows in which y or an x is null, NaN or infinite take no part,
    and the next row follows the one before.  Null keys are a group.  Rows of
    a group with the same order are taken in no stated order.  From a
    condition number of 1e10 on a ridge is added, to coefficients and errors
    alike.  t is kept within 50; an error of 1e-8 or less is null, with t 0
    and p 1.  A y that doesn't vary has an r2 of 0.  An empty table gives an
    empty one.
    """
    k, names = len(xs) + 1, ["const", *xs]
    rows = _rows(df, keys, order, [y, *xs])
    solved = _moments(rows, ["_key"], k).where((F.col("n") >= least) & (F.col("n") > k + 10))
    solved = solved.select("_key", "n", F.pandas_udf(_fitted, _FIT)("n", "_mean", "_cov").alias("_fit"))
    if lags is not None:
        solved = solved.join(_score_parts(rows.join(solved, "_key"), k, lags), "_key")
    else:
        solved = solved.withColumn("_parts", F.lit(None).cast("array<struct<place:long,rows:long,products:array<double>,head:array<double>,tail:array<double>>>"))
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([solved.schema["_key"], T.StructField("n", T.LongType()), *(T.StructField(c, doubles) for c in ("beta", "se", "t", "p")), *(T.StructField(c, T.DoubleType()) for c in ("r2", "adjusted_r2", "condition")), T.StructField("ridge", T.BooleanType())])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in schema.names[2:]}
            for n, f, parts in zip(batch.column("n").to_pylist(), batch.column("_fit").to_pylist(), batch.column("_parts").to_pylist()):
                beta, bread = np.array([f["inter"], *f["beta"]]), np.array(f["bread"]).reshape(k, k)
                if parts is None:
                    spread = f["rest"] / (n - k) * bread
                else:
                    shaped = [(p["rows"], np.array(p["products"]).reshape(lags + 1, k, k), np.array(p["head"]).reshape(-1, k), np.array(p["tail"]).reshape(-1, k)) for p in parts]
                    products = joined_products(shaped)
                    meat = products[0] + sum((1 - lag / (lags + 1)) * (products[lag] + products[lag].T) for lag in range(1, lags + 1))
                    spread = bread @ meat @ bread
                with np.errstate(invalid="ignore", divide="ignore"):
                    se = np.sqrt(np.diag(spread))
                    good = np.isfinite(se) & (se > LEAST_ERROR)
                    t = np.where(good, np.clip(beta / np.where(good, se, 1.0), -LARGEST_T, LARGEST_T), 0.0)
                dof = float(n - k)
                p = np.where(good, incomplete_beta(dof / (dof + t * t), np.array(dof / 2), np.array(0.5)), 1.0)
                r2 = 1 - f["rest"] / f["total"] if f["total"] > 0 else 0.0
                for c, v in (("beta", beta.tolist()), ("se", [s if g else None for s, g in zip(se.tolist(), good)]), ("t", t.tolist()), ("p", p.tolist()), ("r2", r2), ("adjusted_r2", 1 - (1 - r2) * (n - 1) / (n - k - 1)), ("condition", f["condition"]), ("ridge", f["ridge"])):
                    out[c].append(v)
            kinds = {c: pa.list_(pa.float64()) if c in ("beta", "se", "t", "p") else pa.bool_() if c == "ridge" else pa.float64() for c in out}
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("n"), *(pa.array(out[c], kinds[c]) for c in out)], names=schema.names)

    done = solved.select("_key", "n", "_fit", "_parts").mapInArrow(weighed, schema)
    return done.select(*(F.col(f"_key.`{c}`").alias(c) for c in keys), "n", F.array(*map(F.lit, names)).alias("terms"), *schema.names[2:])


def by_term(fits: DataFrame) -> DataFrame:
    """regressions() with a row for each term in place of the arrays."""
    arrays = ["terms", "beta", "se", "t", "p"]
    long = fits.withColumn("_t", F.explode(F.arrays_zip(*arrays))).drop(*arrays)
    return long.select(*long.drop("_t").columns, F.col("_t.terms").alias("term"), *(F.col(f"_t.{c}").alias(c) for c in arrays[1:]))


def granger(df: DataFrame, keys: Sequence[str], y: str, x: str, order: str, max_lag: int, more: int = 20) -> DataFrame:
    """For each group and lag of 1 to max_lag: n, f, p of the last `lag` x beside the last `lag` y, and `best`, the lag of the least p (to 12 digits, then the smaller).

    Each lag has its own rows, those that have so many before them.  Rows
    whose y or x is null, NaN or infinite take no part, and the next follows
    the one before.  Groups of fewer than max_lag + more rows give none.  Null
    keys are a group; an empty table gives an empty one.  A regressor that
    depends on the others adds nothing; a perfect fit gives null f and p.
    """
    rows = _rows(df, keys, order, [y, x])
    w = by("_key", "_at")
    past = [F.lag(f"_z{i}", lag).over(w).alias(f"_p{i}_{lag}") for i in range(2) for lag in range(1, max_lag + 1)]
    rows = rows.select("_key", "_z0", *past)
    widths = [F.struct(F.lit(lag).alias("lag"), *(F.when(F.lit(j <= lag), F.col(f"_p{i}_{j}")).alias(f"_z{1 + i * max_lag + j - 1}") for i in range(2) for j in range(1, max_lag + 1))) for lag in range(1, max_lag + 1)]
    rows = rows.select("_key", "_z0", F.inline(F.array(*widths))).where(F.array(*(F.col(f"_z{j}") for j in range(1, max_lag + 1)))[F.col("lag") - 1].isNotNull())
    moments = _moments(rows, ["_key", "lag"], 2 * max_lag + 1).where(F.col("n") + F.col("lag") >= max_lag + more)

    def rests(lag: pd.Series, cov: pd.Series) -> pd.DataFrame:
        out = []
        for lag, flat in zip(lag, cov):
            i, j = np.tril_indices(2 * max_lag + 1)
            c = np.zeros((2 * max_lag + 1, 2 * max_lag + 1))
            c[i, j] = c[j, i] = np.array([np.nan if v is None else v for v in flat], np.float64)
            own, other = list(range(1, lag + 1)), list(range(1 + max_lag, 1 + max_lag + lag))
            left = []
            for used in (own, own + other):
                a, b = c[np.ix_(used, used)], c[used, 0]
                d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
                left.append(c[0, 0] - (b / d) @ np.linalg.lstsq(a / np.outer(d, d), b / d, rcond=1e-12)[0])
            out.append((left[0], left[1] if left[1] > 1e-14 * c[0, 0] else np.nan))
        return pd.DataFrame(out, columns=["small", "large"], dtype=float)

    tests = moments.select("_key", "lag", "n", F.pandas_udf(rests, "small double, large double")("lag", "_cov").alias("r"))
    below = F.col("n") - 2 * F.col("lag") - 1
    f = F.when(F.isnan("r.large"), None).otherwise(((F.col("r.small") - F.col("r.large")) / F.col("lag")) / (F.col("r.large") / below))
    tests = tests.select("_key", "lag", "n", f.alias("f")).withColumn("p", f_tail(F.col("f"), F.col("lag"), F.col("n") - 2 * F.col("lag") - 1))
    best = tests.groupBy("_key").agg(F.min(F.when(F.col("p").isNotNull(), F.struct(F.round("p", 12), "lag")))["lag"].alias("best"))
    return tests.join(best, "_key").select(*(F.col(f"_key.`{c}`").alias(c) for c in keys), "lag", "n", "f", "p", "best")
