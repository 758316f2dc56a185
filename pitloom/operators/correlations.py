"""Correlations of all pairs of series as products of dense blocks.

Series are dealt to blocks and keys to chunks, so a task holds one chunk of
two blocks as matrices, and a product gives the sums of all their pairs at
once.  A row is copied once for each block, not once for each other series,
and what leaves a task is one row for each pair, not for each pair and key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Series of a block and keys of a chunk, about: blocks are dealt by hash.
BLOCK, CHUNK = 256, 1024


def _dense(codes: np.ndarray, places: np.ndarray, x: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether they are there; the mean of rows with one place."""
    total, count = np.zeros((height, width)), np.zeros((height, width))
    np.add.at(total, (places, codes), x)
    np.add.at(count, (places, codes), 1.0)
    return np.divide(total, count, out=total, where=count > 0), (count > 0).astype(float)


def pair_correlations(df: DataFrame, key: str, series: str, value: str, least: int = 2, part: str | None = None, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n, corr) of every unordered pair of series, met on the key; with `part`, for each of its values (null among them).

    Rows with a null key, series or value, or a NaN or infinite one, take no
    part; of several rows of one key and series the mean counts.  Pairs that
    meet on fewer than `least` keys are left out; corr is null where a side is
    constant, to some 14 digits, and for pairs that meet once.  Sums are taken
    about the series' means.  An empty table gives an empty one.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(series).alias("_s"), F.col(value).cast("double").alias("_x"), (F.col(part) if part else F.lit(None).cast("string")).alias("_part"))
    rows = stored(rows.where(F.col("_k").isNotNull() & F.col("_s").isNotNull() & (F.abs("_x") < float("inf"))))  # read three times
    means = rows.groupBy("_s").agg(F.avg("_x").alias("_m"))
    rows = rows.join(means, "_s").select("_k", "_s", (F.col("_x") - F.col("_m")).alias("_x"), "_part")
    size = rows.agg(F.approx_count_distinct("_s").alias("s"), F.approx_count_distinct("_k").alias("k")).first()  # two numbers
    blocks, chunks = -(-size["s"] // block) or 1, -(-size["k"] // chunk) or 1
    own = F.pmod(F.xxhash64("_s"), F.lit(blocks)).cast("int")
    cells = rows.withColumn("_b", own).withColumn("_c", F.pmod(F.xxhash64("_k"), F.lit(chunks)).cast("int"))
    cells = cells.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    kind, parted = df.schema[series].dataType.simpleString(), df.schema[part].dataType.simpleString() if part else "string"

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pdf["_s"], sort=True)
        places, dates = pd.factorize(pdf["_k"])
        x, m = _dense(codes, places, pdf["_x"].to_numpy(float), len(names), len(dates))
        home = np.zeros(len(names), int)
        home[codes] = pdf["_b"].to_numpy()
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        left, right = np.flatnonzero(home == i), np.flatnonzero(home == j)
        l, lm, r, rm = x[:, left], m[:, left], x[:, right], m[:, right]  # noqa: E741
        sums = {"n": lm.T @ rm, "x": l.T @ rm, "y": lm.T @ r, "xx": (l * l).T @ rm, "yy": lm.T @ (r * r), "xy": l.T @ r}
        a, b = np.meshgrid(left, right, indexing="ij")
        keep = (sums["n"] > 0) & ((a < b) if i == j else True)
        a, b, sums = a[keep], b[keep], {c: v[keep] for c, v in sums.items()}
        turn = a > b
        out = {"a": names[np.where(turn, b, a)], "b": names[np.where(turn, a, b)], "n": sums["n"].astype(np.int64), "x": np.where(turn, sums["y"], sums["x"]), "y": np.where(turn, sums["x"], sums["y"]), "xx": np.where(turn, sums["yy"], sums["xx"]), "yy": np.where(turn, sums["xx"], sums["yy"]), "xy": sums["xy"]}
        return pd.DataFrame({"_part": pdf["_part"].iloc[0], **out})

    found = cells.groupBy("_part", "_i", "_j", "_c").applyInPandas(products, f"_part {parted}, a {kind}, b {kind}, n long, x double, y double, xx double, yy double, xy double")
    total = found.groupBy("_part", "a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    spread = [F.col(c + c) - F.col(c) * F.col(c) / F.col("n") for c in "xy"]
    flat = F.col("n") < 2
    for c, s in zip("xy", spread):
        flat = flat | (s <= F.col(c + c) * 1e-14)
    corr = F.when(~flat, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread[0] * spread[1]))
    return total.where(F.col("n") >= least).select(*([F.col("_part").alias(part)] if part else []), "a", "b", "n", corr.alias("corr"))
