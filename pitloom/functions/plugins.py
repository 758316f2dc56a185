"""Where a user's own code enters: factors, batch scorers, row rules, fits by group, windows of a series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import clip, percent_rank, zscore


class Factor:
    """A subclass gives raw values (date, ticker, raw); compute adds the clipped z-score, the rank and the day they are known."""

    limit = 3.0
    lag_days = 1

    def raw(self, panel: DataFrame) -> DataFrame:
        raise NotImplementedError

    def compute(self, panel: DataFrame) -> DataFrame:
        r = self.raw(panel).select("date", "ticker", "raw")
        z = clip(zscore(F.col("raw"), Window.partitionBy("date")), -self.limit, self.limit)
        return r.withColumns({"z": z, "pct": percent_rank(F.col("raw"), "date"), "known": F.date_add("date", self.lag_days)})


def scored(df: DataFrame, text: str, load: Callable[[], Callable[[pd.Series], pd.Series]], name: str = "score") -> DataFrame:
    """df with a score of each text. `load` runs once in each task and returns the function of a batch; a null text scores null."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for batch in batches:
            yield score(batch.fillna("")).astype("float64").where(batch.notna())

    return df.withColumn(name, run(text))


def classified(rules: Sequence[tuple[Column, str]], other: str) -> Column:
    """The label of the first rule that holds; a rule that is null doesn't."""
    out = F.lit(other)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def drifting_beta(noise: float = 1e-4, error: float = 0.01) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A fit for applyInPandas over (ticker, date, r, m): slope of r on m as a random walk, filtered week by week from (1, 1)."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        b, p, out = 1.0, 1.0, []
        for r, m in zip(g["r"], g["m"]):
            p += noise
            gain = p * m / (m * m * p + error)
            b += gain * (r - m * b)
            p *= 1 - gain * m
            out.append(b)
        return pd.DataFrame({"ticker": g["ticker"], "date": g["date"], "beta": out})

    return fit


@F.udtf(returnType="place: int, window: array<double>, target: double")
class SeriesWindows:
    """The windows of `size` values that end before each value of a series, with that value as the target."""

    def eval(self, values, size: int):
        for i in range(size, len(values)):
            yield i, values[i - size : i], values[i]
