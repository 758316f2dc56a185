"""Column expressions over windows and cross sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(key: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def frame(key: str, rows: int, order: str = "date") -> WindowSpec:
    """The current row and the rows - 1 before it."""
    return by(key, order).rowsBetween(1 - rows, 0)


def since(key: str, order: str = "date") -> WindowSpec:
    return by(key, order).rowsBetween(Window.unboundedPreceding, 0)


def guarded(value: Column, x: Column, w: WindowSpec, least: int) -> Column:
    """value, null until the frame holds so many non-null x."""
    return F.when(F.count(x).over(w) >= least, value)


def change(x: Column, key: str, rows: int = 1) -> Column:
    past = F.lag(x, rows).over(by(key))
    return F.try_divide(x, past) - 1


def forward_change(x: Column, key: str, rows: int = 1) -> Column:
    return F.try_divide(F.lead(x, rows).over(by(key)), x) - 1


def zscore(x: Column, w: WindowSpec, epsilon: float = 0.0) -> Column:
    return F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w) + epsilon)


def percent_rank(x: Column, *keys: str) -> Column:
    """Average-tie rank divided by the number of non-null values; null stays null."""
    order = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def average_rank(x: Column, *keys: str) -> Column:
    order = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2)


def clip(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def next_business_day(d: Column) -> Column:
    return F.when(F.dayofweek(d) == 6, F.date_add(d, 3)).when(F.dayofweek(d) == 7, F.date_add(d, 2)).otherwise(F.date_add(d, 1))


def normalized_ticker(x: Column) -> Column:
    """Trimmed, in upper case, without an exchange before a colon or one of the usual suffixes."""
    return F.regexp_replace(F.upper(F.trim(x)), r"^(NSE|BSE|NYSE)\s*:\s*|\.(NS|BO|N)$", "")
