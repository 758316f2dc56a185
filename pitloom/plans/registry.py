"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The weekly panel of pitloom.sources.tables.bars.
BARS = """bars AS (SELECT CAST(d + ((12 - isodow(d)) % 7) * INTERVAL 1 DAY AS DATE) AS date, ticker, avg(px) AS close, max(px) AS high, min(px) AS low, sum(q) AS volume
FROM (SELECT CAST(l_shipdate AS DATE) AS d, p_brand AS ticker, l_extendedprice / l_quantity AS px, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""
#: Bars with the week's return.
RETURNS = BARS + ", rets AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def day(x: Column | str) -> Column:
    return F.date_format(x, "yyyy-MM-dd")
