"""Ingest of files, entities in headlines, effects and their interactions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matrices import moments
from ..functions.stats import clip
from ..operators.joins import keep_last
from ..sources.ingest import first_existing, header_row, materialized, price_files
from ..sources.tables import bars, table
from .composites import features
from .registry import BARS, RETURNS, day, query, rounded
from .streams import _folder


@query(f"WITH {BARS} SELECT CAST(date AS VARCHAR) AS date, ticker, round(close, 6) AS close, volume FROM bars")
def sc5_price_files(spark, d):
    """One folder of CSV files for each ticker, written first, then read as a vendor's drop would be."""
    folder = _folder(spark)
    bars(spark, d).select("date", "close", "volume", "ticker").write.mode("append").partitionBy("ticker").csv(folder, header=True)
    return price_files(spark, folder, "date date, close double, volume double").select(day("date").alias("date"), "ticker", rounded("close").alias("close"), "volume")


@query("WITH s AS (SELECT CAST(c_custkey // 50 AS BIGINT) AS sheet, count(*) AS n FROM customer GROUP BY 1) SELECT sheet, CASE WHEN sheet % 14 < 12 THEN CAST(sheet % 14 AS INTEGER) END AS header, CASE WHEN sheet % 14 < 12 THEN n END AS n FROM s")
def sc7_header_rows(spark, d):
    """Sheets of 50 customers with up to 13 lines above the header; a header further down than twelve lines is not found."""
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 50).alias("sheet"), F.concat_ws(",", "c_custkey", "c_name", F.col("c_acctbal").cast("string")).alias("line"))
    body = c.groupBy("sheet").agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("body"))
    top = F.repeat(F.lit("report, page 1\n"), (F.col("sheet") % 14).cast("int"))
    s = body.select("sheet", F.concat(top, F.lit("Id, Name ,balance\n"), "body").alias("content")).withColumn("header", header_row(F.col("content"), ["id", "name", "balance"]))
    return s.select("sheet", "header", F.when(F.col("header").isNotNull(), F.size(F.split("content", "\n")) - F.col("header") - 1).cast("long").alias("n"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS payload FROM events""")
def sc13_materialized_events(spark, d):
    return materialized(table(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_id"], _folder(spark))


@query("WITH s AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, max_by((4 - CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) / 2, o_orderkey) AS mood FROM orders GROUP BY 1, 2) SELECT entity, CAST(date AS VARCHAR) AS date, CAST(CASE isodow(date) WHEN 5 THEN date + 3 WHEN 6 THEN date + 2 ELSE date + 1 END AS VARCHAR) AS available, least(greatest(mood, -1), 1) AS mood, 'orders' AS source FROM s")
def sc15_sentiment_export(spark, d):
    """A sentiment table if the store has one, else orders read as news; of one day's rows the last."""
    path = first_existing(spark, [f"{d}/company_sentiment.parquet", f"{d}/orders.parquet"])
    source = path.rsplit("/", 1)[1].removesuffix(".parquet")
    rows = spark.read.parquet(path)
    if source == "orders":
        rows = rows.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq"), ((4 - F.substring("o_orderpriority", 1, 1).cast("double")) / 2).alias("mood"))
    last = keep_last(rows.select("entity", "date", "seq", "mood"), ["entity", "date"], ["seq"])
    weekday = F.dayofweek("date")
    available = F.when(weekday == 6, F.date_add("date", 3)).when(weekday == 7, F.date_add("date", 2)).otherwise(F.date_add("date", 1))
    return last.select("entity", day("date").alias("date"), day(available).alias("available"), clip(F.col("mood"), -1.0, 1.0).alias("mood"), F.lit(source).alias("source"))


@query("""WITH m AS (SELECT DISTINCT upper(replace(p_brand, '#', '')) AS t FROM part WHERE p_size > 25), h AS (SELECT p_partkey, upper(replace(p_brand, '#', '')) AS t, p_name FROM part),
c AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ') || ' Ltd' AS name FROM h)
SELECT p_partkey, 'ticker' AS kind, t AS canonical, CAST(0.95 AS DOUBLE) AS confidence, CAST(4 AS INTEGER) AS start FROM h WHERE t IN (SELECT t FROM m) UNION ALL SELECT p_partkey, 'company', name, CAST(0.7 AS DOUBLE), CAST(length(t) + 16 AS INTEGER) FROM c JOIN h USING (p_partkey)""")
def f11_entities(spark, d):
    """Ticker tokens of a master list and names before 'Ltd'; one entity for each (kind, canonical name, place), that of most confidence."""
    part = table(spark, d, "part")
    master = part.where("p_size > 25").select(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("canonical")).distinct()
    h = part.select("p_partkey", F.concat(F.lit("NSE "), F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(" wins deal, "), F.initcap("p_name"), F.lit(" Ltd says")).alias("text"))
    tokens = h.select("p_partkey", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9&.-]{1,20})\b")))).alias("canonical"))
    tickers = tokens.join(master, "canonical").select("p_partkey", "text", F.lit("ticker").alias("kind"), "canonical", F.lit(0.95).alias("confidence"))
    names = h.select("p_partkey", "text", F.lit("company").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:[A-Z][A-Za-z]+ )+Ltd)\b")))).alias("canonical"), F.lit(0.7).alias("confidence"))
    found = tickers.unionByName(names).withColumn("start", F.instr("text", F.col("canonical")) - 1)
    return found.groupBy("p_partkey", "kind", "canonical", "start").agg(F.max("confidence").alias("confidence"))


_TERMS = ["one", "a", "b", "c", "ab", "ac", "bc", "y"]
_PAIRS = [(0, 1), (0, 2), (1, 2)]


def _entry(i: str, j: str) -> Column:
    """The count, means against one, else covariances: sums of raw products lose the digits that large means take."""
    if i == "one":
        return F.sum(i) if j == "one" else F.avg(j)
    return F.covar_samp(i, j)


def _solved(g: np.ndarray) -> dict:
    """Coefficient, t and mean contribution of each product in y on (x1, x2, x1 * x2), from `_entry`, the columns in units of their deviations; null if singular."""
    coef, t, part = [], [], []
    for k, (i, j) in enumerate(_PAIRS):
        at = [1 + i, 1 + j, 4 + k]
        n, unit = g[0, 0], np.sqrt(g[at, at])
        x = g[np.ix_(at, at)] / np.outer(unit, unit) if n > 4 and (unit > 0).all() else np.zeros((3, 3))
        if not np.isfinite(x).all() or np.linalg.matrix_rank(x) < 3:
            coef, t, part = coef + [None], t + [None], part + [None]
            continue
        inverse, xy = np.linalg.inv(x), g[at, 7] / unit
        b = inverse @ xy
        error = (g[7, 7] - b @ xy) / (n - 4)
        coef, t, part = coef + [b[2] / unit[2]], t + [b[2] / np.sqrt(error * inverse[2, 2])], part + [b[2] / unit[2] * g[0, 4 + k]]
    return {"coef": np.array(coef, object), "t": np.array(t, object), "part": np.array(part, object)}


def interactions(x: DataFrame) -> DataFrame:
    """One row (coef, t, part), an entry for each of the products ab, ac and bc, for x (y, a, b, c)."""
    x = x.withColumns({"one": F.lit(1.0), **{p: F.col(p[0]) * F.col(p[1]) for p in ("ab", "ac", "bc")}})
    return moments(x, _TERMS, _entry, _solved, "coef array<double>, t array<double>, part array<double>")


def _interaction_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS first, '{b}' AS second, b3 AS coef, b3 / sqrt((n - 1) * (vy - b1 * c1 - b2 * c2 - b3 * c3) / (n - 4) * m33 / det / (n - 1)) AS t, b3 * mean AS part FROM (SELECT *, (c1 * (s22 * s33 - s23 * s23) - c2 * (s12 * s33 - s13 * s23) + c3 * (s12 * s23 - s13 * s22)) / det AS b1, (-c1 * (s12 * s33 - s13 * s23) + c2 * (s11 * s33 - s13 * s13) - c3 * (s11 * s23 - s12 * s13)) / det AS b2, (c1 * (s12 * s23 - s13 * s22) - c2 * (s11 * s23 - s12 * s13) + c3 * m33) / det AS b3 FROM
(SELECT *, s11 * s22 - s12 * s12 AS m33, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) AS det FROM (SELECT count(*) AS n, avg({a} * {b}) AS mean, var_samp(y) AS vy, var_samp({a}) AS s11, var_samp({b}) AS s22, var_samp({a} * {b}) AS s33, covar_samp({a}, {b}) AS s12, covar_samp({a}, {a} * {b}) AS s13, covar_samp({b}, {a} * {b}) AS s23, covar_samp({a}, y) AS c1, covar_samp({b}, y) AS c2, covar_samp({a} * {b}, y) AS c3 FROM x)))"""


@query(f"WITH {RETURNS}, x AS (SELECT lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS y, -10 * r AS a, 10 * (high - low) / close AS b, volume / 100 AS c FROM rets QUALIFY a IS NOT NULL AND y IS NOT NULL), u AS (" + " UNION ALL ".join(_interaction_sql("abc"[i], "abc"[j]) for i, j in _PAIRS) + ") SELECT first, second, round(coef, 6) AS coef, round(t, 4) AS t, round(part, 6) AS part FROM u")
def a67_interactions(spark, d):
    """All products in one aggregate over the rows; the regressions are solved from its one row."""
    x = features(spark, d).select(F.col("fwd").alias("y"), (10 * F.col("reversal")).alias("a"), (10 * F.col("spread")).alias("b"), (F.col("volume") / 100).alias("c")).where("a is not null and y is not null")
    m = interactions(x)
    e = m.select(F.posexplode(F.arrays_zip("coef", "t", "part")).alias("k", "e"))
    pair = lambda side: F.array(*(F.lit("abc"[p[side]]) for p in _PAIRS))
    return e.select(F.get(pair(0), F.col("k")).alias("first"), F.get(pair(1), F.col("k")).alias("second"), rounded("e.coef").alias("coef"), rounded("e.t", 4).alias("t"), rounded("e.part").alias("part"))
