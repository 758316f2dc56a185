"""Books under exact caps, and scores under sentiment, market and sector multipliers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import average_rank, clip, frame
from ..operators.caps import two_level
from ..operators.joins import asof_join
from ..sources.tables import bars, table
from .composites import _SENTIMENT, sentiment
from .registry import BARS, day, query, rounded
from .research import _SECTOR, sector

_DATE = "CAST(date AS VARCHAR) AS date"
NAME_CAP, SECTOR_CAP = 0.06, 0.24


def _filled(name: str, source: str, group: str, cap: str, budget: float) -> str:
    """The factor from its definition: of the rows' own ratios, the largest at which the capped sum is within the budget; beyond it what is left goes to the uncapped."""
    return f"""{name}g AS (SELECT {', '.join(f'a.{g}' for g in group.split(', '))}, a.ticker, any_value(a.w) AS w, any_value(a.{cap}) AS c, any_value(a.{cap} / a.w) AS r, sum(least(b.{cap}, a.{cap} / a.w * b.w)) AS g FROM {source} a JOIN {source} b USING ({group}) GROUP BY ALL),
{name}l AS (SELECT {group}, max(CASE WHEN g <= {budget} + 1e-15 THEN r END) AS r FROM {name}g GROUP BY ALL),
{name}f AS (SELECT {group}, ({budget} - coalesce(sum(c) FILTER ({name}g.r <= {name}l.r), 0)) / nullif(sum(w) FILTER ({name}l.r IS NULL OR {name}g.r > {name}l.r), 0) AS f FROM {name}g JOIN {name}l USING ({group}) GROUP BY ALL),
{name} AS (SELECT {source}.*, least({source}.{cap}, coalesce(f * w, {source}.{cap})) AS v FROM {source} JOIN {name}f USING ({group}))"""


@query(f"""WITH {BARS}, w0 AS (SELECT date, {_SECTOR} AS sector, ticker, volume * 1.0 / sum(volume) OVER (PARTITION BY date) AS w, {NAME_CAP} AS c FROM bars),
{_filled('s', 'w0', 'date, sector', 'c', SECTOR_CAP)}, w1 AS (SELECT date, sector, ticker, w, v AS c FROM s), {_filled('d', 'w1', 'date', 'c', 1.0)}
SELECT {_DATE}, ticker, round(v, 8) AS w FROM d""")
def k9_capped_weights(spark, d):
    """Volume weights, no name above 6 % and no sector above 24 %; 1 in sum where the week's names can hold it."""
    book = bars(spark, d).select("date", "ticker", sector().alias("sector"), (F.col("volume") / F.sum("volume").over(Window.partitionBy("date"))).alias("w"))
    out = two_level(book, ["date"], "sector", "w", NAME_CAP, SECTOR_CAP, 1.0, "capped")
    return out.select(day("date").alias("date"), "ticker", rounded("capped", 8).alias("w"))


@query(f"""WITH {BARS}, {_SENTIMENT}, k AS (SELECT date, ticker, {_SECTOR} AS sector, volume, (rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS score FROM bars),
x AS (SELECT k.*, mood, least(1, worth / 250000) AS conviction FROM k ASOF LEFT JOIN s ON k.ticker = s.ticker AND k.date >= s.known),
m AS (SELECT known, avg(mood) AS market FROM s GROUP BY 1), c AS (SELECT last_day(CAST(o_orderdate AS DATE)) + 30 AS available, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT available, n * 1.0 / lag(n) OVER (ORDER BY available) AS growth FROM c),
v AS (SELECT date, sector, sum(volume) AS v FROM k GROUP BY 1, 2), z AS (SELECT date, sector, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM v WINDOW w AS (PARTITION BY sector ORDER BY date ROWS 25 PRECEDING)),
y AS (SELECT x.*, market FROM x ASOF LEFT JOIN m ON x.date >= m.known), g AS (SELECT y.*, growth FROM y ASOF LEFT JOIN e ON y.date >= e.available),
f AS (SELECT g.*, CASE WHEN mood < -0.5 AND conviction > 0.7 THEN 0.0 WHEN mood < -0.2 THEN 0.6 ELSE 1.0 END * CASE WHEN market < -0.4 THEN 0.7 ELSE 1.0 END AS base, CASE WHEN growth > 1.05 THEN 1.1 WHEN growth < 0.95 THEN 0.8 ELSE 1.0 END * CASE WHEN z < -1.5 THEN 0.7 WHEN z > 1.5 THEN 1.15 ELSE 1.0 END AS macro FROM g JOIN z USING (date, sector))
SELECT {_DATE}, ticker, round(CAST(base AS DOUBLE), 6) AS sentiment_multiplier, round(CAST(macro AS DOUBLE), 6) AS macro_multiplier, round(CAST(score AS DOUBLE) * least(greatest(CAST(base AS DOUBLE) * CAST(macro AS DOUBLE), 0), 1.5), 8) AS score FROM f""")
def x31_score_overlay(spark, d):
    """Scores under the ticker's latest known sentiment, the market's, the growth of orders and the sector's activity.

    A mood below -0.2 leaves 0.6 of a score, one below -0.5 held with
    conviction above 0.7 none; a market mood below -0.4 takes 0.7.  Growth of
    the latest known month and the sector's volume against 26 weeks scale the
    rest.  What isn't known leaves the score as it is.
    """
    b = bars(spark, d).select("date", "ticker", "volume", sector().alias("sector"))
    scores = b.withColumn("score", average_rank(F.col("volume"), "date") / F.count(F.lit(1)).over(Window.partitionBy("date"))).drop("volume")
    mood = sentiment(spark, d)
    x = asof_join(scores, mood, "ticker", "date", "known", ["mood", "worth"], "tie", span_days=90)
    months = table(spark, d, "orders").groupBy(F.date_add(F.last_day("o_orderdate"), 30).alias("available")).agg(F.count(F.lit(1)).alias("n"))
    growth = months.withColumn("growth", F.col("n") / F.lag("n").over(Window.orderBy("available")))  # a row a month
    days = asof_join(b.select("date").distinct(), mood.groupBy("known").agg(F.avg("mood").alias("market")), None, "date", "known", ["market"], "known")
    days = asof_join(days, growth, None, "date", "available", ["growth"], "available")
    w = frame("sector", 26)
    activity = b.groupBy("date", "sector").agg(F.sum("volume").alias("v")).select("date", "sector", F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_samp("v").over(w)).alias("z"))
    base = F.when((F.col("mood") < -0.5) & (F.least(F.lit(1.0), F.col("worth") / 250000) > 0.7), 0.0).when(F.col("mood") < -0.2, 0.6).otherwise(1.0) * F.when(F.col("market") < -0.4, 0.7).otherwise(1.0)
    macro = F.when(F.col("growth") > 1.05, 1.1).when(F.col("growth") < 0.95, 0.8).otherwise(1.0) * F.when(F.col("z") < -1.5, 0.7).when(F.col("z") > 1.5, 1.15).otherwise(1.0)
    out = x.join(days, "date").join(activity, ["date", "sector"])
    return out.select(day("date").alias("date"), "ticker", rounded(base).alias("sentiment_multiplier"), rounded(macro).alias("macro_multiplier"), rounded(F.col("score") * clip(base * macro, 0.0, 1.5), 8).alias("score"))
