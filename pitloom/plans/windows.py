"""Window features, rank-correlation research and factors over the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import average_rank, by, change, correlation, forward_change, frame, guarded, percent_rank, since, zscore
from ..sources.tables import bars
from .registry import BARS, RETURNS, day, query, rounded

_DATE = "CAST(date AS VARCHAR) AS date"


def returns(spark, d) -> DataFrame:
    return bars(spark, d).withColumn("r", change(F.col("close"), "ticker"))


def _out(df: DataFrame, *names: str) -> DataFrame:
    return df.select(day("date").alias("date"), "ticker", *(rounded(n).alias(n) for n in names))


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round(close / lag(close, 4) OVER w - 1, 6) AS past, round(lead(close, 4) OVER w / close - 1, 6) AS ahead FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def w1_changes(spark, d):
    return _out(bars(spark, d).withColumns({"past": change(F.col("close"), "ticker", 4), "ahead": forward_change(F.col("close"), "ticker", 4)}), "past", "ahead")


@query(f"WITH {RETURNS} SELECT {_DATE}, ticker, round(CASE WHEN count(r) OVER w >= 10 THEN avg(r) OVER w END, 6) AS mean, round(CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END, 6) AS sd, round(CASE WHEN count(r) OVER w >= 10 THEN max(r) OVER w END, 6) AS top, round(CASE WHEN count(r) OVER w >= 10 THEN min(r) OVER w END, 6) AS low, round(CASE WHEN count(r) OVER w >= 10 THEN sum(r) OVER w END, 5) AS total FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)")
def w2_rolling(spark, d):
    r, w = F.col("r"), frame("ticker", 20)
    out = returns(spark, d).withColumns({"mean": guarded(F.avg(r).over(w), r, w, 10), "sd": guarded(F.stddev_samp(r).over(w), r, w, 10), "top": guarded(F.max(r).over(w), r, w, 10), "low": guarded(F.min(r).over(w), r, w, 10), "total": F.round(guarded(F.sum(r).over(w), r, w, 10), 5)})
    return _out(out, "mean", "sd", "top", "low", "total")


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round(CASE WHEN count(close) OVER w >= 12 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 6) AS z, round((close - avg(close) OVER e) / nullif(stddev_samp(close) OVER e, 0), 6) AS ez FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 25 PRECEDING), e AS (PARTITION BY ticker ORDER BY date)")
def w3_rolling_and_expanding_z(spark, d):
    c, w = F.col("close"), frame("ticker", 26)
    return _out(bars(spark, d).withColumns({"z": guarded(zscore(c, w), c, w, 12), "ez": zscore(c, since("ticker"))}), "z", "ez")


@query(f"WITH {RETURNS}, m AS (SELECT date, avg(r) AS m FROM rets GROUP BY 1), j AS (SELECT * FROM rets JOIN m USING (date) WHERE r IS NOT NULL) SELECT {_DATE}, ticker, round(CASE WHEN count(*) OVER w >= 26 THEN regr_slope(r, m) OVER w END, 5) AS beta, round(CASE WHEN count(*) OVER w >= 26 THEN regr_r2(r, m) OVER w END, 5) AS r2 FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 51 PRECEDING)")
def w5_rolling_beta(spark, d):
    r = returns(spark, d)
    j = r.join(r.groupBy("date").agg(F.avg("r").alias("m")), "date").where("r is not null")
    w = frame("ticker", 52)
    n = F.count(F.lit(1)).over(w)
    return j.select(day("date").alias("date"), "ticker", rounded(F.when(n >= 26, F.regr_slope("r", "m").over(w)), 5).alias("beta"), rounded(F.when(n >= 26, F.regr_r2("r", "m").over(w)), 5).alias("r2"))


@query(f"WITH {BARS}, k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY date) AS n FROM bars) SELECT {_DATE}, ticker, round(rk / n, 6) AS pct, round(least(greatest((volume - avg(volume) OVER d) / (stddev_samp(volume) OVER d + 1e-9), -6), 6), 6) AS z FROM k WINDOW d AS (PARTITION BY date)")
def w7_cross_section(spark, d):
    v = F.col("volume")
    z = zscore(v, Window.partitionBy("date"), 1e-9)
    return _out(bars(spark, d).withColumns({"pct": percent_rank(v, "date"), "z": F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0)))}), "pct", "z")


@query(f"WITH {BARS} SELECT {_DATE}, ticker, CAST(ceil(row_number() OVER (PARTITION BY date ORDER BY close, ticker) * 5.0 / count(*) OVER (PARTITION BY date)) AS INTEGER) AS quintile, CAST(rank() OVER (PARTITION BY date ORDER BY volume DESC) AS INTEGER) AS place FROM bars")
def w10_quintiles(spark, d):
    w = Window.partitionBy("date")
    q = F.ceil(F.row_number().over(w.orderBy("close", "ticker")) * 5.0 / F.count(F.lit(1)).over(w)).cast("int")
    return bars(spark, d).select(day("date").alias("date"), "ticker", q.alias("quintile"), F.rank().over(w.orderBy(F.desc("volume"))).alias("place"))


_DRAW = f"WITH {RETURNS}, e AS (SELECT date, ticker, exp(sum(ln(1 + coalesce(r, 0) * 0.01)) OVER (PARTITION BY ticker ORDER BY date)) AS eq FROM rets), dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM e)"


def drawdowns(spark, d) -> DataFrame:
    """Equity compounded from a hundredth of each return, and its fall from the running peak."""
    eq = F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)) * 0.01)).over(since("ticker")))
    e = returns(spark, d).withColumn("eq", eq)
    return e.withColumn("dd", F.col("eq") / F.max("eq").over(since("ticker")) - 1)


@query(f"{_DRAW} SELECT {_DATE}, ticker, round(eq, 6) AS eq, round(dd, 6) AS dd FROM dd")
def w13_drawdown(spark, d):
    return _out(drawdowns(spark, d), "eq", "dd")


@query(f"{_DRAW}, g AS (SELECT *, sum(CASE WHEN dd > -1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS g FROM dd) SELECT ticker, CAST(min(date) AS VARCHAR) AS peak, CAST(arg_min(date, (dd, date)) AS VARCHAR) AS trough, round(min(dd), 6) AS depth, count(*) - 1 AS weeks FROM g GROUP BY ticker, g HAVING count(*) > 1")
def w14_drawdown_episodes(spark, d):
    g = drawdowns(spark, d).withColumn("g", F.sum(F.when(F.col("dd") > -1e-12, 1).otherwise(0)).over(since("ticker")))
    out = g.groupBy("ticker", "g").agg(day(F.min("date")).alias("peak"), day(F.min_by("date", F.struct("dd", "date"))).alias("trough"), rounded(F.min("dd")).alias("depth"), (F.count(F.lit(1)) - 1).alias("weeks"))
    return out.where("weeks > 0").drop("g")


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round(last_value(CASE WHEN volume > 150 THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date), 6) AS filled FROM bars")
def w22_forward_fill(spark, d):
    return _out(bars(spark, d).withColumn("filled", F.last(F.when(F.col("volume") > 150, F.col("close")), ignorenulls=True).over(since("ticker"))), "filled")


@query(f"WITH {RETURNS} SELECT {_DATE}, ticker, CAST(sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING) = 3 AS INTEGER) AS streak, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS 1 PRECEDING) = 2 AS INTEGER) AS rises FROM rets")
def w23_losing_streak(spark, d):
    bad = F.sum(F.when(F.col("r") < 0, 1).otherwise(0)).over(frame("ticker", 3))
    return returns(spark, d).select(day("date").alias("date"), "ticker", (bad == 3).cast("int").alias("streak"), (F.sum(F.when(F.col("r") > 0, 1).otherwise(0)).over(frame("ticker", 2)) == 2).cast("int").alias("rises"))


_IC = f"""WITH {RETURNS}, f AS (SELECT date, ticker, r, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM rets),
k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS b FROM f WHERE r IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT date, count(*) AS n, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM k GROUP BY 1 HAVING count(*) >= 10)"""


def rank_ic(panel: DataFrame, feature: str, target: str, least: int = 10) -> DataFrame:
    """(date, n, ic): Spearman correlation per date of the rows that have both."""
    both = panel.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    ranked = both.select("date", average_rank(F.col(feature), "date").alias("a"), average_rank(F.col(target), "date").alias("b"))
    return ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("a"), F.col("b")).alias("ic")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame) -> DataFrame:
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.agg(n.alias("dates"), rounded(mean).alias("mean"), rounded(sd).alias("sd"), rounded(F.try_divide(mean, sd / F.sqrt(n))).alias("t"), rounded(F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0))).alias("hit"))


def _panel(spark, d) -> DataFrame:
    return returns(spark, d).withColumn("fwd", forward_change(F.col("close"), "ticker"))


@query(f"{_IC} SELECT {_DATE}, n, round(ic, 6) AS ic FROM ic")
def a13_rank_ic(spark, d):
    return rank_ic(_panel(spark, d), "r", "fwd").select(day("date").alias("date"), "n", rounded("ic").alias("ic"))


@query(f"{_IC} SELECT count(ic) AS dates, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit FROM ic")
def a14_ic_summary(spark, d):
    return ic_summary(rank_ic(_panel(spark, d), "r", "fwd"))


@query(f"WITH {RETURNS}, f AS (SELECT date, ticker, r, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM rets), s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r, ticker) AS lo, row_number() OVER (PARTITION BY date ORDER BY r DESC, ticker DESC) AS hi, floor(count(*) OVER (PARTITION BY date) * 0.2) AS k, count(*) OVER (PARTITION BY date) AS n FROM f WHERE r IS NOT NULL AND fwd IS NOT NULL) SELECT {_DATE}, round(avg(CASE WHEN hi <= k THEN fwd END) - avg(CASE WHEN lo <= k THEN fwd END), 6) AS spread FROM s WHERE n >= 8 GROUP BY 1")
def a18_long_short(spark, d):
    p = _panel(spark, d).where("r is not null and fwd is not null")
    w = Window.partitionBy("date")
    s = p.select("date", "fwd", F.row_number().over(w.orderBy("r", "ticker")).alias("lo"), F.row_number().over(w.orderBy(F.desc("r"), F.desc("ticker"))).alias("hi"), F.count(F.lit(1)).over(w).alias("n"))
    k = F.floor(F.col("n") * 0.2)
    return s.where("n >= 8").groupBy(day("date").alias("date")).agg(rounded(F.avg(F.when(F.col("hi") <= k, F.col("fwd"))) - F.avg(F.when(F.col("lo") <= k, F.col("fwd")))).alias("spread"))


@query(f"WITH {RETURNS} SELECT {_DATE}, round(avg(abs(r - p)), 6) AS turnover FROM (SELECT date, r, lag(r) OVER (PARTITION BY ticker ORDER BY date) AS p FROM rets) GROUP BY 1")
def a19_signal_turnover(spark, d):
    return returns(spark, d).withColumn("p", F.lag("r").over(by("ticker"))).groupBy(day("date").alias("date")).agg(rounded(F.avg(F.abs(F.col("r") - F.col("p")))).alias("turnover"))


@query(f"WITH {RETURNS} SELECT ticker, year(date) AS year, round(avg(r), 6) AS mean, round(stddev_samp(r) * sqrt(52), 6) AS vol, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 6) AS sharpe, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS wins, round(exp(sum(ln(1 + r * 0.01))) - 1, 6) AS total, round(exp(sum(ln(1 + r * 0.01)) * 52 / count(*)) - 1, 6) AS annual, round(min(dd), 6) AS drawdown FROM (SELECT *, exp(run) / exp(greatest(max(run) OVER (PARTITION BY ticker, year(date) ORDER BY date), 0)) - 1 AS dd FROM (SELECT *, sum(ln(1 + r * 0.01)) OVER (PARTITION BY ticker, year(date) ORDER BY date) AS run FROM rets WHERE r IS NOT NULL)) GROUP BY 1, 2")
def a20_period_kpis(spark, d):
    l, w = F.log1p(F.col("r") * 0.01), Window.partitionBy("ticker", "year").orderBy("date")
    r = returns(spark, d).where("r is not null").withColumn("year", F.year("date").cast("long")).withColumn("run", F.sum(l).over(w))
    r = r.withColumn("dd", F.exp(F.col("run") - F.greatest(F.max("run").over(w), F.lit(0.0))) - 1).groupBy("ticker", "year")
    return r.agg(rounded(F.avg("r")).alias("mean"), rounded(F.stddev_samp("r") * F.sqrt(F.lit(52))).alias("vol"), rounded(F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(52))).alias("sharpe"), rounded(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("wins"), rounded(F.exp(F.sum(l)) - 1).alias("total"), rounded(F.exp(F.sum(l) * 52 / F.count(F.lit(1))) - 1).alias("annual"), rounded(F.min("dd")).alias("drawdown"))


@query(f"WITH {RETURNS}, s AS (SELECT ticker, date, CASE WHEN r > 0.02 THEN 'up' WHEN r < -0.02 THEN 'down' ELSE 'flat' END AS a FROM rets), t AS (SELECT a, lead(a) OVER (PARTITION BY ticker ORDER BY date) AS b FROM s) SELECT a, b, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY a), 6) AS p FROM t WHERE b IS NOT NULL GROUP BY 1, 2")
def a24_transitions(spark, d):
    state = F.when(F.col("r") > 0.02, "up").when(F.col("r") < -0.02, "down").otherwise("flat")
    t = returns(spark, d).withColumn("a", state).withColumn("b", F.lead("a").over(by("ticker"))).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("p", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("a"))))


@query(f"WITH {BARS}, w AS (SELECT date, ticker, volume / sum(volume) OVER (PARTITION BY date) AS w FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, ticker) AS n FROM w) SELECT {_DATE}, count(*) FILTER (w > 0.001) AS names, round(sum(CASE WHEN n <= 5 THEN w END), 6) AS top5, round(1 / sum(w * w), 6) AS effective FROM k GROUP BY 1")
def a45_concentration(spark, d):
    w = Window.partitionBy("date")
    k = bars(spark, d).withColumn("w", F.col("volume") / F.sum("volume").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("w"), "ticker")))
    return k.groupBy(day("date").alias("date")).agg(F.count(F.when(F.col("w") > 0.001, 1)).alias("names"), rounded(F.sum(F.when(F.col("n") <= 5, F.col("w")))).alias("top5"), rounded(1 / F.sum(F.col("w") * F.col("w"))).alias("effective"))


@query(f"WITH {RETURNS} SELECT {_DATE}, round(avg(r), 6) AS index, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS breadth, round(stddev_pop(r), 6) AS dispersion FROM rets WHERE r IS NOT NULL GROUP BY 1")
def a62_market_index_breadth(spark, d):
    return returns(spark, d).where("r is not null").groupBy(day("date").alias("date")).agg(rounded(F.avg("r")).alias("index"), rounded(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("breadth"), rounded(F.stddev_pop("r")).alias("dispersion"))


@query(f"WITH {RETURNS}, l AS (SELECT * FROM rets QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 21) SELECT ticker, round(ln(1 + 1e6 * avg(abs(r) / (close * volume))), 6) AS amihud FROM l WHERE r IS NOT NULL AND close * volume > 0 GROUP BY 1 HAVING count(*) >= 10")
def x1_amihud(spark, d):
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = returns(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 21 and r is not null and close * volume > 0")
    return rows.groupBy("ticker").agg(rounded(F.log1p(1e6 * F.avg(F.abs("r") / (F.col("close") * F.col("volume"))))).alias("amihud"), F.count(F.lit(1)).alias("n")).where("n >= 10").drop("n")


@query(f"WITH {RETURNS}, m AS (SELECT date, avg(r) AS m FROM rets GROUP BY 1) SELECT ticker, round(-sqrt((regr_syy(r, m) - regr_sxy(r, m) * regr_sxy(r, m) / regr_sxx(r, m)) / count(*)) * sqrt(252), 5) AS ivol, round(-(covar_samp(r, m) / (stddev_samp(r) * stddev_samp(m))) * stddev_samp(r) / stddev_samp(m), 5) AS bab FROM rets JOIN m USING (date) WHERE r IS NOT NULL GROUP BY 1")
def x3_idiosyncratic_vol(spark, d):
    r = returns(spark, d)
    j = r.join(r.groupBy("date").agg(F.avg("r").alias("m")), "date").where("r is not null")
    rest = F.regr_syy("r", "m") - F.regr_sxy("r", "m") * F.regr_sxy("r", "m") / F.regr_sxx("r", "m")
    return j.groupBy("ticker").agg(rounded(-F.sqrt(rest / F.count(F.lit(1))) * F.sqrt(F.lit(252)), 5).alias("ivol"), rounded(-correlation(F.col("r"), F.col("m")) * F.stddev_samp("r") / F.stddev_samp("m"), 5).alias("bab"))
