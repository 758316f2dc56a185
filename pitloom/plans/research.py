"""Research, regression, portfolio and risk aggregates over the weekly panel and the fact tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import by, correlation, forward_change, frame, since
from ..functions.tails import f_tail, t_tail, t_tail_sql
from ..operators.correlations import pair_correlations
from ..sources.tables import bars, table, week_ending_friday
from .registry import BARS, RETURNS, day, query, rounded
from .windows import _IC, _panel, rank_ic, returns

#: Returns of the weeks that have one, with the market's mean return of the week.
MARKET = RETURNS + ", j AS (SELECT *, avg(r) OVER (PARTITION BY date) AS m FROM rets WHERE r IS NOT NULL)"
_DATE = "CAST(date AS VARCHAR) AS date"
_REGIME = "CASE WHEN m > 0.02 THEN 'up' WHEN m < -0.02 THEN 'down' ELSE 'flat' END"
_SECTOR = "CAST(CAST(regexp_extract(ticker, '[0-9]+') AS BIGINT) % 5 AS BIGINT)"


def market(spark, d) -> DataFrame:
    """Returns with the equal-weight market's, from one window over the dates."""
    return returns(spark, d).where("r is not null").withColumn("m", F.avg("r").over(Window.partitionBy("date")))


def regime():
    return F.when(F.col("m") > 0.02, "up").when(F.col("m") < -0.02, "down").otherwise("flat")


def sector():
    return (F.regexp_extract("ticker", "[0-9]+", 0).cast("long") % 5).cast("long")


def residual_sum(y: str, x: str):
    """Sum of squared residuals of y on x with an intercept, as an aggregate."""
    return F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x))


_RSS = "(regr_syy(r, m) - regr_sxy(r, m) * regr_sxy(r, m) / regr_sxx(r, m))"


def false_discoveries(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """df with `reject`: Benjamini-Hochberg over all rows; p-values are ranked by counts of their distinct values, not in one sort of the rows."""
    counts = df.groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_m"))
    ordered = counts.join(F.broadcast(total)).withColumn("_k", F.sum("_n").over(Window.orderBy(p)))
    cut = ordered.where(F.col(p) <= F.col("_k") * alpha / F.col("_m")).agg(F.max(p).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn("reject", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False)).cast("int")).drop("_cut")


@query(f"WITH {BARS} SELECT {_DATE}, round(max(CASE WHEN ticker = 'Brand#1' THEN close END), 6) AS b1, round(max(CASE WHEN ticker = 'Brand#2' THEN close END), 6) AS b2, round(max(CASE WHEN ticker = 'Brand#3' THEN close END), 6) AS b3 FROM bars GROUP BY 1")
def a9_wide_pivot(spark, d):
    wide = bars(spark, d).groupBy(day("date").alias("date")).pivot("ticker", ["Brand#1", "Brand#2", "Brand#3"]).agg(rounded(F.max("close")))
    return wide.toDF("date", "b1", "b2", "b3")


@query("WITH e AS (SELECT event_type, CAST(CAST(ts AS DATE) + ((12 - isodow(ts)) % 7) * INTERVAL 1 DAY AS DATE) AS w, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) SELECT CAST(w AS VARCHAR) AS week, max(CASE WHEN event_type = 'view' THEN v END) AS view, max(CASE WHEN event_type = 'purchase' THEN v END) AS purchase FROM e GROUP BY 1")
def a12_weekly_last_pivot(spark, d):
    e = table(spark, d, "events").groupBy(week_ending_friday(F.to_date("ts")).alias("w"), "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return e.groupBy(day("w").alias("week")).pivot("event_type", ["view", "purchase"]).agg(F.max("v"))


@query(f"{_IC} SELECT CAST(year(date) AS BIGINT) AS year, count(ic) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd FROM ic GROUP BY 1")
def a15_ic_by_year(spark, d):
    return rank_ic(_panel(spark, d), "r", "fwd").groupBy(F.year("date").cast("long").alias("year")).agg(F.count("ic").alias("n"), rounded(F.avg("ic")).alias("mean"), rounded(F.stddev_samp("ic")).alias("sd"))


_HORIZONS = (1, 2, 4, 8)
_DECAY = " UNION ALL ".join(f"SELECT {h} AS horizon, date, r, f{h} AS fwd FROM f" for h in _HORIZONS)


@query(f"""WITH {RETURNS}, f AS (SELECT date, r, {', '.join(f'lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS f{h}' for h in _HORIZONS)} FROM rets), u AS ({_DECAY}),
k AS (SELECT horizon, date, rank() OVER (PARTITION BY horizon, date ORDER BY r) + (count(*) OVER (PARTITION BY horizon, date, r) - 1) / 2.0 AS a, rank() OVER (PARTITION BY horizon, date ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, date, fwd) - 1) / 2.0 AS b FROM u WHERE r IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT horizon, date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 10) SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS dates, round(avg(ic), 6) AS mean FROM ic GROUP BY 1""")
def a16_ic_decay(spark, d):
    """One pass: the horizons become rows, and ranks are taken within horizon and date."""
    from ..functions.stats import average_rank

    p = returns(spark, d).withColumns({f"f{h}": forward_change(F.col("close"), "ticker", h) for h in _HORIZONS})
    u = p.select("date", "r", *(F.col(f"f{h}").alias(str(h)) for h in _HORIZONS)).unpivot(["date", "r"], [str(h) for h in _HORIZONS], "horizon", "fwd").where("r is not null and fwd is not null")
    k = u.select("horizon", "date", average_rank(F.col("r"), "horizon", "date").alias("a"), average_rank(F.col("fwd"), "horizon", "date").alias("b"))
    ic = k.groupBy("horizon", "date").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("a"), F.col("b")).alias("ic")).where("n >= 10")
    return ic.groupBy(F.col("horizon").cast("long").alias("horizon")).agg(F.count(F.lit(1)).alias("dates"), rounded(F.avg("ic")).alias("mean"))


@query(f"WITH {RETURNS}, f AS (SELECT date, ticker, r, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM rets), k AS (SELECT fwd, CAST(ceil(row_number() OVER (PARTITION BY date ORDER BY r, ticker) * 10.0 / count(*) OVER (PARTITION BY date)) AS BIGINT) AS decile, count(*) OVER (PARTITION BY date) AS n FROM f WHERE r IS NOT NULL AND fwd IS NOT NULL) SELECT decile, count(*) AS n, round(avg(fwd), 6) AS mean FROM k WHERE n >= 20 GROUP BY 1")
def a17_decile_table(spark, d):
    w = Window.partitionBy("date")
    k = _panel(spark, d).where("r is not null and fwd is not null").select("fwd", F.ceil(F.row_number().over(w.orderBy("r", "ticker")) * 10.0 / F.count(F.lit(1)).over(w)).cast("long").alias("decile"), F.count(F.lit(1)).over(w).alias("n"))
    return k.where("n >= 20").groupBy("decile").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("fwd")).alias("mean"))


@query(f"WITH {RETURNS}, k AS (SELECT ticker, year(date) AS y, avg(r) / nullif(stddev_samp(r), 0) * sqrt(52) AS s FROM rets WHERE r IS NOT NULL GROUP BY 1, 2) SELECT ticker, round(stddev_samp(s), 6) AS spread, round(regr_slope(s, y), 6) AS slope, round(min(s), 6) AS low, round(max(s), 6) AS high FROM k GROUP BY 1 HAVING min(s) > -10")
def a21_stability(spark, d):
    k = returns(spark, d).where("r is not null").groupBy("ticker", F.year("date").alias("y")).agg((F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(52))).alias("s"))
    return k.groupBy("ticker").agg(rounded(F.stddev_samp("s")).alias("spread"), rounded(F.regr_slope("s", "y")).alias("slope"), rounded(F.min("s")).alias("low"), rounded(F.max("s")).alias("high")).where("low > -10")


@query(f"WITH {MARKET}, k AS (SELECT *, {_REGIME} AS regime FROM j) SELECT ticker, regime, count(*) AS n, round(avg(r), 6) AS mean, round(avg(CASE WHEN r > 0 THEN r END), 6) AS win, round(avg(CASE WHEN r < 0 THEN r END), 6) AS loss FROM k GROUP BY 1, 2")
def a22_regime_attribution(spark, d):
    return market(spark, d).groupBy("ticker", regime().alias("regime")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("r")).alias("mean"), rounded(F.avg(F.when(F.col("r") > 0, F.col("r")))).alias("win"), rounded(F.avg(F.when(F.col("r") < 0, F.col("r")))).alias("loss"))


def _market_series(spark, d) -> DataFrame:
    """(date, m): one row for each week, so windows over it are small."""
    return returns(spark, d).where("r is not null").groupBy("date").agg(F.avg("r").alias("m"))


_SERIES = RETURNS + ", s AS (SELECT date, avg(r) AS m FROM rets WHERE r IS NOT NULL GROUP BY 1)"


@query(f"WITH {_SERIES}, k AS (SELECT date, m, {_REGIME} AS g, lag({_REGIME}) OVER (ORDER BY date) AS p, sum(m) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, sum(m) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM s) SELECT p AS a, g AS b, count(*) AS n, round(avg(before), 6) AS before, round(avg(after), 6) AS after FROM k WHERE p <> g GROUP BY 1, 2")
def a23_transition_stats(spark, d):
    w = Window.orderBy("date")  # over one series, a row a week
    k = _market_series(spark, d).select(regime().alias("b"), F.lag(regime()).over(w).alias("a"), F.sum("m").over(w.rowsBetween(-3, -1)).alias("before"), F.sum("m").over(w.rowsBetween(1, 3)).alias("after"))
    return k.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("before")).alias("before"), rounded(F.avg("after")).alias("after"))


_RULES = {"negative_price": "o_totalprice < 0", "large_price": "o_totalprice > 400000", "no_customer": "o_custkey IS NULL", "odd_status": "o_orderstatus NOT IN ('F', 'O', 'P')", "no_date": "o_orderdate IS NULL", "late": "o_orderdate > TIMESTAMP '2001-01-01'", "urgent": "o_orderpriority = '1-URGENT'"}


@query("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({v}) AS {k}" for k, v in _RULES.items()) + " FROM orders")
def a26_ingest_rules(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.expr(v), 1)).alias(k) for k, v in _RULES.items()))


@query("SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 10) AS BIGINT)) AS BIGINT) AS hash FROM orders")
def a28_content_hash(spark, d):
    """Order-independent: row hashes are summed, so partitions need no order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus")), 1, 10), 16, 10).cast("long")
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("hash"))


@query("WITH k AS (SELECT event_type, count(*) AS n, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-15') AS age, count(value) * 1.0 / count(*) AS full_share FROM events GROUP BY 1) SELECT event_type, round(pow(1 / (1 + exp(-(ln(n) - 3))) * exp(-age / 30.0) * full_share, 1.0 / 3), 6) AS score FROM k")
def a29_confidence_score(spark, d):
    k = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.lit("2024-02-15").cast("date"), F.max("ts").cast("date")).alias("age"), (F.count("value") / F.count(F.lit(1))).alias("whole"))
    cover = 1 / (1 + F.exp(-(F.log("n") - 3)))
    return k.select("event_type", rounded(F.pow(cover * F.exp(-F.col("age") / 30.0) * F.col("whole"), F.lit(1.0 / 3))).alias("score"))


_TWO = "covar_samp(r, m) AS ym, covar_samp(r, p) AS yp, covar_samp(m, p) AS mp, var_samp(m) AS mm, var_samp(p) AS pp, var_samp(r) AS yy"


@query(f"WITH {MARKET}, q AS (SELECT ticker, count(*) AS n, avg(r) / (stddev_samp(r) / sqrt(count(*))) AS t FROM j GROUP BY 1), k AS (SELECT ticker, round({t_tail_sql('t', 'n - 1')}, 10) AS p FROM q WHERE n >= 2), o AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM k) SELECT ticker, p, CAST(p <= coalesce((SELECT max(p) FROM o WHERE p <= k * 0.2 / n), -1) AS INTEGER) AS reject FROM o")
def a31_false_discoveries(spark, d):
    """Whether mean returns differ from 0: exact t tails, tickers of two returns at least."""
    q = market(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), (F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count(F.lit(1))))).alias("t")).where("n >= 2")
    return false_discoveries(q.select("ticker", rounded(t_tail(F.col("t"), F.col("n") - 1), 10).alias("p")), "p", 0.2)


_LAGS = " UNION ALL ".join(f"SELECT ticker, {k} AS lag, covar_samp(r, m{k}) / nullif(stddev_samp(r) * stddev_samp(m{k}), 0) AS c FROM q WHERE m{k} IS NOT NULL GROUP BY 1" for k in range(4))


@query(f"WITH {MARKET}, q AS (SELECT ticker, r, {', '.join(f'lag(m, {k}) OVER (PARTITION BY ticker ORDER BY date) AS m{k}' for k in range(4))} FROM j), u AS ({_LAGS}) SELECT ticker, CAST(lag AS BIGINT) AS lag, round(c, 5) AS c FROM u WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(abs(c), 8) DESC, lag) = 1")
def a32_optimal_lag(spark, d):
    q = market(spark, d).select("ticker", "r", *(F.lag("m", k).over(by("ticker")).alias(str(k)) for k in range(4)))
    u = q.unpivot(["ticker", "r"], [str(k) for k in range(4)], "lag", "x").where("x is not null").groupBy("ticker", F.col("lag").cast("long").alias("lag")).agg(correlation(F.col("r"), F.col("x")).alias("c")).where("c is not null")
    return u.groupBy("ticker").agg(F.max(F.struct(F.round(F.abs("c"), 8).alias("a"), -F.col("lag"), "lag", "c")).alias("top")).select("ticker", "top.lag", rounded("top.c", 5).alias("c"))


@query(f"WITH {MARKET}, w AS (SELECT ticker, {_RSS} AS s, count(*) AS n FROM j GROUP BY 1), h AS (SELECT ticker, sum(s) AS s FROM (SELECT ticker, date >= DATE '1998-07-01' AS late, {_RSS} AS s FROM j GROUP BY 1, 2) GROUP BY 1) SELECT ticker, round(((w.s - h.s) / 2) / (h.s / (n - 4)), 4) AS f, round(pow(1 + 2 * greatest(((w.s - h.s) / 2) / (h.s / (n - 4)), 0) / (n - 4), -(n - 4) / 2.0), 9) AS p FROM w JOIN h USING (ticker) WHERE n >= 20")
def a34_chow_break(spark, d):
    """Both halves and the whole in one aggregate: moments of a half are those of the rows that lie in it."""
    late = F.col("date") >= F.lit("1998-07-01").cast("date")
    k = market(spark, d).withColumns({"r1": F.when(~late, F.col("r")), "r2": F.when(late, F.col("r"))}).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), residual_sum("r", "m").alias("s"), (residual_sum("r1", "m") + residual_sum("r2", "m")).alias("h")).where("n >= 20")
    f = F.expr("((s - h) / 2) / (h / (n - 4))")
    return k.select("ticker", rounded(f, 4).alias("f"), rounded(f_tail(f, F.lit(2), F.col("n") - 4), 9).alias("p"))


@query(f"WITH {MARKET} SELECT ticker, {_REGIME} AS regime, count(*) AS n, round(regr_slope(r, m), 5) AS beta FROM j GROUP BY 1, 2 HAVING count(*) >= 20")
def a35_regime_beta(spark, d):
    return market(spark, d).groupBy("ticker", regime().alias("regime")).agg(F.count(F.lit(1)).alias("n"), rounded(F.regr_slope("r", "m"), 5).alias("beta")).where("n >= 20")


@query(f"WITH {MARKET}, b AS (SELECT ticker, regr_slope(r, m) AS beta FROM j GROUP BY 1) SELECT {_SECTOR} AS sector, count(*) AS n, round(avg(beta), 5) AS mean, round(quantile_cont(beta, 0.5), 5) AS median, round(stddev_samp(beta), 5) AS sd FROM b GROUP BY 1")
def a36_sector_beta(spark, d):
    b = market(spark, d).groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta"))
    return b.groupBy(sector().alias("sector")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("beta"), 5).alias("mean"), rounded(F.median("beta"), 5).alias("median"), rounded(F.stddev_samp("beta"), 5).alias("sd"))


@query(f"WITH {MARKET}, b AS (SELECT ticker, regr_slope(r, m) AS beta, sum(volume) AS v FROM j GROUP BY 1) SELECT round(sum(v * beta) / sum(v), 5) AS exposure, round(sum(v * beta * -0.1) / sum(v), 5) AS shocked FROM b")
def a37_portfolio_exposure(spark, d):
    b = market(spark, d).groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta"), F.sum("volume").alias("v"))
    return b.agg(rounded(F.sum(F.col("v") * F.col("beta")) / F.sum("v"), 5).alias("exposure"), rounded(F.sum(F.col("v") * F.col("beta") * -0.1) / F.sum("v"), 5).alias("shocked"))


@query(f"WITH {MARKET}, b AS (SELECT ticker, regr_slope(r, m) AS beta FROM j GROUP BY 1), l AS (SELECT ticker, regr_slope(r, m) AS late FROM j WHERE date >= DATE '2000-01-01' GROUP BY 1), p AS (SELECT {_SECTOR} AS theme, sum(abs(late - beta)) AS pressure FROM b JOIN l USING (ticker) GROUP BY 1) SELECT theme, round(pressure, 5) AS pressure, rank() OVER (ORDER BY round(pressure, 5) DESC) AS place FROM p")
def a38_theme_pressure(spark, d):
    late = F.when(F.col("date") >= F.lit("2000-01-01").cast("date"), F.col("r"))
    b = market(spark, d).withColumn("rl", late).groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta"), F.regr_slope("rl", "m").alias("late"))
    p = b.groupBy(sector().alias("theme")).agg(rounded(F.sum(F.abs(F.col("late") - F.col("beta"))), 5).alias("pressure"))
    return p.withColumn("place", F.rank().over(Window.orderBy(F.desc("pressure"))).cast("long"))  # a row for each theme


@query(f"WITH {MARKET}, b AS (SELECT ticker, regr_slope(r, m) AS beta, avg(r) AS a FROM j GROUP BY 1), p AS (SELECT {_SECTOR} AS theme, avg(a) AS pressure FROM b GROUP BY 1), t AS (SELECT b.ticker, round(sum(beta * pressure * CASE WHEN {_SECTOR} = theme THEN 1.0 ELSE 0.1 END), 6) AS wind FROM b CROSS JOIN p GROUP BY 1) SELECT ticker, wind, rank() OVER (ORDER BY wind DESC) AS place FROM t")
def a39_tailwinds(spark, d):
    b = market(spark, d).groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta"), F.avg("r").alias("a"))
    p = b.groupBy(sector().alias("theme")).agg(F.avg("a").alias("pressure"))  # five themes
    wind = F.col("beta") * F.col("pressure") * F.when(sector() == F.col("theme"), 1.0).otherwise(0.1)
    t = b.join(F.broadcast(p)).groupBy("ticker").agg(rounded(F.sum(wind)).alias("wind"))
    return t.withColumn("place", F.rank().over(Window.orderBy(F.desc("wind"))).cast("long"))  # a row for each ticker


@query(f"WITH {RETURNS}, c AS (SELECT a.ticker AS a, b.ticker AS b FROM rets a JOIN rets b ON a.date = b.date AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(covar_samp(a.r, b.r) / (stddev_samp(a.r) * stddev_samp(b.r))) > 0.15), s AS (SELECT ticker, round(avg(r) / stddev_samp(r), 8) AS s FROM rets WHERE r IS NOT NULL GROUP BY 1) SELECT ticker FROM s WHERE ticker NOT IN (SELECT CASE WHEN (x.s, x.ticker) < (y.s, y.ticker) THEN a ELSE b END FROM c JOIN s x ON x.ticker = a JOIN s y ON y.ticker = b)")
def a44_strategy_dedup(spark, d):
    r = returns(spark, d)
    pairs = pair_correlations(r, "date", "ticker", "r", 20).where("abs(corr) > 0.15").select("a", "b")
    s = r.where("r is not null").groupBy("ticker").agg(F.round(F.avg("r") / F.stddev_samp("r"), 8).alias("s"))
    both = pairs.join(s.select(F.col("ticker").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("ticker").alias("b"), F.col("s").alias("sb")), "b")
    weak = both.select(F.when(F.struct("sa", "a") < F.struct("sb", "b"), F.col("a")).otherwise(F.col("b")).alias("ticker")).distinct()
    return s.select("ticker").join(weak, "ticker", "left_anti")


@query(f"WITH {BARS}, k AS (SELECT date, ticker, volume / sum(volume) OVER (PARTITION BY date) AS w FROM bars), n AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM bars)), u AS (SELECT date, ticker, w, 0.0 AS p FROM k UNION ALL SELECT nd, ticker, 0.0, w FROM k JOIN n USING (date) WHERE nd IS NOT NULL), g AS (SELECT date, ticker, sum(w) AS w, sum(p) AS p FROM u GROUP BY 1, 2) SELECT {_DATE}, round(sum(abs(w - p)), 6) AS turnover FROM g GROUP BY 1")
def a46_book_turnover(spark, d):
    """Names that enter or leave count whole: each book also stands as the next date's earlier one."""
    b = bars(spark, d)
    k = b.select("date", "ticker", (F.col("volume") / F.sum("volume").over(Window.partitionBy("date"))).alias("w"))
    dates = b.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))  # a row a week
    u = k.withColumn("p", F.lit(0.0)).unionByName(k.join(dates, "date").where("next is not null").select(F.col("next").alias("date"), "ticker", F.lit(0.0).alias("w"), F.col("w").alias("p")))
    return u.groupBy("date", "ticker").agg(F.sum("w").alias("w"), F.sum("p").alias("p")).groupBy(day("date").alias("date")).agg(rounded(F.sum(F.abs(F.col("w") - F.col("p")))).alias("turnover"))


@query(f"WITH {BARS}, k AS (SELECT date, ticker, volume / sum(volume) OVER (PARTITION BY date) AS a, close * volume / sum(close * volume) OVER (PARTITION BY date) AS b FROM bars), g AS (SELECT date, sum(abs(a - b)) / 2 AS l1, avg(CASE WHEN (a > 0.04) <> (b > 0.04) THEN 1.0 ELSE 0.0 END) AS differ FROM k GROUP BY 1) SELECT {_DATE}, round(least(greatest(0.7 * l1 + 0.3 * differ, 0), 1), 6) AS divergence, CASE WHEN 0.7 * l1 + 0.3 * differ > 0.1 THEN 'high' ELSE 'low' END AS band FROM g")
def a47_book_divergence(spark, d):
    w = Window.partitionBy("date")
    worth = F.col("close") * F.col("volume")
    k = bars(spark, d).select("date", (F.col("volume") / F.sum("volume").over(w)).alias("a"), (worth / F.sum(worth).over(w)).alias("b"))
    g = k.groupBy("date").agg((F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("l1"), F.avg(F.when((F.col("a") > 0.04) != (F.col("b") > 0.04), 1.0).otherwise(0.0)).alias("differ")).withColumn("x", 0.7 * F.col("l1") + 0.3 * F.col("differ"))
    return g.select(day("date").alias("date"), rounded(F.least(F.greatest("x", F.lit(0.0)), F.lit(1.0))).alias("divergence"), F.when(F.col("x") > 0.1, "high").otherwise("low").alias("band"))


@query(f"WITH {MARKET}, t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 60), c AS (SELECT ticker, covar_samp(r, m) / (stddev_samp(r) * stddev_samp(m)) AS c FROM t GROUP BY 1) SELECT ticker, round(c, 5) AS corr, round(CASE WHEN c <= 0.1 THEN 1.0 ELSE greatest(0.5, 1 - (c - 0.1)) END, 5) AS multiplier FROM c")
def a48_crowding(spark, d):
    t = market(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("n <= 60")
    c = t.groupBy("ticker").agg(correlation(F.col("r"), F.col("m")).alias("c"))
    return c.select("ticker", rounded("c", 5).alias("corr"), rounded(F.when(F.col("c") <= 0.1, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (F.col("c") - 0.1))), 5).alias("multiplier"))


@query("SELECT l_returnflag, count(*) AS trades, round(sum(1.5 + 0.001 * l_extendedprice + 0.1 * l_extendedprice * sqrt(l_quantity / 100000)), 2) AS cost, round(sum(1.5 + 0.001 * l_extendedprice + 0.1 * l_extendedprice * sqrt(l_quantity / 100000)) / sum(l_extendedprice) * 10000, 4) AS basis_points FROM lineitem GROUP BY 1")
def a55_trading_costs(spark, d):
    cost = F.expr("1.5D + 0.001D * l_extendedprice + 0.1D * l_extendedprice * sqrt(l_quantity / 100000)")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("trades"), rounded(F.sum(cost), 2).alias("cost"), rounded(F.sum(cost) / F.sum("l_extendedprice") * 10000, 4).alias("basis_points"))


@query(f"WITH {RETURNS}, k AS (SELECT ticker, year(date) AS family, avg(r) AS gap, var_samp(r) AS v FROM rets WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), c AS (SELECT ticker, sum(gap / v) / sum(1 / v) AS g, var_pop(gap) AS s, abs(avg(sign(gap))) AS agree FROM k GROUP BY 1) SELECT ticker, round(least(greatest(g / (1 + 4 * s), -2), 2), 6) AS gap, round(agree, 6) AS agreement FROM c")
def a56_family_combine(spark, d):
    k = returns(spark, d).where("r is not null").groupBy("ticker", F.year("date").alias("family")).agg(F.avg("r").alias("gap"), F.var_samp("r").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    c = k.groupBy("ticker").agg((F.sum(F.col("gap") / F.col("v")) / F.sum(1 / F.col("v"))).alias("g"), F.var_pop("gap").alias("s"), F.abs(F.avg(F.signum("gap"))).alias("agree"))
    return c.select("ticker", rounded(F.least(F.greatest(F.col("g") / (1 + 4 * F.col("s")), F.lit(-2.0)), F.lit(2.0))).alias("gap"), rounded("agree").alias("agreement"))


@query(f"WITH {BARS}, g AS (SELECT date, {_SECTOR} AS sector, ln(close) AS x FROM bars), s AS (SELECT date, sector, stddev_samp(x) AS sd FROM g GROUP BY 1, 2), a AS (SELECT date, avg(x) AS m, stddev_samp(x) AS sd FROM g GROUP BY 1), b AS (SELECT date, avg(sd) AS inner_sd FROM s GROUP BY 1) SELECT {_DATE}, round(m, 6) AS level, round(sd, 6) AS spread, round(inner_sd, 6) AS inner_spread, round(1 / (1 + exp(-(m - 7.3) * 10)), 5) AS bubble FROM a JOIN b USING (date)")
def a57_valuation_state(spark, d):
    g = bars(spark, d).select("date", sector().alias("sector"), F.log("close").alias("x"))
    s = g.groupBy("date", "sector").agg(F.stddev_samp("x").alias("sd")).groupBy("date").agg(F.avg("sd").alias("inner_sd"))
    a = g.groupBy("date").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")).join(s, "date")
    return a.select(day("date").alias("date"), rounded("m").alias("level"), rounded("sd").alias("spread"), rounded("inner_sd").alias("inner_spread"), rounded(1 / (1 + F.exp(-(F.col("m") - 7.3) * 10)), 5).alias("bubble"))


@query(f"WITH {MARKET}, g AS (SELECT date, ticker, max(r) OVER (PARTITION BY date) - r AS regret FROM j) SELECT {_DATE}, ticker, round(regret, 6) AS regret, round(sum(regret) OVER w, 5) AS total, round(sum(regret) OVER (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING), 5) AS recent FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def a58_regret(spark, d):
    g = market(spark, d).withColumn("regret", F.max("r").over(Window.partitionBy("date")) - F.col("r"))
    return g.select(day("date").alias("date"), "ticker", rounded("regret").alias("regret"), rounded(F.sum("regret").over(since("ticker")), 5).alias("total"), rounded(F.sum("regret").over(frame("ticker", 30)), 5).alias("recent"))


@query(f"WITH {MARKET}, b AS (SELECT ticker, regr_slope(r, m) AS beta FROM j GROUP BY 1), e AS (SELECT ticker, r - beta * m AS x, {_REGIME} AS g FROM j JOIN b USING (ticker)), p AS (SELECT ticker, g, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY ticker) AS p FROM e GROUP BY 1, 2), h AS (SELECT ticker, -sum(p * ln(p)) / ln(3) AS entropy FROM p GROUP BY 1) SELECT ticker, round(avg(x) / greatest(stddev_samp(x), 0.1), 5) AS drift, round(any_value(entropy), 5) AS entropy FROM e JOIN h USING (ticker) GROUP BY 1")
def a59_structural_drift(spark, d):
    j = market(spark, d)
    e = j.join(j.groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta")), "ticker").select("ticker", (F.col("r") - F.col("beta") * F.col("m")).alias("x"), regime().alias("g"))
    share = lambda g: F.avg(F.when(F.col("g") == g, 1.0).otherwise(0.0))
    part = [F.when(share(g) > 0, share(g) * F.log(share(g))).otherwise(0.0) for g in ("up", "down", "flat")]
    return e.groupBy("ticker").agg(rounded(F.avg("x") / F.greatest(F.stddev_samp("x"), F.lit(0.1)), 5).alias("drift"), rounded(-functools.reduce(lambda a, b: a + b, part) / F.log(F.lit(3.0)), 5).alias("entropy"))


_CRISES = [("one", "1996-01-01", "1996-06-30"), ("two", "1998-07-01", "1998-12-31"), ("three", "2000-03-01", "2000-12-31")]
_CRISIS_SQL = "c(crisis, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _CRISES) + ")"


@query(f"WITH {_SERIES}, {_CRISIS_SQL}, k AS (SELECT crisis, date, exp(sum(ln(1 + m * 0.01)) OVER (PARTITION BY crisis ORDER BY date)) AS eq FROM s JOIN c ON date BETWEEN a AND b) SELECT crisis, count(*) AS weeks, round(min(eq) - 1, 5) AS trough, round(max_by(eq, date) - 1, 5) AS terminal FROM k GROUP BY 1")
def a61_crisis_windows(spark, d):
    c = spark.createDataFrame(_CRISES, "crisis string, a string, b string")
    k = _market_series(spark, d).join(F.broadcast(c), F.col("date").between(F.col("a").cast("date"), F.col("b").cast("date"))).withColumn("eq", F.exp(F.sum(F.log1p(F.col("m") * 0.01)).over(since("crisis"))))
    return k.groupBy("crisis").agg(F.count(F.lit(1)).alias("weeks"), rounded(F.min("eq") - 1, 5).alias("trough"), rounded(F.max_by("eq", "date") - 1, 5).alias("terminal"))


@query("WITH t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), k AS (SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2) SELECT a, " + ", ".join(f"round(coalesce(sum(CASE WHEN b = '{x}' THEN n END), 0) * 1.0 / sum(n), 6) AS \"{x}\"" for x in ("click", "purchase", "view")) + " FROM k GROUP BY 1")
def a63_influence_matrix(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b is not null")
    n = F.count(F.lit(1))
    return t.groupBy("a").agg(*(rounded(F.count(F.when(F.col("b") == x, 1)) / n).alias(x) for x in ("click", "purchase", "view")))


@query(f"WITH {MARKET}, k AS (SELECT ticker, CAST(year(date) AS BIGINT) AS year, covar_samp(r, m) / nullif(stddev_samp(r) * stddev_samp(m), 0) AS c FROM j GROUP BY 1, 2 HAVING count(*) >= 10) SELECT year, count(*) AS n, round(avg(abs(c)), 5) AS strength FROM k GROUP BY 1")
def a64_edge_strength(spark, d):
    k = market(spark, d).groupBy("ticker", F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("r"), F.col("m")).alias("c")).where("n >= 10")
    return k.groupBy("year").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.abs("c")), 5).alias("strength"))


@query(f"WITH {RETURNS}, p AS (SELECT a.ticker AS a, b.ticker AS b, covar_samp(a.r, b.r) FILTER (a.date >= DATE '2000-06-01') / (stddev_samp(a.r) FILTER (a.date >= DATE '2000-06-01') * stddev_samp(b.r) FILTER (a.date >= DATE '2000-06-01')) AS late, covar_samp(a.r, b.r) FILTER (a.date < DATE '2000-06-01') / (stddev_samp(a.r) FILTER (a.date < DATE '2000-06-01') * stddev_samp(b.r) FILTER (a.date < DATE '2000-06-01')) AS early FROM rets a JOIN rets b ON a.date = b.date AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS pairs, round(avg(late) - avg(early), 5) AS rise, count(*) FILTER (late > 0.3) AS high FROM p")
def a65_correlation_stress(spark, d):
    r = returns(spark, d).where("r is not null").select("date", "ticker", "r")
    halves = r.withColumn("late", F.col("date") >= F.lit("2000-06-01").cast("date"))
    c = pair_correlations(halves, "date", "ticker", "r", 1, "late")
    p = c.groupBy("a", "b").agg(F.max(F.when(F.col("late"), F.col("corr"))).alias("late"), F.max(F.when(~F.col("late"), F.col("corr"))).alias("early"))
    return p.agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg("late") - F.avg("early"), 5).alias("rise"), F.count(F.when(F.col("late") > 0.3, 1)).alias("high"))


@query(f"WITH {_SERIES}, t AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY date DESC) <= 52) SELECT count(*) AS n, round(avg(m) / stddev_samp(m) * sqrt(52), 5) AS sharpe, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 5) AS hit, CAST(avg(m) / stddev_samp(m) * sqrt(52) < 0 AS INTEGER) AS alert FROM t")
def a66_live_monitoring(spark, d):
    t = _market_series(spark, d).orderBy(F.desc("date")).limit(52)
    sharpe = F.avg("m") / F.stddev_samp("m") * F.sqrt(F.lit(52))
    return t.agg(F.count(F.lit(1)).alias("n"), rounded(sharpe, 5).alias("sharpe"), rounded(F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)), 5).alias("hit"), (sharpe < 0).cast("int").alias("alert"))


@query("SELECT CAST(floor(least(value, 99.999) / 10) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN event_type IN ('purchase', 'click') THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY 1")
def a68_calibration(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.least("value", F.lit(99.999)) / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.when(F.col("event_type").isin("purchase", "click"), 1.0).otherwise(0.0))).alias("share"))


@query(f"WITH {MARKET} SELECT {_DATE}, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS risers, round(least(avg(abs(r)) / 0.05, 1), 6) AS participation, round(stddev_samp(r), 6) AS dispersion FROM j GROUP BY 1")
def a69_breadth(spark, d):
    return returns(spark, d).where("r is not null").groupBy(day("date").alias("date")).agg(rounded(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("risers"), rounded(F.least(F.avg(F.abs("r")) / 0.05, F.lit(1.0))).alias("participation"), rounded(F.stddev_samp("r")).alias("dispersion"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_shipdate, year(l_shipdate) AS y, l_extendedprice * l_discount AS gross, 0.0005 * l_extendedprice AS fee, l_extendedprice * l_discount * l_tax AS tax FROM lineitem), m AS (SELECT y, month(l_shipdate) AS month, sum(gross) AS gross, sum(gross - fee - tax) AS net FROM t GROUP BY 1, 2) SELECT CAST(y AS BIGINT) AS year, CAST(month AS BIGINT) AS month, round(gross, 6) AS gross, round(net, 6) AS net, round(sum(net) OVER (PARTITION BY y ORDER BY month), 5) AS ytd FROM m")
def a70_trade_ledger(spark, d):
    """Months first, so the running totals of a year are over twelve rows."""
    t = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), F.month("l_shipdate").cast("long").alias("month"), F.expr("l_extendedprice * l_discount").alias("gross"), F.expr("l_extendedprice * l_discount - 0.0005D * l_extendedprice - l_extendedprice * l_discount * l_tax").alias("net"))
    m = t.groupBy("year", "month").agg(F.sum("gross").alias("gross"), F.sum("net").alias("net"))
    return m.select("year", "month", rounded("gross").alias("gross"), rounded("net").alias("net"), rounded(F.sum("net").over(since("year", "month")), 5).alias("ytd"))


@query("WITH k AS (SELECT event_type, user_id % 10 AS g, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT event_type, CAST(g AS BIGINT) AS g, count(*) AS days, round(regr_slope(n, x), 6) AS trend, sum(n) AS total FROM k GROUP BY 1, 2")
def a71_relationship_trends(spark, d):
    k = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).cast("long").alias("g"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("event_type", "g").agg(F.count(F.lit(1)).alias("days"), rounded(F.regr_slope("n", "x")).alias("trend"), F.sum("n").alias("total"))


@query("SELECT l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice), 5) AS quantity, round(corr(l_discount, l_extendedprice), 5) AS discount, round(corr(l_tax, l_extendedprice), 5) AS tax FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def a72_bivariate_evidence(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), *(rounded(correlation(F.col(f"l_{c}"), F.col("l_extendedprice")), 5).alias(c) for c in ("quantity", "discount", "tax"))).where("n >= 30")


@query("WITH k AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, avg(o_totalprice) / 150000 AS roic FROM orders GROUP BY 1, 2) SELECT k, round(avg(roic), 6) AS mean, count(*) FILTER (roic > 1) AS above, round(1 - stddev_samp(roic) / avg(roic), 6) AS steadiness, round(avg(roic) - 0.9, 6) AS excess FROM k GROUP BY 1")
def a73_roic_consistency(spark, d):
    k = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")).agg((F.avg("o_totalprice") / 150000).alias("roic"))
    return k.groupBy("k").agg(rounded(F.avg("roic")).alias("mean"), F.count(F.when(F.col("roic") > 1, 1)).alias("above"), rounded(1 - F.stddev_samp("roic") / F.avg("roic")).alias("steadiness"), rounded(F.avg("roic") - 0.9).alias("excess"))


@query(f"WITH {MARKET}, b AS (SELECT ticker, regr_slope(r, m) AS beta, avg(r) AS a FROM j GROUP BY 1), s(shock, x) AS (VALUES ('mild', -0.02), ('severe', -0.15)) SELECT ticker, shock, round(beta * x, 5) AS hit, round(a + beta * x, 5) AS alpha FROM b CROSS JOIN s")
def a74_shock_replay(spark, d):
    shocks = spark.createDataFrame([("mild", -0.02), ("severe", -0.15)], "shock string, x double")  # two rows
    b = market(spark, d).groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta"), F.avg("r").alias("a")).join(F.broadcast(shocks))
    return b.select("ticker", "shock", rounded(F.col("beta") * F.col("x"), 5).alias("hit"), rounded(F.col("a") + F.col("beta") * F.col("x"), 5).alias("alpha"))


@query(f"WITH {RETURNS}, k AS (SELECT ticker, date, CASE WHEN r IS NULL THEN 0 ELSE r END AS r FROM rets), b AS (SELECT date, ticker, r, lag(volume / s) OVER (PARTITION BY ticker ORDER BY date) AS w FROM (SELECT date, ticker, r, volume, sum(volume) OVER (PARTITION BY date) AS s FROM rets JOIN (SELECT date AS dt, ticker AS tk FROM k) ON dt = date AND tk = ticker)), p AS (SELECT date, sum(w * r) / nullif(sum(w), 0) AS x FROM b WHERE r IS NOT NULL GROUP BY 1) SELECT {_DATE}, round(x, 6) AS pnl, round(exp(sum(ln(1 + coalesce(x, 0) * 0.01)) OVER (ORDER BY date)), 5) AS equity FROM p")
def x28_paper_pnl(spark, d):
    """Last week's weights earn this week's returns; the equity curve is over one row a week."""
    b = returns(spark, d).withColumn("w0", F.col("volume") / F.sum("volume").over(Window.partitionBy("date"))).withColumn("w", F.lag("w0").over(by("ticker"))).where("r is not null")
    p = b.groupBy("date").agg(F.try_divide(F.sum(F.col("w") * F.col("r")), F.sum("w")).alias("x"))
    return p.select(day("date").alias("date"), rounded("x").alias("pnl"), rounded(F.exp(F.sum(F.log1p(F.coalesce("x", F.lit(0.0)) * 0.01)).over(Window.orderBy("date"))), 5).alias("equity"))


@query(f"WITH {_SERIES}, v AS (SELECT date, m, stddev_samp(m) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sd FROM s) SELECT {_DATE}, round(m * least(0.02 / nullif(sd, 0), 3), 6) AS scaled FROM v")
def x30_volatility_target(spark, d):
    sd = F.stddev_samp("m").over(Window.orderBy("date").rowsBetween(-20, -1))  # over one series, a row a week
    return _market_series(spark, d).select(day("date").alias("date"), rounded(F.col("m") * F.least(F.try_divide(F.lit(0.02), sd), F.lit(3.0))).alias("scaled"))


@query(f"""WITH {RETURNS}, q AS (SELECT date, ticker, close, {', '.join(f"close / lag(close, {k}) OVER w - 1 AS m{k}" for k in (4, 13, 26))} FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date)), u AS ({' UNION ALL '.join(f"SELECT {k} AS look, ticker, year(date) AS y, m{k} AS s, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS f FROM q" for k in (4, 13, 26))}), k AS (SELECT look, y, avg(sign(s) * f) AS mean, stddev_samp(sign(s) * f) AS sd FROM u WHERE s IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2) SELECT CAST(look AS BIGINT) AS look, CAST(y AS BIGINT) AS year, round(mean / sd, 5) AS score, rank() OVER (PARTITION BY y ORDER BY round(mean / sd, 5) DESC) AS place FROM k""")
def x29_grid_evaluation(spark, d):
    """Configurations become rows, so the grid is one plan."""
    looks = (4, 13, 26)
    q = _panel(spark, d).select("ticker", "date", "fwd", *((F.col("close") / F.lag("close", k).over(by("ticker")) - 1).alias(str(k)) for k in looks))
    u = q.unpivot(["ticker", "date", "fwd"], [str(k) for k in looks], "look", "s").where("s is not null and fwd is not null").withColumn("x", F.signum("s") * F.col("fwd"))
    k = u.groupBy(F.col("look").cast("long").alias("look"), F.year("date").cast("long").alias("year")).agg(rounded(F.avg("x") / F.stddev_samp("x"), 5).alias("score"))
    return k.withColumn("place", F.rank().over(Window.partitionBy("year").orderBy(F.desc("score"))).cast("long"))


@query(f"WITH {_SERIES}, e AS (SELECT date, m, exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS eq, stddev_samp(m) OVER (ORDER BY date ROWS 12 PRECEDING) AS v, sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS 2 PRECEDING) AS bad FROM s), f AS (SELECT *, eq / max(eq) OVER (ORDER BY date) - 1 AS dd FROM e), g AS (SELECT *, (dd < -0.1)::INT * 3 + (coalesce(v, 0) > 0.06)::INT * 2 + (bad = 3)::INT + (m < -0.08)::INT * 2 AS level FROM f) SELECT {_DATE}, CAST(level AS INTEGER) AS level, CAST(CASE WHEN level >= 5 THEN 0.25 WHEN level >= 3 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS cap FROM g")
def x26_risk_signals(spark, d):
    w = Window.orderBy("date")  # over one series, a row a week
    e = _market_series(spark, d).withColumns({"eq": F.exp(F.sum(F.log1p("m")).over(w)), "v": F.stddev_samp("m").over(w.rowsBetween(-12, 0)), "bad": F.sum(F.when(F.col("m") < 0, 1).otherwise(0)).over(w.rowsBetween(-2, 0))})
    e = e.withColumn("dd", F.col("eq") / F.max("eq").over(w) - 1)
    level = (F.col("dd") < -0.1).cast("int") * 3 + (F.coalesce("v", F.lit(0.0)) > 0.06).cast("int") * 2 + (F.col("bad") == 3).cast("int") + (F.col("m") < -0.08).cast("int") * 2
    return e.select(day("date").alias("date"), level.alias("level"), F.when(level >= 5, 0.25).when(level >= 3, 0.5).otherwise(1.0).alias("cap"))


@query(f"WITH {RETURNS}, l AS (SELECT * FROM rets WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 52), k AS (SELECT ticker, stddev_samp(r) * sqrt(52) AS vol, min(r) AS worst, avg(r) / stddev_samp(r) * sqrt(52) AS sharpe FROM l GROUP BY 1) SELECT ticker, CAST(vol > 3 AS INTEGER) AS vol_breach, CAST(worst < -0.4 AS INTEGER) AS loss_breach, CAST(sharpe < 1 AS INTEGER) AS sharpe_breach FROM k")
def x27_kill_switch(spark, d):
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    k = returns(spark, d).where("r is not null").withColumn("n", F.row_number().over(w)).where("n <= 52").groupBy("ticker").agg((F.stddev_samp("r") * F.sqrt(F.lit(52))).alias("vol"), F.min("r").alias("worst"), (F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(52))).alias("sharpe"))
    return k.select("ticker", (F.col("vol") > 3).cast("int").alias("vol_breach"), (F.col("worst") < -0.4).cast("int").alias("loss_breach"), (F.col("sharpe") < 1).cast("int").alias("sharpe_breach"))
