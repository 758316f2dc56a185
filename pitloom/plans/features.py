"""More window features, books, factors, options and valuation scalars over the weekly panel and the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.finance import greeks
from ..functions.stats import average_rank, by, change, clip, correlation, frame, guarded, since, zscore
from ..sources.tables import bars, table
from .registry import BARS, RETURNS, day, query, rounded
from .research import _SECTOR, MARKET, _market_series, _SERIES, market, sector
from .windows import returns

_DATE = "CAST(date AS VARCHAR) AS date"
_W = "(PARTITION BY ticker ORDER BY date)"


def _rows(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def _out(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(day("date").alias("date"), "ticker", *(rounded(n, digits).alias(n) for n in names))


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) AS z FROM bars WINDOW w AS {_W}")
def w4_expanding_z(spark, d):
    return _out(bars(spark, d).withColumn("z", zscore(F.col("close"), since("ticker"))), "z")


@query(f"WITH {MARKET}, b AS (SELECT date, ticker, CASE WHEN count(*) OVER w >= 13 THEN regr_slope(r, m) OVER w END AS beta FROM j WINDOW w AS {_rows(26)}), s AS (SELECT *, avg(beta) OVER p AS mean, stddev_samp(beta) OVER p AS sd, count(beta) OVER p AS k FROM b WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT {_DATE}, ticker, round((beta - mean) / nullif(sd, 0), 4) AS drift FROM s WHERE k >= 20")
def w6_beta_drift(spark, d):
    w, p = frame("ticker", 26), by("ticker").rowsBetween(Window.unboundedPreceding, -1)
    b = market(spark, d).withColumn("beta", F.when(F.count(F.lit(1)).over(w) >= 13, F.regr_slope("r", "m").over(w)))
    s = b.withColumn("k", F.count("beta").over(p)).withColumn("drift", F.try_divide(F.col("beta") - F.avg("beta").over(p), F.stddev_samp("beta").over(p)))
    return _out(s.where("k >= 20"), "drift", digits=4)


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round(coalesce(least(greatest((close - avg(close) OVER d) / (stddev_samp(close) OVER d + 1e-9), -6), 6), 0), 6) AS z FROM bars WINDOW d AS (PARTITION BY date)")
def w8_cross_section_z(spark, d):
    return _out(bars(spark, d).withColumn("z", F.coalesce(clip(zscore(F.col("close"), Window.partitionBy("date"), 1e-9), -6.0, 6.0), F.lit(0.0))), "z")


@query(f"WITH {BARS}, s AS (SELECT date, ticker, (close - avg(close) OVER g) / nullif(stddev_samp(close) OVER g, 0) AS z FROM bars WINDOW g AS (PARTITION BY date, {_SECTOR})) SELECT {_DATE}, ticker, round(coalesce((z - min(z) OVER d) / nullif(max(z) OVER d - min(z) OVER d, 0) * 100, 50), 5) AS score FROM s WINDOW d AS (PARTITION BY date)")
def w9_sector_neutral(spark, d):
    s = bars(spark, d).withColumn("sector", sector()).withColumn("z", zscore(F.col("close"), Window.partitionBy("date", "sector")))
    w = Window.partitionBy("date")
    return _out(s.withColumn("score", F.coalesce(F.try_divide(F.col("z") - F.min("z").over(w), F.max("z").over(w) - F.min("z").over(w)) * 100, F.lit(50.0))), "score", digits=5)


@query(f"WITH {BARS}, k AS (SELECT date, ticker, row_number() OVER (PARTITION BY ticker ORDER BY close, date) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM bars) SELECT {_DATE}, ticker, CASE WHEN n < 30 THEN 'unknown' WHEN k * 3 <= n THEN 'low' WHEN k * 3 <= 2 * n THEN 'mid' ELSE 'high' END AS label FROM k")
def w11_terciles(spark, d):
    w = Window.partitionBy("ticker")
    k, n = F.row_number().over(w.orderBy("close", "date")) * 3, F.count(F.lit(1)).over(w)
    return bars(spark, d).select(day("date").alias("date"), "ticker", F.when(n < 30, "unknown").when(k <= n, "low").when(k <= 2 * n, "mid").otherwise("high").alias("label"))


@query(f"WITH {BARS}, s AS (SELECT date, {_SECTOR} AS sector, round(avg(close), 6) AS level FROM bars GROUP BY 1, 2) SELECT {_DATE}, sector, dense_rank() OVER (PARTITION BY date ORDER BY level DESC) AS place FROM s")
def w12_dense_rank(spark, d):
    s = bars(spark, d).groupBy("date", sector().alias("sector")).agg(rounded(F.avg("close")).alias("level"))
    return s.select(day("date").alias("date"), "sector", F.dense_rank().over(Window.partitionBy("date").orderBy(F.desc("level"))).cast("long").alias("place"))


@query("WITH g AS (SELECT user_id, CAST(ts AS DATE) AS dt, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(dt AS VARCHAR) AS date, CAST(max(e) OVER (PARTITION BY user_id ORDER BY dt RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW) > 0 AS INTEGER) AS recent, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY dt RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n10 FROM g")
def w24_trailing_flags(spark, d):
    """By ranges of days, so missing days need no rows."""
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("e"), F.count(F.lit(1)).alias("n"))
    w = lambda n: Window.partitionBy("user_id").orderBy(F.datediff("dt", F.lit("1970-01-01"))).rangeBetween(1 - n, 0)
    return g.select("user_id", day("dt").alias("date"), (F.max("e").over(w(5)) > 0).cast("int").alias("recent"), F.sum("n").over(w(10)).alias("n10"))


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round(volume - avg(volume) OVER {_rows(20)}, 5) AS surprise FROM bars")
def w25_surprise(spark, d):
    return _out(bars(spark, d).withColumn("surprise", F.col("volume") - F.avg("volume").over(frame("ticker", 20))), "surprise", digits=5)


@query(f"WITH {_SERIES}, k AS (SELECT date, avg(m) OVER (ORDER BY date ROWS 7 PRECEDING) - avg(m) OVER (ORDER BY date ROWS BETWEEN 27 PRECEDING AND 20 PRECEDING) AS x FROM s) SELECT {_DATE}, round(x, 6) AS momentum, CASE WHEN x > 0.01 THEN 'rising' WHEN x < -0.01 THEN 'falling' ELSE 'steady' END AS label FROM k WHERE x IS NOT NULL")
def w26_regime_momentum(spark, d):
    w = Window.orderBy("date")  # over one series, a row a week
    k = _market_series(spark, d).withColumn("x", F.avg("m").over(w.rowsBetween(-7, 0)) - F.avg("m").over(w.rowsBetween(-27, -20))).where("x is not null")
    return k.select(day("date").alias("date"), rounded("x").alias("momentum"), F.when(F.col("x") > 0.01, "rising").when(F.col("x") < -0.01, "falling").otherwise("steady").alias("label"))


@query(f"WITH {RETURNS} SELECT {_DATE}, ticker, CAST(coalesce(abs(r) > 2 * avg(abs(r)) OVER {_rows(60)}, false) AS INTEGER) AS spike FROM rets")
def w27_spikes(spark, d):
    x = F.abs("r")
    return returns(spark, d).select(day("date").alias("date"), "ticker", F.coalesce(x > 2 * F.avg(x).over(frame("ticker", 60)), F.lit(False)).cast("int").alias("spike"))


@query(f"WITH {BARS}, z AS (SELECT date, ticker, (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) AS z FROM bars WINDOW w AS {_rows(26)}) SELECT {_DATE}, ticker, round(z - lag(z) OVER {_W}, 5) AS jump FROM z QUALIFY abs(z - lag(z) OVER {_W}) > 2.5")
def w28_change_points(spark, d):
    z = bars(spark, d).withColumn("z", zscore(F.col("close"), frame("ticker", 26))).withColumn("jump", F.col("z") - F.lag("z").over(by("ticker")))
    return _out(z.where("abs(jump) > 2.5"), "jump", digits=5)


@query(f"WITH {MARKET}, c AS (SELECT ticker, date, row_number() OVER {_W} AS k, abs(covar_samp(r, m) OVER w / nullif(stddev_samp(r) OVER w * stddev_samp(m) OVER w, 0)) AS c FROM j WINDOW w AS {_rows(26)}), p AS (SELECT *, max_by(k, c) OVER (PARTITION BY ticker) AS top FROM c WHERE k >= 26) SELECT ticker, round(regr_slope(ln(greatest(c, 0.01)), k), 6) AS slope, count(*) AS n FROM p WHERE k >= top GROUP BY 1 HAVING count(*) >= 10")
def w29_edge_half_life(spark, d):
    w = frame("ticker", 26)
    c = F.abs(F.try_divide(F.covar_samp("r", "m").over(w), F.stddev_samp("r").over(w) * F.stddev_samp("m").over(w)))
    p = market(spark, d).select("ticker", F.row_number().over(by("ticker")).alias("k"), c.alias("c")).where("k >= 26")
    p = p.withColumn("top", F.max_by("k", "c").over(Window.partitionBy("ticker"))).where("k >= top").withColumn("l", F.log(F.greatest("c", F.lit(0.01))))
    return p.groupBy("ticker").agg(rounded(F.regr_slope("l", "k")).alias("slope"), F.count(F.lit(1)).alias("n")).where("n >= 10")


@query(f"WITH {BARS}, w AS (SELECT date, ticker, close, lag(close, 1) OVER {_W} AS c1, lag(close, 2) OVER {_W} AS c2, lag(close, 3) OVER {_W} AS c3, row_number() OVER {_W} AS k FROM bars) SELECT {_DATE}, ticker, round(close / c3, 6) AS x0, round(c1 / c3, 6) AS x1, round(c2 / c3, 6) AS x2 FROM w WHERE k >= 4 AND k % 2 = 0")
def w32_feature_windows(spark, d):
    b = bars(spark, d).select("date", "ticker", F.row_number().over(by("ticker")).alias("k"), F.collect_list("close").over(frame("ticker", 4)).alias("c")).where("k >= 4 and k % 2 = 0")
    return b.select(day("date").alias("date"), "ticker", *(rounded(F.col("c")[3 - i] / F.col("c")[0]).alias(f"x{i}") for i in range(3)))


@query(f"WITH {RETURNS}, l AS (SELECT date, ticker, list(close) OVER {_rows(10)} AS c, row_number() OVER {_W} AS k, lead(close) OVER {_W} / close - 1 AS f FROM rets) SELECT {_DATE}, ticker, round((c[10] - list_avg(c)) / nullif(list_stddev_samp(c), 0), 5) AS last_z, round((c[1] - list_avg(c)) / nullif(list_stddev_samp(c), 0), 5) AS first_z, CAST(f > 0 AS INTEGER) AS label FROM l WHERE k >= 10 AND f IS NOT NULL")
def w33_sequences(spark, d):
    """Each row's window as an array normalised by its own mean and deviation, with the label ahead."""
    c = F.col("c")
    mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / 10
    sd = F.sqrt(F.aggregate(F.transform(c, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / 9)
    s = returns(spark, d).select("date", "ticker", F.collect_list("close").over(frame("ticker", 10)).alias("c"), F.row_number().over(by("ticker")).alias("k"), (F.lead("close").over(by("ticker")) / F.col("close") - 1).alias("f")).where("k >= 10 and f is not null")
    s = s.withColumn("x", F.transform(c, lambda v: F.try_divide(v - mean, sd)))
    return s.select(day("date").alias("date"), "ticker", rounded(F.col("x")[9], 5).alias("last_z"), rounded(F.col("x")[0], 5).alias("first_z"), (F.col("f") > 0).cast("int").alias("label"))


@query(f"WITH {BARS}, t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM bars GROUP BY date HAVING count(*) >= 20), f AS (SELECT unnest(range(0, 50)) AS fold) SELECT CAST(fold AS BIGINT) AS fold, CAST(min(date) AS VARCHAR) AS train, CAST(min(date) FILTER (k >= fold * 13 + 104) AS VARCHAR) AS valid, CAST(min(date) FILTER (k >= fold * 13 + 130) AS VARCHAR) AS test FROM t, f WHERE k >= fold * 13 AND k < fold * 13 + 156 GROUP BY 1 HAVING count(*) = 156")
def w34_time_splits(spark, d):
    """104, 26 and 26 eligible weeks, 13 apart: each date is exploded to the folds that hold it."""
    t = bars(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)  # a row a week
    folds = t.withColumn("fold", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("k") - 155) / 13)).cast("int"), F.floor(F.col("k") / 13).cast("int")))).withColumn("o", F.col("k") - F.col("fold") * 13)
    first = lambda a: day(F.min(F.when(F.col("o") >= a, F.col("date"))))
    return folds.groupBy(F.col("fold").cast("long").alias("fold")).agg(first(0).alias("train"), first(104).alias("valid"), first(130).alias("test"), F.count(F.lit(1)).alias("n")).where("n = 156").drop("n")


@query(f"WITH {BARS}, l AS (SELECT ticker, close, volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars), a AS (SELECT ticker, max(CASE WHEN k = 1 THEN close END) AS price, avg(volume) AS adv FROM l WHERE k <= 20 GROUP BY 1) SELECT ticker, round(0.1 * pow(500 / adv, 0.6), 6) AS impact, CASE WHEN 500 / adv > 3 THEN 'slow' ELSE 'fast' END AS status, round(price * 500, 2) AS worth FROM a")
def w35_exit_risk(spark, d):
    lst = bars(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("k <= 20")
    a = lst.groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("price"), F.avg("volume").alias("adv"))
    return a.select("ticker", rounded(0.1 * F.pow(500 / F.col("adv"), F.lit(0.6))).alias("impact"), F.when(500 / F.col("adv") > 3, "slow").otherwise("fast").alias("status"), rounded(F.col("price") * 500, 2).alias("worth"))


@query(f"WITH {BARS}, a AS (SELECT date, ticker, avg(volume) OVER {_rows(21)} AS adv FROM bars) SELECT {_DATE}, ticker, round(adv / lag(adv, 5) OVER {_W} - 1, 6) AS fell FROM a QUALIFY adv / lag(adv, 5) OVER {_W} - 1 < -0.15")
def w36_liquidity_drop(spark, d):
    a = bars(spark, d).withColumn("adv", F.avg("volume").over(frame("ticker", 21))).withColumn("fell", change(F.col("adv"), "ticker", 5))
    return _out(a.where("fell < -0.15"), "fell")


@query(f"WITH {RETURNS}, k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1 AS age FROM rets WHERE r IS NOT NULL), m AS (SELECT ticker, sum(r * pow(0.97, age)) / sum(pow(0.97, age)) AS mean, sum(r * r * pow(0.97, age)) / sum(pow(0.97, age)) AS sq FROM k GROUP BY 1) SELECT ticker, round(0.8 * mean + 0.2 * 0.01, 6) AS mean, round(sq - mean * mean, 6) AS variance FROM m")
def w37_weighted_moments(spark, d):
    k = returns(spark, d).where("r is not null").withColumn("w", F.pow(F.lit(0.97), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))) - 1))
    m = k.groupBy("ticker").agg((F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("mean"), (F.sum(F.col("r") * F.col("r") * F.col("w")) / F.sum("w")).alias("sq"))
    return m.select("ticker", rounded(0.8 * F.col("mean") + 0.2 * 0.01).alias("mean"), rounded(F.col("sq") - F.col("mean") * F.col("mean")).alias("variance"))


@query(f"WITH {MARKET}, b AS (SELECT date, ticker, regr_slope(r, m) OVER w AS beta, count(*) OVER w AS k FROM j WINDOW w AS {_rows(26)}), c AS (SELECT date, ticker, beta - lag(beta) OVER {_W} AS ch FROM b WHERE k >= 20), z AS (SELECT *, (ch - avg(ch) OVER w) / nullif(stddev_samp(ch) OVER w, 0) AS z, count(ch) OVER w AS n FROM c WINDOW w AS {_rows(52)}) SELECT {_DATE}, ticker, round(z, 4) AS z FROM z WHERE n >= 20 AND abs(z) > 2.5")
def w38_beta_transition(spark, d):
    w, v = frame("ticker", 26), frame("ticker", 52)
    b = market(spark, d).select("date", "ticker", F.regr_slope("r", "m").over(w).alias("beta"), F.count(F.lit(1)).over(w).alias("k")).where("k >= 20")
    c = b.withColumn("ch", F.col("beta") - F.lag("beta").over(by("ticker"))).withColumn("z", zscore(F.col("ch"), v)).withColumn("n", F.count("ch").over(v))
    return _out(c.where("n >= 20 and abs(z) > 2.5"), "z", digits=4)


@query(f"WITH {RETURNS}, k AS (SELECT date, ticker, list(r) OVER {_rows(21)} AS l FROM rets WHERE r IS NOT NULL) SELECT {_DATE}, ticker, round(-list_avg(list_sort(l, 'DESC')[1:5]), 8) AS top5 FROM k WHERE len(l) >= 15")
def k5_top_mean(spark, d):
    """Less the mean of the five largest of 21 returns, from 15 on; the frame is short, so its rows fit in an array."""
    k = returns(spark, d).where("r is not null").withColumn("l", F.collect_list("r").over(frame("ticker", 21))).where(F.size("l") >= 15)
    top = F.slice(F.sort_array("l", asc=False), 1, 5)
    return _out(k.withColumn("top5", -F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / 5), "top5", digits=8)


@query(f"WITH {RETURNS}, v AS (SELECT date, ticker, r, stddev_samp(r) OVER {_rows(26)} AS sd, count(r) OVER {_rows(26)} AS n FROM rets), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r DESC, ticker) AS k FROM v WHERE n >= 10 AND r IS NOT NULL) SELECT {_DATE}, ticker, round(1 / sd / sum(1 / sd) OVER (PARTITION BY date), 6) AS inverse_vol, round((6 - k) * 1.0 / sum(6 - k) OVER (PARTITION BY date), 6) AS by_rank FROM k WHERE k <= 5")
def k6_top_weights(spark, d):
    w, date = frame("ticker", 26), Window.partitionBy("date")
    v = returns(spark, d).withColumns({"sd": F.stddev_samp("r").over(w), "n": F.count("r").over(w)}).where("n >= 10 and r is not null")
    k = v.withColumn("k", F.row_number().over(date.orderBy(F.desc("r"), "ticker"))).where("k <= 5")
    return k.select(day("date").alias("date"), "ticker", rounded(1 / F.col("sd") / F.sum(1 / F.col("sd")).over(date)).alias("inverse_vol"), rounded((6 - F.col("k")) / F.sum(6 - F.col("k")).over(date)).alias("by_rank"))


@query(f"WITH {BARS}, a AS (SELECT date, ticker, avg(volume) OVER {_rows(13)} AS adv, count(*) OVER {_rows(13)} AS n FROM bars), b AS (SELECT date, ticker, least(1.0 / count(*) OVER (PARTITION BY date), adv * 0.0003) AS w FROM a WHERE n >= 5 AND adv > 40) SELECT {_DATE}, ticker, round(w, 6) AS w, round(1 - sum(w) OVER (PARTITION BY date), 6) AS cash FROM b")
def k10_liquidity_capped(spark, d):
    v, date = frame("ticker", 13), Window.partitionBy("date")
    a = bars(spark, d).select("date", "ticker", F.avg("volume").over(v).alias("adv"), F.count(F.lit(1)).over(v).alias("n")).where("n >= 5 and adv > 40")
    b = a.withColumn("w", F.least(1 / F.count(F.lit(1)).over(date), F.col("adv") * 0.0003))
    return _out(b.withColumn("cash", 1 - F.sum("w").over(date)), "w", "cash")


_YEARS = "y AS (SELECT p_brand AS ticker, year(l_shipdate) AS y, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (l_tax - l_discount * 0.4)) AS income, sum(l_extendedprice * l_quantity) / 12 AS assets, sum(l_extendedprice * l_tax) AS cash, sum(l_quantity) AS debt, count(*) AS shares FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), f AS (SELECT *, " + ", ".join(f"lag({c}) OVER (PARTITION BY ticker ORDER BY y) AS p_{c}" for c in ("revenue", "income", "assets", "cash", "debt", "shares")) + " FROM y)"
_ITEMS = ("revenue", "income", "assets", "cash", "debt", "shares")


def statements(spark, d) -> DataFrame:
    """Yearly statement lines of each ticker with those of the year before as p_<line>."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_tax", "l_discount", "l_quantity")
    j = li.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
    sums = {"revenue": "l_extendedprice", "income": "l_extendedprice * (l_tax - l_discount * 0.4D)", "assets": "l_extendedprice * l_quantity / 12", "cash": "l_extendedprice * l_tax", "debt": "l_quantity"}
    y = j.groupBy("ticker", F.year("l_shipdate").cast("long").alias("y")).agg(*(F.sum(F.expr(e)).alias(k) for k, e in sums.items()), F.count(F.lit(1)).alias("shares"))
    w = Window.partitionBy("ticker").orderBy("y")
    return y.withColumns({f"p_{c}": F.lag(c).over(w) for c in _ITEMS})


@query(f"WITH {MARKET}, t AS (SELECT ticker, covar_samp(r, m) OVER l / (stddev_samp(r) OVER l * stddev_samp(m) OVER l) AS rho, stddev_samp(r) OVER s AS si, stddev_samp(m) OVER s AS sm, count(*) OVER l AS n, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM j WINDOW l AS {_rows(252)}, s AS {_rows(21)}) SELECT ticker, round(-rho * si / sm, 5) AS bab FROM t WHERE k = 1 AND n >= 120")
def x2_betting_against_beta(spark, d):
    """Correlation of up to 252 rows, deviations of 21, at the last row; 120 rows at least."""
    r, m = F.col("r"), F.col("m")
    last = market(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("k <= 252")
    short = lambda x: F.stddev_samp(F.when(F.col("k") <= 21, x))
    return last.groupBy("ticker").agg(rounded(-correlation(r, m) * short(r) / short(m), 5).alias("bab"), F.count(F.lit(1)).alias("n")).where("n >= 120").drop("n")


@query(f"WITH {RETURNS}, k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM rets WHERE date <= (SELECT max(date) FROM rets) - 1), t AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY r DESC) AS m, count(*) OVER (PARTITION BY ticker) AS c FROM k WHERE n <= 21 AND r IS NOT NULL) SELECT ticker, round(-avg(r), 6) AS max_factor FROM t WHERE m <= 5 AND c >= 15 GROUP BY 1")
def x4_max_factor(spark, d):
    """Mean of the five largest returns of the last 21 rows before the as-of day, which itself is left out."""
    r = returns(spark, d)
    as_of = r.agg(F.max("date").alias("as_of"))  # one row
    last = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = r.join(F.broadcast(as_of), F.col("date") < F.col("as_of")).withColumn("n", F.row_number().over(last)).where("n <= 21 and r is not null")
    w = Window.partitionBy("ticker")
    top = rows.withColumn("m", F.row_number().over(w.orderBy(F.desc("r")))).withColumn("c", F.count(F.lit(1)).over(w)).where("m <= 5 and c >= 15")
    return top.groupBy("ticker").agg(rounded(-F.avg("r")).alias("max_factor"))


@query(f"WITH {_YEARS} SELECT ticker, y, round(0.6 * income / assets + 0.4 * (income / assets - p_income / p_assets), 6) AS score FROM f WHERE p_assets IS NOT NULL")
def x5_operating_profitability(spark, d):
    return statements(spark, d).where("p_assets is not null").select("ticker", "y", rounded(F.expr("0.6D * income / assets + 0.4D * (income / assets - p_income / p_assets)")).alias("score"))


_TESTS = ["income > 0", "cash > 0", "income / assets > p_income / p_assets", "cash > income", "debt / assets < p_debt / p_assets", "cash / debt > p_cash / p_debt", "shares <= p_shares * 1.02", "income / revenue > p_income / p_revenue", "revenue / assets > p_revenue / p_assets"]


@query(f"WITH {_YEARS} SELECT ticker, y, CAST({' + '.join(f'CASE WHEN {t} THEN 1 ELSE 0 END' for t in _TESTS)} AS INTEGER) AS score FROM f WHERE p_assets IS NOT NULL")
def x6_nine_tests(spark, d):
    """Nine tests of this year's statement against the last one."""
    score = sum((F.expr(f"CASE WHEN {t} THEN 1 ELSE 0 END") for t in _TESTS[1:]), F.expr(f"CASE WHEN {_TESTS[0]} THEN 1 ELSE 0 END"))
    return statements(spark, d).where("p_assets is not null").select("ticker", "y", score.cast("int").alias("score"))


@query(f"WITH {_YEARS} SELECT ticker, y, round(0.4 * (income - cash) / ((assets + p_assets) / 2) - 0.3 * least(cash / nullif(income, 0), 3) + 0.3 * (debt - p_debt) / assets, 6) AS score FROM f WHERE p_assets IS NOT NULL AND income > 0")
def x7_earnings_quality(spark, d):
    return statements(spark, d).where("p_assets is not null and income > 0").select("ticker", "y", rounded(F.expr("0.4D * (income - cash) / ((assets + p_assets) / 2) - 0.3D * least(cash / income, 3D) + 0.3D * (debt - p_debt) / assets")).alias("score"))


_QUARTERS = "q AS (SELECT p_brand AS ticker, year(l_shipdate) * 4 + quarter(l_shipdate) AS q, sum(l_extendedprice) / count(*) AS eps FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), s AS (SELECT ticker, q, eps - lag(eps, 4) OVER w * (1 + avg(g) OVER (PARTITION BY ticker ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS surprise FROM (SELECT *, eps / lag(eps, 4) OVER (PARTITION BY ticker ORDER BY q) - 1 AS g FROM q) WINDOW w AS (PARTITION BY ticker ORDER BY q))"


@query(f"WITH {_QUARTERS}, k AS (SELECT ticker, surprise, stddev_pop(surprise) OVER (PARTITION BY ticker ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd, row_number() OVER (PARTITION BY ticker ORDER BY q DESC) AS n, count(*) OVER (PARTITION BY ticker) AS c FROM s WHERE surprise IS NOT NULL) SELECT ticker, round(surprise / nullif(sd, 0), 5) AS sue FROM k WHERE n = 1 AND c >= 6")
def x8_unexpected_earnings(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    j = li.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("ticker").orderBy("q")
    q = j.groupBy("ticker", (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("q")).agg((F.sum("l_extendedprice") / F.count(F.lit(1))).alias("eps"))
    s = q.withColumn("g", F.col("eps") / F.lag("eps", 4).over(w) - 1).withColumn("surprise", F.col("eps") - F.lag("eps", 4).over(w) * (1 + F.avg("g").over(w.rowsBetween(-8, -1)))).where("surprise is not null")
    k = s.select("ticker", "surprise", F.stddev_pop("surprise").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("sd"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("q"))).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("c"))
    return k.where("n = 1 and c >= 6").select("ticker", rounded(F.try_divide("surprise", "sd"), 5).alias("sue"))


@query(f"WITH {_YEARS} SELECT ticker, y, round(-(debt / shares - p_debt / p_shares), 6) AS pledge FROM f WHERE p_shares IS NOT NULL")
def x9_pledge_change(spark, d):
    return statements(spark, d).where("p_shares is not null").select("ticker", "y", rounded(-(F.col("debt") / F.col("shares") - F.col("p_debt") / F.col("p_shares"))).alias("pledge"))


@query("WITH k AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'fund' ELSE 'other' END AS entity, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS age, CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END AS signed, value FROM events) SELECT user_id, entity, round(sum(CASE WHEN age BETWEEN 0 AND 6 THEN signed ELSE 0 END) / avg(value), 5) AS week, round(sum(CASE WHEN age BETWEEN 0 AND 29 THEN signed ELSE 0 END) / avg(value), 5) AS month FROM k GROUP BY 1, 2")
def x10_deal_pressure(spark, d):
    v = F.col("value")
    k = table(spark, d, "events").select("user_id", "value", F.when(F.col("user_id") % 3 == 0, "fund").otherwise("other").alias("entity"), F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts")).alias("age"), F.when(F.col("event_type") == "purchase", v).when(F.col("event_type") == "error", -v).otherwise(0.0).alias("signed"))
    net = lambda n: F.sum(F.when(F.col("age").between(0, n), F.col("signed")).otherwise(0.0)) / F.avg("value")
    return k.groupBy("user_id", "entity").agg(rounded(net(6), 5).alias("week"), rounded(net(29), 5).alias("month"))


@query(f"WITH {MARKET}, p AS (SELECT date, ticker, CASE WHEN count(*) OVER w >= 13 THEN covar_samp(r, m) OVER w / nullif(var_samp(m) OVER w, 0) END AS beta, avg(abs(r) / (close * volume)) OVER v AS illiq, max(r) OVER v AS top FROM j WINDOW w AS {_rows(26)}, v AS {_rows(13)}) SELECT {_DATE}, ticker, round(beta, 5) AS beta, round(illiq * 1e6, 5) AS illiq, round(top, 6) AS top FROM p")
def x11_panel_factors(spark, d):
    w, v = frame("ticker", 26), frame("ticker", 13)
    p = market(spark, d).select("date", "ticker", F.when(F.count(F.lit(1)).over(w) >= 13, F.try_divide(F.covar_samp("r", "m").over(w), F.var_samp("m").over(w))).alias("beta"), F.avg(F.abs("r") / (F.col("close") * F.col("volume"))).over(v).alias("illiq"), F.max("r").over(v).alias("top"))
    return p.select(day("date").alias("date"), "ticker", rounded("beta", 5).alias("beta"), rounded(F.col("illiq") * 1e6, 5).alias("illiq"), rounded("top").alias("top"))


@query(f"WITH {RETURNS} SELECT {_DATE}, ticker, round(close / lag(close, 4) OVER w - 1, 6) AS momentum, round(-stddev_samp(r) OVER {_rows(20)}, 6) AS low_vol, round(ln(avg(close * volume) OVER {_rows(20)}), 6) AS liquidity, round(-(close / lag(close, 1) OVER w - 1), 6) AS reversal FROM rets WINDOW w AS {_W}")
def x13_signal_pack(spark, d):
    w = frame("ticker", 20)
    p = returns(spark, d).withColumns({"momentum": change(F.col("close"), "ticker", 4), "low_vol": -F.stddev_samp("r").over(w), "liquidity": F.log(F.avg(F.col("close") * F.col("volume")).over(w)), "reversal": -change(F.col("close"), "ticker", 1)})
    return _out(p, "momentum", "low_vol", "liquidity", "reversal")


@query("WITH d AS (SELECT user_id, CAST(ts AS DATE) AS dt, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS sd, avg(v) OVER (PARTITION BY dt) AS m FROM d WINDOW w AS (PARTITION BY user_id ORDER BY dt ROWS 6 PRECEDING)) SELECT user_id, CAST(dt AS VARCHAR) AS date, round((v - mean) / nullif(sd, 0), 5) AS z, round(v - m, 5) AS against_market, round(v - lag(v) OVER (PARTITION BY user_id ORDER BY dt), 5) AS momentum FROM k")
def x16_company_sentiment(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("dt")
    return g.select("user_id", day("dt").alias("date"), rounded(zscore(F.col("v"), w.rowsBetween(-6, 0)), 5).alias("z"), rounded(F.col("v") - F.avg("v").over(Window.partitionBy("dt")), 5).alias("against_market"), rounded(F.col("v") - F.lag("v").over(w), 5).alias("momentum"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS dt, avg(value) AS v FROM events GROUP BY 1), k AS (SELECT dt, lag(v) OVER (ORDER BY dt) AS v FROM d) SELECT CAST(dt AS VARCHAR) AS date, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 5) AS z, round(v - lag(v, 3) OVER (ORDER BY dt), 5) AS momentum FROM k WINDOW w AS (ORDER BY dt ROWS 6 PRECEDING)")
def x17_market_sentiment(spark, d):
    """All of it on the day before: a day's own value is never used."""
    w = Window.orderBy("dt")  # a row a day
    k = table(spark, d, "events").groupBy(F.to_date("ts").alias("dt")).agg(F.avg("value").alias("x")).withColumn("v", F.lag("x").over(w))
    return k.select(day("dt").alias("date"), rounded(zscore(F.col("v"), w.rowsBetween(-6, 0)), 5).alias("z"), rounded(F.col("v") - F.lag("v", 3).over(w), 5).alias("momentum"))


@query("WITH m AS (SELECT last_day(o_orderdate) AS m, o_orderpriority AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), c AS (SELECT *, v / lag(v) OVER w - 1 AS mom, v / lag(v, 12) OVER w - 1 AS yoy FROM m WINDOW w AS (PARTITION BY k ORDER BY m)) SELECT CAST(m AS VARCHAR) AS month, k, round(mom, 6) AS mom, round(yoy, 6) AS yoy, round(avg(mom) OVER (PARTITION BY k ORDER BY m ROWS 2 PRECEDING), 6) AS trend FROM c")
def x20_macro_activity(spark, d):
    w = Window.partitionBy("k").orderBy("m")
    m = table(spark, d, "orders").groupBy(F.last_day("o_orderdate").alias("m"), F.col("o_orderpriority").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    c = m.withColumns({"mom": F.col("v") / F.lag("v").over(w) - 1, "yoy": F.col("v") / F.lag("v", 12).over(w) - 1})
    return c.select(day("m").alias("month"), "k", rounded("mom").alias("mom"), rounded("yoy").alias("yoy"), rounded(F.avg("mom").over(w.rowsBetween(-2, 0))).alias("trend"))


@query(f"WITH {RETURNS}, s AS (SELECT date, {_SECTOR} AS sector, avg(r) AS m, sum(sign(coalesce(r, 0)) * volume) AS flow FROM rets GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY round(m, 8) DESC) AS place, sum(flow) OVER (PARTITION BY sector ORDER BY date ROWS 9 PRECEDING) AS f10 FROM s WHERE m IS NOT NULL) SELECT {_DATE}, sector, place, round(f10, 2) AS flow, CASE WHEN f10 > 500 THEN 'in' WHEN f10 < -500 THEN 'out' ELSE 'flat' END AS state FROM k")
def x21_sector_rotation(spark, d):
    s = returns(spark, d).groupBy("date", sector().alias("sector")).agg(F.avg("r").alias("m"), F.sum(F.signum(F.coalesce("r", F.lit(0.0))) * F.col("volume")).alias("flow")).where("m is not null")
    f = F.sum("flow").over(Window.partitionBy("sector").orderBy("date").rowsBetween(-9, 0))
    return s.select(day("date").alias("date"), "sector", F.rank().over(Window.partitionBy("date").orderBy(F.desc(F.round("m", 8)))).cast("long").alias("place"), rounded(f, 2).alias("flow"), F.when(f > 500, "in").when(f < -500, "out").otherwise("flat").alias("state"))


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round(close - lag(close) OVER w, 6) AS diff, round(ln(close) - lag(ln(close)) OVER w, 6) AS log_diff FROM bars WINDOW w AS {_W}")
def x23_stationary(spark, d):
    c, w = F.col("close"), by("ticker")
    return _out(bars(spark, d).withColumns({"diff": c - F.lag(c).over(w), "log_diff": F.log(c) - F.lag(F.log(c)).over(w)}), "diff", "log_diff")


@query(f"WITH {RETURNS} SELECT {_DATE}, ticker, {', '.join(f'round(lag(r, {k}) OVER w, 6) AS r{k}' for k in range(1, 5))} FROM rets WINDOW w AS {_W}")
def x24_lag_matrix(spark, d):
    return _out(returns(spark, d).withColumns({f"r{k}": F.lag("r", k).over(by("ticker")) for k in range(1, 5)}), *(f"r{k}" for k in range(1, 5)))


def _cdf_sql(x: str) -> str:
    z, t = f"(abs({x}) / sqrt(2))", f"(1 / (1 + 0.3275911 * (abs({x}) / sqrt(2))))"
    tail = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z}))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} / 2 ELSE {tail} / 2 END)"


#: Option contracts read from line items: spot, strike, years and volatility.
_CHAIN = "ch AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS qty, l_extendedprice / l_quantity AS s, l_extendedprice / l_quantity * (0.9 + l_discount * 2) AS k, 0.1 + l_linenumber / 10.0 AS t, 0.15 + l_tax * 2 AS v FROM lineitem), g AS (SELECT *, (ln(s / k) + (0.05 + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(s / k) + (0.05 + v * v / 2) * t) / (v * sqrt(t)) - v * sqrt(t) AS d2 FROM ch)"
_PDF = "(exp(-d1 * d1 / 2) / sqrt(2 * pi()))"


def chain(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("s"), "l_discount", "l_tax")
    c = li.select("l_orderkey", "l_linenumber", "l_returnflag", "qty", "s", (F.col("s") * (0.9 + F.col("l_discount") * 2)).alias("k"), (0.1 + F.col("l_linenumber") / 10.0).alias("t"), (0.15 + F.col("l_tax") * 2).alias("v"))
    return c.withColumns(greeks(F.col("s"), F.col("k"), F.col("t"), F.col("v"), 0.05))


@query(f"WITH {_CHAIN} SELECT l_orderkey, l_linenumber, round({_cdf_sql('d1')}, 5) AS delta, round({_PDF} / (s * v * sqrt(t)), 7) AS gamma, round(s * {_PDF} * sqrt(t), 3) AS vega, round(-s * {_PDF} * v / (2 * sqrt(t)) - 0.05 * k * exp(-0.05 * t) * {_cdf_sql('d2')}, 3) AS theta FROM g")
def f17_option_greeks(spark, d):
    return chain(spark, d).select("l_orderkey", "l_linenumber", rounded("delta", 5).alias("delta"), rounded("gamma", 7).alias("gamma"), rounded("vega", 3).alias("vega"), rounded("theta", 3).alias("theta"))


@query(f"WITH {_CHAIN} SELECT l_returnflag, round(sum(qty * {_cdf_sql('d1')}), 1) AS delta, round(sum(qty * {_PDF} / (s * v * sqrt(t))), 4) AS gamma, count(*) AS n FROM g GROUP BY 1")
def a53_greeks_rollup(spark, d):
    return chain(spark, d).groupBy("l_returnflag").agg(rounded(F.sum(F.col("qty") * F.col("delta")), 1).alias("delta"), rounded(F.sum(F.col("qty") * F.col("gamma")), 4).alias("gamma"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHAIN} SELECT l_orderkey, l_linenumber, round({_cdf_sql('d1')} * s * 0.02 + 0.5 * {_PDF} / (s * v * sqrt(t)) * s * s * 0.0004, 4) AS explained FROM g")
def f31_greeks_attribution(spark, d):
    ds = F.col("s") * 0.02
    return chain(spark, d).select("l_orderkey", "l_linenumber", rounded(F.col("delta") * ds + 0.5 * F.col("gamma") * ds * ds, 4).alias("explained"))


@query("WITH c AS (SELECT 0.9 + l_discount * 2 AS m, l_linenumber AS expiry, 0.15 + l_tax * 2 AS v FROM lineitem) SELECT CAST(expiry AS BIGINT) AS expiry, round(avg(CASE WHEN m < 0.95 THEN v END) - avg(CASE WHEN m > 1.05 THEN v END), 6) AS skew, round(avg(v), 6) AS level FROM c GROUP BY 1")
def a52_skew_term_structure(spark, d):
    c = table(spark, d, "lineitem").select((0.9 + F.col("l_discount") * 2).alias("m"), F.col("l_linenumber").cast("long").alias("expiry"), (0.15 + F.col("l_tax") * 2).alias("v"))
    return c.groupBy("expiry").agg(rounded(F.avg(F.when(F.col("m") < 0.95, F.col("v"))) - F.avg(F.when(F.col("m") > 1.05, F.col("v")))).alias("skew"), rounded(F.avg("v")).alias("level"))


@query("SELECT l_orderkey, l_linenumber, round(0.9 + l_discount * 2, 6) AS moneyness, CASE WHEN l_linenumber <= 1 THEN 'near' WHEN l_linenumber <= 4 THEN 'mid' ELSE 'far' END AS bucket FROM lineitem")
def f16_moneyness(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(0.9 + F.col("l_discount") * 2).alias("moneyness"), F.when(n <= 1, "near").when(n <= 4, "mid").otherwise("far").alias("bucket"))


@query(f"WITH {RETURNS}, k AS (SELECT date, ticker, stddev_samp(r) OVER {_rows(13)} * sqrt(52) AS rv, stddev_samp(r) OVER {_rows(52)} * sqrt(52) AS iv, count(r) OVER {_rows(13)} AS n FROM rets) SELECT {_DATE}, ticker, round(iv - rv, 5) AS premium, round(iv / nullif(rv, 0), 5) AS ratio FROM k WHERE n >= 10")
def f18_variance_premium(spark, d):
    s, w = frame("ticker", 13), frame("ticker", 52)
    k = returns(spark, d).withColumns({"rv": F.stddev_samp("r").over(s) * F.sqrt(F.lit(52)), "iv": F.stddev_samp("r").over(w) * F.sqrt(F.lit(52)), "n": F.count("r").over(s)}).where("n >= 10")
    return k.select(day("date").alias("date"), "ticker", rounded(F.col("iv") - F.col("rv"), 5).alias("premium"), rounded(F.try_divide("iv", "rv"), 5).alias("ratio"))


@query(f"WITH {MARKET}, s AS (SELECT ticker, stddev_samp(r) AS sd, sum(volume) AS v FROM j GROUP BY 1), w AS (SELECT sd, v / (SELECT sum(v) FROM s) AS w FROM s), i AS (SELECT var_samp(m) AS x FROM (SELECT date, avg(m) AS m FROM j GROUP BY 1)) SELECT round(least(greatest((any_value(x) - sum(w * w * sd * sd)) / (pow(sum(w * sd), 2) - sum(w * w * sd * sd)), -1), 1), 5) AS implied FROM w, i")
def f19_implied_correlation(spark, d):
    """From sums: twice the sum over pairs is the square of the sum less the sum of squares."""
    s = market(spark, d).groupBy("ticker").agg(F.stddev_samp("r").alias("sd"), F.sum("volume").alias("v"))
    x = _market_series(spark, d).agg(F.var_samp("m").alias("x"))  # one row
    own = F.sum(F.expr("v * v * sd * sd")) / (F.sum("v") * F.sum("v"))
    all_ = F.pow(F.sum(F.expr("v * sd")) / F.sum("v"), F.lit(2))
    return s.join(F.broadcast(x)).agg(rounded(clip((F.first("x") - own) / (all_ - own), -1.0, 1.0), 5).alias("implied"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + least(0.1 * 0.02 * sqrt(l_quantity / 50), 0.01) + greatest(l_quantity - 45, 0) * 0.0001), 2) AS price FROM lineitem")
def f20_impact_price(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(F.col("l_extendedprice") * (1 + F.least(0.1 * 0.02 * F.sqrt(q / 50), F.lit(0.01)) + F.greatest(q - 45, F.lit(0)) * 0.0001), 2).alias("price"))


_DCF = " + ".join(f"cash * pow(1.08, {i}) / pow(1.11, {i})" for i in range(1, 6))


@query(f"WITH {_YEARS} SELECT ticker, y, round({_DCF} + cash * pow(1.08, 5) * 1.03 / (0.11 - 0.03) / pow(1.11, 5), 5) AS dcf, round(assets + (income - 0.11 * assets) / (0.11 - 0.02), 5) AS residual, round(income * 0.4 * 1.04 / (0.11 - 0.04), 5) AS dividends FROM f")
def f21_intrinsic_values(spark, d):
    return statements(spark, d).select("ticker", "y", rounded(F.expr(f"{_DCF} + cash * pow(1.08, 5) * 1.03D / (0.11D - 0.03D) / pow(1.11, 5)"), 5).alias("dcf"), rounded(F.expr("assets + (income - 0.11D * assets) / (0.11D - 0.02D)"), 5).alias("residual"), rounded(F.expr("income * 0.4D * 1.04D / (0.11D - 0.04D)"), 5).alias("dividends"))


@query(f"WITH {_YEARS} SELECT ticker, y, round(8 * cash - debt * 100 + income, 5) AS deal, round((8 * cash * pow(1.05, 5) - debt * 60) / pow(1.2, 5), 5) AS buyout FROM f")
def f22_transaction_values(spark, d):
    return statements(spark, d).select("ticker", "y", rounded(F.expr("8 * cash - debt * 100 + income"), 5).alias("deal"), rounded(F.expr("(8 * cash * pow(1.05, 5) - debt * 60) / pow(1.2, 5)"), 5).alias("buyout"))


@query(f"WITH {_YEARS} SELECT ticker, y, round(0.3 * least(revenue / assets * 10, 100) + 0.25 * least(greatest((revenue / p_revenue - 0.5) * 100, 0), 100) + 0.2 * least(greatest(income / revenue * 1000, 0), 100) + 0.25 * (100 - least(debt / shares, 100)), 5) AS score FROM f WHERE p_revenue IS NOT NULL")
def f23_score_components(spark, d):
    e = "0.3D * least(revenue / assets * 10, 100D) + 0.25D * least(greatest((revenue / p_revenue - 0.5D) * 100, 0D), 100D) + 0.2D * least(greatest(income / revenue * 1000, 0D), 100D) + 0.25D * (100 - least(debt / shares, 100D))"
    return statements(spark, d).where("p_revenue is not null").select("ticker", "y", rounded(F.expr(e), 5).alias("score"))


_ROLE = "CASE WHEN revenue > p_revenue AND income > p_income THEN 'leader' WHEN revenue > p_revenue THEN 'grower' WHEN income > p_income THEN 'saver' ELSE 'laggard' END"


@query(f"WITH {_YEARS} SELECT ticker, y, {_ROLE} AS role FROM f WHERE p_revenue IS NOT NULL")
def f24_rule_classes(spark, d):
    return statements(spark, d).where("p_revenue is not null").select("ticker", "y", F.expr(_ROLE).alias("role"))


@query(f"WITH {MARKET}, s AS (SELECT date, stddev_samp(r) AS a, avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END) AS b, -avg(r) AS c FROM j GROUP BY 1) SELECT {_DATE}, round(0.4 * coalesce((a - avg(a) OVER w) / nullif(stddev_samp(a) OVER w, 0), 0) + 0.35 * coalesce((b - avg(b) OVER w) / nullif(stddev_samp(b) OVER w, 0), 0) + 0.25 * coalesce((c - avg(c) OVER w) / nullif(stddev_samp(c) OVER w, 0), 0), 5) AS stress FROM s WINDOW w AS (ORDER BY date)")
def f25_stress_score(spark, d):
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # over one series, a row a week
    s = returns(spark, d).where("r is not null").groupBy("date").agg(F.stddev_samp("r").alias("a"), F.avg(F.when(F.col("r") < 0, 1.0).otherwise(0.0)).alias("b"), (-F.avg("r")).alias("c"))
    z = {c: F.coalesce(zscore(F.col(c), w), F.lit(0.0)) for c in "abc"}
    return s.select(day("date").alias("date"), rounded(0.4 * z["a"] + 0.35 * z["b"] + 0.25 * z["c"], 5).alias("stress"))


@query(f"WITH {_YEARS} SELECT ticker, y, round(income * 0.75 / (assets - debt), 6) AS roic, round(income / nullif(assets - debt * 10, 0), 6) AS roe, round(cash / nullif(income, 0), 5) AS conversion FROM f")
def f28_adjusted_metrics(spark, d):
    return statements(spark, d).select("ticker", "y", rounded(F.expr("income * 0.75D / (assets - debt)")).alias("roic"), rounded(F.expr("try_divide(income, assets - debt * 10)")).alias("roe"), rounded(F.expr("try_divide(cash, income)"), 5).alias("conversion"))


@query(f"WITH {_YEARS} SELECT ticker, y, round((cash / revenue) / (p_cash / p_revenue), 6) AS dsri, round(revenue / p_revenue, 6) AS sgi, round((debt / assets) / (p_debt / p_assets), 6) AS lvgi, CAST((cash / revenue) / (p_cash / p_revenue) > 1.1 AS INTEGER) + CAST(revenue / p_revenue > 1.5 AS INTEGER) AS flags FROM f WHERE p_revenue IS NOT NULL")
def f29_forensic_indices(spark, d):
    dsri, sgi, lvgi = F.expr("(cash / revenue) / (p_cash / p_revenue)"), F.expr("revenue / p_revenue"), F.expr("(debt / assets) / (p_debt / p_assets)")
    return statements(spark, d).where("p_revenue is not null").select("ticker", "y", rounded(dsri).alias("dsri"), rounded(sgi).alias("sgi"), rounded(lvgi).alias("lvgi"), ((dsri > 1.1).cast("int") + (sgi > 1.5).cast("int")).alias("flags"))


@query(f"WITH {_YEARS} SELECT ticker, y, round(income + CASE WHEN {_SECTOR} = 0 THEN 0.1 * debt WHEN {_SECTOR} = 1 THEN -0.05 * cash ELSE 0 END, 4) AS income FROM f")
def f30_normalized_financials(spark, d):
    extra = F.when(sector() == 0, 0.1 * F.col("debt")).when(sector() == 1, -0.05 * F.col("cash")).otherwise(0.0)
    return statements(spark, d).select("ticker", "y", rounded(F.col("income") + extra, 4).alias("income"))
