"""Recursive smoothing, technical indicators and order statistics over the weekly panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import by, change, clip, frame, guarded, since
from ..operators.scans import exponential, numbered_values, recursive, span, wilder
from ..operators.sliding import sliding_order
from ..sources.tables import bars, table
from .registry import BARS, RETURNS, day, query, rounded
from .windows import returns

_DATE = "CAST(date AS VARCHAR) AS date"
_W = "(PARTITION BY ticker ORDER BY date)"
HALF_LIFE = 30
_ALPHA = 1 - math.exp(-math.log(2) / HALF_LIFE)


def _rows(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def _out(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(day("date").alias("date"), "ticker", *(rounded(n, digits).alias(n) for n in names))


#: Rows numbered within tickers, and each met with all rows up to it: sums of weights of age are the recursions written out.
_N = "nb AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars)"


def _ema_sql(x: str, alpha: float) -> str:
    """Of rows a up to row b: the first counts whole, the others by alpha."""
    return f"sum({x} * pow({1 - alpha!r}, b.n - a.n) * CASE WHEN a.n = 1 THEN 1 ELSE {alpha!r} END)"


def _span_sql(x: str, n: int) -> str:
    return _ema_sql(x, 2 / (n + 1))


def _wilder_sql(x: str, n: int, place: str = "n") -> str:
    """The first n rows count 1/n each and age from the nth on."""
    return f"sum(CASE WHEN a.{place} >= 1 THEN {x} / {n}.0 * pow({(n - 1) / n!r}, b.{place} - greatest(a.{place}, {n})) END)"


@query(f"WITH {BARS}, {_N}, e AS (SELECT b.ticker, b.date, b.n, {_span_sql('a.close', 12)} AS e12, {_span_sql('a.close', 26)} AS e26 FROM nb b JOIN nb a ON a.ticker = b.ticker AND a.n <= b.n GROUP BY ALL) SELECT {_DATE}, ticker, CASE WHEN n >= 12 THEN round(e12, 5) END AS ema12, CASE WHEN n >= 26 THEN round(e26, 5) END AS ema26 FROM e")
def w15_moving_average(spark, d):
    """Moving averages by span, null until the span is full."""
    b = bars(spark, d).withColumn("n", numbered_values(F.col("date"), "ticker"))
    e = recursive(b, "ticker", "date", {"ema12": span(F.col("close"), 12), "ema26": span(F.col("close"), 26)})
    return _out(e.withColumns({f"ema{k}": F.when(F.col("n") >= k, F.col(f"ema{k}")) for k in (12, 26)}), "ema12", "ema26", digits=5)


@query(f"WITH {RETURNS}, nb AS (SELECT *, count(r) OVER {_W} AS n FROM rets WHERE r IS NOT NULL), e AS (SELECT b.ticker, b.date, b.n, sum(a.r * a.r * {_ALPHA!r} * pow({1 - _ALPHA!r}, b.n - a.n)) AS s, stddev_samp(a.r) AS sd FROM nb b JOIN nb a ON a.ticker = b.ticker AND a.n <= b.n GROUP BY ALL) SELECT {_DATE}, ticker, round(CASE WHEN n < 10 THEN sd ELSE sqrt(s) END * sqrt(252), 5) AS vol FROM e")
def w16_smoothed_volatility(spark, d):
    """The plain deviation until ten returns are known, then the smoothed one of half-life 30."""
    r = returns(spark, d).where("r is not null").withColumns({"n": numbered_values(F.col("r"), "ticker"), "sd": F.stddev_samp("r").over(since("ticker"))})
    s = recursive(r, "ticker", "date", {"s": (F.lit(1 - _ALPHA), _ALPHA * F.col("r") * F.col("r"), F.lit(0.0))})
    return _out(s.withColumn("vol", F.when(F.col("n") < 10, F.col("sd")).otherwise(F.sqrt("s")) * math.sqrt(252)), "vol", digits=5)


def _moves(b: DataFrame) -> DataFrame:
    """True range, gains, losses and directional moves of each bar; a first bar has its own range and no moves."""
    past = lambda c: F.lag(c).over(by("ticker"))
    close, up, down = past("close"), F.col("high") - past("high"), past("low") - F.col("low")
    move = lambda a, b_: F.when((a > b_) & (a > 0), a).otherwise(0.0)
    return b.withColumns({
        "n": numbered_values(F.col("date"), "ticker"), "tr": F.greatest("high", F.coalesce(close, "high")) - F.least("low", F.coalesce(close, "low")),
        "gain": F.coalesce(F.greatest(F.col("close") - close, F.lit(0.0)), F.lit(0.0)), "fall": F.coalesce(F.greatest(close - F.col("close"), F.lit(0.0)), F.lit(0.0)),
        "up": move(up, down), "down": move(down, up),
    })


_MOVES = f"""{_N}, p AS (SELECT *, lag(close) OVER {_W} AS pc, high - lag(high) OVER {_W} AS u, lag(low) OVER {_W} - low AS v FROM nb),
m AS (SELECT *, greatest(high, coalesce(pc, high)) - least(low, coalesce(pc, low)) AS tr, coalesce(greatest(close - pc, 0), 0) AS gain, coalesce(greatest(pc - close, 0), 0) AS fall, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS up, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS down FROM p)"""


def technical_indicators(b: DataFrame) -> DataFrame:
    """b (date, ticker, close, high, low, volume) with its indicators, each null until its frame is full.

    Moving averages of 20, 50 and 200 rows, MACD (12 less 26), RSI 14 by
    smoothed gains and losses, ATR and ADX 14 by Wilder's averages, ROC 10,
    the width of Bollinger's bands (20 rows, two deviations either way), the
    high of 252 rows and the close's share of it, the volume's share of its
    50-row mean, and whether the averages are in order while ADX is above 20.
    """
    c, w = F.col("close"), frame("ticker", 20)
    full = lambda x, k: F.when(F.col("n") >= k, x)
    m = _moves(b)
    wide = {f"w_{x}": wilder(F.col(x), F.col("n"), 14, "ticker") for x in ("tr", "up", "down")}
    e = recursive(m, "ticker", "date", {**{f"e{k}": span(c, k) for k in (12, 20, 26, 50, 200)}, "rise": exponential(F.col("gain"), 1 / 14), "drop": exponential(F.col("fall"), 1 / 14), **wide})
    e = e.withColumn("dx", full(F.coalesce(100 * F.try_divide(F.abs(F.col("w_up") - F.col("w_down")), F.col("w_up") + F.col("w_down")), F.lit(0.0)), 14))
    e = recursive(e, "ticker", "date", {"adx": wilder(F.col("dx"), F.col("n") - 13, 14, "ticker")})
    e = e.withColumns({
        "ema20": full(F.col("e20"), 20), "ema50": full(F.col("e50"), 50), "ema200": full(F.col("e200"), 200), "macd": full(F.col("e12") - F.col("e26"), 26), "adx": full(F.col("adx"), 27),
        "rsi": full(F.when(F.col("drop") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("rise"), F.col("drop")))), 14), "roc": 100 * change(c, "ticker", 10), "atr": full(F.col("w_tr"), 14),
        "bb_width": full(4 * F.stddev_pop(c).over(w) / c, 20), "high_52w": full(F.max(c).over(frame("ticker", 252)), 252), "vol_avg": full(F.avg("volume").over(frame("ticker", 50)), 50),
    })
    in_order = (F.col("ema20") > F.col("ema50")) & (F.col("ema50") > F.col("ema200")) & (F.col("adx") > 20)
    return e.withColumns({"breakout_strength": c / F.col("high_52w"), "volume_surge": F.col("volume") / F.col("vol_avg"), "trend_regime": F.coalesce(in_order, F.lit(False)).cast("int")})


_INDICATORS = {"ema20": 4, "ema50": 4, "ema200": 4, "adx": 4, "rsi": 4, "macd": 4, "roc": 4, "atr": 4, "bb_width": 6, "high_52w": 8, "breakout_strength": 6, "volume_surge": 6}


@query(f"""WITH {BARS}, {_MOVES}, e AS (SELECT b.ticker, b.date, b.n, {', '.join(f"{_span_sql('a.close', k)} AS e{k}" for k in (12, 20, 26, 50, 200))}, {_ema_sql('a.gain', 1 / 14)} AS rise, {_ema_sql('a.fall', 1 / 14)} AS drop,
{', '.join(f"{_wilder_sql('a.' + x, 14)} AS w_{x}" for x in ('tr', 'up', 'down'))} FROM m b JOIN m a ON a.ticker = b.ticker AND a.n <= b.n GROUP BY ALL),
x AS (SELECT ticker, n - 13 AS k, coalesce(100 * abs(w_up - w_down) / nullif(w_up + w_down, 0), 0) AS dx FROM e WHERE n >= 14), y AS (SELECT b.ticker, b.k + 13 AS n, {_wilder_sql('a.dx', 14, 'k')} AS adx FROM x b JOIN x a ON a.ticker = b.ticker AND a.k <= b.k WHERE b.k >= 14 GROUP BY ALL),
f AS (SELECT e.*, close, volume, adx AS a, CASE WHEN e.n >= 20 THEN e20 END AS ema20, CASE WHEN e.n >= 50 THEN e50 END AS ema50, CASE WHEN e.n >= 200 THEN e200 END AS ema200, lag(close, 10) OVER w AS c10, stddev_pop(close) OVER (w ROWS 19 PRECEDING) AS sd, max(close) OVER (w ROWS 251 PRECEDING) AS top, avg(volume) OVER (w ROWS 49 PRECEDING) AS va FROM e JOIN m USING (ticker, date) LEFT JOIN y ON y.ticker = e.ticker AND y.n = e.n WINDOW w AS (PARTITION BY e.ticker ORDER BY date))
SELECT {_DATE}, ticker, round(ema20, 4) AS ema20, round(ema50, 4) AS ema50, round(ema200, 4) AS ema200, round(a, 4) AS adx, CASE WHEN n >= 14 THEN round(CASE WHEN drop = 0 THEN 100 ELSE 100 - 100 / (1 + rise / drop) END, 4) END AS rsi, CASE WHEN n >= 26 THEN round(e12 - e26, 4) END AS macd, round(100 * (close / c10 - 1), 4) AS roc, CASE WHEN n >= 14 THEN round(w_tr, 4) END AS atr,
CASE WHEN n >= 20 THEN round(4 * sd / close, 6) END AS bb_width, CASE WHEN n >= 252 THEN round(top, 8) END AS high_52w, CASE WHEN n >= 252 THEN round(close / top, 6) END AS breakout_strength, CASE WHEN n >= 50 THEN round(volume / va, 6) END AS volume_surge, CAST(coalesce(ema20 > ema50 AND ema50 > ema200 AND a > 20, false) AS INTEGER) AS trend_regime FROM f""")
def w17_indicators(spark, d):
    t = technical_indicators(bars(spark, d))
    return t.select(day("date").alias("date"), "ticker", *(rounded(c, k).alias(c) for c, k in _INDICATORS.items()), "trend_regime")


def _rolling_z(x: Column, rows: int) -> Column:
    w = frame("ticker", rows)
    return guarded((x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-12), x, w, max(5, rows // 3))


_SIMPLE = ("ret1", "ret5", "ret21", "volume_z", "range", "rsi", "atr", "obv_z", "adx", "cci", "mfi", "williams", "stochastic", "from_high")


@query(f"""WITH {BARS}, b AS (SELECT *, lag(close) OVER {_W} AS pc, high - lag(high) OVER {_W} AS hu, lag(low) OVER {_W} - low AS lu, (high + low + close) / 3 AS tp FROM bars),
c AS (SELECT *, lag(tp) OVER {_W} AS pt, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, greatest(hu, 0) AS p0, greatest(lu, 0) AS m0, sum(coalesce(sign(close - pc), 0) * volume) OVER {_W} AS obv FROM b),
s AS (SELECT *, CASE WHEN p0 > m0 THEN p0 ELSE 0 END AS pd, CASE WHEN m0 > CASE WHEN p0 > m0 THEN p0 ELSE 0 END THEN m0 ELSE 0 END AS md, row_number() OVER {_W} AS n, avg(tp) OVER {_rows(14)} AS ta, avg(greatest(close - pc, 0)) OVER {_rows(14)} AS up, avg(greatest(pc - close, 0)) OVER {_rows(14)} AS down FROM c),
t AS (SELECT *, CASE WHEN n >= 14 THEN abs(tp - ta) END AS dev, CASE WHEN n >= 14 THEN sum(tr) OVER v END AS tr14, 100 * sum(pd) OVER v AS ps, 100 * sum(md) OVER v AS ms, sum(CASE WHEN tp > pt THEN tp * volume ELSE 0 END) OVER v AS pf, sum(CASE WHEN tp < pt THEN tp * volume ELSE 0 END) OVER v AS nf, max(high) OVER v AS hh, min(low) OVER v AS ll FROM s WINDOW v AS {_rows(14)}),
u AS (SELECT *, CASE WHEN n >= 14 THEN 100 * abs(ps / (tr14 + 1e-12) - ms / (tr14 + 1e-12)) / (ps / (tr14 + 1e-12) + ms / (tr14 + 1e-12) + 1e-12) END AS dx FROM t)
SELECT {_DATE}, ticker, round(ln(close / pc), 6) AS ret1, round(ln(close / lag(close, 5) OVER {_W}), 6) AS ret5, round(ln(close / lag(close, 21) OVER {_W}), 6) AS ret21, CASE WHEN n >= 7 THEN round((volume - avg(volume) OVER z) / (stddev_samp(volume) OVER z + 1e-12), 6) END AS volume_z, round((high - low) / (close + 1e-12), 6) AS range,
CASE WHEN n >= 15 THEN round(1 - 1 / (1 + up / (down + 1e-12)), 6) END AS rsi, CASE WHEN n >= 14 THEN round(tr14 / 14 / (close + 1e-12), 6) END AS atr, CASE WHEN n >= 7 THEN round((obv - avg(obv) OVER z) / (stddev_samp(obv) OVER z + 1e-12), 6) END AS obv_z, CASE WHEN n >= 27 THEN round(least(greatest(avg(dx) OVER v / 100, 0), 1), 6) END AS adx,
CASE WHEN n >= 27 THEN round(least(greatest((tp - ta) / (0.015 * avg(dev) OVER v + 1e-12), -400), 400) / 100, 6) END AS cci, CASE WHEN n >= 14 THEN round(least(greatest((100 - 100 / (1 + pf / (nf + 1e-12))) / 100, 0), 1), 6) END AS mfi, CASE WHEN n >= 14 THEN round(least(greatest(-(hh - close) / (hh - ll + 1e-12), -1), 0), 6) END AS williams, CASE WHEN n >= 14 THEN round(least(greatest((close - ll) / (hh - ll + 1e-12), 0), 1), 6) END AS stochastic,
CASE WHEN n >= 60 THEN round(close / (max(high) OVER {_rows(252)} + 1e-12), 6) END AS from_high FROM u WINDOW z AS {_rows(21)}, v AS {_rows(14)}""")
def w18_simple_indicators(spark, d):
    """The set by plain means, as row frames alone; each is null until its frame is full."""
    v, tiny, zero = frame("ticker", 14), 1e-12, F.lit(0.0)
    past = lambda c, k=1: F.lag(c, k).over(by("ticker"))
    full = lambda x, k: F.when(F.col("n") >= k, x)
    close, volume = F.col("close"), F.col("volume")
    b = bars(spark, d).withColumn("pc", past("close")).withColumns({"n": numbered_values(F.col("date"), "ticker"), "tp": (F.col("high") + F.col("low") + close) / 3, "p0": F.greatest(F.col("high") - past("high"), zero), "m0": F.greatest(past("low") - F.col("low"), zero)})
    b = b.withColumns({
        "pt": past("tp"), "tr": F.when(F.col("pc").isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc")))),
        "pd": F.when(F.col("p0") > F.col("m0"), F.col("p0")).otherwise(zero), "ch": close - F.col("pc"), "obv": F.sum(F.coalesce(F.signum(close - F.col("pc")), zero) * volume).over(since("ticker")), "ta": F.avg("tp").over(v),
    }).withColumn("md", F.when(F.col("m0") > F.col("pd"), F.col("m0")).otherwise(zero))
    worth = lambda c: F.sum(F.when(c, F.col("tp") * volume).otherwise(zero)).over(v)
    tr14 = F.sum("tr").over(v) + tiny
    plus, minus = 100 * F.sum("pd").over(v) / tr14, 100 * F.sum("md").over(v) / tr14
    hh, ll = F.max("high").over(v), F.min("low").over(v)
    b = b.withColumns({"dev": full(F.abs(F.col("tp") - F.col("ta")), 14), "dx": full(100 * F.abs(plus - minus) / (plus + minus + tiny), 14), "mf": 1 - 1 / (1 + worth(F.col("tp") > F.col("pt")) / (worth(F.col("tp") < F.col("pt")) + tiny))})
    gain, loss = F.avg(F.greatest("ch", zero)).over(v), F.avg(F.greatest(-F.col("ch"), zero)).over(v)
    b = b.withColumns({
        "ret1": F.log(close / F.col("pc")), "ret5": F.log(close / past("close", 5)), "ret21": F.log(close / past("close", 21)), "volume_z": _rolling_z(volume, 21), "range": (F.col("high") - F.col("low")) / (close + tiny),
        "rsi": full(1 - 1 / (1 + gain / (loss + tiny)), 15), "atr": full(F.sum("tr").over(v) / 14 / (close + tiny), 14), "obv_z": _rolling_z(F.col("obv"), 21), "adx": full(clip(F.avg("dx").over(v) / 100, 0.0, 1.0), 27),
        "cci": full(clip((F.col("tp") - F.col("ta")) / (0.015 * F.avg("dev").over(v) + tiny), -400.0, 400.0) / 100, 27), "mfi": full(clip(F.col("mf"), 0.0, 1.0), 14), "williams": full(clip(-(hh - close) / (hh - ll + tiny), -1.0, 0.0), 14),
        "stochastic": full(clip((close - ll) / (hh - ll + tiny), 0.0, 1.0), 14), "from_high": full(close / (F.max("high").over(frame("ticker", 252)) + tiny), 60),
    })
    return _out(b, *_SIMPLE)


@query(f"WITH {BARS}, nb AS (SELECT *, row_number() OVER {_W} AS n FROM bars), l AS (SELECT b.date, b.ticker, any_value(b.close) AS c, count(*) AS k, min(a.close) AS low, max(a.close) AS high, count(*) FILTER (a.close < b.close) AS below FROM nb b JOIN nb a ON a.ticker = b.ticker AND a.n BETWEEN b.n - 251 AND b.n GROUP BY ALL) SELECT {_DATE}, ticker, round(CASE WHEN high > low THEN (c - low) / (high - low) * 100 ELSE 50 END, 6) AS rank, round(100.0 * below / k, 6) AS percentile FROM l WHERE k >= 20")
def w19_range_rank(spark, d):
    """Rank within the range, and exact share below, of 252 rows."""
    w = frame("ticker", 252)
    low, high = F.min("close").over(w), F.max("close").over(w)
    b = bars(spark, d).select("date", "ticker", "close", F.when(high > low, (F.col("close") - low) / (high - low) * 100).otherwise(50.0).alias("rank"))
    return _out(sliding_order(b, "ticker", "date", "close", 252).where("n >= 20").withColumn("percentile", 100.0 * F.col("below") / F.col("n")), "rank", "percentile")


@query(f"WITH {RETURNS}, v AS (SELECT date, ticker, row_number() OVER {_W} AS n, CASE WHEN count(r) OVER {_rows(30)} >= 30 THEN round(stddev_samp(r) OVER {_rows(30)} * sqrt(252), 9) END AS v FROM rets), q AS (SELECT b.date, b.ticker, any_value(b.v) AS v, count(a.v) FILTER (a.v < b.v) * 1.0 / count(a.v) AS p, quantile_cont(a.v, 0.33) AS low, quantile_cont(a.v, 0.66) AS high FROM v b JOIN v a ON a.ticker = b.ticker AND a.n BETWEEN b.n - 251 AND b.n WHERE b.v IS NOT NULL GROUP BY ALL) SELECT {_DATE}, ticker, round(v, 6) AS vol, round(p, 6) AS percentile, CASE WHEN p < 0.33 THEN 'Low' WHEN p < 0.66 THEN 'Normal' ELSE 'High' END AS regime, round(low, 6) AS low, round(high, 6) AS high FROM q")
def w20_volatility_regime(spark, d):
    """Volatility of 30 rows by its share of the last 252 that lie below it, with the trailing tercile bounds."""
    w = frame("ticker", 30)
    v = returns(spark, d).select("date", "ticker", guarded(F.round(F.stddev_samp("r").over(w) * math.sqrt(252), 9), F.col("r"), w, 30).alias("vol"))  # rounded, so that equal ones tie in every engine
    s = sliding_order(v, "ticker", "date", "vol", 252, [0.33, 0.66]).where("vol is not null").withColumn("p", F.col("below") / F.col("n"))
    regime = F.when(F.col("p") < 0.33, "Low").when(F.col("p") < 0.66, "Normal").otherwise("High")
    return s.select(day("date").alias("date"), "ticker", rounded("vol").alias("vol"), rounded("p").alias("percentile"), regime.alias("regime"), rounded(F.col("quantiles")[0]).alias("low"), rounded(F.col("quantiles")[1]).alias("high"))


#: Least mean dollar volume of each tier, scaled to the panel.
TIERS = {"large": 400_000.0, "mid": 300_000.0, "small": 200_000.0}
_ADV = {21: 15, 63: 30, 126: 60}


@query(f"WITH {BARS}, a AS (SELECT date, ticker, {', '.join(f'coalesce(CASE WHEN count(*) OVER {_rows(k)} >= {least} THEN avg(close * volume) OVER {_rows(k)} END, {other}) AS a{k}' for k, least, other in ((21, 15, '0'), (63, 30, 'a21'), (126, 60, 'a63')))}, count(*) OVER {_W} AS n FROM bars) SELECT {_DATE}, ticker, round(a21, 2) AS adv21, round(a63, 2) AS adv63, round(a126, 2) AS adv126, CASE {' '.join(f'WHEN a21 >= {v} THEN {chr(39)}{k}{chr(39)}' for k, v in TIERS.items())} ELSE 'micro' END AS tier FROM a WHERE n >= 10")
def w21_volume_tiers(spark, d):
    """Mean dollar volumes of three frames, each falling back on the shorter one, and the tier of the shortest."""
    worth, cols, last = F.col("close") * F.col("volume"), {}, F.lit(0.0)
    for k, least in _ADV.items():
        last = F.coalesce(guarded(F.avg(worth).over(frame("ticker", k)), worth, frame("ticker", k), least), last)
        cols[f"adv{k}"] = last
    a = bars(spark, d).withColumns(cols).withColumn("n", numbered_values(F.col("date"), "ticker")).where("n >= 10")
    tier = F.lit("micro")
    for name, least in reversed(TIERS.items()):
        tier = F.when(F.col("adv21") >= least, name).otherwise(tier)
    return a.select(day("date").alias("date"), "ticker", *(rounded(c, 2).alias(c) for c in cols), tier.alias("tier"))


@query(f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS dt, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'purchase') AS good, avg(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS k FROM events GROUP BY 1, 2),
e AS (SELECT b.user_id, b.dt, {_span_sql('a.v', 5).replace('.n', '.k')} - {_span_sql('a.v', 20).replace('.n', '.k')} AS m FROM d b JOIN d a ON a.user_id = b.user_id AND a.k <= b.k GROUP BY ALL)
SELECT user_id, CAST(dt AS VARCHAR) AS date, CAST(bad > good AS INTEGER) AS negative, CAST(good > bad AS INTEGER) AS positive, round(avg(v) OVER (w ROWS 4 PRECEDING), 8) AS mean5, round(v - lag(v, 5) OVER w, 8) AS momentum, round(n / avg(n) OVER (w ROWS 19 PRECEDING), 8) AS spike, round(m, 5) AS narrative, coalesce(n - lag(n) OVER w, 0) AS drift FROM d JOIN e USING (user_id, dt) WINDOW w AS (PARTITION BY user_id ORDER BY dt)""")
def x18_news_features(spark, d):
    """A day's flags by what prevails, 5-day mean and change, volume against 20 days, and the gap of two smoothed means."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.count(F.lit(1)).alias("n"), kind("error").alias("bad"), kind("purchase").alias("good"), F.avg("value").alias("v"))
    w = by("user_id", "dt")
    g = g.withColumns({"mean5": F.avg("v").over(w.rowsBetween(-4, 0)), "momentum": F.col("v") - F.lag("v", 5).over(w), "spike": F.col("n") / F.avg("n").over(w.rowsBetween(-19, 0)), "drift": F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0).cast("long"))})
    e = recursive(g, "user_id", "dt", {"fast": span(F.col("v"), 5), "slow": span(F.col("v"), 20)})
    return e.select("user_id", day("dt").alias("date"), (F.col("bad") > F.col("good")).cast("int").alias("negative"), (F.col("good") > F.col("bad")).cast("int").alias("positive"), *(rounded(c, 8).alias(c) for c in ("mean5", "momentum", "spike")), rounded(F.col("fast") - F.col("slow"), 5).alias("narrative"), "drift")
