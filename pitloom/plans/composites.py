"""Features combined: pruning, families, shrunk matrices, components, permutation, leg backtests, event packs, and users' own code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.matrices import decorrelated, first_component, moments, shrunk
from ..functions.plugins import Factor, SeriesWindows, classified, drifting_beta, scored
from ..functions.stats import average_rank, by, change, clip, correlation, forward_change, zscore
from ..operators.joins import asof_join
from ..sources.storage import stored
from ..sources.tables import bars, table, week_ending_friday
from .registry import BARS, RETURNS, day, query, rounded
from .research import _SECTOR, sector
from .windows import returns

_DATE = "CAST(date AS VARCHAR) AS date"
FEATURES = ["reversal", "spread", "volume", "top", "bottom"]
_WIDE = RETURNS + """, f AS (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd, -r AS reversal, (high - low) / close AS spread, high / close AS top, low / close AS bottom FROM rets)"""
_RANKED = _WIDE + ", u AS (" + " UNION ALL ".join(f"SELECT date, ticker, fwd, '{x}' AS feature, {x} AS x FROM f" for x in FEATURES) + """),
k AS (SELECT *, rank() OVER (PARTITION BY date, feature ORDER BY x) + (count(*) OVER (PARTITION BY date, feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, feature ORDER BY fwd) + (count(*) OVER (PARTITION BY date, feature, fwd) - 1) / 2.0 AS b FROM u WHERE x IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT date, feature, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 10)"""
_PRUNED = _RANKED + """, pairs AS (SELECT l.feature AS a, r.feature AS b FROM k l JOIN k r ON l.date = r.date AND l.ticker = r.ticker AND l.feature < r.feature GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(covar_samp(l.a, r.a) / nullif(stddev_samp(l.a) * stddev_samp(r.a), 0)) >= 0.5),
h AS (SELECT coalesce(list(e), []) AS close FROM (SELECT a || '|' || b AS e FROM pairs UNION ALL SELECT b || '|' || a FROM pairs)),
o AS (SELECT list(feature ORDER BY abs(s) DESC, feature) AS fs FROM (SELECT feature, avg(ic) AS s FROM ic GROUP BY 1)),
g AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT i + 1, CASE WHEN len(list_filter(kept, lambda x: list_contains(close, fs[i + 1] || '|' || x))) > 0 THEN kept ELSE list_append(kept, fs[i + 1]) END FROM g, o, h WHERE i < len(fs)),
keep AS (SELECT arg_max(kept, i) AS kept FROM g)"""


def features(spark, d) -> DataFrame:
    """The panel with five features and the next week's return."""
    hi, lo, c = F.col("high"), F.col("low"), F.col("close")
    return returns(spark, d).withColumns({"fwd": forward_change(c, "ticker"), "reversal": -F.col("r"), "spread": (hi - lo) / c, "top": hi / c, "bottom": lo / c})


def ranked(spark, d) -> DataFrame:
    u = features(spark, d).unpivot(["date", "ticker", "fwd"], FEATURES, "feature", "x").where("x is not null and fwd is not null")
    return u.withColumns({"a": average_rank(F.col("x"), "date", "feature"), "b": average_rank(F.col("fwd"), "date", "feature")})


def weekly_ic(k: DataFrame, *keys: str) -> DataFrame:
    return k.groupBy("date", *keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("a"), F.col("b")).alias("ic")).where("n >= 10").drop("n")


def pruned(k: DataFrame, ic: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row (fs, close, kept): features by falling |mean IC|, pairs whose ranks correlate, and those kept greedily. Features are few and fixed."""
    each = k.groupBy("date", "ticker").agg(F.collect_list(F.struct("feature", "a")).alias("each"))
    p = each.select(F.explode("each").alias("l"), "each").select("l", F.explode("each").alias("r")).where("l.feature < r.feature")
    p = p.groupBy(F.col("l.feature").alias("a"), F.col("r.feature").alias("b")).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("l.a"), F.col("r.a")).alias("c")).where((F.col("n") >= 20) & (F.abs("c") >= threshold))
    h = p.select(F.explode(F.array(F.concat_ws("|", "a", "b"), F.concat_ws("|", "b", "a"))).alias("e")).agg(F.collect_list("e").alias("close"))
    o = ic.groupBy("feature").agg(F.avg("ic").alias("s")).agg(F.sort_array(F.collect_list(F.struct((-F.abs("s")).alias("s"), "feature"))).alias("o")).select(F.col("o.feature").alias("fs"))
    near = lambda f, x: F.array_contains("close", F.concat_ws("|", f, x))
    kept = F.aggregate("fs", F.array().cast("array<string>"), lambda acc, f: F.when(F.exists(acc, lambda x: near(f, x)), acc).otherwise(F.concat(acc, F.array(f))))
    return o.join(F.broadcast(h)).withColumn("kept", kept)


@query(f"WITH RECURSIVE {_PRUNED}, e AS (SELECT unnest(fs) AS feature, unnest(range(1, len(fs) + 1)) AS place FROM o) SELECT feature, CAST(place AS BIGINT) AS place, CAST(list_contains(kept, feature) AS INTEGER) AS kept, CASE WHEN NOT list_contains(kept, feature) THEN list_filter(kept, lambda x: list_contains(close, feature || '|' || x))[1] END AS dropped_by FROM e, keep, h")
def a40_pruned_features(spark, d):
    """Correlations of ranks within dates, over all rows."""
    k = ranked(spark, d)
    p = pruned(k, weekly_ic(k, "feature")).select("close", "kept", F.posexplode("fs").alias("i", "feature"))
    rival = F.filter("kept", lambda x: F.array_contains("close", F.concat_ws("|", "feature", x)))
    inside = F.array_contains("kept", F.col("feature"))
    return p.select("feature", (F.col("i") + 1).cast("long").alias("place"), inside.cast("int").alias("kept"), F.when(~inside, F.get(rival, F.lit(0))).alias("dropped_by"))


@query(f"""WITH {_RANKED}, i AS (SELECT CAST(year(date) AS BIGINT) AS w, feature, abs(avg(ic)) AS x FROM ic GROUP BY 1, 2),
t AS (SELECT *, rank() OVER (PARTITION BY w ORDER BY x) AS k, row_number() OVER (PARTITION BY w ORDER BY x DESC, feature) <= 2 AS best FROM i)
SELECT 'pair' AS kind, CAST(l.w AS VARCHAR) AS a, CAST(r.w AS VARCHAR) AS b, round(corr(l.k, r.k), 6) AS first, round(sum(CASE WHEN l.best AND r.best THEN 1.0 ELSE 0 END) / sum(CASE WHEN l.best OR r.best THEN 1 ELSE 0 END), 6) AS second FROM t l JOIN t r ON l.feature = r.feature AND l.w < r.w GROUP BY l.w, r.w
UNION ALL SELECT 'feature', feature, NULL, round(stddev_samp(x) / avg(x), 6), round(avg(x), 6) FROM i GROUP BY feature""")
def a43_importance_stability(spark, d):
    """Years' importances (|mean IC|): rank correlation and Jaccard of the best two for pairs of years; variation and mean for features."""
    i = weekly_ic(ranked(spark, d), "feature").groupBy(F.year("date").cast("string").alias("w"), "feature").agg(F.abs(F.avg("ic")).alias("x"))
    best = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("x"), "feature")) <= 2
    t = i.withColumns({"k": F.rank().over(Window.partitionBy("w").orderBy("x")), "best": best})
    side = lambda s: t.select("feature", F.col("w").alias(s), F.col("k").alias(f"k{s}"), F.col("best").alias(f"best{s}"))
    p = side("a").join(side("b"), "feature").where("a < b").groupBy("a", "b").agg(
        rounded(F.corr("ka", "kb")).alias("first"), rounded(F.count_if(F.col("besta") & F.col("bestb")) / F.count_if(F.col("besta") | F.col("bestb"))).alias("second"))
    e = i.groupBy(F.col("feature").alias("a")).agg(rounded(F.stddev_samp("x") / F.avg("x")).alias("first"), rounded(F.avg("x")).alias("second"))
    return p.select(F.lit("pair").alias("kind"), "a", "b", "first", "second").unionByName(e.select(F.lit("feature").alias("kind"), "a", F.lit(None).cast("string").alias("b"), "first", "second"))


_FAMILY = "CASE WHEN feature IN ('reversal', 'top', 'bottom') THEN 'price' ELSE 'activity' END"


@query(f"""WITH RECURSIVE {_PRUNED}, m AS (SELECT *, avg(ic) OVER (PARTITION BY feature) AS mean FROM ic),
s AS (SELECT feature, {_FAMILY} AS family, sign(avg(ic)) * (avg(CASE WHEN sign(ic) = sign(mean) THEN 1.0 ELSE 0 END) + abs(avg(ic) / stddev_samp(ic)) + abs(avg(ic))) AS w FROM m, keep WHERE list_contains(kept, feature) GROUP BY 1),
w AS (SELECT feature, family, w / sum(abs(w)) OVER (PARTITION BY family) AS w FROM s),
z AS (SELECT date, ticker, fwd, feature, (x - avg(x) OVER p) / nullif(stddev_samp(x) OVER p, 0) AS z FROM k WINDOW p AS (PARTITION BY date, feature)),
c AS (SELECT date, ticker, family, max(fwd) AS fwd, round(sum(w * z), 9) AS v FROM z JOIN w USING (feature) GROUP BY 1, 2, 3),
q AS (SELECT *, least(greatest((v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0), -6), 6) AS score FROM c WINDOW p AS (PARTITION BY date, family)),
r AS (SELECT *, rank() OVER (PARTITION BY date, family ORDER BY score) AS a, rank() OVER (PARTITION BY date, family ORDER BY fwd) AS b, count(*) OVER (PARTITION BY date, family) AS n FROM q WHERE score IS NOT NULL),
y AS (SELECT date, family, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic, avg(CASE WHEN a > 0.8 * n THEN fwd END) - avg(CASE WHEN a <= 0.2 * n THEN fwd END) AS spread FROM r GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT family, count(*) AS weeks, round(avg(ic), 6) AS ic, round(avg(ic) / stddev_samp(ic), 5) AS ir, round(avg(spread), 6) AS spread FROM y GROUP BY 1""")
def x14_families(spark, d):
    """Features that pruning keeps, weighted by sign(mean IC) times stability, ratio and size of the IC, summed by family and scored by date; sums are rounded, so that equal ones tie."""
    k = ranked(spark, d)
    ic = weekly_ic(k, "feature")
    m = ic.withColumn("mean", F.avg("ic").over(Window.partitionBy("feature")))
    same = F.avg(F.when(F.signum("ic") == F.signum("mean"), 1.0).otherwise(0.0))
    s = m.groupBy("feature").agg((F.signum(F.avg("ic")) * (same + F.abs(F.avg("ic") / F.stddev_samp("ic")) + F.abs(F.avg("ic")))).alias("w"))
    w = s.join(pruned(k, ic).select(F.explode("kept").alias("feature")), "feature").withColumn("family", F.expr(_FAMILY))
    w = w.withColumn("w", F.col("w") / F.sum(F.abs("w")).over(Window.partitionBy("family")))
    c = k.withColumn("z", zscore(F.col("x"), Window.partitionBy("date", "feature"))).join(w, "feature").groupBy("date", "ticker", "family").agg(F.max("fwd").alias("fwd"), F.round(F.sum(F.col("w") * F.col("z")), 9).alias("v"))
    q = c.withColumn("score", clip(zscore(F.col("v"), Window.partitionBy("date", "family")), -6.0, 6.0)).where("score is not null")
    place = lambda x: F.rank().over(Window.partitionBy("date", "family").orderBy(x))
    r = q.withColumns({"a": place("score"), "b": place("fwd"), "n": F.count(F.lit(1)).over(Window.partitionBy("date", "family"))})
    spread = F.avg(F.when(F.col("a") > 0.8 * F.col("n"), F.col("fwd"))) - F.avg(F.when(F.col("a") <= 0.2 * F.col("n"), F.col("fwd")))
    y = r.groupBy("date", "family").agg(F.count(F.lit(1)).alias("size"), correlation(F.col("a"), F.col("b")).alias("ic"), spread.alias("spread")).where("size >= 10")
    return y.groupBy("family").agg(F.count(F.lit(1)).alias("weeks"), rounded(F.avg("ic")).alias("ic"), rounded(F.avg("ic") / F.stddev_samp("ic"), 5).alias("ir"), rounded(F.avg("spread")).alias("spread"))


_SECTORS = [f"s{i}" for i in range(5)]
_SECTOR_RETURNS = RETURNS + f", v AS (SELECT date, {', '.join(f'avg(CASE WHEN {_SECTOR} = {i} THEN r END) AS s{i}' for i in range(5))} FROM rets GROUP BY 1), whole AS (SELECT * FROM v WHERE {' AND '.join(f'{s} IS NOT NULL' for s in _SECTORS)})"


def sector_returns(spark, d) -> DataFrame:
    """Weeks in which all sectors have a return."""
    v = returns(spark, d).groupBy("date").agg(*(F.avg(F.when(sector() == i, F.col("r"))).alias(s) for i, s in enumerate(_SECTORS)))
    return v.dropna(subset=_SECTORS)


@query(f"WITH {_SECTOR_RETURNS}, c AS ({' UNION ALL '.join(f'SELECT {i!r} AS a, {j!r} AS b, covar_samp({i}, {j}) AS c FROM whole' for i in _SECTORS for j in _SECTORS)}), t AS (SELECT *, sum(CASE WHEN a = b THEN c END) OVER () / 5 AS mu FROM c), l AS (SELECT *, CASE WHEN a = b THEN mu ELSE 0 END AS target FROM t), s AS (SELECT *, least(greatest(sum((c - target) ^ 2) OVER () / (sum(c * c) OVER () + 1e-12), 0.2), 0.6) AS share FROM l) SELECT a, b, round((1 - share) * c + share * target, 8) AS cov, round(share, 5) AS share FROM s")
def a51_shrunk_covariance(spark, d):
    """The SQL leaves the eigenvalue floor out; with mean variances over 5e-4 it never binds."""
    def work(s: np.ndarray) -> dict:
        m, share = shrunk(s)
        return {"cov": m, "share": [share]}

    m = moments(sector_returns(spark, d), _SECTORS, F.covar_samp, work, "cov array<double>, share array<double>")
    e = m.select(F.posexplode("cov").alias("i", "cov"), F.col("share")[0].alias("share"))
    return e.select(F.concat(F.lit("s"), (F.col("i") / 5).cast("int")).alias("a"), F.concat(F.lit("s"), F.col("i") % 5).alias("b"), rounded("cov", 8).alias("cov"), rounded("share", 5).alias("share"))


_THREE = ["reversal", "spread", "volume"]
_BASE = np.array([0.5, 0.3, 0.2])
_WHOLE = _WIDE + ", whole AS (SELECT * FROM f WHERE reversal IS NOT NULL)"


@query(f"""WITH {_WHOLE}, c AS (SELECT 0.85 * corr(reversal, spread) AS p, 0.85 * corr(reversal, volume) AS q, 0.85 * corr(spread, volume) AS s FROM whole),
a AS (SELECT 0.5 * (1 - s * s) + 0.3 * (q * s - p) + 0.2 * (p * s - q) AS x, 0.5 * (q * s - p) + 0.3 * (1 - q * q) + 0.2 * (p * q - s) AS y, 0.5 * (p * s - q) + 0.3 * (p * q - s) + 0.2 * (1 - p * p) AS z FROM c),
w AS (SELECT x / (abs(x) + abs(y) + abs(z)) AS w0, y / (abs(x) + abs(y) + abs(z)) AS w1, z / (abs(x) + abs(y) + abs(z)) AS w2 FROM a),
m AS (SELECT date, avg(reversal) AS reversal, avg(spread) AS spread, avg(volume) AS volume FROM whole GROUP BY 1),
t AS (SELECT date, {', '.join(f'({x} - avg({x}) OVER b) / CASE WHEN count({x}) OVER b >= 12 THEN nullif(stddev_samp({x}) OVER b, 0) END AS {x}' for x in _THREE)} FROM m WINDOW b AS (ORDER BY date ROWS 51 PRECEDING)),
s AS (SELECT date, w0, w1, w2, w0 * reversal + w1 * spread + w2 * volume AS score FROM t, w)
SELECT {_DATE}, round(w0, 6) AS w_reversal, round(w1, 6) AS w_spread, round(w2, 6) AS w_volume, round(score, 5) AS score, round(score - lag(score, 4) OVER (ORDER BY date), 5) AS momentum FROM s""")
def x33_decorrelated_score(spark, d):
    """The market's means of three features, z-scored over a year (one row a week), under weights solved against their correlation."""
    whole = features(spark, d).where("reversal is not null")
    w = moments(whole, _THREE, correlation_or_one, lambda c: {"w": decorrelated(c, _BASE)}, "w array<double>")
    m = whole.groupBy("date").agg(*(F.avg(x).alias(x) for x in _THREE))
    week = Window.orderBy("date")
    back = week.rowsBetween(-51, 0)
    t = m.select("date", *(F.when(F.count(x).over(back) >= 12, zscore(F.col(x), back)).alias(x) for x in _THREE)).join(F.broadcast(w))
    s = t.withColumn("score", F.col("w")[0] * F.col("reversal") + F.col("w")[1] * F.col("spread") + F.col("w")[2] * F.col("volume"))
    return s.select(day("date").alias("date"), *(rounded(F.col("w")[i]).alias(f"w_{x}") for i, x in enumerate(_THREE)), rounded("score", 5).alias("score"), rounded(F.col("score") - F.lag("score", 4).over(week), 5).alias("momentum"))


def correlation_or_one(a: str, b: str):
    return F.lit(1.0) + F.lit(0) * F.count(F.lit(1)) if a == b else correlation(F.col(a), F.col(b))


#: Power iteration on the correlation of sectors' returns, from equal loadings.
_POWER = _SECTOR_RETURNS + ", c AS (SELECT " + ", ".join(f"corr(s{i}, s{j}) AS c{i}{j}" for i in range(5) for j in range(5)) + " FROM whole), p AS (SELECT 0 AS n, " + ", ".join(f"CAST({1 - i / 10} AS DOUBLE) AS v{i}" for i in range(5)) + " UNION ALL SELECT n + 1, " + ", ".join(f"u{i} / sqrt({' + '.join(f'u{j} * u{j}' for j in range(5))})" for i in range(5)) + " FROM (SELECT n, " + ", ".join(" + ".join(f"c{i}{j} * v{j}" for j in range(5)) + f" AS u{i}" for i in range(5)) + " FROM p, c WHERE n < 4000)), e AS (SELECT " + ", ".join(f"v{i} * sign(abs_sum) AS v{i}" for i in range(5)) + " FROM (SELECT *, list_extract(list_sort([" + ", ".join(f"{{'k': -abs(v{i}), 'v': v{i}}}" for i in range(5)) + "]), 1).v AS abs_sum FROM p WHERE n = 4000)), y AS (SELECT date, " + " + ".join(f"v{i} * (s{i} - avg(s{i}) OVER ()) / stddev_samp(s{i}) OVER ()" for i in range(5)) + " AS raw FROM whole, e)"


def component(spark, d) -> DataFrame:
    """Weeks with the first component of the standardised sector returns; its largest loading counts positive."""
    whole = sector_returns(spark, d)
    v = moments(whole, _SECTORS, F.corr, lambda c: {"v": first_component(c)}, "v array<double>")
    scale = whole.agg(*(F.avg(s).alias(f"m{s}") for s in _SECTORS), *(F.stddev_samp(s).alias(f"d{s}") for s in _SECTORS))
    terms = [F.col("v")[i] * (F.col(s) - F.col(f"m{s}")) / F.col(f"d{s}") for i, s in enumerate(_SECTORS)]
    return whole.join(F.broadcast(v)).join(F.broadcast(scale)).select("date", *_SECTORS, sum(terms[1:], terms[0]).alias("raw"))


@query(f"WITH RECURSIVE {_POWER}, a AS (SELECT corr(raw, ({' + '.join(_SECTORS)}) / 5) AS c FROM y JOIN whole USING (date)) SELECT {_DATE}, round(raw * CASE WHEN c < 0 THEN -1 ELSE 1 END, 4) AS factor FROM y, a")
def a49_first_component(spark, d):
    """Oriented to rise with the anchors' mean return."""
    y = component(spark, d)
    c = y.agg(F.corr("raw", sum((F.col(s) for s in _SECTORS[1:]), F.col(_SECTORS[0])) / 5).alias("c"))
    return y.join(F.broadcast(c)).select(day("date").alias("date"), rounded(F.col("raw") * F.when(F.col("c") < 0, -1).otherwise(1), 4).alias("factor"))


@query(f"WITH RECURSIVE {_POWER} SELECT {_DATE}, round(100 * (raw - min(raw) OVER ()) / nullif(max(raw) OVER () - min(raw) OVER (), 0), 3) AS score FROM y")
def a50_component_score(spark, d):
    """From 0 to 100 over the weeks."""
    y = component(spark, d)
    ends = y.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return y.join(F.broadcast(ends)).select(day("date").alias("date"), rounded(F.try_divide(100 * (F.col("raw") - F.col("low")), F.col("high") - F.col("low")), 3).alias("score"))


@query(f"""WITH {_WHOLE}, t AS (SELECT ticker, avg(reversal) * 100 AS x, avg(spread) AS y, avg(volume) / 100 AS z FROM whole GROUP BY 1),
c AS (SELECT var_samp(x) + 1e-6 AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS c, var_samp(y) + 1e-6 AS d, covar_samp(y, z) AS e, var_samp(z) + 1e-6 AS f FROM t),
i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c),
p AS (SELECT l.ticker AS a_ticker, r.ticker AS b_ticker, l.x - r.x AS x, l.y - r.y AS y, l.z - r.z AS z FROM t l JOIN t r ON {_SECTOR.replace('ticker', 'l.ticker')} = {_SECTOR.replace('ticker', 'r.ticker')} AND l.ticker < r.ticker)
SELECT a_ticker, b_ticker, round(sqrt(greatest(0, (x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * (x * y * (c * e - b * f) + x * z * (b * e - c * d) + y * z * (b * c - a * e))) / det)), 5) AS distance FROM p, i""")
def j14_mahalanobis(spark, d):
    """Pairs within a sector, so that the join is an equi join; the covariance is of all series, with a ridge of 1e-6."""
    t = features(spark, d).where("reversal is not null").groupBy("ticker").agg((F.avg("reversal") * 100).alias("x"), F.avg("spread").alias("y"), (F.avg("volume") / 100).alias("z"))
    inverse = moments(t, ["x", "y", "z"], F.covar_samp, lambda c: {"m": np.linalg.pinv(c + 1e-6 * np.eye(3))}, "m array<double>")
    v = t.select("ticker", sector().alias("s"), F.array("x", "y", "z").alias("v"))
    p = v.withColumnsRenamed({"ticker": "a_ticker", "v": "va"}).join(v.withColumnsRenamed({"ticker": "b_ticker", "v": "vb"}), "s").where("a_ticker < b_ticker").join(F.broadcast(inverse))
    diff = F.zip_with("va", "vb", lambda a, b: a - b)
    form = F.aggregate(F.transform("m", lambda m, i: m * F.get("diff", (i / 3).cast("int")) * F.get("diff", i % 3)), F.lit(0.0), lambda s, x: s + x)
    return p.withColumn("diff", diff).select("a_ticker", "b_ticker", rounded(F.sqrt(F.greatest(F.lit(0.0), form)), 5).alias("distance"))


_ORDER = "md5(rep || '|' || date || '|' || ticker), ticker"


@query(f"""WITH {RETURNS}, f AS (SELECT CAST(date AS VARCHAR) AS date, ticker, r AS x, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS y FROM rets), v AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL),
n AS (SELECT rep, date, x, y, row_number() OVER (PARTITION BY rep, date ORDER BY ticker) AS a, row_number() OVER (PARTITION BY rep, date ORDER BY {_ORDER}) AS b FROM v, range(1, 41) AS t(rep)),
p AS (SELECT l.rep, corr(l.x, r.y) AS c FROM n l JOIN n r ON l.rep = r.rep AND l.date = r.date AND l.a = r.b GROUP BY 1), o AS (SELECT corr(x, y) AS ic FROM v)
SELECT round(ic, 6) AS ic, round(avg(CASE WHEN abs(c) >= abs(ic) THEN 1.0 ELSE 0 END), 6) AS p, round(quantile_cont(c, 0.025), 6) AS low, round(quantile_cont(c, 0.975), 6) AS high, round(stddev_pop(c), 6) AS effect FROM p, o GROUP BY ic""")
def a60_permutation(spark, d):
    """Signals are dealt anew within each date, by a hash of replicate and row, so no sort holds more than a date's rows."""
    v = returns(spark, d).select(day("date").alias("date"), "ticker", F.col("r").alias("x"), forward_change(F.col("close"), "ticker").alias("y")).where("x is not null and y is not null")
    n = v.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))))
    cell = Window.partitionBy("rep", "date")
    n = n.withColumns({"a": F.row_number().over(cell.orderBy("ticker")), "b": F.row_number().over(cell.orderBy(F.md5(F.concat_ws("|", F.col("rep").cast("string"), "date", "ticker")), "ticker"))})
    p = n.select("rep", "date", F.col("a").alias("k"), "x").join(n.select("rep", "date", F.col("b").alias("k"), "y"), ["rep", "date", "k"]).groupBy("rep").agg(F.corr("x", "y").alias("c"))
    o = v.agg(F.corr("x", "y").alias("ic"))
    out = p.join(F.broadcast(o)).groupBy("ic").agg(F.avg(F.when(F.abs("c") >= F.abs("ic"), 1.0).otherwise(0.0)).alias("p"), F.percentile("c", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_pop("c").alias("effect"))
    return out.select(rounded("ic").alias("ic"), rounded("p").alias("p"), rounded(F.col("q")[0]).alias("low"), rounded(F.col("q")[1]).alias("high"), rounded("effect").alias("effect"))


@query(f"""WITH {BARS}, l AS (SELECT o_orderkey AS trade, CAST(CAST(o_orderdate AS DATE) + ((12 - isodow(o_orderdate)) % 7) * INTERVAL 1 DAY AS DATE) AS entry, p_brand AS ticker, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS side, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
x AS (SELECT trade, k AS week, side, q, close FROM l, range(0, 8) AS t(k) JOIN bars b ON b.ticker = l.ticker AND b.date = CAST(l.entry + k * 7 * INTERVAL 1 DAY AS DATE)),
v AS (SELECT trade, week, sum(close * (1 + 0.005 * side) * side * q) AS buy, sum(close * (1 - 0.005 * side) * side * q) AS sell, sum(close * (1 + 0.005 * side) * q) * 0.001 AS fee_in, sum(close * (1 - 0.005 * side) * q) * 0.001 AS fee_out FROM x GROUP BY 1, 2),
n AS (SELECT v.trade, v.week, e.buy AS cost, v.sell - e.buy AS gross, e.fee_in + v.fee_out AS fees FROM v JOIN v e ON e.trade = v.trade AND e.week = 0 WHERE abs(e.buy) > 1e-6),
s AS (SELECT *, (gross - fees) / abs(cost) AS ret FROM n), z AS (SELECT trade, coalesce(min(CASE WHEN ret < -0.3 THEN week END), max(week)) AS week FROM s GROUP BY 1)
SELECT trade, week AS weeks, round(gross, 3) AS gross, round(fees, 3) AS fees, round(gross - fees, 3) AS net FROM s JOIN z USING (trade, week)""")
def a54_leg_backtest(spark, d):
    """Orders as trades, their lines as legs (every second one sold), weekly bars as the chain; a trade ends after eight weeks or in its first week below -30 %.

    A leg takes its eight weeks from one row of the stored chain and a trade's
    weeks are columns of one aggregate, so no row is made for each leg and week.
    """
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trade"), "l_partkey", "l_quantity", F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1).alias("side"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("trade"), week_ending_friday(F.to_date("o_orderdate")).alias("entry"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    legs = lines.join(parts, "l_partkey").join(orders, "trade").groupBy("trade", "entry", "ticker", "side").agg(F.sum("l_quantity").alias("q"))
    weeks = range(8)
    ahead = bars(spark, d).select("ticker", "date", "close", F.explode(F.array(*map(F.lit, weeks))).alias("week")).withColumn("entry", F.expr("date_sub(date, week * 7)"))
    chain = stored(ahead.groupBy("ticker", "entry").agg(F.array(*(F.max(F.when(F.col("week") == k, F.struct("close"))) for k in weeks)).alias("chain")))
    x = legs.join(chain, ["ticker", "entry"]).select("trade", "side", "q", *(F.get("chain", F.lit(k)).alias(f"bar{k}") for k in weeks))
    side, q = F.col("side"), F.col("q")
    buy, sell = (lambda k: F.col(f"bar{k}.close") * (1 + 0.005 * side)), (lambda k: F.col(f"bar{k}.close") * (1 - 0.005 * side))
    v = x.groupBy("trade").agg(
        F.sum(buy(0) * side * q).alias("cost"), (F.sum(buy(0) * q) * 0.001).alias("paid"),
        *(c for k in weeks for c in (F.max(F.col(f"bar{k}").isNotNull()).alias(f"any{k}"), F.sum(sell(k) * side * q).alias(f"sell{k}"), (F.sum(sell(k) * q) * 0.001).alias(f"fee{k}"))))
    each = F.array(*(F.when(F.col(f"any{k}"), F.struct(F.lit(k).alias("week"), (F.col(f"sell{k}") - F.col("cost")).alias("gross"), (F.col("paid") + F.col(f"fee{k}")).alias("fees"))) for k in weeks))
    s = v.where(F.abs("cost") > 1e-6).select("trade", "cost", F.filter(each, lambda w: w.isNotNull()).alias("each"))
    lost = F.filter("each", lambda w: (w["gross"] - w["fees"]) / F.abs("cost") < -0.3)
    e = s.select("trade", F.coalesce(F.get(lost, F.lit(0)), F.element_at("each", -1)).alias("e"))
    return e.select("trade", F.col("e.week").cast("long").alias("weeks"), rounded("e.gross", 3).alias("gross"), rounded("e.fees", 3).alias("fees"), rounded(F.col("e.gross") - F.col("e.fees"), 3).alias("net"))


_SENTIMENT = "s AS (SELECT 'Brand#' || (o_custkey % 25 + 1) AS ticker, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS known, max_by((3 - CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) / 2, o_orderkey) AS mood, max_by(o_totalprice, o_orderkey) AS worth FROM orders GROUP BY 1, 2)"


def sentiment(spark, d) -> DataFrame:
    """Orders read as news: their priority as mood, known on the next day; of one day's the last."""
    o = table(spark, d, "orders").select(
        F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1).alias("ticker"), F.date_add(F.to_date("o_orderdate"), 1).alias("known"), "o_orderkey",
        F.struct(((3 - F.substring("o_orderpriority", 1, 1).cast("double")) / 2).alias("mood"), F.col("o_totalprice").alias("worth")).alias("v"))
    last = o.groupBy("ticker", "known").agg(F.max("o_orderkey").alias("tie"), F.max_by("v", "o_orderkey").alias("v"))
    return last.select("ticker", "known", "tie", "v.mood", "v.worth")


@query(f"""WITH {BARS}, {_SENTIMENT}, f AS (SELECT date, ticker, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM bars),
j AS (SELECT f.date, f.ticker, fwd, mood FROM f ASOF JOIN s ON f.ticker = s.ticker AND f.date >= s.known WHERE fwd IS NOT NULL),
k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY mood) + (count(*) OVER (PARTITION BY date, mood) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS b FROM j),
i AS (SELECT date, count(*) AS n, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM k GROUP BY 1 HAVING count(*) >= 10)
SELECT {_DATE}, round(ic, 6) AS ic, round(avg(ic) OVER (ORDER BY date ROWS 12 PRECEDING), 6) AS quarter FROM i""")
def x19_sentiment_ic(spark, d):
    f = bars(spark, d).select("date", "ticker", forward_change(F.col("close"), "ticker").alias("fwd"))
    j = asof_join(f, sentiment(spark, d), "ticker", "date", "known", ["mood"], "tie", span_days=90).where("fwd is not null and mood is not null")
    i = weekly_ic(j.withColumns({"a": average_rank(F.col("mood"), "date"), "b": average_rank(F.col("fwd"), "date")}))
    return i.select(day("date").alias("date"), rounded("ic").alias("ic"), rounded(F.avg("ic").over(Window.orderBy("date").rowsBetween(-12, 0))).alias("quarter"))


_RETURNED = "b AS (SELECT p_brand AS ticker, CAST(CAST(l_shipdate AS DATE) + INTERVAL 1 DAY AS DATE) AS known, sum(l_quantity) AS back FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"
_PACK = ["mood", "worth", "back"]
_CENTRED = ", ".join(f"round((rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER w - 0.5, 6) * CASE WHEN {x} IS NOT NULL THEN 1 END AS {x}_rank, round(({x} - avg({x}) OVER w) / nullif(stddev_samp({x}) OVER w, 0), 5) AS {x}_z" for x in _PACK)


@query(f"WITH {BARS}, {_SENTIMENT}, {_RETURNED}, j AS (SELECT bars.date, bars.ticker, mood, worth FROM bars ASOF LEFT JOIN s ON bars.ticker = s.ticker AND bars.date >= s.known), p AS (SELECT j.*, back FROM j ASOF LEFT JOIN b ON j.ticker = b.ticker AND j.date >= b.known) SELECT {_DATE}, ticker, {_CENTRED} FROM p WINDOW w AS (PARTITION BY date)")
def x32_event_pack(spark, d):
    """All event families meet the panel in one union and one sort by ticker; then z-score and centred rank by date."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(parts, "l_partkey").groupBy("ticker", F.date_add(F.to_date("l_shipdate"), 1).alias("date")).agg(F.sum("l_quantity").alias("back"))
    rows = sentiment(spark, d).select("ticker", F.col("known").alias("date"), "mood", "worth").unionByName(back, allowMissingColumns=True).withColumn("asked", F.lit(0))
    every = rows.unionByName(bars(spark, d).select("ticker", "date", F.lit(1).alias("asked")), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    p = every.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in _PACK}).where("asked = 1")
    date = Window.partitionBy("date")
    return p.select(day("date").alias("date"), "ticker", *(c for x in _PACK for c in (rounded(average_rank(F.col(x), "date") / F.count(x).over(date) - 0.5).alias(f"{x}_rank"), rounded(zscore(F.col(x), date), 5).alias(f"{x}_z"))))


@query(f"""WITH {BARS}, m AS (SELECT date, avg(close) AS level, sum(volume) AS volume FROM bars GROUP BY 1), x AS (SELECT *, level / lag(level, 4) OVER (ORDER BY date) - 1 AS trend FROM m),
o AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS worth, count(*) AS orders FROM orders GROUP BY 1), t AS (SELECT *, avg(worth) OVER w AS mean5, worth / lag(worth) OVER (ORDER BY date) - 1 AS change FROM o WINDOW w AS (ORDER BY date ROWS 4 PRECEDING))
SELECT CAST(t.date AS VARCHAR) AS date, orders, round(worth, 2) AS worth, round(mean5, 2) AS mean5, round(change, 6) AS change, round(level, 6) AS level, round(trend, 6) AS trend FROM t ASOF LEFT JOIN x ON t.date >= x.date""")
def x22_daily_panel(spark, d):
    """A daily series, its technicals and the latest ended week's market on one calendar; one row a day."""
    m = bars(spark, d).groupBy(F.col("date").alias("week")).agg(F.avg("close").alias("level"))
    x = m.withColumn("trend", F.try_divide(F.col("level"), F.lag("level", 4).over(Window.orderBy("week"))) - 1).withColumn("tie", F.lit(0))
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("worth"), F.count(F.lit(1)).alias("orders"))
    days = Window.orderBy("date")
    t = o.withColumns({"mean5": F.avg("worth").over(days.rowsBetween(-4, 0)), "change": F.col("worth") / F.lag("worth").over(days) - 1})
    j = asof_join(t, x, None, "date", "week", ["level", "trend"], "tie")
    return j.select(day("date").alias("date"), "orders", rounded("worth", 2).alias("worth"), rounded("mean5", 2).alias("mean5"), *(rounded(c).alias(c) for c in ("change", "level", "trend")))


_NAMES = "lower(p_name || ' ' || p_type) AS name FROM part"


@query(f"""WITH n AS (SELECT DISTINCT {_NAMES}), a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2) || ' ' || p_type) AS alias FROM part), nt AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS t FROM n), wa AS (SELECT DISTINCT alias, unnest(string_split(alias, ' ')) AS t FROM a),
c AS (SELECT name, alias, count(*) AS shared FROM nt JOIN wa USING (t) GROUP BY 1, 2),
s AS (SELECT name, alias, greatest(2.0 * shared / (len(list_distinct(string_split(name, ' '))) + len(list_distinct(string_split(alias, ' ')))), 1 - levenshtein(name, alias) / greatest(length(name), length(alias)), CASE WHEN contains(name, alias) OR contains(alias, name) THEN least(length(name), length(alias)) / greatest(length(name), length(alias)) ELSE 0 END) AS score FROM c)
SELECT name, alias, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, alias) = 1""")
def j16_fuzzy_names(spark, d):
    """Candidates share a word; the best by word overlap, edit distance or containment. Names and aliases are distinct lists, words that many share cost most."""
    part = table(spark, d, "part")
    n = part.select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name")).distinct()
    a = part.select(F.lower(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type")).alias("alias")).distinct()
    words = lambda df, c: df.withColumn(f"{c}_words", F.array_distinct(F.split(c, " "))).withColumn("t", F.explode(f"{c}_words"))
    c = words(n, "name").join(words(a, "alias"), "t").drop("t").distinct()
    small, large = F.least(F.length("name"), F.length("alias")), F.greatest(F.length("name"), F.length("alias"))
    overlap = 2.0 * F.size(F.array_intersect("name_words", "alias_words")) / (F.size("name_words") + F.size("alias_words"))
    inside = F.when(F.contains("name", "alias") | F.contains("alias", "name"), small / large).otherwise(0.0)
    s = c.withColumn("score", F.greatest(overlap, 1 - F.levenshtein("name", "alias") / large, inside))
    best = s.groupBy("name").agg(F.min_by(F.struct("alias", "score"), F.struct(-F.round("score", 9), "alias")).alias("b"))
    return best.select("name", "b.alias", rounded("b.score").alias("score"))


class Momentum(Factor):
    """Twelve weeks' change but for the last."""

    def raw(self, panel: DataFrame) -> DataFrame:
        return panel.withColumn("raw", F.try_divide(F.lag("close", 1).over(by("ticker")), F.lag("close", 12).over(by("ticker"))) - 1).where("raw is not null")


@query(f"WITH {BARS}, x AS (SELECT date, ticker, lag(close) OVER w / lag(close, 12) OVER w - 1 AS raw FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)), y AS (SELECT * FROM x WHERE raw IS NOT NULL) SELECT {_DATE}, ticker, round(raw, 6) AS raw, round(CASE WHEN stddev_samp(raw) OVER d > 0 THEN least(greatest((raw - avg(raw) OVER d) / stddev_samp(raw) OVER d, -3), 3) END, 6) AS z, round((rank() OVER (PARTITION BY date ORDER BY raw) + (count(*) OVER (PARTITION BY date, raw) - 1) / 2.0) / count(*) OVER d, 6) AS pct, CAST(CAST(date + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS known FROM y WINDOW d AS (PARTITION BY date)")
def ud1_factor(spark, d):
    out = Momentum().compute(bars(spark, d))
    return out.select(day("date").alias("date"), "ticker", rounded("raw").alias("raw"), rounded("z").alias("z"), rounded("pct").alias("pct"), day("known").alias("known"))


def _stops():
    return lambda texts: 1000.0 * texts.str.count(r"\.") / texts.str.len().clip(lower=1)


@query("SELECT doc_id, round(1000.0 * (length(text) - length(replace(text, '.', ''))) / greatest(length(text), 1), 6) AS score FROM documents")
def ud2_scorer(spark, d):
    """Full stops for each thousand characters, as a stand-in for a model that a task loads once."""
    return scored(table(spark, d, "documents").select("doc_id", "text"), "text", _stops).select("doc_id", rounded("score").alias("score"))


@query(f"""WITH RECURSIVE {RETURNS}, j AS (SELECT date, ticker, r, avg(r) OVER (PARTITION BY date) AS m, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM rets WHERE r IS NOT NULL),
k AS (SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS date, CAST(1 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS p FROM j UNION ALL
SELECT ticker, n, date, b + gain * (r - m * b), q * (1 - gain * m) FROM (SELECT k.ticker, j.n, j.date, j.r, j.m, k.b, k.p + 1e-4 AS q, (k.p + 1e-4) * j.m / (j.m * j.m * (k.p + 1e-4) + 0.01) AS gain FROM k JOIN j ON j.ticker = k.ticker AND j.n = k.n + 1))
SELECT {_DATE}, ticker, round(b, 5) AS beta FROM k WHERE n > 0""")
def ud3_drifting_beta(spark, d):
    """One series for each group; its length, in weeks, bounds the group."""
    j = returns(spark, d).where("r is not null").withColumn("m", F.avg("r").over(Window.partitionBy("date"))).select("ticker", "date", "r", "m")
    out = j.groupBy("ticker").applyInPandas(drifting_beta(), "ticker string, date date, beta double")
    return out.select(day("date").alias("date"), "ticker", rounded("beta", 5).alias("beta"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'overdrawn' WHEN c_acctbal < 1000 AND c_mktsegment = 'BUILDING' THEN 'watch' WHEN c_acctbal > 8000 THEN 'strong' ELSE 'normal' END AS class FROM customer")
def ud4_row_classes(spark, d):
    worth = F.col("c_acctbal")
    rules = [(worth < 0, "overdrawn"), ((worth < 1000) & (F.col("c_mktsegment") == "BUILDING"), "watch"), (worth > 8000, "strong")]
    return table(spark, d, "customer").select("c_custkey", classified(rules, "normal").alias("class"))


@query(f"WITH {BARS}, x AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS place, lag(close, 4) OVER w AS a, lag(close, 3) OVER w AS b, lag(close, 2) OVER w AS c, lag(close) OVER w AS e FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, CAST(place AS INTEGER) AS place, round(a, 6) AS oldest, round((a + b + c + e) / 4, 6) AS mean, round(close, 6) AS target FROM x WHERE place >= 4")
def ud5_series_windows(spark, d):
    """A table function over each ticker's series."""
    series = bars(spark, d).groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("series"))
    w = series.lateralJoin(SeriesWindows(F.col("series").outer(), F.lit(4)))
    mean = F.aggregate("window", F.lit(0.0), lambda s, x: s + x) / F.size("window")
    return w.select("ticker", "place", rounded(F.col("window")[0]).alias("oldest"), rounded(mean).alias("mean"), rounded("target").alias("target"))
