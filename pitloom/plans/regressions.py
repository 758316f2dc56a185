"""Regressions of the panel's returns: several regressors with Newey-West errors, lag choice, Granger tests.

The SQL finds each coefficient another way: the regressor, and the dependent
variable, less what the other regressors explain (Gram-Schmidt), in windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import by
from ..functions.tails import t_tail_sql
from ..operators.regression import by_term, granger, regressions
from .registry import query, rounded
from .research import _SECTOR, MARKET, false_discoveries, market, sector


def _cleared(name: str, source: str, part: str, columns: list[str], steps: int) -> str:
    """CTEs name0 to name{steps}: columns about their means, then those after each of the first `steps` ones less what it explains."""
    window = f"WINDOW w AS (PARTITION BY {part})"
    out = [f"{name}0 AS (SELECT * REPLACE ({', '.join(f'{c} - avg({c}) OVER w AS {c}' for c in columns)}) FROM {source} {window})"]
    for i, c in enumerate(columns[:steps]):
        less = ", ".join(f"{d} - {c} * (sum({c} * {d}) OVER w) / nullif(sum({c} * {c}) OVER w, 0) AS {d}" for d in columns[i + 1 :])
        out.append(f"{name}{i + 1} AS (SELECT * REPLACE ({less}) FROM {name}{i} {window})")
    return ", ".join(out)


def _newey_west(source: str, y: str, xs: list[str], lags: int = 4) -> str:
    """CTEs up to fits (ticker, term, n, beta, se, t, p, r2), of tickers with 30 rows at least."""
    k, others = len(xs), [f"o{i}" for i in range(len(xs) - 1)]
    arms = " UNION ALL ".join(f"SELECT ticker, date, '{x}' AS term, {y} AS y, {y} AS y_all, {x} AS x{''.join(f', {o} AS o{i}' for i, o in enumerate(v for v in xs if v != x))} FROM {source} WHERE {' AND '.join(f'{v} IS NOT NULL' for v in [y, *xs])}" for x in xs)
    products = "".join(f" + {2 * (1 - lag / (lags + 1))} * coalesce(sum(s * s{lag}), 0)" for lag in range(1, lags + 1))
    return f"""arms AS ({arms}), {_cleared('g', 'arms', 'ticker, term', [*others, 'x', 'y', 'y_all'], k - 1)},
sl AS (SELECT ticker, term, date, x, y, sum(x * y) OVER w / sum(x * x) OVER w AS beta FROM g{k - 1} WINDOW w AS (PARTITION BY ticker, term)),
tot AS (SELECT ticker, term, sum(y_all * y_all) AS total FROM g0 GROUP BY 1, 2),
sc AS (SELECT *, x * (y - beta * x) AS s FROM sl), la AS (SELECT *, {', '.join(f'lag(s, {lag}) OVER (PARTITION BY ticker, term ORDER BY date) AS s{lag}' for lag in range(1, lags + 1))} FROM sc),
se AS (SELECT ticker, term, count(*) AS n, any_value(beta) AS beta, sqrt(sum(s * s){products}) / sum(x * x) AS se, sum(pow(y - beta * x, 2)) AS rest FROM la GROUP BY 1, 2),
fits AS (SELECT ticker, term, n, beta, se, least(greatest(beta / se, -50), 50) AS t, 1 - rest / total AS r2 FROM se JOIN tot USING (ticker, term) WHERE n >= 30)"""


_THREE = "d AS (SELECT ticker, date, r, m AS market, lag(r) OVER w AS momentum, lag(m) OVER w AS market_before FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date))"
_XS = ["market", "momentum", "market_before"]


@query(f"WITH {MARKET}, {_THREE}, {_newey_west('d', 'r', _XS)} SELECT ticker, term, n, round(beta, 6) AS beta, round(se, 6) AS se, round(t, 5) AS t, round({t_tail_sql('t', 'n - 4')}, 9) AS p, round(r2, 6) AS r2 FROM fits")
def a30_ols(spark, d) -> DataFrame:
    """Returns on the market's, their own of the week before and the market's of the week before, with errors over four lags."""
    w = by("ticker")
    rows = market(spark, d).select("ticker", "date", "r", F.col("m").alias("market"), F.lag("r").over(w).alias("momentum"), F.lag("m").over(w).alias("market_before"))
    fits = by_term(regressions(rows, ["ticker"], "r", _XS, "date")).where("term <> 'const'")
    return fits.select("ticker", "term", "n", *(rounded(c, n).alias(c) for c, n in (("beta", 6), ("se", 6), ("t", 5), ("p", 9), ("r2", 6))))


_PAST = [f"m{lag}" for lag in range(4)]
_LAGGED = f"d AS (SELECT ticker, date, r, {', '.join(f'lag(m, {lag}) OVER w AS m{lag}' for lag in range(4))} FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date))"


@query(f"""WITH {MARKET}, {_LAGGED}, {_newey_west('d', 'r', _PAST)},
top AS (SELECT *, round({t_tail_sql('t', 'n - 5')}, 10) AS p FROM fits QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(abs(t), 8) DESC, term) = 1),
o AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m, {_SECTOR} AS sector FROM top)
SELECT ticker, sector, CAST(substr(term, 2) AS BIGINT) AS lag, round(beta, 6) AS beta, round(t, 5) AS t, p, round(r2, 6) AS r2, CAST(p <= coalesce((SELECT max(p) FROM o WHERE p <= k * 0.05 / m), -1) AS INTEGER) AS reject, round(avg(beta) OVER s, 6) AS sector_mean, round(coalesce(stddev_samp(beta) OVER s, 0), 6) AS sector_sd FROM o WINDOW s AS (PARTITION BY sector, term)""")
def x25_market_regressions(spark, d) -> DataFrame:
    """Each ticker on the market of this and the three weeks before: the lag of the largest |t|, false discoveries among those over all tickers, and mean and deviation of the betas of a sector at that lag."""
    w = by("ticker")
    rows = market(spark, d).select("ticker", "date", "r", *(F.lag("m", lag).over(w).alias(f"m{lag}") for lag in range(4)))
    fits = by_term(regressions(rows, ["ticker"], "r", _PAST, "date")).where("term <> 'const'").withColumn("lag", F.substring("term", 2, 9).cast("long"))
    top = fits.groupBy("ticker").agg(F.max_by(F.struct("lag", "beta", "t", F.round("p", 10).alias("p"), "r2"), F.struct(F.round(F.abs("t"), 8), -F.col("lag"))).alias("b")).select("ticker", "b.*")
    chosen = false_discoveries(top, "p", 0.05).withColumn("sector", sector())
    s = Window.partitionBy("sector", "lag")
    return chosen.select("ticker", "sector", "lag", rounded("beta").alias("beta"), rounded("t", 5).alias("t"), "p", rounded("r2").alias("r2"), "reject", rounded(F.avg("beta").over(s)).alias("sector_mean"), rounded(F.coalesce(F.stddev_samp("beta").over(s), F.lit(0.0))).alias("sector_sd"))


def _lag_test(lag: int) -> str:
    own, other = [f"y{i}" for i in range(1, lag + 1)], [f"x{i}" for i in range(1, lag + 1)]
    rows = f"e{lag} AS (SELECT ticker, y, y AS u, {', '.join(own + other)} FROM d WHERE y{lag} IS NOT NULL)"
    small = _cleared(f"s{lag}_", f"e{lag}", "ticker", [*own, "u"], lag)
    large = _cleared(f"l{lag}_", f"e{lag}", "ticker", [*own, *other, "u"], 2 * lag)
    return f"{rows}, {small}, {large}, f{lag} AS (SELECT ticker, {lag} AS lag, a.n, ((a.rest - b.rest) / {lag}) / (b.rest / (a.n - {2 * lag + 1})) AS f FROM (SELECT ticker, count(*) AS n, sum(u * u) AS rest FROM s{lag}_{lag} GROUP BY 1) a JOIN (SELECT ticker, sum(u * u) AS rest FROM l{lag}_{2 * lag} GROUP BY 1) b USING (ticker) WHERE a.n + {lag} >= 23)"


_F = "greatest(f, 0)"
_DOF = "(n - 2 * lag - 1)"
#: Tails of F with 1, 2 and 3 degrees of freedom above: the first is a t's, the second a power, the third the first's and a term.
_F_TAIL = f"""CASE lag WHEN 1 THEN {t_tail_sql(f'sqrt({_F})', _DOF)} WHEN 2 THEN pow(1 + 2 * {_F} / {_DOF}, -{_DOF} / 2.0)
ELSE {t_tail_sql(f'sqrt(3 * {_F})', _DOF)} + exp({_DOF} / 2.0 * ln({_DOF} / ({_DOF} + 3 * {_F})) + 0.5 * ln(greatest(3 * {_F} / ({_DOF} + 3 * {_F}), 1e-300)) - ln(0.5) - lgamma({_DOF} / 2.0) - lgamma(0.5) + lgamma(({_DOF} + 1) / 2.0)) END"""


@query(f"""WITH {MARKET}, d AS (SELECT ticker, date, r AS y, {', '.join(f'lag(r, {i}) OVER w AS y{i}, lag(m, {i}) OVER w AS x{i}' for i in range(1, 4))} FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date)),
{', '.join(map(_lag_test, (1, 2, 3)))}, q AS (SELECT *, {_F_TAIL} AS p FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3))
SELECT ticker, CAST(lag AS BIGINT) AS lag, n, round(f, 4) AS f, round(p, 9) AS p, CAST(first_value(lag) OVER (PARTITION BY ticker ORDER BY round(p, 12), lag) AS BIGINT) AS best FROM q""")
def a33_granger(spark, d) -> DataFrame:
    """Whether the market's last one, two or three weeks help to tell a ticker's return beside its own, each lag on all rows that have it."""
    q = granger(market(spark, d), ["ticker"], "r", "m", "date", 3)
    return q.select("ticker", F.col("lag").cast("long").alias("lag"), "n", rounded("f", 4).alias("f"), rounded("p", 9).alias("p"), F.col("best").cast("long").alias("best"))
