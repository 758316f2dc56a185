"""Data hygiene, point-in-time panels, text and scalar rules, set operations and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import clip, frame
from ..operators.joins import asof_join, replace_by_key
from ..sources.storage import stored
from ..sources.tables import bars, table
from .registry import BARS, RETURNS, day, query, rounded
from .windows import rank_ic

_DATE = "CAST(date AS VARCHAR) AS date"


def rescrambled(df: DataFrame, cut: str, value: str) -> DataFrame:
    """df with the values after the cut replaced by others drawn from a hash of the row's key."""
    other = F.pmod(F.xxhash64("ticker", "date"), 1000) / 10.0
    return df.withColumn(value, F.when(F.col("date") > F.lit(cut).cast("date"), other).otherwise(F.col(value)))


def moved_before(compute, df: DataFrame, cut: str, value: str, out: str) -> DataFrame:
    """Rows up to the cut, and how many of them change in `out` if what comes later is scrambled; leakage if any do.

    df is computed once and stored: sums of floats that are computed twice may differ in their last digits.
    """
    df = stored(df)
    keep = lambda x: compute(x).where(F.col("date") <= F.lit(cut).cast("date"))
    a, b = keep(df).select("ticker", "date", F.col(out).alias("x")), keep(rescrambled(df, cut, value)).select("ticker", "date", F.col(out).alias("y"))
    return a.join(b, ["ticker", "date"]).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("x").eqNullSafe(F.col("y")), 1)).alias("moved"))


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS place, count({c}) AS n FROM orders" for i, c in enumerate(_ORDER_COLUMNS, 1)))
def sc3_schema_probe(spark, d):
    """The columns with their places, from the schema, and how many values each has."""
    t = table(spark, d, "orders")
    counts = t.agg(*(F.count(c).alias(c) for c in t.columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(i).alias("place"), F.col(c).alias("n")) for i, c in enumerate(t.columns, 1)))).alias("x")).select("x.*")


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, o_totalprice AS value, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE o_orderdate IS NOT NULL")
def sc4_canonical_dataset(spark, d):
    out = canonical(table(spark, d, "orders"), {"id": ["o_orderkey", "orderkey"], "value": ["o_totalprice", "price"], "date": ["o_orderdate", "Timestamp"]})
    return out.where("date is not null").withColumn("date", day("date"))


def canonical(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names, each from the first alias that df has; an error if none is there."""
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a.lower()] for a in options if a.lower() in have), None) for name, options in aliases.items()}
    if missing := [n for n, c in found.items() if c is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN value END), 4) AS view, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS purchase, CAST(max(CAST(ts AS DATE)) + 45 AS VARCHAR) AS available FROM events GROUP BY 1")
def sc6_statement_pivot(spark, d):
    e = table(spark, d, "events")
    wide = e.groupBy("user_id").pivot("event_type", ["view", "purchase"]).agg(rounded(F.sum("value"), 4))
    return wide.join(e.groupBy("user_id").agg(day(F.date_add(F.to_date(F.max("ts")), 45)).alias("available")), "user_id")


@query("SELECT l_linestatus, CAST(CASE WHEN year(l_shipdate) = 1997 THEN 2 ELSE 1 END AS INTEGER) AS version, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sc9_partition_replace(spark, d):
    """Rows of the replaced year come from the new version, all others stay."""
    li = table(spark, d, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year")).withColumn("version", F.lit(1))
    new = li.where("year = 1997").withColumn("version", F.lit(2))
    return replace_by_key(li, new, ["year"]).groupBy("l_linestatus", "version").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BARS} SELECT {_DATE}, ticker, round(close, 6) AS price, volume AS quantity, round(high - low, 6) AS width FROM bars")
def sc10_feature_store_read(spark, d):
    """Feature tables met on (date, ticker); they come from one shuffle on these keys, so the joins need no other."""
    b = bars(spark, d)
    parts = [b.select("date", "ticker", rounded("close").alias("price")), b.select("date", "ticker", F.col("volume").alias("quantity")), b.select("date", "ticker", rounded(F.col("high") - F.col("low")).alias("width"))]
    return parts[0].join(parts[1], ["date", "ticker"]).join(parts[2], ["date", "ticker"]).withColumn("date", day("date"))


@query("WITH e AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, value FROM events), k AS (SELECT a, b, user_id, max(round(value / 500 + 0.5 * (user_id % 3), 6)) AS score FROM e WHERE b IS NOT NULL AND a <> b AND value >= 10 GROUP BY 1, 2, 3) SELECT a, b, user_id, score FROM k QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, user_id) = 1")
def sc14_relationship_scan(spark, d):
    e = table(spark, d, "events").select("user_id", "value", F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    k = e.where("b is not null and a <> b and value >= 10").withColumn("score", rounded(F.col("value") / 500 + 0.5 * (F.col("user_id") % 3)))
    return k.groupBy("a", "b").agg(F.max(F.struct("score", -F.col("user_id"), "user_id")).alias("top")).select("a", "b", "top.user_id", "top.score")


@query(f"WITH {BARS} SELECT count(*) AS n, 0 AS moved FROM bars WHERE date <= DATE '1998-06-26'")
def pf3_scramble_test(spark, d):
    rolling = lambda x: x.withColumn("f", F.avg("close").over(frame("ticker", 8)))
    return moved_before(rolling, bars(spark, d), "1998-06-26", "close", "f")


def _ic_sql(lag: int) -> str:
    return f"""SELECT avg(ic) AS ic FROM (SELECT date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS b FROM (SELECT date, lag(r, {lag}) OVER (PARTITION BY ticker ORDER BY date) AS x, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM rets) WHERE x IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10)"""


@query(f"WITH {RETURNS}, a AS ({_ic_sql(0)}), b AS ({_ic_sql(1)}) SELECT round(a.ic, 6) AS without_lag, round(b.ic, 6) AS with_lag, CAST(abs(a.ic) / abs(b.ic) > 1.2 AS INTEGER) AS leak FROM a, b")
def pf4_lag_leakage(spark, d):
    from .windows import _panel

    p = _panel(spark, d).withColumn("x", F.lag("r").over(Window.partitionBy("ticker").orderBy("date")))
    mean = lambda f, name: rank_ic(p, f, "fwd").agg(F.avg("ic").alias(name))
    out = mean("r", "a").join(F.broadcast(mean("x", "b")))  # one row each
    return out.select(rounded("a").alias("without_lag"), rounded("b").alias("with_lag"), (F.abs("a") / F.abs("b") > 1.2).cast("int").alias("leak"))


@query("SELECT event_type, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS age, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') > 2 AS INTEGER) AS stale FROM events GROUP BY 1")
def pf5_freshness(spark, d):
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date(F.max("ts")))
    return table(spark, d, "events").groupBy("event_type").agg(age.cast("long").alias("age"), (age > 2).cast("int").alias("stale"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS ticker, CAST(p_size AS DOUBLE) AS volume, try_cast(p_type AS DOUBLE) AS close FROM part")
def pf6_standard_columns(spark, d):
    out = canonical(table(spark, d, "part"), {"ticker": ["symbol", "P_PARTKEY"], "volume": ["p_size"], "close": ["p_type"]})
    return out.select(F.col("ticker").cast("string").alias("ticker"), F.col("volume").cast("double").alias("volume"), F.col("close").try_cast("double").alias("close"))


@query("SELECT 'o_orderkey' AS name, 'ok' AS finding, count(*) - count(o_orderkey) AS missing FROM orders UNION ALL SELECT 'o_orderdate', 'ok', count(*) - count(o_orderdate) FROM orders UNION ALL SELECT 'o_totalprice', 'not bigint', count(*) - count(o_totalprice) FROM orders UNION ALL SELECT 'o_region', 'absent', count(*) FROM orders")
def pf7_schema_validation(spark, d):
    """Of each column wanted: its finding by name and type, and the rows without a value."""
    return validated(table(spark, d, "orders"), {"o_orderkey": "bigint", "o_orderdate": "timestamp", "o_totalprice": "bigint", "o_region": "string"})


def validated(df: DataFrame, want: dict[str, str]) -> DataFrame:
    have = dict(df.dtypes)
    finding = {c: "absent" if c not in have else "ok" if have[c].startswith(t) else f"not {t}" for c, t in want.items()}
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in want if c in have))
    missing = lambda c: F.col("_n") - (F.col(c) if c in have else F.lit(0))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(f).alias("finding"), missing(c).alias("missing")) for c, f in finding.items()))).alias("x")).select("x.*")


@query("SELECT CASE source_name WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partial' END AS state, count(*) AS n, round(avg(price), 4) AS price FROM (SELECT o_orderstatus AS source_name, o_totalprice / 1000 AS price FROM orders) GROUP BY 1")
def pf8_standard_format(spark, d):
    names = F.create_map(*map(F.lit, ("F", "filled", "O", "open")))
    return table(spark, d, "orders").groupBy(F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("partial")).alias("state")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("o_totalprice") / 1000), 4).alias("price"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.missing') AS DOUBLE), CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 50 THEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) END, value) AS x FROM events")
def pf9_coalesced(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing").try_cast("double"), F.when(k > 50, k), F.col("value")).alias("x"))


@query(f"WITH {BARS}, n AS (SELECT count(DISTINCT date) AS n FROM bars) SELECT ticker, round(count(*) FILTER (volume > 150) * 1.0 / any_value(n), 6) AS coverage FROM bars, n GROUP BY 1 HAVING count(*) FILTER (volume > 150) * 1.0 / any_value(n) >= 0.4")
def pf13_coverage_filter(spark, d):
    b = bars(spark, d)
    n = b.select("date").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    share = F.count(F.when(F.col("volume") > 150, 1)) / F.first("n")
    return b.join(F.broadcast(n)).groupBy("ticker").agg(share.alias("c")).where("c >= 0.4").select("ticker", rounded("c").alias("coverage"))


_SPLITS = [("Brand#1", "1997-05-01", 2.0), ("Brand#1", "1999-02-01", 3.0), ("Brand#7", "1998-01-01", 5.0), ("Brand#7", "2099-01-01", 9.0)]
_SPLIT_SQL = "s(ticker, dt, ratio) AS (VALUES " + ", ".join(f"('{t}', DATE '{a}', {r})" for t, a, r in _SPLITS) + ")"


@query(f"WITH {BARS}, {_SPLIT_SQL}, f AS (SELECT date, ticker, exp(sum(ln(ratio))) AS f FROM bars JOIN s USING (ticker) WHERE date < dt AND dt <= DATE '2001-12-31' GROUP BY 1, 2) SELECT {_DATE}, ticker, round(close / coalesce(f, 1), 6) AS close, round(volume * coalesce(f, 1), 4) AS volume FROM bars LEFT JOIN f USING (date, ticker)")
def pf14_split_adjustment(spark, d):
    """A ticker's splits go along as one small array, so each row is joined once."""
    s = spark.createDataFrame(_SPLITS, "ticker string, at string, ratio double").withColumn("at", F.col("at").cast("date")).where("at <= date'2001-12-31'").groupBy("ticker").agg(F.collect_list(F.struct("at", "ratio")).alias("splits"))
    factor = F.coalesce(F.aggregate(F.filter("splits", lambda x: x["at"] > F.col("date")), F.lit(1.0), lambda a, x: a * x["ratio"]), F.lit(1.0))
    out = bars(spark, d).join(F.broadcast(s), "ticker", "left").withColumn("f", factor)
    return out.select(day("date").alias("date"), "ticker", rounded(F.col("close") / F.col("f")).alias("close"), rounded(F.col("volume") * F.col("f"), 4).alias("volume"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.9) AS q FROM events GROUP BY 1) SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 'rate' WHEN event_type = 'purchase' THEN 'money' ELSE 'flow' END AS family, round(avg(CASE WHEN q > 1.5 AND event_type IN ('view', 'click') THEN value / 100 ELSE value END), 6) AS mean FROM events JOIN q USING (event_type) GROUP BY 1, 2")
def pf18_unit_families(spark, d):
    """The scale of a series is judged by a quantile, taken together with the mean in one aggregate."""
    family = F.when(F.col("event_type").rlike("view|click"), "rate").when(F.col("event_type").rlike("purchase"), "money").otherwise("flow")
    k = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.9).alias("q"), F.avg("value").alias("mean")).withColumn("family", family)
    return k.select("event_type", "family", rounded(F.when((F.col("q") > 1.5) & (F.col("family") == "rate"), F.col("mean") / 100).otherwise(F.col("mean"))).alias("mean"))


@query("WITH k AS (SELECT o_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS a, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS b FROM orders GROUP BY 1) SELECT o_custkey, round(coalesce(a, b), 2) AS value FROM k WHERE coalesce(a, b) IS NOT NULL")
def pf19_aliased_value(spark, d):
    maps = keyed(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice")
    return maps.select("o_custkey", rounded(picked(F.col("values"), "1-urgent", "2-high"), 2).alias("value")).where("value is not null")


def keyed(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, values): a map from the lower-case name to the sum of its values."""
    sums = df.groupBy(key, F.lower(name).alias("_n")).agg(F.sum(value).alias("_v"))
    return sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_n", "_v"))).alias("values"))


def picked(values, *names: str):
    """The first of the names that the map has."""
    return F.coalesce(*(F.try_element_at(values, F.lit(n.lower())) for n in names))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey % 97 = 0) AS mismatches FROM orders")
def pf20_replica_mismatch(spark, d):
    """Only keys and row hashes of the two states meet."""
    live = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    shadow = live.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 97 == 0, 1.0).otherwise(0.0))
    h = lambda x, name: x.select("o_orderkey", F.xxhash64("o_totalprice", "o_orderstatus").alias(name))
    return h(live, "a").join(h(shadow, "b"), "o_orderkey", "outer").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("mismatches"))


@query("SELECT CASE WHEN l_discount > 0.08 AND l_tax > 0.06 THEN 'discount,tax' WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.06 THEN 'tax' ELSE '' END AS reasons, count(*) AS n FROM lineitem GROUP BY 1")
def pf21_quarantine(spark, d):
    reasons = F.concat_ws(",", F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_tax") > 0.06, "tax"))
    return table(spark, d, "lineitem").groupBy(reasons.alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


_FUND = "fund AS (SELECT p_brand AS ticker, CAST(last_day(l_shipdate) AS DATE) + 45 AS available, sum(l_extendedprice) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def monthly(spark, d) -> DataFrame:
    """(ticker, available, revenue): a brand's months, known 45 days after their end."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    joined = li.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("ticker", F.date_add(F.last_day("l_shipdate"), 45).alias("available")).agg(F.sum("l_extendedprice").alias("revenue"))


@query(f"WITH {BARS}, {_FUND}, p AS (SELECT b.date, b.ticker, f.revenue FROM bars b ASOF LEFT JOIN fund f ON b.ticker = f.ticker AND b.date >= f.available) SELECT {_DATE}, ticker, round(coalesce((revenue - avg(revenue) OVER w) / (stddev_samp(revenue) OVER w + 1e-9), 0), 5) AS z FROM p WINDOW w AS (PARTITION BY date)")
def j3_fundamentals_panel(spark, d):
    p = asof_join(bars(spark, d).select("ticker", "date"), monthly(spark, d), "ticker", "date", "available", ["revenue"], "available", span_days=90)
    w = Window.partitionBy("date")
    return p.select(day("date").alias("date"), "ticker", rounded(F.coalesce(F.try_divide(F.col("revenue") - F.avg("revenue").over(w), F.stddev_samp("revenue").over(w) + 1e-9), F.lit(0.0)), 5).alias("z"))


@query(f"WITH {BARS} SELECT CAST(a.date AS VARCHAR) AS date, a.ticker, round(a.close / b.close - 1, 6) AS yearly FROM bars a ASOF LEFT JOIN (SELECT ticker, date + 365 AS date, close FROM bars) b ON a.ticker = b.ticker AND a.date >= b.date")
def j5_self_asof(spark, d):
    b = bars(spark, d).select("ticker", "date", "close")
    past = b.select("ticker", F.date_add("date", 365).alias("then"), F.col("close").alias("old"))
    return asof_join(b, past, "ticker", "date", "then", ["old"], "then", span_days=90).select(day("date").alias("date"), "ticker", rounded(F.col("close") / F.col("old") - 1).alias("yearly"))


@query(f"WITH {_FUND}, o AS (SELECT l_orderkey, l_linenumber, p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49) SELECT l_orderkey, l_linenumber, round(v / revenue, 6) AS share FROM o ASOF LEFT JOIN fund f ON o.ticker = f.ticker AND o.date >= f.available")
def j6_event_over_revenue(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("v"))
    o = li.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
    out = asof_join(o.select("ticker", "date", "l_orderkey", "l_linenumber", "v"), monthly(spark, d), "ticker", "date", "available", ["revenue"], "available", span_days=90)
    return out.select("l_orderkey", "l_linenumber", rounded(F.col("v") / F.col("revenue")).alias("share"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j10_anti_join(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("WITH a AS (SELECT last_day(o_orderdate) AS m, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT last_day(l_shipdate) AS m, count(*) AS lines FROM lineitem GROUP BY 1), c AS (SELECT last_day(ts) AS m, count(*) AS events FROM events GROUP BY 1) SELECT CAST(m AS VARCHAR) AS month, orders, lines, events FROM a FULL JOIN b USING (m) FULL JOIN c USING (m)")
def j11_outer_series(spark, d):
    """Each series is summed first; only months meet."""
    one = lambda t, c, name: table(spark, d, t).groupBy(F.last_day(c).alias("m")).agg(F.count(F.lit(1)).alias(name))
    out = one("orders", "o_orderdate", "orders").join(one("lineitem", "l_shipdate", "lines"), "m", "outer").join(one("events", "ts", "events"), "m", "outer")
    return out.select(day("m").alias("month"), "orders", "lines", "events")


_CHAIN_EDGES = "t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT a, b, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY a) AS p FROM t WHERE b IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_CHAIN_EDGES}, c AS (SELECT 'view>' || b AS path, b AS at, p, 1 AS depth FROM e WHERE a = 'view' AND b <> 'view' UNION ALL SELECT c.path || '>' || e.b, e.b, c.p * e.p, depth + 1 FROM c JOIN e ON e.a = c.at WHERE depth < 3 AND NOT contains('>' || c.path || '>', '>' || e.b || '>')) SELECT path, CAST(depth AS BIGINT) AS depth, round(p, 6) AS strength FROM c")
def j17_causal_chains(spark, d):
    """Breadth-first by joins with the edges of the graph, to a fixed depth, without cycles."""
    t = table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    e = t.select("a", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("a"))).alias("p"))
    level = e.where("a = 'view' and b <> 'view'").select(F.array("a", "b").alias("path"), F.col("b").alias("at"), F.col("p").alias("strength"))
    out = level
    for _ in range(2):
        level = level.join(e, F.col("a") == F.col("at")).where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (F.col("strength") * F.col("p")).alias("strength"))
        out = out.unionByName(level)
    return out.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("depth"), rounded("strength").alias("strength"))


@query("WITH s AS (SELECT DISTINCT last_day(o_orderdate) AS snap, o_custkey FROM orders), x AS (SELECT max(snap) AS snap FROM s WHERE snap <= DATE '1998-06-15') SELECT s.o_custkey FROM s JOIN x USING (snap) JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0")
def j18_universe_as_of(spark, d):
    s = table(spark, d, "orders").select(F.last_day("o_orderdate").alias("snap"), "o_custkey").distinct()
    x = s.where("snap <= date'1998-06-15'").agg(F.max("snap").alias("snap"))  # one row
    able = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return s.join(F.broadcast(x), "snap").join(able, "o_custkey", "left_semi").select("o_custkey")


@query("WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS c FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY 1), q AS (SELECT vec_id, sqrt(sum(v * v)) AS q FROM x GROUP BY 1), s AS (SELECT x.vec_id, c.label, round(sum(x.v * c.c) / any_value(n.n * q.q), 5) AS score FROM x JOIN c USING (i) JOIN n ON n.label = c.label JOIN q ON q.vec_id = x.vec_id GROUP BY 1, 2) SELECT vec_id, CAST(label AS BIGINT) AS nearest, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1")
def j15_nearest_centroid(spark, d):
    """Each vector against the mean of each label, some ten of them, in the JVM."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    c = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    centroids = c.agg(F.collect_list(F.struct("label", "c")).alias("all"))  # one row, of as many vectors as labels
    scored = F.transform("all", lambda s: F.struct(F.round(dot(F.col("v"), s["c"]) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(s["c"], s["c"])), 5).alias("score"), (-s["label"]).alias("order"), s["label"].alias("label")))
    return e.join(F.broadcast(centroids)).select("vec_id", F.array_max(scored).alias("top")).select("vec_id", F.col("top.label").alias("nearest"), "top.score")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def k1_order_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u4_except_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events")
def u5_distinct(spark, d):
    return table(spark, d, "events").select("user_id", day("ts").alias("date")).distinct()


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS metric FROM part")
def f2_snake_case(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")).alias("metric"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) > 3 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year, CAST(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS quarter_end FROM orders")
def f3_fiscal_period(spark, d):
    """From texts like `Mar 2024`, as statements give them."""
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM yyyy").alias("period"))
    month = F.to_date("period", "MMM yyyy")
    return text.select("o_orderkey", (F.year(month) + (F.month(month) > 3).cast("int")).cast("long").alias("fiscal_year"), day(F.last_day(F.add_months(F.trunc(month, "quarter"), 2))).alias("quarter_end"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders")
def f4_mixed_dates(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", day(F.coalesce(*(F.try_to_date("t", f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MMM-yyyy")))).alias("date"))


@query("SELECT o_orderkey, CAST(last_day(o_orderdate) + 30 AS VARCHAR) AS monthly, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) AS daily FROM orders")
def f6_month_end_lag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", day(F.date_add(F.last_day("o_orderdate"), 30)).alias("monthly"), day(F.date_add(F.to_date("o_orderdate"), 1)).alias("daily"))


#: Rating codes with their numbers, fixed values.
RATINGS = {"AAA": 20, "AA+": 19, "AA": 18, "AA-": 17, "A+": 16, "A": 15, "A-": 14, "BBB": 12, "BB": 9, "B": 6, "C": 3, "D": 1}
_GRADE = "CASE p_size % 6 WHEN 0 THEN '[X] AAA (stable)' WHEN 1 THEN 'IND AA+' WHEN 2 THEN 'bbb' WHEN 3 THEN 'A-/watch' WHEN 4 THEN 'withdrawn' ELSE 'D' END"


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 20 WHEN 1 THEN 19 WHEN 2 THEN 12 WHEN 3 THEN 14 WHEN 5 THEN 1 END AS rating FROM part")
def f7_rating_scale(spark, d):
    """The longest code that stands alone in the text, by one pattern."""
    codes = "|".join(c.replace("+", r"\+") for c in sorted(RATINGS, key=len, reverse=True))
    code = F.regexp_extract(F.upper(F.expr(_GRADE)), rf"(?<![A-Z])({codes})(?![A-Z+\-])", 1)
    return table(spark, d, "part").select("p_partkey", F.try_element_at(F.create_map(*[F.lit(x) for kv in RATINGS.items() for x in kv]), code).alias("rating"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN round(p_retailprice / 100, 4) END AS crore FROM part")
def f8_order_value(spark, d):
    head = F.expr("CASE p_size % 3 WHEN 0 THEN concat('wins order worth Rs ', p_retailprice, ' crore') WHEN 1 THEN concat('order of INR ', p_retailprice, ' lakh from') ELSE 'order received' END")
    amount = F.regexp_extract(head, r"(?i)(?:rs\.?|inr)\s*([\d.]+)\s*(crore|lakh)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(head, r"(?i)(?:rs\.?|inr)\s*([\d.]+)\s*(crore|lakh)", 2))
    return table(spark, d, "part").select("p_partkey", F.when(unit == "lakh", F.round(amount / 100, 4)).when(unit == "crore", amount).alias("crore"))


_EVENT_RULES = [("licen[cs]e|copyright", "legal"), ("error|fail|wrong", "trouble"), ("market|price|trade", "business"), ("school|book|learn", "education")]
_CASES = " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{k}'" for p, k in _EVENT_RULES)


@query(f"SELECT doc_id, CASE {_CASES} ELSE 'other' END AS kind FROM documents")
def f9_text_event_class(spark, d):
    """The first rule of the list that matches, over the whole text."""
    low, out = F.lower(F.coalesce("text", F.lit(""))), F
    for pattern, kind in _EVENT_RULES:
        out = out.when(low.rlike(pattern), kind)
    return table(spark, d, "documents").select("doc_id", out.otherwise("other").alias("kind"))


_POS, _NEG = ["good", "great", "best", "happy", "new"], ["bad", "worst", "wrong", "fail", "old"]


def _hits_sql(words):
    return " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)


@query(f"WITH k AS (SELECT doc_id, {_hits_sql(_POS)} AS p, {_hits_sql(_NEG)} AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(p * 1.0 / greatest(p + n, 1), 6) AS positive, CAST(CASE WHEN greatest(p, n) * 1.0 / greatest(p + n, 1) < 0.55 THEN 0 ELSE sign(p - n) END AS INTEGER) AS polarity FROM k")
def f10_sentiment(spark, d):
    hits = lambda words: sum((F.contains("low", F.lit(w)).cast("int") for w in words), F.lit(0))
    k = table(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("low")).select("doc_id", hits(_POS).alias("p"), hits(_NEG).alias("n"))
    total = F.greatest(F.col("p") + F.col("n"), F.lit(1))
    return k.select("doc_id", rounded(F.col("p") / total).alias("positive"), F.when(F.greatest("p", "n") / total < 0.55, 0).otherwise(F.signum((F.col("p") - F.col("n")).cast("double"))).cast("int").alias("polarity"))


@query("SELECT event_id, CAST(CASE isodow(ts + INTERVAL 6 HOUR) WHEN 6 THEN CAST(ts + INTERVAL 6 HOUR AS DATE) + 2 WHEN 7 THEN CAST(ts + INTERVAL 6 HOUR AS DATE) + 1 ELSE CAST(ts + INTERVAL 6 HOUR AS DATE) END AS VARCHAR) AS available FROM events")
def f13_publish_to_available(spark, d):
    at = F.to_date(F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return table(spark, d, "events").select("event_id", day(F.when(F.dayofweek(at) == 7, F.date_add(at, 2)).when(F.dayofweek(at) == 1, F.date_add(at, 1)).otherwise(at)).alias("available"))


@query("SELECT tok AS token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tok FROM part) WHERE tok <> '' GROUP BY 1")
def f14_exploded_tokens(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round(value / nullif(user_id % 5, 0), 6) AS ratio, round(ln(1 + value), 6) AS log, round(least(greatest(value, 10), 90), 6) AS clipped, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS squashed FROM events")
def f15_safe_math(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", rounded(F.try_divide(v, F.col("user_id") % 5)).alias("ratio"), rounded(F.log1p(v)).alias("log"), rounded(clip(v, 10.0, 90.0)).alias("clipped"), rounded(1 / (1 + F.exp(-(v - 50) / 10))).alias("squashed"))


@query("SELECT CASE WHEN p_type LIKE '%A%' THEN 'has_a' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def f32_keyword_sector(spark, d):
    return table(spark, d, "part").groupBy(F.when(F.contains("p_type", F.lit("A")), "has_a").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), sum(o_totalprice) FILTER (o_orderstatus = 'O')), 2) AS value FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus IN ('F', 'O')) > 0")
def f27_keyed_access(spark, d):
    return keyed(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice").select("o_custkey", rounded(picked(F.col("values"), "F", "O"), 2).alias("value")).where("value is not null")


@query("WITH c AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS b FROM supplier) SELECT coalesce(c.k, s.k) AS k, coalesce(c.name, s.name) AS name, CASE WHEN c.k IS NULL THEN 'second' WHEN s.k IS NULL THEN 'first' ELSE 'both' END AS origin FROM c FULL JOIN s USING (k)")
def x34_universe_enrichment(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("b"))
    return c.join(s, "k", "outer").select("k", F.coalesce("a", "b").alias("name"), F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("both").alias("origin"))


@query("SELECT user_id, event_id, CASE WHEN value > 80 THEN 'buy' WHEN value < 10 THEN 'sell' ELSE 'neutral' END AS label FROM (SELECT * FROM events WHERE event_type <> 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def j20_labeled_frame(spark, d):
    """At most five examples of a user, the strongest ones: the cap is the operator's own feature."""
    e = table(spark, d, "events").where("event_type <> 'error'").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("n <= 5")
    return e.select("user_id", "event_id", F.when(F.col("value") > 80, "buy").when(F.col("value") < 10, "sell").otherwise("neutral").alias("label"))
