"""Scans, point-in-time filters, joins, aggregates, top-k and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import clip, next_business_day, normalized_ticker
from ..operators.correlations import pair_correlations
from ..operators.joins import asof_join, keep_last, replace_by_key
from ..operators.quantiles import exact_quantiles
from ..sources.tables import bars, range_scan, table
from .registry import BARS, RETURNS, day, query, rounded


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30' AND l_returnflag = 'R' AND l_linenumber IN (1, 2) ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 100")
def sc1_range_scan(spark, d):
    import datetime as dt

    out = range_scan(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"], "l_shipdate", dt.datetime(1996, 1, 1), dt.datetime(1996, 6, 30), {"l_returnflag": "R"}, {"l_linenumber": [1, 2]}, ["l_shipdate", "l_orderkey", "l_linenumber"], 100)
    return out.withColumn("shipped", day("l_shipdate")).drop("l_shipdate")


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem")
def sc2_scalar(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.expr("sum(l_extendedprice * (1 - l_discount))"), 2).alias("value"))


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def sc8_replace_by_key(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return replace_by_key(orders, orders.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query("WITH span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), cal AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS dt FROM span), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, CAST(dt AS VARCHAR) AS missing FROM u CROSS JOIN cal WHERE (user_id, dt) NOT IN (SELECT user_id, CAST(ts AS DATE) FROM events)")
def sc11_missing_dates(spark, d):
    seen = table(spark, d, "events").select("user_id", F.to_date("ts").alias("dt")).distinct()
    span = seen.agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    calendar = seen.select("user_id").distinct().join(F.broadcast(span)).select("user_id", F.explode(F.sequence("a", "b")).alias("dt"))
    return calendar.join(seen, ["user_id", "dt"], "left_anti").select("user_id", day("dt").alias("missing"))


@query("SELECT event_type, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def sc12_coverage(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(day(F.min("ts")).alias("first"), day(F.max("ts")).alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE last_day(o_orderdate) + 45 <= DATE '1998-06-30' GROUP BY 1")
def pf1_point_in_time(spark, d):
    known = table(spark, d, "orders").withColumn("availability_date", F.date_add(F.last_day("o_orderdate"), 45))
    return known.where(F.col("availability_date") <= F.lit("1998-06-30").cast("date")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS violations, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'")
def pf2_pit_violations(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate") > F.lit("2000-01-01").cast("timestamp")).agg(F.count(F.lit(1)).alias("violations"), day(F.min("o_orderdate")).alias("first"))


@query(f"WITH {BARS}, s AS (SELECT date, avg(close) AS m, stddev_samp(close) AS sd, count(close) AS n FROM bars GROUP BY 1) SELECT CAST(date AS VARCHAR) AS date, ticker, round(CASE WHEN n >= 10 THEN least(greatest(close, m - 1.5 * sd), m + 1.5 * sd) ELSE close END, 6) AS close FROM bars JOIN s USING (date)")
def pf10_limit_by_std(spark, d):
    b = bars(spark, d)
    stats = b.groupBy("date").agg(F.avg("close").alias("m"), F.stddev_samp("close").alias("sd"), F.count("close").alias("n"))
    limited = clip(F.col("close"), F.col("m") - 1.5 * F.col("sd"), F.col("m") + 1.5 * F.col("sd"))
    return b.join(stats, "date").select(day("date").alias("date"), "ticker", rounded(F.when(F.col("n") >= 10, limited).otherwise(F.col("close"))).alias("close"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1) SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events JOIN q USING (event_type)")
def pf11_winsorize(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    q = exact_quantiles(e, ["event_type"], F.col("value"), [0.05, 0.95])
    return e.join(q, "event_type").select("event_id", rounded(clip(F.col("value"), F.col("q")[0], F.col("q")[1])).alias("value"))


@query("WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1), a AS (SELECT event_type, med, quantile_cont(abs(value - med), 0.5) AS mad FROM events JOIN m USING (event_type) GROUP BY 1, 2) SELECT event_id, round(least(greatest(value, med - 1.5 * 1.4826 * mad), med + 1.5 * 1.4826 * mad), 6) AS value FROM events JOIN a USING (event_type)")
def pf12_mad_clip(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    med = exact_quantiles(e, ["event_type"], F.col("value"), [0.5]).select("event_type", F.col("q")[0].alias("med"))
    off = exact_quantiles(e.join(med, "event_type"), ["event_type"], F.abs(F.col("value") - F.col("med")), [0.5]).select("event_type", F.col("q")[0].alias("mad"))
    mad = med.join(off, "event_type")
    width = 1.5 * 1.4826 * F.col("mad")
    return e.join(mad, "event_type").select("event_id", rounded(clip(F.col("value"), F.col("med") - width, F.col("med") + width)).alias("value"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')")
def pf15_delisted(spark, d):
    active = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(active, "c_custkey", "left_anti")


@query("SELECT CASE p_brand WHEN 'Brand#1' THEN 'Brand#100' WHEN 'Brand#2' THEN 'Brand#200' ELSE p_brand END AS ticker, count(*) AS n FROM part GROUP BY 1")
def pf16_symbol_migration(spark, d):
    moves = spark.createDataFrame([("Brand#1", "Brand#100", "1996-01-01"), ("Brand#2", "Brand#200", "1999-01-01"), ("Brand#3", "Brand#300", "2030-01-01")], "old string, new string, effective string").where("effective <= '2001-12-31'")
    parts = table(spark, d, "part").join(F.broadcast(moves), F.col("p_brand") == F.col("old"), "left")
    return parts.groupBy(F.coalesce("new", "p_brand").alias("ticker")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 60 ELSE 45 END AS VARCHAR) AS available FROM orders")
def pf17_release_lag(spark, d):
    lags = spark.createDataFrame([("F", 30), ("O", 60)], "o_orderstatus string, days int")
    return table(spark, d, "orders").join(F.broadcast(lags), "o_orderstatus", "left").select("o_orderkey", day(F.date_add(F.to_date("o_orderdate"), F.coalesce("days", F.lit(45)))).alias("available"))


@query("WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT n_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, r_name FROM c FULL JOIN s USING (k) JOIN nation ON n_nationkey = k LEFT JOIN region ON r_regionkey = n_regionkey")
def j1_outer_merge(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    out = c.join(s, "k", "outer").join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "r_name")


@query("WITH b AS (SELECT user_id, ts, max_by(value, event_id) AS value, max(event_id) AS last_view FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT a.event_id, b.last_view, b.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
def j2_asof_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"), F.col("value").alias("view_value"))
    out = asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", ["last_view", "view_value"], "last_view", span_days=7)
    return out.select("event_id", "last_view", "view_value")


_MACRO = "macro AS (SELECT last_day(o_orderdate) + 30 AS available, round(avg(o_totalprice), 4) AS level FROM orders GROUP BY 1)"


@query(f"WITH {BARS}, {_MACRO} SELECT CAST(b.date AS VARCHAR) AS date, b.ticker, m.level FROM bars b ASOF LEFT JOIN macro m ON b.date >= m.available")
def j4_keyless_asof(spark, d):
    macro = table(spark, d, "orders").groupBy(F.date_add(F.last_day("o_orderdate"), 30).alias("available")).agg(rounded(F.avg("o_totalprice"), 4).alias("level"))
    out = asof_join(bars(spark, d).select("date", "ticker"), macro, None, "date", "available", ["level"], "available")
    return out.select(day("date").alias("date"), "ticker", "level")


@query("WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS dt FROM orders) SELECT a.o_orderkey, CAST(coalesce(min(b.dt) + 1, any_value(a.dt) + 60) AS VARCHAR) AS available FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.dt > a.dt AND b.dt <= a.dt + 180 GROUP BY 1")
def j7_first_announcement(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("dt"))
    # the first later date of a customer is the least one in a frame of days after the row
    w = Window.partitionBy("o_custkey").orderBy(F.datediff("dt", F.lit("1970-01-01"))).rangeBetween(1, 180)
    return o.select("o_orderkey", day(F.coalesce(F.date_add(F.min("dt").over(w), 1), F.date_add("dt", 60))).alias("available"))


_REGIMES = [("calm", "1995-01-01", "1996-12-31"), ("storm", "1997-01-01", "1997-09-30"), ("growth", "1998-02-01", "2001-12-31")]


@query(f"WITH {BARS}, w(regime, a, b) AS (VALUES ('calm', DATE '1995-01-01', DATE '1996-12-31'), ('storm', DATE '1997-01-01', DATE '1997-09-30'), ('growth', DATE '1998-02-01', DATE '2001-12-31')) SELECT coalesce(regime, 'unknown') AS regime, count(*) AS n, round(avg(close), 6) AS close FROM bars LEFT JOIN w ON date BETWEEN a AND b GROUP BY 1")
def j8_regime_join(spark, d):
    w = spark.createDataFrame(_REGIMES, "regime string, a string, b string").select("regime", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    out = bars(spark, d).join(F.broadcast(w), F.col("date").between(F.col("a"), F.col("b")), "left")
    return out.groupBy(F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("close")).alias("close"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS dt FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_linestatus = 'F')")
def j9_common_dates(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("dt"))
    return a.intersect(table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.to_date("l_shipdate").alias("dt"))).agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN '  ' ELSE n_name END AS name FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation WHERE n_nationkey > 5) SELECT k, coalesce(nullif(trim(a.name), ''), b.name) AS name FROM a FULL JOIN b USING (k)")
def j12_two_sources(spark, d):
    n = table(spark, d, "nation")
    a = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, "  ").otherwise(F.col("n_name")).alias("first"))
    b = n.where("n_nationkey > 5").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("second"))
    return a.join(b, "k", "outer").select("k", F.coalesce(F.nullif(F.trim("first"), F.lit("")), "second").alias("name"))


@query(f"WITH {RETURNS} SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, round(covar_samp(a.r, b.r) / (stddev_samp(a.r) * stddev_samp(b.r)), 6) AS corr FROM rets a JOIN rets b ON a.date = b.date AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20")
def j13_pair_correlation(spark, d):
    from .windows import returns

    return pair_correlations(returns(spark, d), "date", "ticker", "r", 20).withColumn("corr", rounded("corr"))


_SHOCKS = [("base", 0.0, 0.0), ("down", -0.1, 0.05), ("crash", -0.3, 0.2), ("up", 0.08, -0.02)]


@query("WITH s(scenario, m, v) AS (VALUES ('base', 0.0, 0.0), ('down', -0.1, 0.05), ('crash', -0.3, 0.2), ('up', 0.08, -0.02)) SELECT scenario, round(sum(l_extendedprice * m + 0.5 * l_quantity * m * m + l_tax * l_extendedprice * v), 2) AS pnl FROM lineitem CROSS JOIN s GROUP BY 1")
def j19_scenarios(spark, d):
    shocks = spark.createDataFrame(_SHOCKS, "scenario string, m double, v double")  # four rows
    pnl = F.col("l_extendedprice") * F.col("m") + 0.5 * F.col("l_quantity") * F.col("m") * F.col("m") + F.col("l_tax") * F.col("l_extendedprice") * F.col("v")
    return table(spark, d, "lineitem").join(F.broadcast(shocks)).groupBy("scenario").agg(rounded(F.sum(pnl), 2).alias("pnl"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, count(DISTINCT l_partkey) AS parts, round(avg(l_quantity) * avg(l_discount), 6) AS product FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 10")
def a1_group_aggregates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("l_extendedprice")).alias("mean"), rounded(F.stddev_samp("l_extendedprice")).alias("sd"), F.countDistinct("l_partkey").alias("parts"), rounded(F.avg("l_quantity") * F.avg("l_discount")).alias("product")).where("n >= 10")


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 6) AS bought, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 6) AS lost, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, max(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS large FROM events GROUP BY 1, 2")
def a2_conditional_aggregates(spark, d):
    kind = lambda k: F.col("event_type") == k
    return table(spark, d, "events").groupBy("user_id", day("ts").alias("date")).agg(rounded(F.sum(F.when(kind("purchase"), F.col("value")).otherwise(0))).alias("bought"), rounded(F.sum(F.when(kind("error"), F.col("value")).otherwise(0))).alias("lost"), F.count(F.when(kind("view"), 1)).alias("views"), F.max(F.when(F.col("value") > 100, 1).otherwise(0)).alias("large"))


@query("SELECT l_suppkey, round(CASE WHEN sum(l_discount) > 0 THEN sum(l_extendedprice * l_discount) / sum(l_discount) ELSE avg(l_extendedprice) END, 6) AS price FROM lineitem GROUP BY 1")
def a3_weighted_mean(spark, d):
    w, v = F.col("l_discount"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(rounded(F.when(F.sum(w) > 0, F.try_divide(F.sum(v * w), F.sum(w))).otherwise(F.avg(v))).alias("price"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def a4_mode(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    return c.groupBy("user_id").agg(F.max(F.struct("n", -F.col("f"), "event_type")).alias("top")).select("user_id", "top.event_type", "top.n")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) = 1")
def a5_arg_max(spark, d):
    return table(spark, d, "events").groupBy(day("ts").alias("date")).agg(F.max(F.struct("value", -F.col("event_id"), "event_id")).alias("top")).select("date", "top.event_id", "top.value")


@query("WITH m AS (SELECT p_type, quantile_cont(p_retailprice, 0.5) AS med FROM part WHERE p_size > 10 GROUP BY 1) SELECT p_partkey, round(p_retailprice / med - 1, 6) AS gap FROM part JOIN m USING (p_type)")
def a6_group_median(spark, d):
    p = table(spark, d, "part")
    med = p.where("p_size > 10").groupBy("p_type").agg(F.median("p_retailprice").alias("med"))
    return p.join(med, "p_type").select("p_partkey", rounded(F.col("p_retailprice") / F.col("med") - 1).alias("gap"))


@query(f"WITH {BARS} SELECT CAST(date AS VARCHAR) AS date, count(DISTINCT ticker) AS n FROM bars GROUP BY 1 HAVING count(DISTINCT ticker) >= 24")
def a7_eligible_dates(spark, d):
    return bars(spark, d).groupBy(day("date").alias("date")).agg(F.countDistinct("ticker").alias("n")).where("n >= 24")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def a8_count_pivot(spark, d):
    return table(spark, d, "events").groupBy(day("ts").alias("date")).pivot("event_type", ["click", "error", "purchase"]).count().na.fill(0)


@query("SELECT p_partkey, 'size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def a10_unpivot(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "metric", "value")


@query("SELECT o_orderpriority, CAST(CAST(dt + ((12 - isodow(dt)) % 7) * INTERVAL 1 DAY AS DATE) AS VARCHAR) AS week, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS last, round(sum(o_totalprice), 2) AS total FROM (SELECT *, CAST(o_orderdate AS DATE) AS dt FROM orders) GROUP BY 1, 2")
def a11_weekly_resample(spark, d):
    from ..sources.tables import week_ending_friday

    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority", day(week_ending_friday(F.to_date("o_orderdate"))).alias("week")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates, count(*) FILTER (l_discount > 0.05) AS outside, count(*) - count(l_tax) AS missing, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS newest, CAST(count(*) - count(l_tax) > 0.9 * count(*) AS INTEGER) AS nearly_empty, round(100 * (1 - (count(*) - count(l_tax)) / count(*)) * (1 - (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*)), 6) AS score FROM lineitem")
def a25_quality_counts(spark, d):
    keyed = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("o"), F.count("l_tax").alias("t"), F.max("l_shipdate").alias("s"))
    return keyed.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("o").alias("outside"), (F.sum("n") - F.sum("t")).alias("missing"), day(F.max("s")).alias("newest"), (F.sum("n") - F.sum("t") > 0.9 * F.sum("n")).cast("int").alias("nearly_empty"), rounded(100 * (F.sum("t") / F.sum("n")) * (1 - F.sum(F.col("n") - 1) / F.sum("n"))).alias("score"))


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT count(*) AS outside FROM lineitem, q WHERE l_extendedprice < a - 0.2 * (b - a) OR l_extendedprice > b + 0.2 * (b - a)")
def a27_iqr_outliers(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice")
    q = exact_quantiles(li, [], F.col("l_extendedprice"), [0.25, 0.75])  # one row
    x, a, b = F.col("l_extendedprice"), F.col("q")[0], F.col("q")[1]
    return li.join(F.broadcast(q)).where((x < a - 0.2 * (b - a)) | (x > b + 0.2 * (b - a))).agg(F.count(F.lit(1)).alias("outside"))


@query("WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders) SELECT * EXCLUDE (o_orderdate) FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def k2_latest_row(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("top")).select("o_custkey", "top.o_orderkey", "top.o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def k3_last_rows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def k4_keep_last(spark, d):
    return keep_last(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier")
def u1_union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"))
    return c.unionByName(s, allowMissingColumns=True)


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS dt, 1 AS p, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 UNION ALL SELECT CAST(l_shipdate AS DATE), 2, round(sum(l_extendedprice), 2) FROM lineitem GROUP BY 1) SELECT CAST(dt AS VARCHAR) AS date, p, v FROM a QUALIFY row_number() OVER (PARTITION BY dt ORDER BY p DESC) = 1")
def u2_priority_union(spark, d):
    a = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("dt")).agg(rounded(F.sum("o_totalprice"), 2).alias("v")).withColumn("p", F.lit(1))
    b = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg(rounded(F.sum("l_extendedprice"), 2).alias("v")).withColumn("p", F.lit(2))
    return a.unionByName(b).groupBy("dt").agg(F.max(F.struct("p", "v")).alias("top")).select(day("dt").alias("date"), "top.p", "top.v")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def u3_common_keys(spark, d):
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("SELECT event_id, CAST(CASE isodow(ts) WHEN 5 THEN CAST(ts AS DATE) + 3 WHEN 6 THEN CAST(ts AS DATE) + 2 ELSE CAST(ts AS DATE) + 1 END AS VARCHAR) AS available FROM events")
def f5_next_business_day(spark, d):
    return table(spark, d, "events").select("event_id", day(next_business_day(F.to_date("ts"))).alias("available"))


@query("SELECT p_partkey, upper(regexp_replace(p_brand, 'Brand#', 'B')) AS ticker, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) AS metric FROM part")
def f1_normalized_names(spark, d):
    return table(spark, d, "part").select("p_partkey", normalized_ticker(F.concat(F.when(F.col("p_size") % 2 == 0, "nse: ").otherwise(" "), F.regexp_replace("p_brand", "Brand#", "b"), F.when(F.col("p_size") % 3 == 0, ".NS").otherwise(" "))).alias("ticker"), F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")).alias("metric"))


@query("SELECT page_id, md5(left(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), 'https?://[^ ]+', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g')), 2000)) AS head, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), 'https?://[^ ]+', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g'))) AS n FROM pages")
def f12_stripped_text(spark, d):
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "https?://[^ ]+", " "), "[ \\n\\t\\r]+", " ")
    return table(spark, d, "pages").select("page_id", F.md5(F.left(F.trim(text), F.lit(2000))).alias("head"), F.length(F.trim(text)).cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_object('event', event_type, 'k', CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS payload FROM events")
def f26_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), F.from_json("props", "k long")["k"].alias("k"))).alias("payload"))
