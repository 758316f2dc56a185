"""Streaming twins of batch roll-ups, run over all that the events table holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.storage import new_folder
from ..sources.tables import table
from ..streaming.ordered import EUPHORIA, FEAR, MOVES, OPTIMISM, PANIC, breach_step, in_event_order, regime_step, with_rocks
from ..streaming.rollups import distinct_within, event_stream, followed, in_slices, run_to_table, sessions, slices_to_table, sliding_counts, tumbling_counts
from ..streaming.upserts import enriching, groups, scoring
from .registry import day, query, rounded


def _folder(spark) -> str:
    return new_folder(spark, "stream")


#: Days on which a slice of the events ends.
_CUTS = ("2024-01-11", "2024-01-21")


def _slices(spark, d, cuts=_CUTS):
    """The events in parts, every third one arriving twenty hours late."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 20 HOURS")).otherwise(F.col("ts"))
    place = sum((seen >= F.lit(c).cast("timestamp")).cast("int") for c in cuts)
    return [e.where(place == i) for i in range(len(cuts) + 1)]


@query("WITH x AS (SELECT CAST(ts AS DATE) AS d, event_type, value FROM events) SELECT CAST(d AS VARCHAR) AS date, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x WHERE d + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2")
def st3_tumbling_windows(spark, d):
    """Windows that the watermark has closed, as append mode emits them."""
    rows = run_to_table(tumbling_counts(event_stream(spark, d)), _folder(spark))
    return rows.select(day(F.col("w.start")).alias("date"), "event_type", "n", rounded("total", 4).alias("total"))


@query("SELECT DISTINCT event_id FROM events")
def st6_deduplicated(spark, d):
    stream = event_stream(spark, d)
    return run_to_table(distinct_within(stream.union(stream), ["event_id"], "60 days").select("event_id"), _folder(spark))


@query("SELECT event_type, count(*) AS n, sum(length(event_type) + event_id) AS total FROM events GROUP BY 1")
def st1_event_sink(spark, d):
    """An append-only log whose payload is JSON, read back from the sink."""
    log = event_stream(spark, d).select("event_id", "ts", F.to_json(F.struct("event_type", "user_id")).alias("payload"))
    rows = run_to_table(log, _folder(spark)).withColumn("event_type", F.get_json_object("payload", "$.event_type"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("event_type") + F.col("event_id")).alias("total"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(*) AS n, round(avg(value / (1 + value)), 6) AS mean, round(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS strong FROM events GROUP BY 1, 2")
def st2_incremental_scores(spark, d):
    """Three slices of events, the second one sent again with the third: each event is scored once, and the days and types that a batch touches are upserted."""
    folder, slices = _folder(spark), _slices(spark, d)
    slices[2] = slices[2].unionByName(slices[1])
    score = lambda rows: rows.select("event_id", day("ts").alias("date"), "event_type", "value", (F.col("value") / (1 + F.col("value"))).alias("score"))
    run = scoring(folder, "event_id", score, ["date", "event_type"], [F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg((F.col("value") > 60).cast("double")).alias("strong")])
    in_slices(slices, folder, lambda stream: stream.writeStream.foreachBatch(run))
    return groups(spark, folder, ["date", "event_type"]).select("date", "event_type", "n", rounded("mean").alias("mean"), rounded("strong").alias("strong"))


@query("WITH x AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events), w AS (SELECT d - CAST(k AS INTEGER) AS s, event_type FROM x, (SELECT unnest(range(0, 5)) AS k)) SELECT CAST(CAST(s AS DATE) AS VARCHAR) AS start, event_type, count(*) AS n FROM w WHERE s + 5 <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2")
def st4_sliding_windows(spark, d):
    rows = run_to_table(sliding_counts(event_stream(spark, d), "5 days", "1 day"), _folder(spark))
    return rows.select(day(F.col("w.start")).alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def st5_sessions(spark, d):
    rows = run_to_table(sessions(event_stream(spark, d), "user_id", "6 hours"), _folder(spark))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_ORDERED = "e AS (SELECT event_id, user_id, ts, value, row_number() OVER w AS i, coalesce(ts - lag(ts) OVER w > INTERVAL 2 DAY, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_DUE = "ts <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)"


def log_z(value: str) -> Column:
    """The logarithm of a value as a z; of 0 it is minus infinity, where Spark's is null."""
    x = F.col(value)
    return (F.when(x == 0, float("-inf")).otherwise(F.log(x)) - 3.3) / 1.28


_Z = "((ln(value) - 3.3) / 1.28)"
_RAW = f"CASE WHEN {_Z} < {PANIC} THEN 'panic' WHEN {_Z} < {FEAR} THEN 'fear' WHEN {_Z} < {OPTIMISM} THEN 'neutral' WHEN {_Z} < {EUPHORIA} THEN 'optimism' ELSE 'euphoria' END"
_MOVED = " OR ".join(f"({_RAW} = '{to}' AND {f"regime = '{start}' AND " if start else ''}{_Z} {side} {bound})" for to, start, side, bound in MOVES)


@query(f"WITH RECURSIVE {_ORDERED}, s AS (SELECT user_id, i, {_RAW} AS regime FROM e WHERE i = 1 UNION ALL SELECT user_id, e.i, CASE WHEN fresh OR {_MOVED} THEN {_RAW} ELSE regime END FROM s JOIN e USING (user_id) WHERE e.i = s.i + 1) SELECT event_id, regime FROM s JOIN e USING (user_id, i) WHERE {_DUE}")
def st7_held_regimes(spark, d):
    """Regimes of users by the logarithm of their events' values, in order of time over two slices with late rows; two idle days start a user anew."""
    change = lambda s: in_event_order(s.withColumn("z", log_z("value")), "user_id", "event_id", "z", regime_step, "regime string", "regime string", "2 days", 2 * 86400)
    return with_rocks(spark, lambda: slices_to_table(_slices(spark, d, _CUTS[1:]), _folder(spark), change))


@query(f"""WITH RECURSIVE {_ORDERED}, s AS (SELECT user_id, i, value - 60 AS run, greatest(value - 60, 0) AS peak, CAST(value < 60 AS INTEGER) AS losses, 2 / 21.0 * abs(value - 60) AS size FROM e WHERE i = 1
UNION ALL SELECT user_id, e.i, CASE WHEN fresh THEN 0 ELSE run END + value - 60, CASE WHEN fresh THEN greatest(value - 60, 0) ELSE greatest(peak, run + value - 60) END, CASE WHEN value < 60 THEN CASE WHEN fresh THEN 0 ELSE losses END + 1 ELSE 0 END, CASE WHEN fresh THEN 0 ELSE 19 / 21.0 * size END + 2 / 21.0 * abs(value - 60) FROM s JOIN e USING (user_id) WHERE e.i = s.i + 1),
a AS (SELECT event_id, peak - run AS fall, losses, size, CAST(round(peak - run, 8) > 150 AS INTEGER) + 2 * CAST(losses >= 5 AS INTEGER) + 4 * CAST(size > 45 AS INTEGER) AS alerts FROM s JOIN e USING (user_id, i) WHERE {_DUE})
SELECT event_id, round(fall, 4) AS fall, CAST(losses AS BIGINT) AS losses, round(size, 6) AS size, CAST(alerts AS BIGINT) AS alerts FROM a WHERE alerts > 0""")
def st8_breaches(spark, d):
    """Users whose sum of (value - 60) has fallen by 150 from its peak, who have five losses in a row, or whose smoothed moves pass 45; as st7."""
    step = breach_step(60.0, 150.0, 5, 2 / 21, 45.0)
    change = lambda s: in_event_order(s, "user_id", "event_id", "value", step, "total double, peak double, losses int, size double", "fall double, losses long, size double, alerts long", "2 days", 2 * 86400).where("alerts > 0")
    rows = with_rocks(spark, lambda: slices_to_table(_slices(spark, d, _CUTS[1:]), _folder(spark), change))
    return rows.select("event_id", rounded("fall", 4).alias("fall"), "losses", rounded("size").alias("size"), "alerts")


@query("WITH k AS (SELECT CAST(ts AS DATE) + 1 AS available, event_type, round(avg(value), 6) AS level FROM events WHERE day(ts) % 3 = 0 GROUP BY 1, 2) SELECT event_id, level, CAST(CAST(k.available AS DATE) AS VARCHAR) AS available FROM events e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.ts >= k.available")
def st9_enriched(spark, d):
    """Each event with its type's last level known by then: levels are there for every third day and known from the next, other days take the last one."""
    def features(session):
        e = table(session, d, "events").where(F.dayofmonth("ts") % 3 == 0)
        levels = e.groupBy(F.date_add(F.to_date("ts"), 1).alias("available"), "event_type").agg(rounded(F.avg("value")).alias("level"))
        return levels.select("event_type", F.col("available").cast("timestamp").alias("at"), "level", day("available").alias("available"))

    folder = _folder(spark)
    run = enriching(folder, features, "event_type", "ts", "at", ["level", "available"], 7)
    in_slices(_slices(spark, d), folder, lambda stream: stream.select("event_id", "event_type", "ts").writeStream.foreachBatch(run))
    return spark.read.parquet(f"{folder}/rows").select("event_id", "level", "available")


@query("SELECT a.event_id AS first, b.event_id AS then FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def st10_interval_join(spark, d):
    kind = lambda k: event_stream(spark, d).where(F.col("event_type") == k)
    return run_to_table(followed(kind("view"), kind("purchase"), "user_id", "12 HOURS"), _folder(spark))
