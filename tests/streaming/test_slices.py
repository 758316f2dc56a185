"""Streams fed as several files, late rows among them, against plain loops; replayed batches change nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitloom.plans.streams import log_z
from pitloom.sources.storage import new_folder
from pitloom.streaming.ordered import MOVES, breach_step, in_event_order, regime_step, with_rocks
from pitloom.streaming.rollups import in_slices, slices_to_table
from pitloom.streaming.upserts import enriching, groups, scores, scoring

HOUR = 3_600_000_000
START = 20_000 * 24 * HOUR


def regimes(z):
    """The same, row by row."""
    bounds, names, now, out = [-2, -0.5, 0.5, 2], ["panic", "fear", "neutral", "optimism", "euphoria"], "none", []
    for v in z:
        if not np.isnan(v):
            raw = names[sum(v >= b for b in bounds)]
            if now == "none" or any(raw == to and start in ("", now) and (v > b if side == ">" else v < b) for to, start, side, b in MOVES):
                now = raw
        out.append(now)
    return out


def test_regime_step():
    """First by range; a switch needs the buffer; fear is reached from panic alone."""
    z = np.array([np.nan, 0.6, 0.3, 0.24, -0.6, -2.1, -2.3, -1.9, -1.7, -0.3, -0.2, 0.7, 0.8, 2.1, 2.3, 1.0])
    state, out = regime_step(None, np.arange(len(z)), z)
    assert list(out["regime"]) == ["none", "optimism", "optimism", "neutral", "neutral", "neutral", "panic", "panic", "fear", "fear", "neutral", "neutral", "optimism", "optimism", "euphoria", "euphoria"]
    rng = np.random.default_rng(1)
    z = np.where(rng.random(3000) < 0.05, np.nan, rng.normal(0, 1.5, 3000))
    state, whole, at = None, [], np.arange(3000)
    for a in range(0, 3000, 700):
        state, out = regime_step(state, at[a : a + 700], z[a : a + 700])
        whole += list(out["regime"])
    assert whole == regimes(z)


def test_breach_step():
    rng = np.random.default_rng(2)
    v = np.where(rng.random(500) < 0.1, np.nan, rng.normal(0, 10, 500))
    total = peak = size = 0.0
    losses, want = 0, []
    for x in v:
        if not np.isnan(x):
            total, losses, size = total + x, losses + 1 if x < 0 else 0, 0.9 * size + 0.1 * abs(x)
            peak = max(peak, total)
        want.append((peak - total, losses, size, (peak - total > 60) + 2 * (losses >= 4) + 4 * (size > 8)))
    step, state, got = breach_step(0.0, 60.0, 4, 0.1, 8.0), None, []
    for a in (0, 1, 200):
        b = {0: 1, 1: 200, 200: 500}[a]
        state, out = step(state, np.arange(a, b), v[a:b])
        got += list(zip(*(out[c] for c in ("fall", "losses", "size", "alerts"))))
    assert np.allclose(got, want)


def test_order_over_many_files(spark):
    """Six files, rows up to a day late, a null key, ties, a gap that starts a key anew; the answer is that of one sorted pass."""
    rng, rows = np.random.default_rng(3), []
    for key in (1, 2, None):
        at = START + np.sort(rng.integers(0, 20 * 24, 70)) * HOUR
        at[60:] += 6 * 24 * HOUR * (key == 1)
        rows += [(key, int(t), None if rng.random() < 0.1 else float(rng.normal(0, 1.5))) for t in at]
    rows = [(k, i, t, z) for i, (k, t, z) in enumerate(rows)]
    last, due, want = max(t for _, _, t, _ in rows), {}, {}
    for key in (1, 2, None):
        mine = sorted((t, i, np.nan if z is None else z) for k, i, t, z in rows if k == key)
        run = []
        for j, (t, i, z) in enumerate(mine):
            if j and t - mine[j - 1][0] > 3 * 24 * HOUR:
                run = []
            run.append(z)
            want[i] = regimes(run)[-1]
            due[i] = t <= last - 2 * 24 * HOUR
    df = spark.createDataFrame(rows, "k long, id long, at long, z double").withColumn("ts", F.timestamp_micros("at"))
    seen = F.col("at") + F.when(F.col("id") % 4 == 0, 23 * HOUR).otherwise(0)
    place = F.least(F.floor((seen - START) / (3.5 * 24 * HOUR)), F.lit(5))
    change = lambda s: in_event_order(s, "k", "id", "z", regime_step, "regime string", "regime string", "2 days", 3 * 86400)
    folder = new_folder(spark)
    got = with_rocks(spark, lambda: slices_to_table([df.where(place == i) for i in range(6)], folder, change)).collect()
    assert {r.id: r.regime for r in got} == {i: v for i, v in want.items() if due[i]} and len(got) == sum(due.values())


@pytest.fixture()
def slices(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"2024-01-{1 + i % 5:02d}", float(i)) for i in range(40)] + [(None, "a", "2024-01-01", 1.0)], "id long, kind string, date string, value double")
    return [df.where("id < 15"), df.where("id >= 10 and id < 30 or id is null"), df.where("id >= 25")]


def test_replayed_batches_change_nothing(spark, slices):
    folder = new_folder(spark)
    run = scoring(folder, "id", lambda d: d.withColumn("score", F.col("value") * 2), ["date", "kind"], [F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")])
    in_slices(slices, folder, lambda s: s.writeStream.foreachBatch(run))
    state = lambda: (sorted(map(str, scores(spark, folder).collect())), sorted(map(str, groups(spark, folder, ["date", "kind"]).collect())))
    first = state()
    whole = slices[0].union(slices[1]).union(slices[2]).distinct().groupBy("date", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * 2).alias("total"))
    assert first[1] == sorted(map(str, whole.select("date", "kind", "n", "total").collect()))
    run(slices[2], 2)  # the batch that was under way when the driver was lost
    run(slices[2], 2)
    assert state() == first and len(first[0]) == 41
    run(slices[0].limit(0), 3)
    assert state() == first


def test_enriching(spark):
    """Last features at or before the event, none before the first, none for a null key; a replay writes the same rows."""
    day = lambda n, h=0: F.timestamp_micros(F.lit((n * 24 + h) * HOUR))
    known = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit("a").alias("k"), day(n).alias("at"), F.lit(float(n)).alias("v")) for n in (2, 5, 40)))).alias("x")).select("x.*")
    events = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(k).alias("k"), day(n, h).alias("ts")) for i, (k, n, h) in enumerate([("a", 1, 0), ("a", 2, 0), ("a", 4, 23), ("a", 39, 0), ("b", 9, 0), (None, 9, 0), ("a", 41, 1)])))).alias("x")).select("x.*")
    folder = new_folder(spark)
    run = enriching(folder, lambda _: known, "k", "ts", "at", ["v"], 7)
    in_slices([events.where("id < 3"), events.where("id >= 3")], folder, lambda s: s.writeStream.foreachBatch(run))
    run(events.where("id >= 3"), 1)
    got = {r.id: r.v for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {0: None, 1: 2.0, 2: 2.0, 3: 5.0, 4: None, 5: None, 6: 40.0}
    assert spark.read.parquet(f"{folder}/rows").count() == 7


def test_fall_that_equals_its_limit():
    """Cents that have fallen by the limit exactly are no breach, wherever batches end."""
    rng = np.random.default_rng(7)
    for size in rng.integers(1, 40, 200).tolist():
        v = np.round(rng.uniform(0, 200, 40), 2)
        run = np.cumsum(np.round(100 * v).astype(int) - 6000)
        fall = np.maximum.accumulate(np.maximum(run, 0)) - run
        limit = int(fall.max())
        step, state, got = breach_step(60.0, limit / 100, 99, 0.1, 1e9), None, []
        for a in range(0, 40, size):
            state, out = step(state, np.arange(len(v[a : a + size])), v[a : a + size])
            got += out["alerts"].tolist()
        assert not any(got)


def test_logarithm_of_zero(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (None,)], "value double").select(log_z("value").alias("z")).collect()
    assert [r.z for r in rows] == [-np.inf, -3.3 / 1.28, None]
    assert list(regime_step(None, np.arange(3), np.array([0.0, -np.inf, 1.0]))[1]["regime"]) == ["neutral", "panic", "panic"]
