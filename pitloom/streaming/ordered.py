"""State of a key that takes its events in order of time, however they arrive.

Events wait in the key's state until the watermark has passed them; a timer
then hands those that are due, sorted by time, to a step.  So the result
doesn't depend on how events fall into micro-batches, as long as none comes
later than the watermark allows (Spark drops those).  A gap longer than
`idle` starts a key anew, and a timer removes the state of a key once the
watermark lies that far beyond its last event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.scans import compose

#: Takes a key's state (None at first), event times in microseconds and values; returns the new state and the result columns.
Step = Callable[[tuple | None, np.ndarray, np.ndarray], tuple[tuple, dict[str, np.ndarray]]]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    def __init__(self, step: Step, state: str, columns: Sequence[str], idle: int):
        self.step, self.schema, self.columns, self.idle = step, state, columns, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, value double")
        self.known = handle.getValueState("known", f"_last long, {self.schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(list(zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["value"].astype(float).tolist())))
                low = int(pdf["at"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pd.DataFrame(list(self.waiting.get()), columns=["at", "id", "value"])
        due, rest = waiting[waiting["at"] <= mark].sort_values(["at", "id"]), waiting[waiting["at"] > mark]
        known = self.known.get() if self.known.exists() else None
        last, state = (known[0], tuple(known[1:])) if known else (None, None)
        if len(due):
            at = due["at"].to_numpy(np.int64)
            gap = np.diff(at, prepend=at[0] if last is None else last)
            cuts = np.flatnonzero(gap > self.idle)
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if a == b:
                    continue
                state = None if a in cuts else state
                state, out = self.step(state, at[a:b], due["value"].to_numpy(float)[a:b])
                yield pd.DataFrame({"id": due["id"].to_numpy(np.int64)[a:b], **out})[["id", *self.columns]]
            last = int(at[-1])
            if len(rest):
                self.waiting.put(list(zip(rest["at"].tolist(), rest["id"].tolist(), rest["value"].tolist())))
            else:
                self.waiting.clear()
            self.known.update((last, *state))
        if len(rest):
            self._wake(int(rest["at"].min()))
        elif last is not None and last + self.idle <= mark:
            self.known.clear()
        elif last is not None:
            self._wake(last + self.idle)

    def _wake(self, at: int) -> None:
        """One timer a key: at the earliest time asked for."""
        at = -(-at // 1000)
        for t in list(self.handle.listTimers()):
            if t <= at:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def in_event_order(events: DataFrame, key: str, event_id: str, value: str, step: Step, state: str, output: str, late: str, idle_seconds: int) -> DataFrame:
    """(event_id, columns of output) of a stream with a `ts`: each event once the watermark, so late, has passed it.

    state and output are DDL of what the step keeps and returns.  Null values
    reach the step as NaN; null keys are a key; null times take no part, and times
    up to 1970-01-01, where watermarks start, are late from the first.  The
    result must be started through with_rocks, which names the store that such
    state needs.
    """
    names = [c.split()[0] for c in output.split(", ")]
    rows = events.where("ts is not null").withWatermark("ts", late)
    rows = rows.select(F.to_json(F.struct(key)).alias("by"), "ts", F.unix_micros("ts").alias("at"), F.col(event_id).cast("long").alias("id"), F.col(value).cast("double").alias("value"))  # Spark hands frames over as named tuples: no leading underscores
    processor = _InOrder(step, state, names, idle_seconds * 1_000_000)
    found = rows.groupBy("by").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"id long, {output}", outputMode="Append", timeMode="EventTime")
    return found.select(F.col("id").alias(event_id), *names)


def with_rocks(spark, run: Callable):
    """run() with the state store that processors with timers need; the session's own setting comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(_PROVIDER, before)


#: Bounds of panic, fear, optimism and euphoria, and what must be crossed beyond one to switch.
PANIC, FEAR, OPTIMISM, EUPHORIA, BUFFER = -2.0, -0.5, 0.5, 2.0, 0.25
#: The moves allowed, (to, from or '' for any, '>' or '<', what z must pass).  A z that lies in another regime's range without such a move changes nothing.
MOVES = (
    ("panic", "", "<", PANIC - BUFFER),
    ("fear", "panic", ">", PANIC + BUFFER),
    ("neutral", "fear", ">", FEAR + BUFFER),
    ("neutral", "optimism", "<", OPTIMISM - BUFFER),
    ("optimism", "neutral", ">", OPTIMISM + BUFFER),
    ("euphoria", "", ">", EUPHORIA + BUFFER),
)
NAMES = ("panic", "fear", "neutral", "optimism", "euphoria")
_BOUNDS = np.array([PANIC, FEAR, OPTIMISM, EUPHORIA])


def regime_step(state: tuple | None, at: np.ndarray, z: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
    """Five regimes with hysteresis: the first z sets one by its range, later ones by MOVES; NaN keeps what is ('none' before the first)."""
    raw = np.searchsorted(_BOUNDS, z, side="right")
    allowed = np.zeros((len(z), 5), bool)  # whether a row's z lets a key go from a regime to the raw one
    for to, start, side, bound in MOVES:
        fits = (raw == NAMES.index(to)) & ((z > bound) if side == ">" else (z < bound))
        allowed[fits] |= [start in ("", name) for name in NAMES]
    now, out = (NAMES.index(state[0]) if state and state[0] != "none" else -1), np.empty(len(z), np.int64)
    for i, (r, known) in enumerate(zip(raw.tolist(), ~np.isnan(z))):
        if known and (now < 0 or allowed[i, now]):
            now = r
        out[i] = now
    names = np.array(["none", *NAMES], object)[out + 1]
    return (str(names[-1]),), {"regime": names}


def breach_step(start: float, limit: float, losses: int, alpha: float, spread: float) -> Step:
    """A running sum of (value - start), its fall below its peak, the losses in a row and the smoothed size of the moves; `alerts` adds 1, 2 and 4 for each that is past its bound.  NaN moves nothing and ends no row of losses.  Falls are rounded to eight digits before they meet their limit, as sums from different starts differ in their last ones."""
    def step(state: tuple | None, at: np.ndarray, value: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
        total, peak, streak, size = state or (0.0, 0.0, 0, 0.0)
        known = ~np.isnan(value)
        move = np.where(known, value - start, 0.0)
        run = total + np.cumsum(move)
        top = np.maximum(np.maximum.accumulate(run), peak)
        loss = known & (move < 0)
        ends = np.maximum.accumulate(np.where(known & ~loss, np.arange(len(move)), -1))
        count = np.cumsum(loss)
        row = count - np.where(ends >= 0, count[ends], -streak)
        weight, add = compose(np.where(known, 1 - alpha, 1.0), np.where(known, alpha * np.abs(move), 0.0))
        smooth = add + weight * size
        alerts = (np.round(top - run, 8) > limit) * 1 + (row >= losses) * 2 + (smooth > spread) * 4
        return (float(run[-1]), float(top[-1]), int(row[-1]), float(smooth[-1])), {"fall": top - run, "losses": row.astype(np.int64), "size": smooth, "alerts": alerts.astype(np.int64)}

    return step
