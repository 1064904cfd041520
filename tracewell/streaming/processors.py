"""Stateful stream operators on state variables and timers: lifecycle watch, running z-scores, one chained flow."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators.anomaly import DEFAULT_THRESHOLD, windowed_totals
from tracewell.operators.lifecycle import ALLOWED_MOVES, TERMINAL_STATES

ALERTS = "correlation_id string, problem string, state string, at timestamp"
FIRST_STATE = "INITIALIZED"  # Fixed value: the state before any move.


def _millis(at: datetime) -> int:
    return int(at.timestamp() * 1000) if at.tzinfo else int(at.replace(tzinfo=timezone.utc).timestamp() * 1000)


class LifecycleWatch(StatefulProcessor):
    """Per open request: its state, a timer, and the moves of a batch in a map while they are read.

    Rows come one by one and go to the map; what is held in memory is the moves' times and numbers, never a frame.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, due long")
        self.moves = handle.getMapState("moves", "at long, seq long, number long", "state_from string, state_to string, occurred_at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        order, horizon = [], timerValues.getCurrentWatermarkInMs()
        for number, row in enumerate(rows):
            if _millis(row["occurred_at"]) < horizon:
                continue
            place = (int(pd.Timestamp(row["occurred_at"]).value // 1000), row["seq"] or 0, number)
            self.moves.updateValue(place, (row["state_from"], row["state_to"], row["occurred_at"]))
            order.append(place)
        if not order:
            return
        current, due = self.now.get() if self.now.exists() else (FIRST_STATE, None)
        if due is not None:
            self.handle.deleteTimer(due)
            if due <= horizon:  # rows and timer came in one batch: the time ran out before these rows
                yield self._stuck(key, current, horizon)
                current = FIRST_STATE
        at = None
        for place in sorted(order):
            state_from, state_to, at = self.moves.getValue(place)
            self.moves.removeKey(place)
            if (state_from, state_to) not in ALLOWED_MOVES or state_from != current:
                yield Row(correlation_id=key[0], problem="illegal", state=state_to, at=at)
            current = state_to
        if current in TERMINAL_STATES:
            self.now.clear()
            return
        due = max(_millis(at) + self.wait_ms, horizon + 1)
        self.now.update((current, due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state, _ = self.now.get()
        self.now.clear()
        yield self._stuck(key, state, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _stuck(key: Any, state: str, horizon: int) -> Row:
        return Row(correlation_id=key[0], problem="stuck", state=state, at=datetime.fromtimestamp(horizon / 1000, timezone.utc).replace(tzinfo=None))

    def close(self) -> None:
        pass


def lifecycle_watch(transitions: DataFrame, patience: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Illegal moves, and requests that reach no final state within ``patience`` of event time, as they come.

    ``transitions(correlation_id, seq, state_from, state_to, occurred_at)``; rows older than the watermark are dropped.
    State ends with the final state or with the alert; a request that goes on after its alert starts anew.
    """
    watch = LifecycleWatch(int(pd.Timedelta(patience).total_seconds() * 1000))
    keyed = transitions.withWatermark("occurred_at", watermark).groupBy("correlation_id")
    return keyed.transformWithState(statefulProcessor=watch, outputStructType=ALERTS, outputMode="append", timeMode="EventTime")


class RunningScores(StatefulProcessor):
    """Count, mean and sum of squared differences of a key's windows. A key without windows for ``idle_ms`` of event
    time is forgotten."""

    def __init__(self, key: str, threshold: float, idle_ms: int) -> None:
        self.key, self.threshold, self.idle_ms = key, threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", "n long, mean double, spread double, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        count, mean, spread, due = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, None)
        # A key closes few windows in a batch: these are totals, not raw rows.
        closed = sorted((row["window_start"], row["total"], row["n"]) for row in rows)
        for start, total, n in closed:
            deviation = math.sqrt(spread / (count - 1)) if count > 1 else 0.0
            z = (total - mean) / deviation if deviation > 0 else None
            count += 1
            step = total - mean
            mean += step / count
            spread += step * (total - mean)
            yield Row(**{self.key: key[0], "window_start": start, "n": n, "total": total, "z": z, "anomaly": z is not None and abs(z) > self.threshold})
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(_millis(closed[-1][0]), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.moments.update((count, mean, spread, due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.moments.clear()
        return iter(())

    def close(self) -> None:
        pass


def anomaly_stream(
    rows: DataFrame, time: str, key: str, value: str, width: str = "5 minutes", threshold: float = DEFAULT_THRESHOLD,
    watermark: str = "10 minutes", idle: str = "30 days",
) -> DataFrame:
    """Rows to closed windows to z-scores against all earlier windows of the key, chained in one query.

    One checkpoint covers both steps, so a restart resumes both; with :func:`tracewell.sources.sinks.dual_write` as
    ``foreachBatch`` the scores reach two sinks or none.
    """
    timed = rows.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, watermark)
    totals = timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    closed = totals.select(key, F.col("window.start").alias("window_start"), F.window_time("window").alias("closed_at"), "n", "total")
    scores = RunningScores(key, threshold, int(pd.Timedelta(idle).total_seconds() * 1000))
    schema = f"{key} string, window_start timestamp, n long, total double, z double, anomaly boolean"
    return closed.groupBy(key).transformWithState(
        statefulProcessor=scores, outputStructType=schema, outputMode="append", timeMode="EventTime")


def batch_scores(rows: DataFrame, time: str, key: str, value: str, width: str = "5 minutes", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """What :func:`anomaly_stream` gives for all windows, as one query over a table."""
    from pyspark.sql import Window

    totals = windowed_totals(rows.filter(F.col(time).isNotNull() & F.col(key).isNotNull()), time, key, value, width).withColumn("total", F.col("total").cast("double"))
    before = Window.partitionBy(key).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    deviation = F.stddev_samp("total").over(before)
    z = F.when(deviation > 0, (F.col("total") - F.avg("total").over(before)) / deviation)
    return totals.withColumn("z", z).withColumn("anomaly", F.coalesce(F.abs("z") > threshold, F.lit(False)))
