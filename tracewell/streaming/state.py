"""Stateful streams: lifecycle checks, admission, running z-scores, read models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.admission import Bucket
from tracewell.operators.lifecycle import ALLOWED_MOVES, TERMINAL_STATES
from tracewell.sources.keyed import KeyedTable
from tracewell.sources.sinks import BatchSink

ALERTS = "correlation_id string, problem string, state string, at timestamp"


def lifecycle_alerts(transitions: DataFrame, patience: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Illegal moves, and requests that reach no final state within ``patience`` (event time).

    ``transitions(correlation_id, seq, state_from, state_to, occurred_at)``. State is one name per open
    request; it ends with the final state or with the alert.
    """
    wait_ms = int(pd.Timedelta(patience).total_seconds() * 1000)

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = []
        current = state.get[0] if state.exists else "INITIALIZED"
        if state.hasTimedOut:
            at = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            found.append((key[0], "stuck", current, at))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["occurred_at", "seq"])
            for move in rows.itertuples():
                if (move.state_from, move.state_to) not in ALLOWED_MOVES or move.state_from != current:
                    found.append((key[0], "illegal", move.state_to, move.occurred_at))
                current = move.state_to
            if current in TERMINAL_STATES:
                if state.exists:
                    state.remove()
            else:
                state.update((current,))
                due = int(rows["occurred_at"].max().timestamp() * 1000) + wait_ms
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["correlation_id", "problem", "state", "at"])

    watched = transitions.withWatermark("occurred_at", watermark).groupBy("correlation_id")
    return watched.applyInPandasWithState(check, ALERTS, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def admissions(calls: DataFrame, rate: float, capacity: float | None = None) -> DataFrame:
    """Token-bucket decisions on a stream of ``(key, call_id, at)``; state is two numbers per key."""
    capacity = rate if capacity is None else capacity

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        bucket = Bucket(rate, capacity, tokens, last)
        rows = pd.concat(list(frames)).sort_values(["at", "call_id"])
        decisions = [bucket.admit(at.timestamp()) for at in rows["at"]]
        state.update((bucket.tokens, bucket.last))
        yield rows[["key", "call_id", "at"]].assign(admitted=decisions)

    return calls.select("key", "call_id", "at").groupBy("key").applyInPandasWithState(
        decide, "key string, call_id string, at timestamp, admitted boolean", "tokens double, last double",
        "append", GroupStateTimeout.NoTimeout,
    )


def running_zscores(totals: DataFrame, key: str, threshold: float = 3.0) -> DataFrame:
    """Closed windows ``(key, window_start, total)`` scored against all windows of their key before them.

    Run it on the files a window query has written: the engine allows no custom state after an aggregation
    in one query. State is count, mean and sum of squared differences per key.
    """

    def score(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, mean, spread = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("window_start")
        scores = []
        for total in rows["total"]:
            deviation = math.sqrt(spread / (count - 1)) if count > 1 else 0.0
            scores.append((total - mean) / deviation if deviation > 0 else None)
            count += 1
            step = total - mean
            mean += step / count
            spread += step * (total - mean)
        state.update((count, mean, spread))
        scored = rows[[key, "window_start", "total"]].assign(z=pd.Series(scores, index=rows.index, dtype="float64"))
        yield scored.assign(anomaly=(scored["z"].abs() > threshold).astype(bool))

    schema = f"{key} string, window_start timestamp, total double, z double, anomaly boolean"
    return totals.select(key, "window_start", "total").groupBy(key).applyInPandasWithState(
        score, schema, "n long, mean double, spread double", "append", GroupStateTimeout.NoTimeout
    )


def state_table(spark: SparkSession, path: str) -> KeyedTable:
    """Read model: the current state per request."""
    schema = "correlation_id string, state_to string, occurred_at timestamp, seq long"
    return KeyedTable(spark, path, schema, "correlation_id", ("occurred_at", "seq"))


def project_states(path: str) -> BatchSink:
    """``foreachBatch`` function of the read model: each batch is merged into one generation. A replay changes nothing."""
    return lambda df, batch_id: state_table(df.sparkSession, path).merge(df, batch_id)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Current state per request over all projected batches."""
    return state_table(spark, path).rows()
