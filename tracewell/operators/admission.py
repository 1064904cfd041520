"""Token-bucket admission replayed over a call log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.ordered import previous_value, running_last


class Bucket:
    """Tokens left and the time of the last call; starts full."""

    def __init__(self, rate: float, capacity: float, tokens: float | None = None, last: float | None = None) -> None:
        self.rate, self.capacity = rate, capacity
        self.tokens = capacity if tokens is None else tokens
        self.last = last

    def admit(self, at: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + max(0.0, at - self.last) * self.rate)
        self.last = at
        admitted = self.tokens >= 1
        self.tokens -= admitted
        return admitted


def busy_periods(calls: DataFrame, key: str, time: str, order: tuple[str, ...], idle: float, bucket: Column) -> DataFrame:
    """Calls with ``period``, the start of their busy period.

    A pause of ``idle`` seconds refills any bucket, so what follows it does not depend on what went before:
    periods of one key can be replayed in different tasks.
    """
    keyed = calls.withColumn("_bucket", bucket)
    by = [time, *order]
    chained = previous_value(keyed, [key], "_bucket", by, F.col(time), "_previous")
    seconds = F.col(time).cast("double") - F.col("_previous").cast("double")
    opened = chained.withColumn(
        "_opening", F.when(F.col("_previous").isNull() | (seconds >= idle), F.struct(*by))
    )
    return running_last(opened, [key], "_bucket", by, "_opening", "period").drop("_previous", "_opening", "_bucket")


def token_bucket(
    calls: DataFrame, key: str, time: str, order: tuple[str, ...], rate: float, capacity: float | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Calls plus ``admitted``: a full bucket of ``capacity`` tokens per key, ``rate`` new ones a second.

    ``capacity`` defaults to ``rate``. Within one busy period each decision depends on the one before, so a
    period is streamed through one task in time order with the bucket as its only state.
    """
    capacity = rate if capacity is None else capacity
    if rate <= 0 or capacity <= 0:
        raise ValueError("rate and capacity must be positive")
    bucket = F.date_trunc("hour", time) if bucket is None else bucket
    periods = busy_periods(calls, key, time, order, capacity / rate, bucket)
    schema = T.StructType([*calls.schema.fields, T.StructField("admitted", T.BooleanType())])
    columns = calls.columns

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Bucket(rate, capacity)
        for frame in frames:
            decisions = []
            for group, at in zip(frame["_period"], frame["_at"], strict=True):
                if group != current:
                    current, state = group, Bucket(rate, capacity)
                decisions.append(state.admit(at))
            yield frame[columns].assign(admitted=decisions)

    seconds = F.col(time).cast("timestamp").cast("double").alias("_at")
    period_name = F.concat_ws("|", F.col(key).cast("string"), F.to_json("period"))
    grouped = periods.select(*columns, seconds, period_name.alias("_period"))
    in_order = grouped.repartition("_period").sortWithinPartitions("_period", time, *order)
    return in_order.mapInPandas(replay, schema)
