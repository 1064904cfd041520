"""Z-score anomalies over tumbling windows: against the whole key and against a trailing range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 3.0


def windowed_totals(rows: DataFrame, time: str, key: str, value: str, width: str = "5 minutes") -> DataFrame:
    """``(key, window_start, n, total)`` per tumbling window."""
    totals = rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return totals.select(key, F.col("window.start").alias("window_start"), "n", "total")


def _score(total: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (total - mean) / deviation)


def _flagged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("anomaly", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def zscore_anomalies(
    rows: DataFrame, time: str, key: str, value: str, width: str = "5 minutes", threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Windows scored against mean and sample deviation of all windows of their key.

    A key without spread scores null and is no anomaly.
    """
    totals = windowed_totals(rows, time, key, value, width)
    # One row per key and time window is left here: an analytic window spares a second read of the raw rows.
    whole = Window.partitionBy(key)
    scored = totals.withColumn("mean", F.avg("total").over(whole)).withColumn(
        "deviation", F.stddev_samp("total").over(whole)
    )
    return _flagged(scored.withColumn("z", _score(F.col("total"), F.col("mean"), F.col("deviation"))), threshold)


def trailing_zscore(
    rows: DataFrame, time: str, key: str, value: str, width: str, history: int, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Windows scored against the ``history`` windows before them.

    The ordered window sees one row per key and time window, never the raw rows.
    """
    totals = windowed_totals(rows, time, key, value, width)
    before = Window.partitionBy(key).orderBy("window_start").rowsBetween(-history, -1)
    scored = totals.withColumn("mean", F.avg("total").over(before)).withColumn(
        "deviation", F.stddev_samp("total").over(before)
    )
    return _flagged(scored.withColumn("z", _score(F.col("total"), F.col("mean"), F.col("deviation"))), threshold)
