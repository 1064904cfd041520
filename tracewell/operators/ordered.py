"""Ordered calculations per key that never sort one key in one task.

A window over a key puts the whole key into one task. These helpers work on (key, bucket) pieces instead,
where the bucket cuts the order into ranges, and carry one small row per piece to the next bucket. Keys and
buckets are not null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_carry(df: DataFrame, keys: list[str], bucket: str, carry: DataFrame) -> DataFrame:
    """Both sides hash by (key, bucket), the layout the window after this join needs anyway."""
    by = [*keys, bucket]
    other = carry.select(*[F.col(name).alias(f"_carry_{name}") for name in by], "_carry")
    matches = reduce(lambda a, b: a & b, [F.col(name) == F.col(f"_carry_{name}") for name in by])
    return df.join(other, matches, "left").drop(*[f"_carry_{name}" for name in by])


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this one."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _with_carry(df, keys, bucket, totals)
    return joined.withColumn(out, F.coalesce("_carry", F.lit(0)) + F.sum(value).over(within)).drop("_carry")


def previous_value(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``value`` of the row before this one in the key's order; null for the first row."""
    kept = df.withColumn(out, F.struct(value.alias("v")))
    last = kept.groupBy(*keys, bucket).agg(F.max_by(out, F.struct(*order)).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(bucket)
    carry = last.withColumn("_carry", F.lag("_last").over(earlier)).drop("_last")
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    joined = _with_carry(kept, keys, bucket, carry)
    previous = F.coalesce(F.lag(out).over(within), F.col("_carry"))
    return joined.withColumn(out, previous).withColumn(out, F.col(out)["v"]).drop("_carry")


def running_last(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Latest non-null ``value`` of the key up to and including this row."""
    last = df.groupBy(*keys, bucket).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _with_carry(df, keys, bucket, carry)
    return joined.withColumn(
        out, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carry"))
    ).drop("_carry")
