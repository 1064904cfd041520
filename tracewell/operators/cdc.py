"""Change-data envelopes to current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.schemas import CDC_ENVELOPE
from tracewell.sources.keyed import KeyedTable


def parse_changes(raw: DataFrame, value: str = "value", schema: T.StructType = CDC_ENVELOPE) -> DataFrame:
    """``(before, after, op, ts_ms, source)`` from JSON envelopes, parsed once however many fields are used."""
    return raw.select(F.inline(F.array(F.from_json(F.col(value).cast("string"), schema))))


def apply_changes(changes: DataFrame, key: str) -> DataFrame:
    """Current rows: the latest change per key by (ts_ms, lsn), deleted keys left out.

    Create, update and snapshot read all count as "this is the row now". Merges per task, so a key with very
    many changes costs one row per task.
    """
    row = F.coalesce("after", "before")
    order = F.struct("ts_ms", F.col("source.lsn").alias("lsn"))
    latest = changes.groupBy(row[key].alias("row_key")).agg(
        F.max_by(F.struct(F.col("op"), F.col("after")), order).alias("latest")
    )
    return latest.filter("latest.op <> 'd'").select("latest.after.*")


def change_rows(changes: DataFrame, key: str) -> DataFrame:
    """``(row_key, ts_ms, lsn, op, row)``: changes in the form :func:`change_table` merges; keys as text."""
    row = F.coalesce("after", "before")
    return changes.select(row[key].cast("string").alias("row_key"), "ts_ms", F.col("source.lsn").alias("lsn"), "op", F.col("after").alias("row"))


def change_table(spark: SparkSession, folder: str, schema: T.StructType = CDC_ENVELOPE) -> KeyedTable:
    """Current rows as a stored table. A delete stays: an older change that comes late does not undo it."""
    rows = T.StructType([
        T.StructField("row_key", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("lsn", T.LongType()),
        T.StructField("op", T.StringType()), T.StructField("row", schema["after"].dataType)])
    return KeyedTable(spark, folder, rows, "row_key", ("ts_ms", "lsn"), "op = 'd'")
