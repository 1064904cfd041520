"""Sinks: event messages, audit objects, windowed files, two sinks at once, copies by topic."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.boundary import assert_safe
from tracewell.functions.canonical import canonical_json, message_headers, partition_key
from tracewell.operators.events import matching_topics
from tracewell.sources.commits import CommitLog

# Producer settings of the event sink.
KAFKA_PRODUCER = {
    "kafka.acks": "all", "kafka.retries": "3", "kafka.enable.idempotence": "true",
    "kafka.compression.type": "zstd", "kafka.linger.ms": "5",
}
BatchSink = Callable[[DataFrame, int], None]


def to_messages(
    events: DataFrame, key: str, traceparent: Column | None = None, extra_headers: Column | None = None
) -> DataFrame:
    """``(topic, key, value, headers)`` of events of one type. The job fails before an unsafe value leaves."""
    with_headers = events.withColumn("message_headers", message_headers(events, traceparent, extra_headers))
    safe = assert_safe(with_headers, key, headers="message_headers")
    return safe.select(
        "topic", F.encode(partition_key(safe), "UTF-8").alias("key"),
        F.encode(canonical_json(safe, events.columns), "UTF-8").alias("value"),
        F.col("message_headers").alias("headers"),
    )


def write_messages(messages: DataFrame, servers: str | None = None, path: str | None = None, **options: str) -> None:
    """Messages to Kafka, or to Parquet files with the same columns."""
    if servers:
        writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
        writer.option("includeHeaders", "true").options(**{**KAFKA_PRODUCER, **options}).save()
    else:
        messages.write.mode("append").parquet(path)


def ordered_by_key(events: DataFrame, time: str = "occurred_at") -> DataFrame:
    """Events of a key in time order, for file sinks that keep the broker's order.

    Files are ranges of (key, time): the files of a busy key follow one another, none holds it all.
    """
    keyed = events.withColumn("_key", partition_key(events))
    return keyed.repartitionByRange("_key", time).sortWithinPartitions("_key", time).drop("_key")


def replicate_topics(messages: DataFrame, write: Callable[[DataFrame], None], pattern: str = r"^payments\..*") -> None:
    """Copy matching topics with key, value and headers as they are."""
    write(matching_topics(messages, pattern))


def write_audit(objects: DataFrame, path: str, batch: str | None = None) -> bool:
    """Create-only append of audit objects, partitioned by category and day; False if ``batch`` was written before.

    Objects are made once, into a staged folder that no reader sees; a commit record makes it part of the sink. Keys
    that are already stored are left as they are. Of two writers one commits second: it compares its staged keys with
    what the other has added and drops those that are there now. A crash before the commit leaves nothing behind but
    the staged folder. A key that occurs twice in one batch fails the job: two records must never share a key.
    """
    spark = objects.sparkSession
    log = CommitLog(spark, f"{path}/commits")
    rest = [name for name in objects.columns if name != "object_key"]
    once = objects.groupBy("object_key").agg(F.count("*").alias("copies"), F.max(F.struct(*rest)).alias("object"))
    twice = F.raise_error(F.concat(F.lit("duplicate audit key "), F.col("object_key"))).cast("boolean")
    fresh = once.filter(F.when(F.col("copies") == 1, F.lit(True)).otherwise(twice)).select("object_key", "object.*")
    staged = _stage_audit(fresh, path)
    while True:
        numbers = log.numbers()
        records = [log.read(number) for number in numbers]
        if batch is not None and any(record["batch"] == batch for record in records):
            log.remove(f"{path}/data/commit={staged}")
            return False
        mine = _read_audit(spark, path, [staged])
        # Category and day are folders, and part of the key: other days are not read.
        days = mine.select("category", "dt").distinct()
        known = _read_audit(spark, path, [record["folder"] for record in records])
        if known is not None:
            known = known.join(days, ["category", "dt"], "left_semi").select("object_key")
            if not mine.join(known, "object_key", "left_semi").isEmpty():
                older, staged = staged, _stage_audit(mine.join(known, "object_key", "left_anti"), path)
                log.remove(f"{path}/data/commit={older}")
        if log.create((numbers[-1] if numbers else -1) + 1, {"folder": staged, "batch": batch}):
            return True


def _stage_audit(objects: DataFrame, path: str) -> str:
    name = os.urandom(8).hex()
    objects.write.partitionBy("category", "dt").parquet(f"{path}/data/commit={name}")
    return name


AUDIT = "object_key string, body string, content_md5 string, retain_until timestamp, commit string, category string, dt string"


def _read_audit(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    folders = [f"{path}/data/commit={name}" for name in names]
    if not folders:
        return None
    return spark.read.schema(AUDIT).option("basePath", f"{path}/data").parquet(*folders).drop("commit")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Every committed audit object."""
    log = CommitLog(spark, f"{path}/commits")
    found = _read_audit(spark, path, [log.read(number)["folder"] for number in log.numbers()])
    return spark.createDataFrame([], AUDIT).drop("commit") if found is None else found


def write_windows(counts: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Closed windows appended as Parquet. ``every=None`` takes what is there and stops (for scheduled runs)."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.option("path", path)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def batch_folder(root: str) -> BatchSink:
    """Sink that replaces the folder of a batch: a replayed batch leaves no second copy."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def empty_batch_folder(root: str) -> BatchSink:
    """Undo of :func:`batch_folder`: the batch's folder holds no rows afterwards."""

    def undo(df: DataFrame, batch_id: int) -> None:
        df.limit(0).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return undo


def dual_write(first: BatchSink, second: BatchSink, undo_first: BatchSink) -> BatchSink:
    """``foreachBatch`` function that feeds two idempotent sinks the same rows.

    If the second fails, the first is undone and the batch fails, so Spark replays it as a whole.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.persist()
        try:
            first(rows, batch_id)
            try:
                second(rows, batch_id)
            except Exception:
                undo_first(rows, batch_id)
                raise
        finally:
            rows.unpersist()

    return write
