"""Event streams: sources, watermarked window counts, side output of late and malformed rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.events import parse_events, split_malformed, window_counts
from tracewell.schemas import EVENT_TOPICS, STREAM_FIELDS
from tracewell.sources.sinks import BatchSink, batch_folder

WATERMARK, WINDOW = "10 minutes", "1 minute"  # Fixed values: allowed lateness and window width.


def read_event_stream(
    spark: SparkSession, servers: str, topics: tuple[str, ...] = tuple(EVENT_TOPICS.values()),
    offsets: str = "latest", per_trigger: int | None = None,
) -> DataFrame:
    """Kafka source over several topics (``value``, ``topic``, ``key``, ``headers``)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", ",".join(topics)).option("startingOffsets", offsets)
    reader = reader.option("includeHeaders", "true")
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load()


def read_file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """The same rows from files, for replays and tests."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def event_counts(
    raw: DataFrame, schema: T.StructType = STREAM_FIELDS, dedup: bool = True,
    watermark: str = WATERMARK, width: str = WINDOW,
) -> DataFrame:
    """JSON messages to counts per window and type; copies of an event id within the watermark count once."""
    events = split_malformed(parse_events(raw, schema))[0].withWatermark("occurred_at", watermark)
    if dedup:
        events = events.dropDuplicatesWithinWatermark(["event_id"])
    return window_counts(events, width)


def malformed_events(raw: DataFrame, schema: T.StructType = STREAM_FIELDS) -> DataFrame:
    """The messages that :func:`event_counts` leaves out because they cannot be read, for a sink of their own."""
    return split_malformed(parse_events(raw, schema))[1]


def side_output(
    accept: BatchSink, quarantine_path: str, horizon_path: str, time: str = "occurred_at",
    lateness: timedelta = timedelta(minutes=10),
) -> BatchSink:
    """``foreachBatch`` function: rows without a time or older than the watermark go to quarantine.

    The watermark of a batch is the latest time of all earlier batches less ``lateness``, as the engine
    defines it. Each batch stores the latest time so far in its own folder, so a replay sees the same watermark
    and a batch reads one row, that of its predecessor.
    """
    reject, remember = batch_folder(quarantine_path), batch_folder(horizon_path)

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        latest = None
        if batch_id:
            seen = spark.read.schema("latest timestamp").parquet(f"{horizon_path}/batch={batch_id - 1}")
            latest = seen.first()["latest"]
        late = F.col(time).isNull()
        if latest is not None:
            late = late | (F.col(time) < F.lit(latest) - F.lit(lateness))
        rows = df.persist()
        try:
            accept(rows.filter(~late), batch_id)
            reject(rows.filter(late), batch_id)
            remember(rows.agg(F.greatest(F.max(time), F.lit(latest).cast("timestamp")).alias("latest")), batch_id)
        finally:
            rows.unpersist()

    return write


class EventIntake:
    """One reading of a message stream with all its outputs: window counts, late rows, malformed texts, copies.

    A ``foreachBatch`` sink. Each output of a batch is a folder of its own that a replay replaces, and a batch reads
    only what earlier batches have left, so every message is in exactly one output, across restarts: counts, late,
    malformed and copies add up to the messages read. The watermark is the latest time of earlier batches less
    ``lateness``; copies are told from event ids that are not older than it.
    """

    OUTPUTS = {
        "counts": "window_start timestamp, window_end timestamp, event_type string, count long",
        "late": "event_id string, event_type string, occurred_at timestamp", "malformed": "raw_value string",
        "copies": "event_id string, copies long", "seen": "event_id string, occurred_at timestamp", "horizon": "latest timestamp",
    }

    def __init__(self, path: str, schema: T.StructType = STREAM_FIELDS, width: str = WINDOW, lateness: timedelta = timedelta(minutes=10)) -> None:
        self.path, self.schema, self.width, self.lateness = path.rstrip("/"), schema, width, lateness

    def read(self, spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
        """All rows of an output, or those of the batches ``before`` one."""
        rows = spark.read.schema(f"{self.OUTPUTS[output]}, batch long").option("basePath", f"{self.path}/{output}")
        found = rows.parquet(f"{self.path}/{output}")
        return found if before is None else found.filter(F.col("batch") < before)

    def counts(self, spark: SparkSession, closed: bool = True) -> DataFrame:
        """Events per window and type, by default of windows that the watermark has passed."""
        added = self.read(spark, "counts").groupBy("window_start", "window_end", "event_type").agg(F.sum("count").alias("count"))
        if not closed:
            return added
        latest = self.read(spark, "horizon").agg(F.max("latest")).first()[0]
        return added.filter(F.col("window_end") <= F.lit(latest) - F.lit(self.lateness))

    def __call__(self, raw: DataFrame, batch_id: int) -> None:
        spark = raw.sparkSession
        write = {output: batch_folder(f"{self.path}/{output}") for output in self.OUTPUTS}
        latest = self.read(spark, "horizon", batch_id).agg(F.max("latest")).first()[0] if batch_id else None
        horizon = F.lit(None).cast("timestamp") if latest is None else F.lit(latest) - F.lit(self.lateness)
        rows = parse_events(raw, self.schema).persist()
        try:
            good, broken = split_malformed(rows)
            late = F.coalesce(F.col("occurred_at") < horizon, F.lit(False))
            # Of equal ids in a batch the earliest counts; one row per id is left, with the number of its copies.
            first = good.filter(~late).groupBy("event_id").agg(
                F.min(F.struct("occurred_at", "event_type")).alias("event"), (F.count("*") - 1).alias("copies"))
            if batch_id:
                seen = self.read(spark, "seen", batch_id)
                known = (seen if latest is None else seen.filter(F.col("occurred_at") >= horizon)).select("event_id", F.lit(True).alias("known")).distinct()
                first = first.join(known, "event_id", "left")
            else:
                first = first.withColumn("known", F.lit(None).cast("boolean"))
            first = first.select("event_id", "event.*", "copies", F.coalesce("known", F.lit(False)).alias("known")).persist()
            fresh = first.filter(~F.col("known"))
            write["malformed"](broken, batch_id)
            write["late"](good.filter(late).select("event_id", "event_type", "occurred_at"), batch_id)
            write["copies"](first.select("event_id", (F.col("copies") + F.col("known").cast("long")).alias("copies")).filter("copies > 0"), batch_id)
            write["counts"](window_counts(fresh, self.width), batch_id)
            write["seen"](fresh.select("event_id", "occurred_at"), batch_id)
            write["horizon"](good.agg(F.greatest(F.max("occurred_at"), F.lit(latest).cast("timestamp")).alias("latest")), batch_id)
            first.unpersist()
        finally:
            rows.unpersist()
