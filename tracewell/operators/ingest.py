"""Documents to redacted chunks and telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import privacy, text
from tracewell.functions.boundary import sanitize_column
from tracewell.schemas import STRING


def redact_documents(documents: DataFrame, key: str, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(request_id, text, source)`` -> the same rows with redacted text, source token and ``pii_counts``.

    ``redactor`` may replace the built-in one; it returns ``struct<text, kinds>``.
    """
    redaction = (redactor or (lambda col: privacy.redact(col, key)))(F.col("text"))
    redacted = documents.withColumn("redaction", redaction)
    return (
        redacted.withColumn("text", F.col("redaction.text"))
        .withColumn("pii_counts", privacy.kind_counts(F.col("redaction.kinds")))
        .withColumn("source_token", sanitize_column(F.col("source"), STRING, "source", key))
        .drop("redaction", "source")
    )


def split_documents(redacted: DataFrame, splitter: Callable[[Column], Column] = text.chunk_recursive) -> DataFrame:
    """``pieces`` (array of chunk texts) in place of the text; a frame that has them already stays as it is."""
    if "pieces" in redacted.columns:
        return redacted
    return redacted.withColumn("pieces", splitter(F.col("text"))).drop("text")


def chunk_documents(redacted: DataFrame, splitter: Callable[[Column], Column] = text.chunk_recursive) -> DataFrame:
    """One row per chunk: ``(chunk_id, request_id, position, text, source_token)``; empty text gives none.

    The split is exploded in place: an explode of a named column would be preceded by a filter that splits
    every text once more.
    """
    split = F.col("pieces") if "pieces" in redacted.columns else splitter(F.col("text"))
    pieces = redacted.select("request_id", "source_token", F.posexplode(split).alias("position", "text"))
    return pieces.select(
        text.chunk_id(F.col("request_id"), F.col("position"), F.col("text")).alias("chunk_id"),
        "request_id", "position", "text", "source_token",
    )


def ingest_telemetry(redacted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per request: number of chunks (zero included) and PII counts. Chunks are counted before the join."""
    counted = chunks.groupBy("request_id").agg(F.count("*").cast("int").alias("chunk_count"))
    return redacted.select("request_id", "source_token", "pii_counts").join(counted, "request_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))
    )


def telemetry_rows(redacted: DataFrame, splitter: Callable[[Column], Column] = text.chunk_recursive) -> DataFrame:
    """The same telemetry without any shuffle, from the rows that are about to be chunked."""
    return split_documents(redacted, splitter).withColumn("chunk_count", F.size("pieces")).drop("pieces")


def pii_totals(redacted: DataFrame, *by: str) -> DataFrame:
    """Hits per kind (and per ``by`` columns)."""
    none = F.create_map().cast("map<string,bigint>")
    # Not the bare column: its explode would filter first and find the personal data twice.
    hits = redacted.select(*by, F.explode(F.coalesce("pii_counts", none)).alias("kind", "hits"))
    return hits.groupBy(*by, "kind").agg(F.sum("hits").alias("hits"), F.count("*").alias("rows_with_kind"))
