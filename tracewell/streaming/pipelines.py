"""Streams of documents and payments through the same operators as the batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import ingest, lifecycle, payments, validation
from tracewell.plans import requests
from tracewell.sources.sinks import BatchSink


def ingest_batches(
    key: str, chunks: BatchSink, telemetry: BatchSink, rejected: BatchSink,
    splitter: Callable[[Column], Column] = text.chunk_recursive,
) -> BatchSink:
    """``foreachBatch`` function: validate, redact, chunk; each output goes to its own idempotent sink."""

    def write(df: DataFrame, batch_id: int) -> None:
        checked = validation.validate_documents(df)
        valid, failed = validation.split_valid(checked)
        split = ingest.split_documents(ingest.redact_documents(valid, key), splitter).persist()
        try:
            chunks(ingest.chunk_documents(split), batch_id)
            telemetry(ingest.telemetry_rows(split), batch_id)
            # Refused texts are not stored in clear: what is kept says who failed and why.
            rejected(failed.select("request_id", "failed"), batch_id)
        finally:
            split.unpersist()

    return write


def payment_streams(stream: DataFrame, key: str, at: str = "paid_at", watermark: str = "10 minutes"
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ingested events, scored events, refused payments) of a payment stream, stateless.

    A payment whose envelope is refused is in the third alone, with its ``error``.
    """
    accepted, refused = payments.split_payments(stream.withWatermark(at, watermark))
    tokenized = payments.tokenize_payments(accepted, key)
    ingested = payments.ingested_events(tokenized, F.col(at))
    scored = payments.scored_events(payments.score_payments(ingested), F.to_timestamp("occurred_at"))
    return ingested, scored, refused


def decision_latency(ingested: DataFrame, scored: DataFrame, bound: str = "10 minutes", watermark: str = "10 minutes"
                     ) -> DataFrame:
    """Stream-stream join of payments and their decisions; a payment without one within ``bound`` has nulls.

    ``ingested(event_id, ingested_at)``, ``scored(causation_id, decision, scored_at)``.
    """
    left = ingested.withWatermark("ingested_at", watermark)
    right = scored.withWatermark("scored_at", watermark)
    in_time = F.expr(f"scored_at >= ingested_at AND scored_at <= ingested_at + interval {bound}")
    joined = left.join(right, (F.col("causation_id") == F.col("event_id")) & in_time, "left_outer")
    return joined.withColumn(
        "seconds", F.col("scored_at").cast("double") - F.col("ingested_at").cast("double")
    )


def with_failures(payments_in: DataFrame, failures: DataFrame, bound: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Payments with ``scorer_error``: the error with which their scoring failed, null for those without one.

    ``payments(request_id, paid_at, ...)``, ``failures(request_id, error, failed_at)``: a failure counts within
    ``bound`` of its payment. A payment without one comes out when the watermark has passed that time.
    """
    left = payments_in.withWatermark("paid_at", watermark)
    right = failures.select(F.col("request_id").alias("failed_id"), F.col("error").alias("scorer_error"), "failed_at").withWatermark("failed_at", watermark)
    in_time = F.expr(f"failed_at >= paid_at AND failed_at <= paid_at + interval {bound}")
    joined = left.join(right, (F.col("failed_id") == F.col("request_id")) & in_time, "left_outer")
    return joined.drop("failed_id", "failed_at")


def payment_batches(key: str, sinks: dict[str, BatchSink]) -> BatchSink:
    """``foreachBatch`` function over :func:`with_failures`: events, compensations, moves and refusals of a batch.

    ``sinks`` names one idempotent sink each for ingested, scored, compensated, transitions, undone and rejected. A
    payment whose scoring failed is reviewed with score 0, compensated, and its lifecycle ends as compensated.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.persist()
        try:
            result = requests.process_payments(rows, key, F.col("paid_at"), error=F.col("scorer_error"), carry=("scorer_error", "paid_at"))
            found = {
                "ingested": result.ingested, "scored": result.scored, "compensated": result.compensated, "rejected": result.rejected,
                "transitions": lifecycle.lifecycle_transitions(result.outcomes), "undone": lifecycle.lifecycle_compensations(result.outcomes),
            }
            for name, sink in sinks.items():
                sink(found[name], batch_id)
        finally:
            rows.unpersist()

    return write
