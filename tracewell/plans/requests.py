"""The three request flows over tables: ingest documents, answer questions, process payments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.canonical import stable_traceparent
from tracewell.functions.privacy import redact_text
from tracewell.operators import answers, audit, events, ingest, lifecycle, payments, retrieval, validation
from tracewell.session import stored


def _traced(rows: DataFrame) -> DataFrame:
    """Server-issued correlation and trace ids where the rows bring none."""
    if "correlation_id" not in rows.columns:
        rows = rows.withColumn("correlation_id", events.stable_uuid(F.lit("correlation"), F.col("request_id")))
    if "traceparent" not in rows.columns:
        rows = rows.withColumn("traceparent", stable_traceparent(F.col("request_id"), F.col("correlation_id")))
    return rows


def lifecycle_audit(transitions: DataFrame, compensations: DataFrame, at: str, key: str) -> DataFrame:
    """Audit objects of transitions and of compensations ``(correlation_id, request_id, boundary, reason, ...)``.

    Column ``at`` of both is the time of the record.
    """
    moves = audit.transition_records(transitions, F.col(at))
    undone = audit.compensation_records(compensations, F.col(at)).drop(at)
    return audit.audit_objects(moves, "transitions", "correlation_id", key).unionByName(
        audit.audit_objects(undone, "compensations", "correlation_id", key))


@dataclass(frozen=True)
class IngestResult:
    """Frames of one ingest run; ``rejected`` names the failed rules and keeps no text.

    ``transitions`` carry the source token when a request opens and the audit key when it completes; ``closing`` are
    the events that end requests.
    """

    chunks: DataFrame
    telemetry: DataFrame
    transitions: DataFrame
    compensations: DataFrame
    audit: DataFrame
    rejected: DataFrame
    closing: DataFrame


def ingest_documents(
    documents: DataFrame, key: str, at: Column,
    splitter: Callable[[Column], Column] = text.chunk_recursive, outcome: Column | None = None, error: Column | None = None,
) -> IngestResult:
    """``(request_id, text, source)`` to chunks, telemetry, lifecycle and audit records.

    Redaction and splitting run once: their result is written to the shared folder and all outputs read it
    from there. ``outcome`` (a key of the ingest outcomes, default ok) tells what became of the index and
    audit writes, ``error`` the type of the failure; chunks of a request that did not end well are taken back.
    """
    valid, failed = validation.split_valid(validation.validate_documents(_traced(documents)))
    outcome = F.lit("ok") if outcome is None else outcome
    split = stored(
        ingest.split_documents(ingest.redact_documents(valid, key), splitter)
        .withColumn("flow", F.lit("ingest")).withColumn("outcome", outcome).withColumn("error", F.lit("") if error is None else error),
        "redacted",
    )
    outcomes = split.select("flow", "outcome", "request_id", "correlation_id", "traceparent", "source_token", "error")
    counted = ingest.telemetry_rows(split)
    telemetry = events.make_events(
        counted, "TelemetryIngested", at, events.stable_uuid(F.lit("TelemetryIngested"), F.col("request_id")))
    payload = counted.filter("outcome = 'ok'").select(
        "request_id", "correlation_id", "traceparent", F.lit("ingest").alias("event"), "source_token", "pii_counts",
        "chunk_count",
    )
    records = stored(audit.audit_objects(audit.request_records(payload, at), "requests", "request_id", key), "audit")
    keys = records.select(F.get_json_object("body", "$.request_id").alias("request_id"), "object_key")
    keyed = outcomes.join(keys, "request_id", "left")
    moves = lifecycle.lifecycle_transitions(keyed)
    facts = F.when(F.col("seq") == 1, F.create_map(F.lit("source_token"), F.col("source_token"))).when(
        F.col("object_key").isNotNull(), F.create_map(F.lit("audit_key"), F.col("object_key")))
    return IngestResult(
        chunks=ingest.chunk_documents(split.filter("outcome = 'ok'")),
        telemetry=telemetry,
        transitions=moves.withColumn("payload", facts),
        compensations=lifecycle.lifecycle_compensations(outcomes),
        audit=records,
        rejected=failed.select("request_id", "failed"),
        closing=events.union_events(
            lifecycle.audit_logged_events(keyed.filter("object_key IS NOT NULL"), at), lifecycle.compensated_events(keyed, at)),
    )


@dataclass(frozen=True)
class AskResult:
    """``transitions`` carry the audit key of a request that was recorded; ``undone`` are the compensation records of
    store, model and audit sink; ``closing`` the events that end a request."""

    hits: DataFrame
    answers: DataFrame
    events: DataFrame
    compensations: DataFrame
    audit: DataFrame
    rejected: DataFrame
    transitions: DataFrame
    undone: DataFrame
    closing: DataFrame


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "lexical": retrieval.retrieve_lexical, "bm25": retrieval.retrieve_bm25, "vector": retrieval.retrieve_vector,
}


def ask(
    questions: DataFrame, chunks: DataFrame, key: str, at: Column, strategy: str = "lexical",
    vectors: tuple[DataFrame, DataFrame] | None = None, model: Callable[[], Callable[[str], str]] | None = None,
    generator: Callable[[DataFrame], DataFrame] | None = None, store_error: Column | None = None, audit_error: Column | None = None,
    messages: answers.Messages = answers.Messages(),
) -> AskResult:
    """``(query_id, request_id, question, top_k)`` against ``(chunk_id, insert_seq, text)``.

    Questions are redacted before anything else sees them. ``vectors`` holds (query vectors, chunk vectors)
    for the vector strategy; ``model`` builds a text model per task, ``generator`` adds answer and llm_error itself;
    without either the answers say so. ``store_error`` and ``audit_error`` read columns of the questions: the type of
    error with which the store failed to search, or the audit sink to write, else null. A question whose store failed
    gets no evidence; an answer whose audit failed leaves no record and is taken back.
    """
    none = F.lit(None).cast("string")
    valid, failed = validation.split_valid(validation.validate_questions(_traced(questions)))
    safe = valid.withColumn("question", redact_text(F.col("question"), key))
    safe = safe.withColumn("retrieval_error", none if store_error is None else store_error)
    safe = safe.withColumn("audit_error", none if audit_error is None else audit_error)
    searched = safe.filter("retrieval_error IS NULL")
    if strategy == "vector":
        found = retrieval.retrieve_vector(*vectors)
        found = found if store_error is None else found.join(searched.select("query_id"), "query_id", "left_semi")
    else:
        found = STRATEGIES[strategy](searched, chunks)
    hits = stored(retrieval.attach_text(found, chunks), "hits")
    evidence = answers.with_evidence(safe, hits)
    if model or generator:
        answered = generator(evidence) if generator else answers.generate(evidence, model)
    else:
        answered = evidence.withColumn("answer", none).withColumn("llm_error", none)
    said = answers.answer_text(F.col("retrieved_count"), F.col("answer"), F.col("llm_error"), bool(model or generator), messages)
    answered = stored(answered.withColumn("answer", redact_text(said, key)), "answers")
    processed = answers.outcome_events(answered, at)
    compensations = answers.answer_compensations(processed, at)
    # At most two per request: one of the store, one of the model.
    listed = compensations.groupBy("request_id").agg(
        F.collect_list(F.struct(*compensations.columns)).alias("compensations"))
    payload = answers.audit_tokens(answered, key).join(listed, "request_id", "left").select(
        "request_id", "correlation_id", "traceparent", F.lit("ask").alias("event"), "question_token", "output_token",
        F.col("retrieved_count").alias("retrieved_chunk_count"),
        F.coalesce("compensations", F.array().cast(listed.schema["compensations"].dataType)).alias("compensations"),
    )
    recorded = payload.join(answered.filter("audit_error IS NULL").select("request_id"), "request_id", "left_semi")
    objects = audit.audit_objects(
        audit.request_records(recorded, at), "requests", "request_id", key)
    outcome = (
        F.when(F.col("audit_error").isNotNull(), "audit_failed").when(F.col("retrieval_error").isNotNull(), "store_failed")
        .when(F.col("llm_error").isNotNull(), "model_failed").otherwise("ok")
    )
    outcomes = answered.select(
        F.lit("ask").alias("flow"), outcome.alias("outcome"), "request_id", "correlation_id", "traceparent", F.col("audit_error").alias("error"))
    keyed = stored(objects, "audit")
    # The key of a record names its request; keys come from the stored records, so they are what was written.
    keys = keyed.select(F.get_json_object("body", "$.request_id").alias("request_id"), "object_key")
    outcomes = stored(outcomes.join(keys, "request_id", "left"), "outcomes")
    moves = lifecycle.lifecycle_transitions(outcomes)
    moves = moves.withColumn("payload", F.when((F.col("seq") == 2) & F.col("object_key").isNotNull(), F.create_map(F.lit("audit_key"), F.col("object_key"))))
    own = answers.compensation_boundaries(compensations).select(
        "request_id", "correlation_id", "boundary", "reason", F.substring_index("error_detail", ":", -1).alias("error"))
    sink = lifecycle.lifecycle_compensations(outcomes.filter("outcome = 'audit_failed'")).select("request_id", "correlation_id", "boundary", "reason", "error")
    closing = events.union_events(lifecycle.audit_logged_events(outcomes.filter("object_key IS NOT NULL"), at), lifecycle.compensated_events(outcomes, at))
    return AskResult(
        hits=hits,
        answers=answered.filter("audit_error IS NULL").select("request_id", "answer", "evidence"),
        events=processed,
        compensations=compensations,
        audit=keyed,
        rejected=failed.select("request_id", "failed"),
        transitions=moves,
        undone=own.unionByName(sink),
        closing=closing,
    )


@dataclass(frozen=True)
class PaymentResult:
    """``outcomes`` feeds the lifecycle operators: flow, outcome, request_id, correlation_id, decision."""

    ingested: DataFrame
    scored: DataFrame
    compensated: DataFrame
    outcomes: DataFrame
    rejected: DataFrame


def process_payments(
    requests: DataFrame, key: str, at: Column, anomaly: Column | None = None, error: Column | None = None,
    raw: str | None = None, carry: tuple[str, ...] = (),
) -> PaymentResult:
    """``(request_id, correlation_id, transaction_id, ...)`` to events and outcomes; everything is row-local.

    ``error`` and ``anomaly`` read columns of the ingested events and the columns of the requests named in ``carry``.
    """
    accepted, refused = payments.split_payments(_traced(requests), raw)
    tokenized = payments.tokenize_payments(accepted, key)
    # Scored once: the request id travels beside the event, so events and outcomes come from the same scores.
    ingested = payments.ingested_events(tokenized, at, ("request_id", *carry))
    scored = payments.score_payments(ingested, anomaly, error)
    decided = scored.select(
        F.lit("payment").alias("flow"),
        F.when(F.col("failure_reason") == "", F.lit("ok")).otherwise(F.lit("scorer_failed")).alias("outcome"),
        "request_id", "correlation_id", "decision",
    )
    invalid = refused.select(
        F.lit("payment").alias("flow"), F.lit("invalid").alias("outcome"), "request_id", "correlation_id",
        F.lit("").alias("decision"),
    )
    return PaymentResult(
        ingested=ingested.drop("request_id", *carry),
        scored=payments.scored_events(scored, at),
        compensated=payments.compensated_events(scored, at),
        outcomes=decided.unionByName(invalid),
        rejected=refused.select("request_id", "error"),
    )
