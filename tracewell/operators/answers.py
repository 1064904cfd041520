"""Answers for batches of questions: evidence, prompt, fallback messages, outcome events, audit tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.canonical import error_boundary
from tracewell.functions.privacy import redact_text, token_for
from tracewell.operators.events import make_events, stable_uuid

# Messages without a generated answer.
NO_EVIDENCE = "No indexed evidence is available."
UNAVAILABLE = "Inference is unavailable; retrieved evidence is returned without a generated answer."
DISABLED = "Inference is disabled; retrieved evidence is returned without a generated answer."
FAIL_SAFE = "DOWNSTREAM_FAILURE_FAIL_SAFE"


def with_evidence(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions plus ``evidence`` (hits in rank order, at most top_k of them) and ``retrieved_count``."""
    hit = F.struct("index", "text", "backend", "score")
    grouped = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("evidence"))
    joined = questions.join(grouped, "query_id", "left")
    return joined.withColumn("retrieved_count", F.coalesce(F.size("evidence"), F.lit(0)))


def prompt() -> Column:
    """Instruction, question and evidence as one text."""
    evidence = F.coalesce(F.to_json("evidence"), F.lit("[]"))
    return F.concat(
        F.lit("Answer using retrieved evidence only.\nQuestion: "), F.col("question"), F.lit("\nEvidence: "), evidence
    )


def generate(questions: DataFrame, model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``answer`` and ``llm_error`` from a text model that each task loads once; asked only with evidence."""

    def run(frames):
        invoke = model()
        for frame in frames:
            answers, errors = [], []
            for text, count in zip(frame["prompt"], frame["retrieved_count"], strict=True):
                answer = error = None
                if count:
                    try:
                        answer = invoke(text)
                    except Exception as problem:
                        error = type(problem).__name__
                answers.append(answer)
                errors.append(error)
            yield frame.assign(answer=pd.Series(answers, index=frame.index, dtype=object),
                               llm_error=pd.Series(errors, index=frame.index, dtype=object))

    asked = questions.withColumn("prompt", prompt())
    schema = T.StructType([
        *asked.schema.fields, T.StructField("answer", T.StringType()), T.StructField("llm_error", T.StringType()),
    ])
    return asked.mapInPandas(run, schema)


@dataclass(frozen=True)
class Messages:
    """What callers read where there is no generated answer."""

    no_evidence: str = NO_EVIDENCE
    unavailable: str = UNAVAILABLE
    disabled: str = DISABLED


def answer_text(retrieved: Column, model_answer: Column, llm_error: Column, llm_enabled: bool, messages: Messages = Messages()) -> Column:
    """What the caller reads: the model's answer or the message for its absence."""
    with_evidence_only = (
        F.when(llm_error.isNotNull(), F.lit(messages.unavailable)).otherwise(model_answer) if llm_enabled else F.lit(messages.disabled)
    )
    return F.when(retrieved > 0, with_evidence_only).otherwise(F.lit(messages.no_evidence))


def outcome_events(answered: DataFrame, occurred_at: Column, model: str = "fallback") -> DataFrame:
    """One TransactionProcessed per question from retrieved_count, retrieval_error, llm_error."""
    failed = F.col("retrieval_error").isNotNull() | F.col("llm_error").isNotNull()
    rows = (
        answered.withColumn("operation_id", F.col("request_id"))
        .withColumn("status", F.when(failed, F.lit("compensated")).otherwise(F.lit("processed")))
        .withColumn("metadata", F.struct(
            F.col("retrieved_count").cast("int").alias("retrieved_count"), F.lit(model).alias("model"),
            "retrieval_error", "llm_error",
        ))
    )
    return make_events(rows, "TransactionProcessed", occurred_at, stable_uuid(F.lit("TransactionProcessed"), F.col("request_id")))


def answer_compensations(processed: DataFrame, occurred_at: Column) -> DataFrame:
    """One TransactionCompensated per failed boundary, caused by the outcome event."""
    pairs = F.array(
        F.struct(F.lit("retrieval_store").alias("boundary"), F.col("metadata.retrieval_error").alias("error")),
        F.struct(F.lit("llm_inference").alias("boundary"), F.col("metadata.llm_error").alias("error")),
    )
    failed = processed.withColumn("pair", F.explode(F.filter(pairs, lambda p: p["error"].isNotNull())))
    rows = (
        failed.withColumn("causation_id", F.col("event_id"))
        .withColumn("error_detail", F.concat_ws(":", "pair.boundary", "pair.error"))
        .withColumn("reason", F.lit(FAIL_SAFE)).withColumn("original_event_type", F.lit("TransactionProcessed"))
    )
    event_id = stable_uuid(F.lit("TransactionCompensated"), F.col("causation_id"), F.col("error_detail"))
    return make_events(rows, "TransactionCompensated", occurred_at, event_id)


def compensation_boundaries(compensations: DataFrame) -> DataFrame:
    return compensations.withColumn("boundary", error_boundary(F.col("error_detail")))


def audit_tokens(answered: DataFrame, key: str) -> DataFrame:
    """Question and answer redacted, then only their tokens."""
    return (
        answered.withColumn("question_token", token_for("query", redact_text(F.col("question"), key), key))
        .withColumn("output_token", token_for("answer", redact_text(F.col("answer"), key), key))
        .drop("question", "answer")
    )


def retrieval_rollup(processed: DataFrame) -> DataFrame:
    """Outcomes per status and model: requests, hits, requests without evidence."""
    count = F.col("metadata.retrieved_count")
    return processed.groupBy("status", F.col("metadata.model").alias("model")).agg(
        F.count("*").alias("requests"), F.sum(count).alias("retrieved"), F.count_if(count == 0).alias("without_evidence")
    )
