"""Request lifecycles: outcome -> transitions, compensations, final events; checks on recorded transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.events import make_events, stable_uuid, union_events
from tracewell.operators.ordered import previous_value

# States, allowed moves, opening reasons and the outcome table
# (flow, outcome) -> (final state, reason, [(boundary, reason)], [final event types]).
ALLOWED_MOVES = (("INITIALIZED", "PROCESSING"), ("PROCESSING", "COMPLETED"), ("PROCESSING", "COMPENSATED"))
TERMINAL_STATES = ("COMPLETED", "COMPENSATED")
OPENING_REASONS = {
    "ingest": "Received document for ingestion",
    "payment": "Payment transaction received",
    "ask": "Question received for retrieval",
}
OUTCOMES = {
    ("ingest", "ok"): ("COMPLETED", "Ingestion completed successfully", [], ["AuditRecordLogged"]),
    ("ingest", "index_failed"): (
        "COMPENSATED", "Vector store write failed", [("retrieval_store", "STORE_ADD_FAILED")], ["IngestionCompensated"]),
    ("ingest", "audit_failed"): (
        "COMPENSATED", "Audit persistence failed", [("audit_sink", "AUDIT_WRITE_FAILED")], ["IngestionCompensated"]),
    ("ingest", "audit_and_rollback_failed"): (
        "COMPENSATED", "Audit persistence failed",
        [("retrieval_store", "ROLLBACK_FAILED"), ("audit_sink", "AUDIT_WRITE_FAILED")], ["IngestionCompensated"]),
    ("ingest", "failed"): (
        "COMPENSATED", "Unhandled ingestion failure", [("ingestion", "UNHANDLED_FAILURE")], ["IngestionCompensated"]),
    ("payment", "ok"): ("COMPLETED", "Decision: {decision}", [], ["PaymentRiskScored"]),
    ("payment", "scorer_failed"): (
        "COMPENSATED", "Risk scoring failed closed", [("payment_risk_scoring", "DOWNSTREAM_TIMEOUT_FAIL_CLOSED")],
        ["PaymentCompensated", "PaymentRiskScored"]),
    ("payment", "invalid"): (
        "COMPENSATED", "Payment ingestion failed", [("payment_ingestion", "UNHANDLED_FAILURE")], []),
    ("ask", "ok"): ("COMPLETED", "Retrieval and inference completed", [], ["AuditRecordLogged"]),
    ("ask", "store_failed"): (
        "COMPENSATED", "Retrieval returned a safe fallback", [("retrieval_store", "DOWNSTREAM_FAILURE_FAIL_SAFE")],
        ["TransactionCompensated", "AuditRecordLogged"]),
    ("ask", "model_failed"): (
        "COMPENSATED", "Retrieval returned a safe fallback", [("llm_inference", "DOWNSTREAM_FAILURE_FAIL_SAFE")],
        ["TransactionCompensated", "AuditRecordLogged"]),
    ("ask", "audit_failed"): (
        "COMPENSATED", "Audit persistence failed", [("audit_sink", "AUDIT_WRITE_FAILED")], ["TransactionCompensated"]),
}


def outcome_rules(spark: SparkSession) -> DataFrame:
    """The outcome table as rows; its size is fixed, so it is always safe to broadcast."""
    rows = [
        (flow, outcome, OPENING_REASONS[flow], state, reason, compensations, events)
        for (flow, outcome), (state, reason, compensations, events) in OUTCOMES.items()
    ]
    return spark.createDataFrame(
        rows,
        "flow string, outcome string, opening string, final_state string, final_reason string, "
        "compensations array<struct<boundary:string,reason:string>>, final_events array<string>",
    )


def _ruled(outcomes: DataFrame) -> DataFrame:
    """Outcomes beside their rule. An outcome without one fails the job: it must not vanish in the join."""
    name = F.concat_ws("/", "flow", "outcome")
    unknown = F.raise_error(F.concat(F.lit("unknown outcome "), name)).cast("boolean")
    known = F.when(name.isin(*["/".join(pair) for pair in OUTCOMES]), F.lit(True)).otherwise(unknown)
    return outcomes.filter(known).join(F.broadcast(outcome_rules(outcomes.sparkSession)), ["flow", "outcome"])


def lifecycle_transitions(outcomes: DataFrame) -> DataFrame:
    """Two transitions per outcome row ``(flow, outcome, request_id, correlation_id, decision, ...)``."""
    decision = F.col("decision") if "decision" in outcomes.columns else F.lit("")
    closing = F.replace(F.col("final_reason"), F.lit("{decision}"), F.coalesce(decision, F.lit("")))

    def move(seq: int, state_from: str, state_to: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"), F.lit(state_from).alias("state_from"), state_to.alias("state_to"),
            reason.alias("reason"),
        )

    moves = F.array(
        move(1, "INITIALIZED", F.lit("PROCESSING"), F.col("opening")),
        move(2, "PROCESSING", F.col("final_state"), closing),
    )
    return _ruled(outcomes).select(*outcomes.columns, F.explode(moves).alias("move")).select(*outcomes.columns, "move.*")


def lifecycle_compensations(outcomes: DataFrame) -> DataFrame:
    """One row per compensation of every failed outcome."""
    ruled = _ruled(outcomes).select(*outcomes.columns, F.explode("compensations").alias("done"))
    return ruled.select(*outcomes.columns, "done.*")


def lifecycle_final_events(outcomes: DataFrame) -> DataFrame:
    """One row per event type that closes an outcome."""
    return _ruled(outcomes).select(*outcomes.columns, F.explode("final_events").alias("final_event"))


def transition_events(transitions: DataFrame, occurred_at: Column) -> DataFrame:
    event_id = stable_uuid(F.lit("StateTransitionLogged"), F.col("request_id"), F.col("seq").cast("string"))
    return make_events(transitions.withColumn("entity_id", F.col("request_id")), "StateTransitionLogged", occurred_at, event_id)


def compensated_events(outcomes: DataFrame, occurred_at: Column) -> DataFrame:
    """The event that closes a failed ingest, or an answer whose audit failed.

    ``outcomes`` may carry source_token and ``error`` (type of the failure). Failed stores, models and scorers
    have their own events with the payment and answer operators.
    """
    ruled = _ruled(outcomes).withColumn("last", F.element_at("compensations", -1))
    error = F.col("error") if "error" in outcomes.columns else F.lit("")
    audit_failed = F.col("last.boundary") == "audit_sink"
    rows = (
        ruled.withColumn("reason", F.col("last.reason")).withColumn("operation_id", F.col("request_id"))
        .withColumn("error_detail", F.when(audit_failed, F.lit("audit sink unavailable")).otherwise(error))
    )
    ingest = rows.filter("flow = 'ingest' AND outcome <> 'ok'")
    ask = rows.filter("flow = 'ask' AND outcome = 'audit_failed'")

    def of(frame: DataFrame, event_type: str) -> DataFrame:
        return make_events(frame, event_type, occurred_at, stable_uuid(F.lit(event_type), F.col("request_id"), F.col("reason")))

    return union_events(of(ingest, "IngestionCompensated"), of(ask, "TransactionCompensated"))


def audit_logged_events(outcomes: DataFrame, occurred_at: Column) -> DataFrame:
    """One AuditRecordLogged per request whose record was written; ``outcomes`` carries its ``object_key``."""
    logged = lifecycle_final_events(outcomes).filter("final_event = 'AuditRecordLogged'")
    rows = logged.withColumn("record_type", F.col("flow"))
    return make_events(rows, "AuditRecordLogged", occurred_at, stable_uuid(F.lit("AuditRecordLogged"), F.col("request_id")))


def check_transitions(transitions: DataFrame, bucket: Column, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Every transition with ``legal``: an allowed move that starts where the one before it ended.

    ``bucket`` cuts each lifecycle into ranges of its order, so a very long one is not sorted in one task.
    """
    keyed = transitions.withColumn("_bucket", bucket)
    chained = previous_value(keyed, ["correlation_id"], "_bucket", list(order), F.col("state_to"), "previous")
    allowed = F.lit(False)
    for state_from, state_to in ALLOWED_MOVES:
        allowed = allowed | ((F.col("state_from") == state_from) & (F.col("state_to") == state_to))
    continues = F.coalesce(F.col("previous"), F.lit("INITIALIZED")) == F.col("state_from")
    return chained.withColumn("legal", F.coalesce(allowed & continues, F.lit(False))).drop("_bucket")


def current_state(transitions: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Latest state per lifecycle and whether it is terminal; merges per task."""
    latest = transitions.groupBy("correlation_id").agg(
        F.max_by("state_to", F.struct(*order)).alias("state"), F.count("*").alias("transitions")
    )
    return latest.withColumn("terminal", F.col("state").isin(*TERMINAL_STATES))


def compensation_counts(compensations: DataFrame) -> DataFrame:
    """Compensations per boundary and reason, with the default labels for missing ones."""
    labelled = compensations.select(
        F.coalesce("boundary", F.lit("audit")).alias("boundary"),
        F.coalesce("reason", F.lit("downstream_failure")).alias("reason"),
    )
    return labelled.groupBy("boundary", "reason").agg(F.count("*").alias("compensations"))
