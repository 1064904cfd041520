"""Event contracts, request schemas and fixed vocabularies."""

from __future__ import annotations

import json

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOLEAN = T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ENVELOPE = _struct(event_id=STRING, occurred_at=STRING, correlation_id=STRING, causation_id=STRING, traceparent=STRING)
ANSWER_METADATA = _struct(retrieved_count=INT, model=STRING, retrieval_error=STRING, llm_error=STRING)

# Topic and own fields of every event type, in contract order.
EVENT_TOPICS = {
    "TelemetryIngested": "telemetry.ingested",
    "TransactionProcessed": "transaction.processed",
    "PaymentTransactionIngested": "payments.transaction.ingested.v2",
    "PaymentRiskScored": "payments.risk.scored.v2",
    "AuditRecordLogged": "audit.record.logged",
    "IngestionCompensated": "ingestion.compensated",
    "TransactionCompensated": "transaction.compensated",
    "PaymentCompensated": "payments.compensated.v2",
    "StateTransitionLogged": "state.transition.logged",
}
BASE_TOPICS = ("domain.events", "domain.compensations")
EVENT_FIELDS = {
    "TelemetryIngested": _struct(
        request_id=STRING, source_token=STRING, chunk_count=INT, pii_counts=T.MapType(STRING, LONG)),
    "TransactionProcessed": _struct(request_id=STRING, operation_id=STRING, status=STRING, metadata=ANSWER_METADATA),
    "PaymentTransactionIngested": _struct(
        transaction_token=STRING, merchant_token=STRING, amount_minor=LONG, currency=STRING,
        payment_network=STRING, pii_tokenized=BOOLEAN),
    "PaymentRiskScored": _struct(
        transaction_token=STRING, risk_score=DOUBLE, decision=STRING, model_version=STRING, failure_reason=STRING),
    "AuditRecordLogged": _struct(request_id=STRING, object_key=STRING, record_type=STRING),
    "IngestionCompensated": _struct(
        reason=STRING, original_event_type=STRING, request_id=STRING, source_token=STRING, error_detail=STRING),
    "TransactionCompensated": _struct(
        reason=STRING, original_event_type=STRING, request_id=STRING, operation_id=STRING, error_detail=STRING),
    "PaymentCompensated": _struct(
        reason=STRING, original_event_type=STRING, transaction_token=STRING, decision=STRING, error_detail=STRING),
    "StateTransitionLogged": _struct(
        request_id=STRING, entity_id=STRING, state_from=STRING, state_to=STRING, reason=STRING,
        payload=T.MapType(STRING, STRING)),
}
# What an event field holds when its producer names none.
EVENT_DEFAULTS = {"status": "processed", "decision": "review", "pii_tokenized": True}

STREAM_FIELDS = T.StructType([
    T.StructField("event_id", STRING), T.StructField("event_type", STRING),
    T.StructField("occurred_at", T.TimestampType()), T.StructField("request_id", STRING),
])

DOCUMENT = _struct(text=STRING, source=STRING)
QUESTION = _struct(question=STRING, top_k=INT)
PAYMENT = _struct(
    transaction_id=STRING, merchant_id=STRING, amount_minor=LONG, currency=STRING, payment_network=STRING)
REQUEST_LOG = _struct(route=STRING, method=STRING, status=INT, seconds=DOUBLE, ts=T.TimestampType())
CDC_ENVELOPE = T.StructType([
    T.StructField("before", PAYMENT), T.StructField("after", PAYMENT), T.StructField("op", STRING),
    T.StructField("ts_ms", LONG), T.StructField("source", _struct(lsn=LONG)),
])


def event_schema(event_type: str) -> T.StructType:
    """Whole contract of one event type: envelope, own fields, event_type, topic."""
    return T.StructType([
        *ENVELOPE.fields, *EVENT_FIELDS[event_type].fields,
        T.StructField("event_type", STRING), T.StructField("topic", STRING),
    ])


_AVRO = {
    "string": STRING, "long": LONG, "int": INT, "double": DOUBLE, "float": T.FloatType(), "boolean": BOOLEAN,
    "bytes": T.BinaryType(),
}


def schema_from_avsc(contract: str) -> T.StructType:
    """Struct of an Avro record contract given as JSON text; fields keep their order."""

    def field_type(kind) -> T.DataType:
        if isinstance(kind, list):
            return field_type(next(k for k in kind if k != "null"))
        if isinstance(kind, str):
            return _AVRO[kind]
        if kind["type"] == "record":
            return T.StructType([T.StructField(f["name"], field_type(f["type"])) for f in kind["fields"]])
        if kind["type"] == "array":
            return T.ArrayType(field_type(kind["items"]))
        if kind["type"] == "map":
            return T.MapType(STRING, field_type(kind["values"]))
        return field_type(kind["type"])

    return field_type(json.loads(contract))


def contract_differences(schema: T.StructType, contract: str) -> list[str]:
    """Fields whose name, type or position differs from the contract; empty when they conform."""
    have = [f"{f.name}:{f.dataType.simpleString()}" for f in schema]
    want = [f"{f.name}:{f.dataType.simpleString()}" for f in schema_from_avsc(contract)]
    width = max(len(have), len(want))
    pairs = zip(have + [""] * (width - len(have)), want + [""] * (width - len(want)), strict=True)
    return [f"{mine or 'missing'} != {theirs or 'unexpected'}" for mine, theirs in pairs if mine != theirs]
