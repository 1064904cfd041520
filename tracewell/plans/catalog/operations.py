"""Registered queries: lifecycles, audit records, service metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.canonical import bounded_method, bounded_route, status_class
from tracewell.operators import audit, events, lifecycle, metrics
from tracewell.plans import requests
from tracewell.plans.catalog.common import KEY, PAYMENTS_SQL, iso_sql, ntz, token_sql, uuid_sql
from tracewell.sources import tables


def _outcomes(spark, folder):
    """Documents by language and orders by status as outcomes of the three flows."""
    documents = tables.documents(spark, folder).select(
        F.when(F.col("doc_id") % 2 == 0, "ingest").otherwise("ask").alias("flow"), "lang", "request_id",
        F.lit("").alias("decision"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"),
    )
    ingest_outcome = F.when(F.col("lang") == "de", "index_failed").when(F.col("lang") == "fr", "audit_failed").when(
        F.col("lang") == "es", "audit_and_rollback_failed").otherwise("ok")
    ask_outcome = F.when(F.col("lang") == "de", "store_failed").when(F.col("lang") == "fr", "model_failed").when(
        F.col("lang") == "es", "audit_failed").otherwise("ok")
    documents = documents.withColumn("outcome", F.when(F.col("flow") == "ingest", ingest_outcome).otherwise(ask_outcome))
    orders = tables.payments(spark, folder).select(
        F.lit("payment").alias("flow"),
        F.when(F.col("o_orderstatus") == "P", "scorer_failed").when(F.col("currency") == "JPY", "invalid")
        .otherwise("ok").alias("outcome"),
        "request_id", F.when(F.col("amount_minor") > 500_000, "review").otherwise("allow").alias("decision"),
        F.col("paid_at").alias("at"),
    )
    both = documents.select("flow", "outcome", "request_id", "decision", "at").unionByName(orders)
    return both.withColumn("correlation_id", F.concat(F.lit("c-"), "request_id"))


def lifecycle_events(spark, folder):
    moves = lifecycle.lifecycle_transitions(_outcomes(spark, folder))
    return moves.select("request_id", "seq", "state_from", "state_to", "reason")


def lifecycle_compensations(spark, folder):
    return lifecycle.lifecycle_compensations(_outcomes(spark, folder)).select("request_id", "boundary", "reason")


def lifecycle_final_events(spark, folder):
    return lifecycle.lifecycle_final_events(_outcomes(spark, folder)).select("request_id", "final_event")


def compensation_rollup(spark, folder):
    rows = lifecycle.lifecycle_compensations(_outcomes(spark, folder))
    unnamed = rows.withColumn("boundary", F.when(F.col("boundary") != "ingestion", F.col("boundary"))).withColumn(
        "reason", F.when(F.col("flow") != "payment", F.col("reason")))
    return lifecycle.compensation_counts(unnamed)


def _broken_transitions(spark, folder):
    """The second move is missing for incomplete scorers' requests and starts wrongly for JPY ones."""
    moves = lifecycle.lifecycle_transitions(_outcomes(spark, folder))
    moves = moves.filter(~((F.col("outcome") == "scorer_failed") & (F.col("seq") == 1)))
    return moves.withColumn(
        "state_from", F.when((F.col("outcome") == "invalid") & (F.col("seq") == 2), "INITIALIZED").otherwise(F.col("state_from")))


def transition_check(spark, folder):
    checked = lifecycle.check_transitions(_broken_transitions(spark, folder), F.floor(F.col("seq") / 1000))
    return checked.select("correlation_id", "seq", "state_from", "state_to", "previous", "legal")


def current_lifecycle_state(spark, folder):
    moves = lifecycle.lifecycle_transitions(_outcomes(spark, folder))
    open_too = moves.filter(~((F.col("outcome") == "scorer_failed") & (F.col("seq") == 2)))
    return lifecycle.current_state(open_too)


def _audit_objects(spark, folder):
    rows = tables.payments(spark, folder).select(
        "request_id", F.when(F.col("o_orderstatus") != "P", F.col("correlation_id")).alias("correlation_id"),
        F.lit("payment").alias("event"), F.col("merchant_id").alias("source"), "amount_minor", "paid_at",
    )
    records = audit.request_records(rows, F.col("paid_at")).drop("paid_at")
    return audit.audit_objects(records, "requests", "request_id", KEY)


def audit_records(spark, folder):
    return _audit_objects(spark, folder).select("category", "dt", "object_key", "body", "content_md5")


def retention_candidates(spark, folder):
    objects = _audit_objects(spark, folder)
    now = F.lit("2003-06-01 00:00:00").cast("timestamp")
    return audit.expired(objects, now).select("object_key", ntz("retain_until").alias("retain_until"))


def transition_audit(spark, folder):
    moves = lifecycle.lifecycle_transitions(_outcomes(spark, folder)).withColumn(
        "payload", F.create_map(F.lit("decision"), "decision", F.lit("source"), "flow"))
    objects = audit.audit_objects(audit.transition_records(moves, F.col("at")), "transitions", "correlation_id", KEY)
    return objects.select("category", "dt", "object_key", "body")


def compensation_audit(spark, folder):
    undone = lifecycle.lifecycle_compensations(_outcomes(spark, folder)).select(
        "correlation_id", "request_id", "boundary", "reason", F.col("flow").alias("source"), "at")
    moves = lifecycle.lifecycle_transitions(_outcomes(spark, folder))
    objects = requests.lifecycle_audit(moves, undone, "at", KEY)
    return objects.filter("category = 'compensations'").select("dt", "object_key", "body")


def closing_events(spark, folder):
    """Compensation events and audit notices of all outcomes, with a failure type and an object key."""
    outcomes = _outcomes(spark, folder).withColumn("error", F.concat(F.col("flow"), F.lit("Error"))).withColumn(
        "object_key", F.concat(F.lit("requests/"), "request_id"))
    log = events.union_events(
        lifecycle.compensated_events(outcomes, F.col("at")), lifecycle.audit_logged_events(outcomes, F.col("at")))
    return log.select(
        "event_id", "occurred_at", "event_type", "topic", "request_id", "correlation_id", "reason", "operation_id",
        "error_detail", "object_key", "record_type",
    )


def transition_events(spark, folder):
    moves = lifecycle.lifecycle_transitions(_outcomes(spark, folder))
    logged = lifecycle.transition_events(moves, F.col("at"))
    return logged.select("event_id", "causation_id", "occurred_at", "topic", "entity_id", "state_from", "state_to", "reason")


def audit_completeness(spark, folder):
    """Orders without line items stand for requests without a record."""
    requests = tables.table(spark, folder, "orders").select(F.concat(F.lit("pay-"), "o_orderkey").alias("request_id"), "o_orderstatus")
    records = tables.table(spark, folder, "lineitem").select(F.concat(F.lit("pay-"), "l_orderkey").alias("request_id"))
    missing = audit.unaudited(requests, records).withColumn("audited", F.lit(False))
    return missing.unionByName(audit.audited(requests, records).withColumn("audited", F.lit(True)))


def label_bounding(spark, folder):
    log = tables.request_log(spark, folder)
    return log.select(
        "event_id", bounded_route(F.col("route")).alias("route"), bounded_method(F.col("method")).alias("method"),
        status_class(F.col("status")).alias("status_class"),
    )


def _labelled(rows):
    return rows.withColumn("labels", metrics.label_text(F.col("labels")))


def http_counters(spark, folder):
    log = metrics.bounded_labels(tables.request_log(spark, folder))
    return _labelled(metrics.counters(log, "rag_http_requests_total", "route", "method", "status_class"))


def duration_histogram(spark, folder):
    log = metrics.bounded_labels(tables.request_log(spark, folder))
    rows = _labelled(metrics.histogram(log, "rag_http_request_duration_seconds", "seconds", "route", "method"))
    return rows.withColumn("sum", F.round("sum", 4))


def latest_gauge(spark, folder):
    return _labelled(metrics.latest_gauge(
        tables.request_log(spark, folder), "rag_health_check_duration_seconds", "seconds", "ts", "boundary"))


def inflight_profile(spark, folder):
    """Requests of up to some minutes, by boundary and day; durations count as minutes here."""
    calls = tables.request_log(spark, folder).withColumn("ended", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(round(seconds) as int))"))
    profile = metrics.in_flight_profile(calls, "ts", "ended", "boundary", "day", "hour")
    return profile.select("boundary", ntz("bucket").alias("bucket"), F.col("max_in_flight").cast("bigint").alias("max_in_flight"), "started")


def zero_filled_families(spark, folder):
    log = metrics.bounded_labels(tables.request_log(spark, folder))
    samples = metrics.counters(log, "rag_http_requests_total", "method").unionByName(
        metrics.counters(log, "rag_downstream_failures_total", "boundary", value="seconds"))
    rows = _labelled(metrics.zero_filled(samples))
    return rows.withColumn("value", F.round("value", 3))


def readiness(spark, folder):
    """Users are targets that need the event types of their history; a type is healthy if its last value is small."""
    log = tables.event_log(spark, folder)
    required = log.select(F.col("correlation_id").alias("target"), F.col("event_type").alias("dependency")).distinct()
    never_checked = log.select(F.col("correlation_id").alias("target"), F.lit("never").alias("dependency")).distinct()
    required = required.unionByName(never_checked.filter(F.col("target").endswith("7")))
    checks = log.select(
        F.col("event_type").alias("dependency"), F.when(F.col("value") < 100, "ok").otherwise("failed").alias("status"),
        F.col("occurred_at").alias("checked_at"),
    ).filter("dependency <> 'signup'")
    return metrics.readiness(required, checks)


QUERIES = {f.__name__: f for f in (
    lifecycle_events, lifecycle_compensations, lifecycle_final_events, compensation_rollup, transition_check,
    current_lifecycle_state, audit_records, retention_candidates, transition_audit, compensation_audit,
    closing_events, transition_events, audit_completeness, label_bounding,
    http_counters, duration_histogram, latest_gauge, inflight_profile, zero_filled_families, readiness,
)}

_OUTCOMES = f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'ingest' ELSE 'ask' END AS flow,
       CASE WHEN lang = 'en' THEN 'ok'
            WHEN doc_id % 2 = 0 THEN CASE lang WHEN 'de' THEN 'index_failed' WHEN 'fr' THEN 'audit_failed'
                                     WHEN 'es' THEN 'audit_and_rollback_failed' ELSE 'ok' END
            ELSE CASE lang WHEN 'de' THEN 'store_failed' WHEN 'fr' THEN 'model_failed' WHEN 'es' THEN 'audit_failed'
                 ELSE 'ok' END END AS outcome,
       'doc-' || doc_id AS request_id, '' AS decision, TIMESTAMP '2024-01-01 00:00:00' AS happened FROM documents
UNION ALL
SELECT 'payment', CASE WHEN o_orderstatus = 'P' THEN 'scorer_failed' WHEN currency = 'JPY' THEN 'invalid' ELSE 'ok' END,
       request_id, CASE WHEN amount_minor > 500000 THEN 'review' ELSE 'allow' END, paid_at FROM ({PAYMENTS_SQL}) p
"""

_MOVES = f"""
WITH outcomes AS ({_OUTCOMES}),
moves AS (
    SELECT flow, outcome, request_id, decision, happened, 1 AS seq, 'INITIALIZED' AS state_from, 'PROCESSING' AS state_to,
           CASE flow WHEN 'ingest' THEN 'Received document for ingestion' WHEN 'payment' THEN 'Payment transaction received'
                ELSE 'Question received for retrieval' END AS reason FROM outcomes
    UNION ALL
    SELECT flow, outcome, request_id, decision, happened, 2, 'PROCESSING', CASE WHEN outcome = 'ok' THEN 'COMPLETED' ELSE 'COMPENSATED' END,
           CASE WHEN flow = 'ingest' AND outcome = 'ok' THEN 'Ingestion completed successfully'
                WHEN outcome = 'index_failed' THEN 'Vector store write failed'
                WHEN outcome IN ('audit_failed', 'audit_and_rollback_failed') THEN 'Audit persistence failed'
                WHEN flow = 'payment' AND outcome = 'ok' THEN 'Decision: ' || decision
                WHEN outcome = 'scorer_failed' THEN 'Risk scoring failed closed'
                WHEN outcome = 'invalid' THEN 'Payment ingestion failed'
                WHEN outcome = 'ok' THEN 'Retrieval and inference completed'
                ELSE 'Retrieval returned a safe fallback' END FROM outcomes)
"""

_COMPENSATIONS = f"""
WITH outcomes AS ({_OUTCOMES}),
done AS (
    SELECT flow, request_id, CASE WHEN outcome IN ('index_failed', 'store_failed', 'audit_and_rollback_failed') THEN 'retrieval_store'
             WHEN outcome = 'audit_failed' THEN 'audit_sink' WHEN outcome = 'scorer_failed' THEN 'payment_risk_scoring'
             WHEN outcome = 'invalid' THEN 'payment_ingestion' ELSE 'llm_inference' END AS boundary,
           CASE outcome WHEN 'index_failed' THEN 'STORE_ADD_FAILED' WHEN 'audit_and_rollback_failed' THEN 'ROLLBACK_FAILED'
             WHEN 'audit_failed' THEN 'AUDIT_WRITE_FAILED' WHEN 'scorer_failed' THEN 'DOWNSTREAM_TIMEOUT_FAIL_CLOSED'
             WHEN 'invalid' THEN 'UNHANDLED_FAILURE' ELSE 'DOWNSTREAM_FAILURE_FAIL_SAFE' END AS reason
    FROM outcomes WHERE outcome <> 'ok'
    UNION ALL
    SELECT flow, request_id, 'audit_sink', 'AUDIT_WRITE_FAILED' FROM outcomes WHERE outcome = 'audit_and_rollback_failed')
"""

_AUDIT_BODY = f"""
SELECT request_id, paid_at, '{{"amount_minor":' || amount_minor || ',"correlation_id":"'
       || CASE WHEN o_orderstatus <> 'P' THEN correlation_id ELSE request_id END || '","event":"payment","request_id":"'
       || request_id || '","source":"' || {token_sql("source", "merchant_id")} || '","timestamp":"'
       || {iso_sql("paid_at")} || '"}}' AS body FROM ({PAYMENTS_SQL}) p
"""
_AUDIT_KEY = "'requests/requests/' || strftime(paid_at, '%Y/%m/%d/%H%M%S.%f') || 'Z-' || request_id || '-' || md5(body) || '.json'"

_LOG = """
SELECT event_id, coalesce('/' || nullif(event_type, 'error'), 'unmatched') AS route,
       (['GET','POST','PUT','OTHER','DELETE','PATCH','OTHER'])[CAST(event_id % 7 AS INTEGER) + 1] AS method,
       CASE WHEN (event_id % 6 * 100 + 100 + user_id % 5) // 100 BETWEEN 2 AND 5
            THEN CAST((event_id % 6 * 100 + 100 + user_id % 5) // 100 AS VARCHAR) || 'xx' ELSE 'other' END AS status_class,
       value / 10 AS seconds, ts, 'boundary-' || (user_id % 3) AS boundary FROM events
"""
_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)
_BUCKETS = " UNION ALL ".join(
    f"SELECT route, method, {i} AS position, '{bound:g}' AS le, count(*) FILTER (WHERE seconds <= {bound}) AS bucket_count, "
    f"sum(seconds) AS sum, count(*) AS count FROM log GROUP BY route, method" for i, bound in enumerate(_BOUNDS)
) + " UNION ALL SELECT route, method, 14, '+Inf', count(*), sum(seconds), count(*) FROM log GROUP BY route, method"

ORACLES = {
    "lifecycle_events": f"{_MOVES} SELECT request_id, seq, state_from, state_to, reason FROM moves",
    "lifecycle_compensations": f"{_COMPENSATIONS} SELECT request_id, boundary, reason FROM done",
    "lifecycle_final_events": f"""
        WITH outcomes AS ({_OUTCOMES})
        SELECT request_id, 'AuditRecordLogged' AS final_event FROM outcomes
        WHERE (flow = 'ingest' AND outcome = 'ok') OR (flow = 'ask' AND outcome <> 'audit_failed')
        UNION ALL SELECT request_id, 'IngestionCompensated' FROM outcomes WHERE flow = 'ingest' AND outcome <> 'ok'
        UNION ALL SELECT request_id, 'TransactionCompensated' FROM outcomes WHERE flow = 'ask' AND outcome <> 'ok'
        UNION ALL SELECT request_id, 'PaymentRiskScored' FROM outcomes WHERE flow = 'payment' AND outcome <> 'invalid'
        UNION ALL SELECT request_id, 'PaymentCompensated' FROM outcomes WHERE outcome = 'scorer_failed'""",
    "compensation_rollup": f"""{_COMPENSATIONS}
        SELECT coalesce(nullif(boundary, 'ingestion'), 'audit') AS boundary,
               CASE WHEN flow = 'payment' THEN 'downstream_failure' ELSE reason END AS reason, count(*) AS compensations
        FROM done GROUP BY ALL""",
    "transition_check": f"""{_MOVES},
        broken AS (SELECT 'c-' || request_id AS correlation_id, seq,
                          CASE WHEN outcome = 'invalid' AND seq = 2 THEN 'INITIALIZED' ELSE state_from END AS state_from, state_to
                   FROM moves WHERE NOT (outcome = 'scorer_failed' AND seq = 1)),
        chained AS (SELECT *, lag(state_to) OVER (PARTITION BY correlation_id ORDER BY seq) AS previous FROM broken)
        SELECT correlation_id, seq, state_from, state_to, previous,
               (state_from, state_to) IN (('INITIALIZED', 'PROCESSING'), ('PROCESSING', 'COMPLETED'), ('PROCESSING', 'COMPENSATED'))
               AND coalesce(previous, 'INITIALIZED') = state_from AS legal FROM chained""",
    "current_lifecycle_state": f"""{_MOVES}
        SELECT 'c-' || request_id AS correlation_id, arg_max(state_to, seq) AS state, count(*) AS transitions,
               arg_max(state_to, seq) IN ('COMPLETED', 'COMPENSATED') AS terminal
        FROM moves WHERE NOT (outcome = 'scorer_failed' AND seq = 2) GROUP BY request_id""",
    "audit_records": f"""
        SELECT 'requests' AS category, strftime(paid_at, '%Y-%m-%d') AS dt, {_AUDIT_KEY} AS object_key, body,
               base64(unhex(md5(body))) AS content_md5 FROM ({_AUDIT_BODY}) b""",
    "retention_candidates": f"""
        SELECT {_AUDIT_KEY} AS object_key, paid_at + INTERVAL '2555 days' AS retain_until FROM ({_AUDIT_BODY}) b
        WHERE paid_at + INTERVAL '2555 days' < TIMESTAMP '2003-06-01 00:00:00'""",
    "transition_audit": f"""{_MOVES},
        bodies AS (SELECT 'c-' || request_id AS owner, happened, '{{"correlation_id":"c-' || request_id || '","payload":{{"decision":"'
               || decision || '","source":"' || {token_sql("source", "flow")} || '"}},"reason":"' || reason
               || '","record_type":"state_transition","state_from":"' || state_from || '","state_to":"' || state_to
               || '","timestamp":"' || {iso_sql("happened")} || '"}}' AS body FROM moves)
        SELECT 'transitions' AS category, strftime(happened, '%Y-%m-%d') AS dt, 'requests/transitions/'
               || strftime(happened, '%Y/%m/%d/%H%M%S.%f') || 'Z-' || owner || '-' || md5(body) || '.json' AS object_key, body FROM bodies""",
    "compensation_audit": f"""
        WITH outcomes AS ({_OUTCOMES}),
        done AS ({_COMPENSATIONS.split("done AS (")[1].strip().removesuffix(")")}),
        bodies AS (SELECT 'c-' || request_id AS owner, happened, '{{"boundary":"' || boundary || '","correlation_id":"c-' || request_id
               || '","reason":"' || reason || '","record_type":"compensation","request_id":"' || request_id || '","source":"'
               || {token_sql("source", "flow")} || '","timestamp":"' || {iso_sql("happened")} || '"}}' AS body
               FROM done JOIN (SELECT request_id, happened FROM outcomes) o USING (request_id))
        SELECT strftime(happened, '%Y-%m-%d') AS dt, 'requests/compensations/' || strftime(happened, '%Y/%m/%d/%H%M%S.%f')
               || 'Z-' || owner || '-' || md5(body) || '.json' AS object_key, body FROM bodies""",
    "closing_events": f"""
        WITH outcomes AS ({_OUTCOMES}),
        failed AS (
            SELECT *, CASE WHEN flow = 'ingest' THEN 'IngestionCompensated' ELSE 'TransactionCompensated' END AS event_type,
                   CASE WHEN outcome = 'index_failed' THEN 'STORE_ADD_FAILED' ELSE 'AUDIT_WRITE_FAILED' END AS reason
            FROM outcomes WHERE (flow = 'ingest' AND outcome <> 'ok') OR (flow = 'ask' AND outcome = 'audit_failed'))
        SELECT {uuid_sql("event_type", "request_id", "reason")} AS event_id, {iso_sql("happened")} AS occurred_at, event_type,
               CASE WHEN flow = 'ingest' THEN 'ingestion.compensated' ELSE 'transaction.compensated' END AS topic, request_id,
               'c-' || request_id AS correlation_id, reason, CASE WHEN flow = 'ask' THEN request_id END AS operation_id,
               CASE WHEN outcome = 'index_failed' THEN flow || 'Error' ELSE 'audit sink unavailable' END AS error_detail,
               NULL AS object_key, NULL AS record_type FROM failed
        UNION ALL
        SELECT {uuid_sql("'AuditRecordLogged'", "request_id")}, {iso_sql("happened")}, 'AuditRecordLogged', 'audit.record.logged',
               request_id, 'c-' || request_id, NULL, NULL, NULL, 'requests/' || request_id, flow FROM outcomes
        WHERE (flow = 'ingest' AND outcome = 'ok') OR (flow = 'ask' AND outcome <> 'audit_failed')""",
    "transition_events": f"""{_MOVES},
        ids AS (SELECT *, {uuid_sql("'StateTransitionLogged'", "request_id", "seq")} AS event_id FROM moves)
        SELECT event_id, {uuid_sql("'root'", "event_id")} AS causation_id, {iso_sql("happened")} AS occurred_at,
               'state.transition.logged' AS topic, request_id AS entity_id, state_from, state_to, reason FROM ids""",
    "audit_completeness": """
        SELECT 'pay-' || o_orderkey AS request_id, o_orderstatus,
               o_orderkey IN (SELECT l_orderkey FROM lineitem) AS audited FROM orders""",
    "label_bounding": f"SELECT event_id, route, method, status_class FROM ({_LOG}) l",
    "http_counters": f"""
        SELECT 'rag_http_requests_total' AS metric,
               'method="' || method || '",route="' || route || '",status_class="' || status_class || '"' AS labels,
               count(*)::DOUBLE AS value FROM ({_LOG}) l GROUP BY route, method, status_class""",
    "duration_histogram": f"""
        WITH log AS ({_LOG}), buckets AS ({_BUCKETS})
        SELECT 'rag_http_request_duration_seconds' AS metric, 'method="' || method || '",route="' || route || '"' AS labels,
               position, le, bucket_count, round(sum, 4) AS sum, count FROM buckets""",
    "latest_gauge": f"""
        SELECT 'rag_health_check_duration_seconds' AS metric, 'boundary="' || boundary || '"' AS labels,
               arg_max(seconds, ts) AS value FROM ({_LOG}) l GROUP BY boundary""",
    "inflight_profile": f"""
        WITH calls AS (SELECT boundary, ts, ts + to_minutes(CAST(round(seconds) AS INTEGER)) AS ended FROM ({_LOG}) l),
        edges AS (SELECT boundary, ts AS happened, 1 AS change FROM calls UNION ALL SELECT boundary, ended, -1 FROM calls),
        levels AS (SELECT boundary, happened, change,
                          sum(change) OVER (PARTITION BY boundary ORDER BY happened, change ROWS UNBOUNDED PRECEDING) AS level FROM edges),
        buckets AS (SELECT boundary, date_trunc('day', happened) AS bucket, max(level) AS peak, sum(change) AS net,
                           count(*) FILTER (WHERE change = 1) AS started FROM levels GROUP BY ALL)
        SELECT boundary, bucket, CAST(greatest(peak, coalesce(sum(net) OVER (PARTITION BY boundary ORDER BY bucket
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS max_in_flight, started FROM buckets""",
    "zero_filled_families": f"""
        WITH log AS ({_LOG}),
        samples AS (SELECT 'rag_http_requests_total' AS metric, 'method="' || method || '"' AS labels, count(*)::DOUBLE AS value
                    FROM log GROUP BY method
                    UNION ALL SELECT 'rag_downstream_failures_total', 'boundary="' || boundary || '"', sum(seconds)
                    FROM log GROUP BY boundary),
        declared AS (SELECT unnest(['rag_http_requests_total','rag_http_request_duration_seconds','rag_http_requests_in_flight',
                     'rag_health_checks_total','rag_health_check_duration_seconds','rag_ready','rag_bulkhead_active',
                     'rag_bulkhead_rejections_total','rag_ratelimit_rejections_total','rag_boundary_duration_seconds',
                     'rag_downstream_failures_total','rag_compensating_events_total']) AS metric,
                     unnest(['counter','histogram','gauge','counter','gauge','gauge','gauge','counter','counter','histogram',
                     'counter','counter']) AS kind)
        SELECT metric, kind, coalesce(labels, '') AS labels, round(coalesce(value, 0), 3) AS value
        FROM declared LEFT JOIN samples USING (metric)""",
    "readiness": """
        WITH required AS (SELECT DISTINCT 'u-' || user_id AS target, event_type AS dependency FROM events
                          UNION ALL SELECT DISTINCT 'u-' || user_id, 'never' FROM events WHERE user_id % 10 = 7),
        latest AS (SELECT event_type AS dependency, CASE WHEN arg_max(value, ts) < 100 THEN 'ok' ELSE 'failed' END AS status
                   FROM events WHERE event_type <> 'signup' GROUP BY event_type)
        SELECT target, bool_and(coalesce(status = 'ok', false)) AS ready,
               count(*) FILTER (WHERE NOT coalesce(status = 'ok', false)) AS unhealthy, count(*) AS required
        FROM required LEFT JOIN latest USING (dependency) GROUP BY target""",
}
