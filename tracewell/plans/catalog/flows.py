"""Registered queries: the composite flows and reports, run end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import answers, lifecycle, metrics
from tracewell.plans import reports, requests
from tracewell.plans.catalog.common import KEY, PAYMENTS_SQL, SCORE_SQL, ntz, token_sql, uuid_sql
from tracewell.plans.catalog.operations import _LOG
from tracewell.plans.catalog.payments import _ENVELOPES
from tracewell.plans.catalog.payments import _envelopes as payment_envelopes
from tracewell.plans.catalog.privacy import REDACTED_SQL, chunk_id_sql, recursive_chunks_sql
from tracewell.plans.catalog.retrieval import _LEXICAL
from tracewell.sources import tables


def _at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _ingested(spark, folder):
    documents = tables.documents(spark, folder).withColumn("correlation_id", F.concat(F.lit("c-"), "request_id"))
    outcome = F.when(F.col("lang") == "de", "index_failed").otherwise("ok")
    return requests.ingest_documents(documents, KEY, _at(), outcome=outcome, error=F.when(F.col("lang") == "de", "TimeoutError").otherwise(""))


def ingest_documents(spark, folder):
    telemetry = _ingested(spark, folder).telemetry
    kinds = F.sort_array(F.map_keys("pii_counts"))
    return telemetry.select(
        "request_id", "event_id", "source_token", "chunk_count", "topic", F.array_join(kinds, ",").alias("kinds"))


def ingest_lifecycle(spark, folder):
    moves = _ingested(spark, folder).transitions
    return moves.select("request_id", "correlation_id", "seq", "state_from", "state_to", "reason")


def ingest_closing(spark, folder):
    """Events that end ingest requests, beside what the moves of a request carry."""
    result = _ingested(spark, folder)
    carried = result.transitions.groupBy("request_id").agg(F.array_join(F.sort_array(F.flatten(F.collect_list(F.map_keys("payload")))), ",").alias("carried"))
    events = result.closing.select(
        "request_id", "event_type", "reason", "error_detail", F.coalesce(F.col("object_key") != "", F.lit(False)).alias("recorded"),
        (F.col("source_token") != "").alias("from_source"))
    return events.join(carried, "request_id")


def ingest_chunks(spark, folder):
    return _ingested(spark, folder).chunks


def ask_questions(spark, folder):
    questions = tables.questions(spark, folder).withColumn("correlation_id", F.col("request_id"))
    answered = requests.ask(questions, tables.document_chunks(spark, folder), KEY, _at()).answers
    return answered.select("request_id", "answer", F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence"))


def process_payments(spark, folder):
    """Faulty and sound envelopes through the whole payment flow, to the last lifecycle state."""
    rows = payment_envelopes(spark, folder)
    rows = rows.withColumn("request_id", F.concat(F.lit("pay-"), "o_orderkey")).withColumn("correlation_id", F.concat(F.lit("c-"), "o_orderkey"))
    result = requests.process_payments(rows, KEY, _at())
    moves = lifecycle.lifecycle_transitions(result.outcomes).filter("seq = 2")
    return moves.select("request_id", "outcome", "decision", "state_to", "reason")


def service_metrics(spark, folder):
    log = tables.request_log(spark, folder)
    compensations = log.filter("route IS NULL").select(
        F.when(F.col("boundary") != "boundary-0", F.col("boundary")).alias("boundary"), F.lit(None).cast("string").alias("reason"))
    checks = log.select(
        F.col("boundary").alias("check"), F.when(F.col("seconds") < 5, "ok").otherwise("failed").alias("status"), "seconds",
        F.col("ts").alias("checked_at"),
    )
    rows = reports.service_metrics(log, compensations, checks)
    text = F.transform(F.sort_array(F.map_keys("labels")), lambda k: F.concat(k, F.lit("="), F.col("labels")[k]))
    return rows.select("metric", "kind", F.array_join(text, ",").alias("labels"), "le", F.round("value", 4).alias("value"))


def ask_flow(spark, folder):
    """Lifecycle of every question: the store fails for ids ending in 9, the model for those ending in 4, the audit
    sink for one of seven. Moves, compensations and closing events in one table."""
    number = F.col("query_id")
    fails = lambda when, name: F.when(when, F.lit(name))
    generated = lambda asked: asked.withColumn("llm_error", fails((number % 10 == 4) & (F.col("retrieved_count") > 0), "CallTimedOut")).withColumn(
        "answer", F.when(F.col("llm_error").isNull() & (F.col("retrieved_count") > 0), F.concat(F.lit("answer to "), "request_id")))
    result = requests.ask(
        tables.questions(spark, folder), tables.document_chunks(spark, folder), KEY, F.lit("2024-01-01 00:00:00").cast("timestamp"),
        generator=generated, store_error=fails(number % 10 == 9, "BulkheadRejected"), audit_error=fails(number % 7 == 3, "OSError"),
        messages=answers.Messages(no_evidence="nothing found"))
    none = F.lit(None).cast("string")
    moves = result.transitions.select("request_id", F.lit("move").alias("kind"), F.col("state_to").alias("what"), "reason", F.col("payload").isNotNull().alias("recorded"))
    undone = result.undone.select("request_id", F.lit("undone").alias("kind"), F.concat_ws(":", "boundary", "error").alias("what"), "reason", F.lit(False).alias("recorded"))
    closing = result.closing.select(
        "request_id", F.lit("event").alias("kind"), F.col("event_type").alias("what"), F.nullif("reason", F.lit("")).alias("reason"),
        F.coalesce(F.col("object_key") != "", F.lit(False)).alias("recorded"))
    said = result.answers.select("request_id", F.lit("answer").alias("kind"), F.col("answer").alias("what"), none.alias("reason"), F.lit(False).alias("recorded"))
    return moves.unionByName(undone).unionByName(closing).unionByName(said)


def service_families(spark, folder):
    """All twelve families from one reading of the events as a service log; the report is of noon on the 15th."""
    log = tables.request_log(spark, folder)
    event = F.col("event_id")
    failure = F.when(event % 11 == 3, "BulkheadRejected").when(event % 11 == 5, "RateLimitExceeded").when(event % 11 == 7, "CallTimedOut")
    log = log.select(
        "route", "method", "status", "seconds", "ts", (F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("seconds") * 100).cast("int"))).alias("ended_at"),
        F.when(F.col("boundary") != "boundary-2", F.col("boundary")).alias("boundary"), F.col("method").alias("operation"), failure.alias("failure"),
        F.coalesce("route", F.lit("none")).alias("dependency"), F.when(event % 5 == 0, F.col("boundary")).alias("check_name"),
        F.when(F.col("seconds") < 5, "ok").otherwise("failed").alias("check_status"))
    rows = metrics.all_families(log, F.lit("2024-01-15 12:00:00").cast("timestamp"), ("boundary-0", "boundary-1", "boundary-2"))
    text = F.transform(F.sort_array(F.map_keys("labels")), lambda k: F.concat(k, F.lit("="), F.col("labels")[k]))
    return rows.select("metric", "kind", F.array_join(text, ",").alias("labels"), "le", F.round("value", 4).alias("value"))


def trace_completeness(spark, folder):
    """Orders as requests: two moves each, line items as their events, records for all but every ninth."""
    orders = tables.payments(spark, folder)
    outcomes = orders.select(
        F.lit("payment").alias("flow"), F.when(F.col("o_orderstatus") == "P", "scorer_failed").otherwise("ok").alias("outcome"),
        "request_id", "correlation_id", F.lit("allow").alias("decision"), "o_orderkey",
    )
    moves = lifecycle.lifecycle_transitions(outcomes).filter("NOT (o_orderkey % 7 = 0 AND seq = 1)")
    items = tables.table(spark, folder, "lineitem").select(
        F.concat(F.lit("c-"), "l_orderkey").alias("correlation_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("event_id"),
        F.col("l_returnflag").alias("event_type"), F.col("l_shipdate").cast("timestamp").alias("occurred_at"),
    )
    records = orders.filter("o_orderkey % 9 > 0").select("correlation_id")
    rows = reports.trace_completeness(items, moves, records)
    return rows.select(
        "correlation_id", "events", "event_types", ntz("started_at").alias("started_at"), ntz("ended_at").alias("ended_at"),
        "state", "transitions", "terminal", "legal", "audited",
    )


def transaction_anomalies(spark, folder):
    """Orders as inserts at their order date; windows of a week per currency."""
    rows = tables.payments(spark, folder)
    row = F.struct("transaction_id", "merchant_id", "amount_minor", "currency", "payment_network")
    envelope = F.to_json(F.struct(
        row.alias("after"), F.when(F.col("o_orderstatus") == "P", "d").otherwise("c").alias("op"),
        F.unix_millis("paid_at").alias("ts_ms"), F.struct(F.col("o_orderkey").alias("lsn")).alias("source"),
    ))
    scored = reports.transaction_anomalies(rows.select(envelope.alias("value")), "7 days", 2.0)
    return scored.select(
        "currency", ntz("window_start").alias("window_start"), "n", "total", F.round("z", 4).alias("z"), "anomaly")


QUERIES = {f.__name__: f for f in (
    ingest_documents, ingest_lifecycle, ingest_chunks, ingest_closing, ask_questions, process_payments, service_metrics, service_families, ask_flow,
    trace_completeness, transaction_anomalies,
)}

_BOUNDS = ("0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10", "30", "60", "120")
_DURATION = "rag_http_request_duration_seconds"
_HISTOGRAM = " UNION ALL ".join(
    f"SELECT '{_DURATION}_bucket', 'histogram', 'method=' || method || ',route=' || route, '{bound}', "
    f"CAST(count(*) FILTER (WHERE seconds <= {bound}) AS DOUBLE) FROM log GROUP BY route, method" for bound in _BOUNDS
) + "".join(
    f" UNION ALL SELECT '{_DURATION}_{name}', 'histogram', 'method=' || method || ',route=' || route, {le}, "
    f"CAST({value} AS DOUBLE) FROM log GROUP BY route, method"
    for name, le, value in (("bucket", "'+Inf'", "count(*)"), ("sum", "NULL", "sum(seconds)"), ("count", "NULL", "count(*)"))
)

# Documents the ingest accepts, redacted and cut.
_ACCEPTED = f"""
{REDACTED_SQL},
accepted AS MATERIALIZED (
    SELECT doc_id, r.text FROM documents d JOIN redacted r USING (doc_id) WHERE length(d.text) BETWEEN 1 AND 200000),
{recursive_chunks_sql("accepted")}"""

_CALLS = """
    SELECT *, CASE event_id % 11 WHEN 3 THEN 'BulkheadRejected' WHEN 5 THEN 'RateLimitExceeded' WHEN 7 THEN 'CallTimedOut' END AS failure,
           CASE WHEN place <> 2 THEN 'boundary-' || place END AS boundary, 'boundary-' || place AS check_name,
           ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts + to_minutes(floor(seconds * 100)::BIGINT) > TIMESTAMP '2024-01-15 12:00:00' AS held
    FROM (SELECT event_id, ts, value / 10 AS seconds, user_id % 3 AS place, CASE WHEN event_type = 'error' THEN NULL ELSE '/' || event_type END AS raw_route,
                 coalesce(raw_route, 'unmatched') AS route, (event_id % 6 * 100 + 100 + user_id % 5) // 100 AS hundreds,
                 (['GET','POST','PUT','BREW','DELETE','PATCH','get'])[event_id % 7 + 1] AS raw_method,
                 CASE WHEN raw_method IN ('BREW', 'get') THEN 'OTHER' ELSE raw_method END AS method,
                 CASE WHEN hundreds BETWEEN 2 AND 5 THEN hundreds || 'xx' ELSE 'other' END AS status_class FROM events) e"""
_CALLED = "boundary IS NOT NULL AND coalesce(failure, '') NOT IN ('BulkheadRejected', 'RateLimitExceeded')"


def _buckets_sql(metric, labels, where):
    bounds = " UNION ALL ".join(f"SELECT '{bound}' AS le, {bound}::DOUBLE AS bound" for bound in _BOUNDS)
    return f"""
        SELECT '{metric}_bucket', 'histogram', {labels}, le, count(*) FILTER (WHERE seconds <= bound)::DOUBLE
        FROM calls, ({bounds} UNION ALL SELECT '+Inf', 'Infinity'::DOUBLE) b WHERE {where} GROUP BY ALL
        UNION ALL SELECT '{metric}_sum', 'histogram', {labels}, NULL, sum(seconds) FROM calls WHERE {where} GROUP BY ALL
        UNION ALL SELECT '{metric}_count', 'histogram', {labels}, NULL, count(*) FROM calls WHERE {where} GROUP BY ALL"""


ORACLES = {
    "ingest_closing": """
        SELECT 'doc-' || doc_id AS request_id, CASE WHEN lang = 'de' THEN 'IngestionCompensated' ELSE 'AuditRecordLogged' END AS event_type,
               CASE WHEN lang = 'de' THEN 'STORE_ADD_FAILED' END AS reason, CASE WHEN lang = 'de' THEN 'TimeoutError' END AS error_detail,
               lang <> 'de' AS recorded, CASE WHEN lang = 'de' THEN true END AS from_source,
               CASE WHEN lang = 'de' THEN 'source_token' ELSE 'audit_key,source_token' END AS carried
        FROM documents WHERE length(text) BETWEEN 1 AND 200000""",
    "ask_flow": f"""
        WITH {_LEXICAL}, counts AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id),
        asked AS (
            SELECT 'q-' || item_id AS request_id, item_id % 10 = 9 AS store, item_id % 7 = 3 AS sink, NOT store AND coalesce(n, 0) > 0 AS found,
                   found AND item_id % 10 = 4 AS model, store OR model OR sink AS failed
            FROM benchmark LEFT JOIN counts ON query_id = item_id)
        SELECT request_id, 'move' AS kind, 'PROCESSING' AS what, 'Question received for retrieval' AS reason, false AS recorded FROM asked
        UNION ALL SELECT request_id, 'move', CASE WHEN failed THEN 'COMPENSATED' ELSE 'COMPLETED' END,
               CASE WHEN sink THEN 'Audit persistence failed' WHEN failed THEN 'Retrieval returned a safe fallback'
                    ELSE 'Retrieval and inference completed' END, NOT sink FROM asked
        UNION ALL SELECT request_id, 'undone', 'retrieval_store:BulkheadRejected', 'DOWNSTREAM_FAILURE_FAIL_SAFE', false FROM asked WHERE store
        UNION ALL SELECT request_id, 'undone', 'llm_inference:CallTimedOut', 'DOWNSTREAM_FAILURE_FAIL_SAFE', false FROM asked WHERE model
        UNION ALL SELECT request_id, 'undone', 'audit_sink:OSError', 'AUDIT_WRITE_FAILED', false FROM asked WHERE sink
        UNION ALL SELECT request_id, 'event', 'AuditRecordLogged', NULL, true FROM asked WHERE NOT sink
        UNION ALL SELECT request_id, 'event', 'TransactionCompensated', 'AUDIT_WRITE_FAILED', false FROM asked WHERE sink
        UNION ALL SELECT request_id, 'answer', CASE WHEN NOT found THEN 'nothing found' WHEN model THEN
               'Inference is unavailable; retrieved evidence is returned without a generated answer.' ELSE 'answer to ' || request_id END, NULL, false
        FROM asked WHERE NOT sink""",
    "service_families": f"""
        WITH calls AS ({_CALLS}), checks AS (SELECT * FROM calls WHERE event_id % 5 = 0),
        samples(metric, kind, labels, le, value) AS (
            SELECT 'rag_http_requests_total', 'counter', 'method=' || method || ',route=' || route || ',status_class=' || status_class, NULL::VARCHAR, count(*)::DOUBLE
            FROM calls GROUP BY ALL
            UNION ALL SELECT 'rag_http_requests_in_flight', 'gauge', '', NULL, count(*) FILTER (held) FROM calls
            UNION ALL SELECT 'rag_bulkhead_active', 'gauge', 'boundary=' || boundary, NULL, count(*) FILTER (held) FROM calls WHERE {_CALLED} GROUP BY ALL
            UNION ALL SELECT 'rag_bulkhead_rejections_total', 'counter', 'boundary=' || boundary, NULL, count(*) FROM calls
                      WHERE boundary IS NOT NULL AND failure = 'BulkheadRejected' GROUP BY ALL
            UNION ALL SELECT 'rag_ratelimit_rejections_total', 'counter', 'boundary=' || boundary, NULL, count(*) FROM calls
                      WHERE boundary IS NOT NULL AND failure = 'RateLimitExceeded' GROUP BY ALL
            UNION ALL SELECT 'rag_downstream_failures_total', 'counter', 'boundary=' || boundary || ',dependency=' || coalesce(raw_route, 'none'), NULL, count(*)
                      FROM calls WHERE {_CALLED} AND failure IS NOT NULL GROUP BY ALL
            UNION ALL SELECT 'rag_compensating_events_total', 'counter', 'boundary=' || boundary || ',reason=' || failure, NULL, count(*)
                      FROM calls WHERE boundary IS NOT NULL AND failure IS NOT NULL GROUP BY ALL
            UNION ALL SELECT 'rag_health_checks_total', 'counter', 'check=' || check_name || ',status=' || CASE WHEN seconds < 5 THEN 'ok' ELSE 'failed' END, NULL, count(*)
                      FROM checks GROUP BY ALL
            UNION ALL SELECT 'rag_health_check_duration_seconds', 'gauge', 'check=' || check_name, NULL, arg_max(seconds, ts) FROM checks GROUP BY ALL
            UNION ALL SELECT 'rag_ready', 'gauge', '', NULL, (count(*) FILTER (latest < 5) = 3)::INT
                      FROM (SELECT arg_max(seconds, ts) AS latest FROM checks GROUP BY check_name) c
            UNION ALL {_buckets_sql("rag_http_request_duration_seconds", "'method=' || method || ',route=' || route", "true")}
            UNION ALL {_buckets_sql("rag_boundary_duration_seconds", "'boundary=' || boundary || ',operation=' || raw_method", _CALLED)})
        SELECT metric, kind, labels, le, round(value, 4) AS value FROM samples""",
    "ingest_documents": f"""
        WITH RECURSIVE {_ACCEPTED},
        names AS (SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM kinds GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*)::INTEGER AS n FROM pieced GROUP BY doc_id)
        SELECT 'doc-' || doc_id AS request_id, {uuid_sql("'TelemetryIngested'", "'doc-' || doc_id")} AS event_id,
               {token_sql("source", "source")} AS source_token, coalesce(n, 0) AS chunk_count,
               'telemetry.ingested' AS topic, coalesce(kinds, '') AS kinds
        FROM accepted JOIN documents d USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "ingest_chunks": f"""
        WITH RECURSIVE {_ACCEPTED}
        SELECT {chunk_id_sql("p.text")} AS chunk_id, 'doc-' || doc_id AS request_id, position, p.text,
               {token_sql("source", "source")} AS source_token
        FROM pieced p JOIN documents d USING (doc_id) WHERE lang <> 'de'""",
    "ingest_lifecycle": """
        SELECT 'doc-' || doc_id AS request_id, 'c-doc-' || doc_id AS correlation_id, 1 AS seq, 'INITIALIZED' AS state_from,
               'PROCESSING' AS state_to, 'Received document for ingestion' AS reason FROM documents
        UNION ALL
        SELECT 'doc-' || doc_id, 'c-doc-' || doc_id, 2, 'PROCESSING', CASE WHEN lang = 'de' THEN 'COMPENSATED' ELSE 'COMPLETED' END,
               CASE WHEN lang = 'de' THEN 'Vector store write failed' ELSE 'Ingestion completed successfully' END FROM documents""",
    "ask_questions": f"""WITH {_LEXICAL},
        counts AS (SELECT query_id, count(*)::INTEGER AS n FROM hits GROUP BY query_id)
        SELECT 'q-' || item_id AS request_id, CASE WHEN n > 0
               THEN 'Inference is disabled; retrieved evidence is returned without a generated answer.'
               ELSE 'No indexed evidence is available.' END AS answer, coalesce(n, 0) AS evidence
        FROM benchmark LEFT JOIN counts ON query_id = item_id""",
    "process_payments": f"""
        WITH e AS (SELECT 'pay-' || o_orderkey AS request_id, fault, amount AS amount_minor, currency FROM ({_ENVELOPES}) v),
        d AS (SELECT request_id, CASE WHEN fault IN (1, 2, 3, 5, 6, 7, 9, 10) THEN 'invalid' ELSE 'ok' END AS outcome,
                     CASE WHEN fault IN (1, 2, 3, 5, 6, 7, 9, 10) THEN '' WHEN {SCORE_SQL} >= 0.7 THEN 'review' ELSE 'allow' END AS decision FROM e)
        SELECT request_id, outcome, decision, CASE outcome WHEN 'ok' THEN 'COMPLETED' ELSE 'COMPENSATED' END AS state_to,
               CASE outcome WHEN 'ok' THEN 'Decision: ' || decision ELSE 'Payment ingestion failed' END AS reason FROM d""",
    "service_metrics": f"""
        WITH log AS ({_LOG}),
        samples(metric, kind, labels, le, value) AS (
            SELECT 'rag_http_requests_total', 'counter', 'method=' || method || ',route=' || route || ',status_class=' || status_class,
                   NULL::VARCHAR, count(*)::DOUBLE FROM log GROUP BY method, route, status_class
            UNION ALL SELECT 'rag_compensating_events_total', 'counter', 'boundary=' || coalesce(nullif(boundary, 'boundary-0'), 'audit')
                   || ',reason=downstream_failure', NULL, count(*) FROM log WHERE route = 'unmatched' GROUP BY boundary
            UNION ALL SELECT 'rag_health_checks_total', 'counter', 'check=' || boundary || ',status='
                   || CASE WHEN seconds < 5 THEN 'ok' ELSE 'failed' END, NULL, count(*) FROM log GROUP BY boundary, seconds < 5
            UNION ALL SELECT 'rag_health_check_duration_seconds', 'gauge', 'check=' || boundary, NULL, arg_max(seconds, ts)
                   FROM log GROUP BY boundary
            UNION ALL {_HISTOGRAM}
            UNION ALL SELECT unnest(['rag_http_requests_in_flight','rag_ready','rag_bulkhead_active','rag_bulkhead_rejections_total',
                     'rag_ratelimit_rejections_total','rag_boundary_duration_seconds','rag_downstream_failures_total']),
                   unnest(['gauge','gauge','gauge','counter','counter','histogram','counter']), '', NULL, 0.0)
        SELECT metric, kind, labels, le, round(value, 4) AS value FROM samples""",
    "trace_completeness": """
        WITH items AS (SELECT l_orderkey, l_returnflag, l_shipdate FROM lineitem),
        traces AS (SELECT l_orderkey, count(*) AS events, count(DISTINCT l_returnflag) AS event_types,
                          min(l_shipdate) AS started_at, max(l_shipdate) AS ended_at FROM items GROUP BY l_orderkey)
        SELECT 'c-' || l_orderkey AS correlation_id, events, event_types, started_at, ended_at,
               CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'P' THEN 'COMPENSATED' ELSE 'COMPLETED' END AS state,
               CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderkey % 7 = 0 THEN 1::BIGINT ELSE 2 END AS transitions,
               CASE WHEN o_orderkey IS NULL THEN NULL ELSE true END AS terminal, o_orderkey % 7 > 0 AS legal,
               coalesce(o_orderkey % 9 > 0, false) AS audited
        FROM traces LEFT JOIN orders ON o_orderkey = l_orderkey""",
    "transaction_anomalies": f"""
        WITH rows AS (SELECT currency, amount_minor, time_bucket(INTERVAL '7 days', paid_at, TIMESTAMP '1970-01-01') AS window_start
                      FROM ({PAYMENTS_SQL}) p WHERE o_orderstatus <> 'P'),
        totals AS (SELECT currency, window_start, count(*) AS n, sum(amount_minor)::BIGINT AS total FROM rows GROUP BY ALL),
        scored AS (SELECT *, avg(total) OVER k AS mean, stddev_samp(total) OVER k AS deviation FROM totals
                   WINDOW k AS (PARTITION BY currency)),
        z AS (SELECT *, CASE WHEN deviation > 0 THEN (total - mean) / deviation END AS z FROM scored)
        SELECT currency, window_start, n, total, round(z, 4) AS z, coalesce(abs(z) > 2.0, false) AS anomaly FROM z""",
}
