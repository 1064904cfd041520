"""Registered queries: event log, envelopes, windows, causation, traces, anomalies, changes."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tracewell.functions.canonical import canonical_json, message_headers, partition_key
from tracewell.operators import admission, anomaly, cdc, events, payments
from tracewell.plans.catalog.common import KEY, PAYMENTS_SQL, SCORE_SQL, iso_sql, ntz, token_sql, uuid_sql
from tracewell.session import shared_dir
from tracewell.sources import tables


def _counts(spark, folder, width):
    counted = events.window_counts(tables.event_log(spark, folder), width)
    return counted.select(ntz("window_start").alias("window_start"), ntz("window_end").alias("window_end"),
                          "event_type", F.col("count").alias("events"))


def event_counts_1m(spark, folder):
    return _counts(spark, folder, "1 minute")


def event_counts_5m(spark, folder):
    return _counts(spark, folder, "5 minutes")


def event_dedup(spark, folder):
    """The whole log arrives twice, the copies an hour late; the earliest copy stays."""
    log = tables.event_log(spark, folder).select("event_id", "event_type", "occurred_at", "correlation_id")
    copies = log.withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 1 hour"))
    kept = events.dedup_events(log.unionByName(copies))
    return kept.select("event_id", "event_type", ntz("occurred_at").alias("occurred_at"), "correlation_id")


def _later():
    return F.to_timestamp("occurred_at") + F.expr("interval 250 milliseconds")


def _scored(spark, folder):
    rows = tables.payments(spark, folder)
    accepted, _ = payments.split_payments(rows)
    ingested = payments.ingested_events(payments.tokenize_payments(accepted, KEY), F.col("paid_at"))
    error = F.when(F.col("correlation_id").endswith("7"), F.lit("CallTimedOut"))
    return ingested, payments.score_payments(ingested, error=error)


def _payment_events(spark, folder):
    ingested, scored = _scored(spark, folder)
    return ingested, payments.scored_events(scored, _later()), payments.compensated_events(scored, _later())


def _payment_log(spark, folder):
    return payments.payment_log(_scored(spark, folder)[1], _later())


def event_log_union(spark, folder):
    log = _payment_log(spark, folder)
    return log.select(
        "event_id", "event_type", "topic", "occurred_at", "correlation_id", "transaction_token", "amount_minor",
        "risk_score", "decision", "failure_reason", "original_event_type",
    )


def event_keys(spark, folder):
    """Message key of payment events (token) and of request events (correlation id)."""
    ingested = _payment_events(spark, folder)[0].select("event_id", "transaction_token", "correlation_id")
    requests = tables.event_log(spark, folder).select("event_id", F.lit("").alias("transaction_token"), "correlation_id")
    both = ingested.unionByName(requests)
    return both.select("event_id", partition_key(both).alias("message_key"))


def _messages(spark, folder):
    """Events as JSON texts with a field the reader ignores; those of type error are cut short."""
    log = tables.event_log(spark, folder)
    body = F.concat(
        F.lit('{"event_id":"'), "event_id", F.lit('","event_type":"'), "event_type", F.lit('","occurred_at":"'),
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('+00:00","request_id":"'), "correlation_id",
        F.lit('","ignored":1}'),
    )
    return log.select(F.when(F.col("event_type") == "error", F.substr(body, F.lit(1), F.length(body) - 20)).otherwise(body).alias("value"))


def envelope_parse(spark, folder):
    good = events.split_malformed(events.parse_events(_messages(spark, folder)))[0]
    return good.withColumn("occurred_at", ntz("occurred_at"))


def envelope_quarantine(spark, folder):
    return events.split_malformed(events.parse_events(_messages(spark, folder)))[1]


def event_headers(spark, folder):
    """Own trace id on every third event; callers add a tenant and try to replace the correlation id."""
    log = tables.event_log(spark, folder).select(
        "event_id", "event_type", "correlation_id", F.concat(F.lit("cause-"), "seq").alias("causation_id"),
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit("00-"), "seq")).otherwise("").alias("traceparent"),
    )
    extra = F.array(*[
        F.struct(F.lit(name).alias("key"), F.encode(F.lit(value), "UTF-8").alias("value"))
        for name, value in (("tenant", "t1"), ("correlation_id", "forged"))
    ])
    headers = message_headers(log, extra=extra)
    readable = F.transform(headers, lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "UTF-8")))
    return log.select("event_id", F.array_join(readable, ";").alias("headers"))


def canonical_json_events(spark, folder):
    log = tables.event_log(spark, folder).select(
        "event_id", "event_type", "value", F.when(F.col("seq") % 5 > 0, F.col("correlation_id")).alias("correlation_id"),
        F.create_map(F.lit("z"), "event_type", F.lit("a"), "correlation_id").alias("labels"),
        F.struct(F.col("seq").alias("seq"), F.array("user_id", "seq").alias("ids")).alias("detail"),
    )
    return log.select("event_id", canonical_json(log).alias("body"))


def causal_pairs(spark, folder):
    kind = F.col("event_type")
    answers = ((kind == "PaymentRiskScored") & ~F.col("correlation_id").endswith("3")) | (kind == "PaymentCompensated")
    pairs = events.causal_pairs_in(_payment_log(spark, folder), kind == "PaymentTransactionIngested", answers)
    return pairs.select("event_id", "correlation_id", "child_id", "child_type", "child_at")


def trace_report(spark, folder):
    report = events.trace_report(tables.event_log(spark, folder))
    return report.withColumn("started_at", ntz("started_at")).withColumn("ended_at", ntz("ended_at"))


def trace_steps(spark, folder):
    steps = events.trace_steps(tables.event_log(spark, folder))
    return steps.select("correlation_id", "event_id", "event_type", F.col("step").cast("bigint").alias("step"))


def distinct_per_window(spark, folder):
    counted = events.distinct_per_window(tables.event_log(spark, folder), "1 day", "occurred_at", "event_type", "user_id")
    return counted.select(ntz("window_start").alias("window_start"), "distinct_event_type", "distinct_user_id")


def publish_reconciliation(spark, folder):
    """Payments whose decision event never arrived; decisions of every tenth payment are withheld."""
    ingested, scored, _ = _payment_events(spark, folder)
    observed = scored.filter(~F.col("correlation_id").endswith("0")).select(F.col("causation_id").alias("event_id"))
    return events.missing_events(ingested, observed).select("event_id", "correlation_id")


def topic_pattern_copy(spark, folder):
    log = _payment_log(spark, folder).select("topic", "event_id")
    requests = tables.event_log(spark, folder).select(F.concat(F.lit("telemetry."), "event_type").alias("topic"), "event_id")
    return events.matching_topics(log.unionByName(requests))


def zscore_anomalies_5m(spark, folder):
    return _zscores(spark, folder, "5 minutes", 3.0)


def zscore_anomalies_1d(spark, folder):
    return _zscores(spark, folder, "1 day", 2.0)


def _zscores(spark, folder, width, threshold):
    scored = anomaly.zscore_anomalies(tables.event_log(spark, folder), "occurred_at", "event_type", "value", width, threshold)
    return scored.select(
        "event_type", ntz("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"),
        F.round("z", 4).alias("z"), "anomaly",
    )


def trailing_zscore(spark, folder):
    scored = anomaly.trailing_zscore(tables.event_log(spark, folder), "occurred_at", "event_type", "value", "6 hours", 12, 2.0)
    return scored.select(
        "event_type", ntz("window_start").alias("window_start"), F.round("total", 4).alias("total"),
        F.round("z", 4).alias("z"), "anomaly",
    )


def _changes(spark, folder):
    """Every order as snapshot read, a later update for two of three, a delete for each one that has status P."""
    rows = tables.payments(spark, folder)
    fields = ["transaction_id", "merchant_id", "amount_minor", "currency", "payment_network"]
    envelope = lambda before, after, op, ts, lsn: F.to_json(F.struct(
        before.alias("before"), after.alias("after"), F.lit(op).alias("op"), F.lit(ts).alias("ts_ms"),
        F.struct(lsn.alias("lsn")).alias("source"),
    ))
    row = F.struct(*fields)
    changed = F.struct(*fields[:2], (F.col("amount_minor") + 1).alias("amount_minor"), *fields[3:])
    none = F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType)
    changes = rows.select(F.explode(F.array_compact(F.array(
        envelope(none, row, "r", 1000, F.col("o_orderkey")),
        F.when(F.col("o_orderkey") % 3 > 0, envelope(row, changed, "u", 2000, F.col("o_orderkey") * 2 + 1)),
        F.when(F.col("o_orderkey") % 3 == 1, envelope(row, row, "u", 2000, F.col("o_orderkey") * 2)),
        F.when(F.col("o_orderstatus") == "P", envelope(row, none, "d", 3000, F.col("o_orderkey"))),
    ))).alias("value"))
    return cdc.parse_changes(changes)


def cdc_current_state(spark, folder):
    return cdc.apply_changes(_changes(spark, folder), "transaction_id")


def cdc_merged(spark, folder):
    """The same changes merged into a stored table, latest first: deletes meet updates and reads that came late."""
    table = cdc.change_table(spark, f"{shared_dir(spark)}/changes-{os.urandom(8).hex()}")
    changes = cdc.change_rows(_changes(spark, folder), "transaction_id")
    for batch, time in enumerate((3000, 2000, 1000)):
        table.merge(changes.filter(F.col("ts_ms") == time), batch)
    table.merge(changes.filter("op = 'r'"), 1)  # a replayed batch
    table.clean()
    return table.rows().select("row.*")


def token_bucket(spark, folder):
    """Two calls a day per user: a user's third call within a busy stretch waits for new tokens."""
    calls = tables.event_log(spark, folder).select("user_id", "event_id", "occurred_at")
    admitted = admission.token_bucket(
        calls, "user_id", "occurred_at", ("event_id",), rate=2 / 86_400, capacity=2, bucket=F.date_trunc("week", "occurred_at"),
    )
    return admitted.withColumn("occurred_at", ntz("occurred_at"))


QUERIES = {f.__name__: f for f in (
    event_counts_1m, event_counts_5m, event_dedup, event_log_union, event_keys, envelope_parse, envelope_quarantine,
    event_headers, canonical_json_events, causal_pairs, trace_report, trace_steps, distinct_per_window,
    publish_reconciliation, topic_pattern_copy, zscore_anomalies_5m, zscore_anomalies_1d, trailing_zscore,
    cdc_current_state, cdc_merged, token_bucket,
)}


def _counts_sql(minutes):
    return f"""
        SELECT time_bucket(INTERVAL '{minutes} minutes', ts) AS window_start,
               time_bucket(INTERVAL '{minutes} minutes', ts) + INTERVAL '{minutes} minutes' AS window_end,
               event_type, count(*) AS events FROM events GROUP BY ALL"""


def _zscore_sql(interval, threshold):
    return f"""
        WITH totals AS (SELECT event_type, time_bucket(INTERVAL '{interval}', ts) AS window_start, count(*) AS n,
                               sum(value) AS total FROM events GROUP BY ALL),
        scored AS (SELECT *, avg(total) OVER k AS mean, stddev_samp(total) OVER k AS deviation FROM totals
                   WINDOW k AS (PARTITION BY event_type)),
        z AS (SELECT *, CASE WHEN deviation > 0 THEN (total - mean) / deviation END AS z FROM scored)
        SELECT event_type, window_start, n, round(total, 4) AS total, round(z, 4) AS z,
               coalesce(abs(z) > {threshold}, false) AS anomaly FROM z"""


_INGESTED = f"""
SELECT *, {token_sql("payment_transaction", "transaction_id")} AS transaction_token FROM ({PAYMENTS_SQL}) p
"""
_IDS = f"""
SELECT *, {uuid_sql("'PaymentTransactionIngested'", "correlation_id", "transaction_token")} AS ingested_id,
       o_orderkey % 10 = 7 AS failed FROM ({_INGESTED}) i
"""
_EVENTS = f"""
WITH base AS ({_IDS}),
payment_events AS (
    SELECT ingested_id AS event_id, 'PaymentTransactionIngested' AS event_type, 'payments.transaction.ingested.v2' AS topic,
           {iso_sql("paid_at")} AS occurred_at, correlation_id, transaction_token, amount_minor,
           NULL::DOUBLE AS risk_score, NULL::VARCHAR AS decision, NULL::VARCHAR AS failure_reason,
           NULL::VARCHAR AS original_event_type, NULL::VARCHAR AS cause FROM base
    UNION ALL
    SELECT {uuid_sql("'PaymentRiskScored'", "ingested_id")}, 'PaymentRiskScored', 'payments.risk.scored.v2',
           {iso_sql("(paid_at + INTERVAL '250 milliseconds')")}, correlation_id, transaction_token, NULL,
           CASE WHEN failed THEN 0.0 ELSE {SCORE_SQL} END,
           CASE WHEN failed OR {SCORE_SQL} >= 0.7 THEN 'review' ELSE 'allow' END,
           CASE WHEN failed THEN 'DOWNSTREAM_TIMEOUT_FAIL_CLOSED' ELSE '' END, NULL, ingested_id FROM base
    UNION ALL
    SELECT {uuid_sql("'PaymentCompensated'", "ingested_id")}, 'PaymentCompensated', 'payments.compensated.v2',
           {iso_sql("(paid_at + INTERVAL '250 milliseconds')")}, correlation_id, transaction_token, NULL, NULL, 'review', NULL,
           'PaymentTransactionIngested', ingested_id FROM base WHERE failed)
"""
_MESSAGE = """
'{"event_id":"e-' || event_id || '","event_type":"' || event_type || '","occurred_at":"'
|| strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","request_id":"u-' || user_id || '","ignored":1}'
"""

ORACLES = {
    "event_counts_1m": _counts_sql(1),
    "event_counts_5m": _counts_sql(5),
    "event_dedup": """
        SELECT 'e-' || event_id AS event_id, event_type, ts AS occurred_at, 'u-' || user_id AS correlation_id FROM events""",
    "event_log_union": f"{_EVENTS} SELECT * EXCLUDE (cause) FROM payment_events",
    "event_keys": f"""
        SELECT ingested_id AS event_id, transaction_token AS message_key FROM ({_IDS}) b
        UNION ALL SELECT 'e-' || event_id, 'u-' || user_id FROM events""",
    "envelope_parse": """
        SELECT 'e-' || event_id AS event_id, event_type, ts AS occurred_at, 'u-' || user_id AS request_id
        FROM events WHERE event_type <> 'error'""",
    "envelope_quarantine": f"""
        SELECT substr(m, 1, length(m) - 20) AS raw_value
        FROM (SELECT {_MESSAGE} AS m FROM events WHERE event_type = 'error') t""",
    "event_headers": """
        SELECT 'e-' || event_id AS event_id, 'correlation_id=u-' || user_id || ';causation_id=cause-' || event_id
               || ';event_id=e-' || event_id || ';event_type=' || event_type
               || CASE WHEN event_id % 3 = 0 THEN ';traceparent=00-' || event_id ELSE '' END || ';tenant=t1' AS headers
        FROM events""",
    "canonical_json_events": """
        SELECT 'e-' || event_id AS event_id,
               '{"correlation_id":' || CASE WHEN event_id % 5 > 0 THEN '"u-' || user_id || '"' ELSE 'null' END
               || ',"detail":{"ids":[' || user_id || ',' || event_id || '],"seq":' || event_id || '},"event_id":"e-' || event_id
               || '","event_type":"' || event_type || '","labels":{"a":"u-' || user_id || '","z":"' || event_type
               || '"},"value":' || CAST(value AS VARCHAR) || '}' AS body FROM events""",
    "causal_pairs": f"""{_EVENTS}
        SELECT p.event_id, p.correlation_id, c.event_id AS child_id, c.event_type AS child_type, c.occurred_at AS child_at
        FROM payment_events p LEFT JOIN payment_events c ON c.cause = p.event_id
             AND (c.event_type = 'PaymentCompensated' OR c.correlation_id NOT LIKE '%3')
        WHERE p.event_type = 'PaymentTransactionIngested'""",
    "trace_report": """
        SELECT 'u-' || user_id AS correlation_id, count(*) AS events, count(DISTINCT event_type) AS event_types,
               min(ts) AS started_at, max(ts) AS ended_at, arg_min(event_type, ts) AS first_type,
               arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id""",
    "trace_steps": """
        SELECT 'u-' || user_id AS correlation_id, 'e-' || event_id AS event_id, event_type,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, 'e-' || event_id) AS step FROM events""",
    "distinct_per_window": """
        SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(DISTINCT event_type) AS distinct_event_type,
               count(DISTINCT user_id) AS distinct_user_id FROM events GROUP BY ALL""",
    "publish_reconciliation": f"SELECT ingested_id AS event_id, correlation_id FROM ({_IDS}) b WHERE o_orderkey % 10 = 0",
    "topic_pattern_copy": f"{_EVENTS} SELECT topic, event_id FROM payment_events",
    "zscore_anomalies_5m": _zscore_sql("5 minutes", 3.0),
    "zscore_anomalies_1d": _zscore_sql("1 day", 2.0),
    "trailing_zscore": """
        WITH totals AS (SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS window_start, sum(value) AS total
                        FROM events GROUP BY ALL),
        scored AS (SELECT *, avg(total) OVER k AS mean, stddev_samp(total) OVER k AS deviation FROM totals
                   WINDOW k AS (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
        z AS (SELECT *, CASE WHEN deviation > 0 THEN (total - mean) / deviation END AS z FROM scored)
        SELECT event_type, window_start, round(total, 4) AS total, round(z, 4) AS z,
               coalesce(abs(z) > 2.0, false) AS anomaly FROM z""",
    "token_bucket": """
        WITH RECURSIVE calls AS (
            SELECT user_id, event_id, ts, epoch_us(ts) / 1000000.0::DOUBLE AS seconds,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        replay AS (
            SELECT user_id, event_id, ts, seconds, n, 2.0::DOUBLE AS tokens FROM calls WHERE n = 1
            UNION ALL
            SELECT c.user_id, c.event_id, c.ts, c.seconds, c.n,
                   least(2.0::DOUBLE, r.tokens - CASE WHEN r.tokens >= 1 THEN 1 ELSE 0 END
                                      + (c.seconds - r.seconds) * (2.0::DOUBLE / 86400))
            FROM replay r JOIN calls c ON c.user_id = r.user_id AND c.n = r.n + 1)
        SELECT user_id, 'e-' || event_id AS event_id, ts AS occurred_at, tokens >= 1 AS admitted FROM replay""",
    "cdc_current_state": f"""
        SELECT transaction_id, merchant_id, amount_minor + CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS amount_minor,
               currency, payment_network FROM ({PAYMENTS_SQL}) p WHERE o_orderstatus <> 'P'""",
    "cdc_merged": f"""
        SELECT transaction_id, merchant_id, amount_minor + CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS amount_minor,
               currency, payment_network FROM ({PAYMENTS_SQL}) p WHERE o_orderstatus <> 'P'""",
}
