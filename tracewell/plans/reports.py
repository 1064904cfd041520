"""Reports over recorded events, logs and changes: metrics, traces, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import anomaly, cdc, events, lifecycle, metrics

SAMPLE = ["metric", "kind", "labels", "le", "value"]


def service_metrics(log: DataFrame, compensations: DataFrame, checks: DataFrame) -> DataFrame:
    """One long table ``(metric, kind, labels, le, value)`` with every declared family.

    ``log(route, method, status, seconds, ts)``, ``compensations(boundary, reason)``,
    ``checks(check, status, seconds, checked_at)``. Histograms give one row per bucket plus _sum and _count.
    """
    bounded = metrics.bounded_labels(log)
    duration = "rag_http_request_duration_seconds"
    plain = (
        metrics.counters(bounded, "rag_http_requests_total", "route", "method", "status_class")
        .unionByName(metrics.counters(_labelled(compensations), "rag_compensating_events_total", "boundary", "reason"))
        .unionByName(metrics.counters(checks, "rag_health_checks_total", "check", "status"))
        .unionByName(metrics.latest_gauge(checks, "rag_health_check_duration_seconds", "seconds", "checked_at", "check"))
    )
    buckets = metrics.histogram(bounded, duration, "seconds", "route", "method")
    none = F.lit(None).cast("string")

    def sample(part: str, le: Column, value: Column) -> Column:
        return F.struct(
            F.lit(f"{duration}_{part}").alias("metric"), le.alias("le"), value.cast("double").alias("value"))

    per_series = F.array(sample("sum", none, F.col("sum")), sample("count", none, F.col("count")))
    spread = buckets.select("labels", F.explode(F.concat(
        F.array(sample("bucket", F.col("le"), F.col("bucket_count"))),
        F.filter(per_series, lambda _: F.col("le") == "+Inf"),
    )).alias("sample"))
    histograms = spread.select("sample.metric", F.lit("histogram").alias("kind"), "labels", "sample.le", "sample.value")
    filled = metrics.zero_filled(plain).filter(~((F.col("metric") == duration) & (F.col("kind") == "histogram")))
    return filled.withColumn("le", none).select(SAMPLE).unionByName(histograms.select(SAMPLE))


def _labelled(compensations: DataFrame) -> DataFrame:
    return compensations.select(
        F.coalesce("boundary", F.lit("audit")).alias("boundary"),
        F.coalesce("reason", F.lit("downstream_failure")).alias("reason"),
    )


def trace_completeness(
    log: DataFrame, transitions: DataFrame, records: DataFrame, bucket: Column | None = None
) -> DataFrame:
    """Per correlation id: events, duration, state, whether all moves were legal and a record exists.

    ``log(correlation_id, event_id, event_type, occurred_at)``, ``transitions(correlation_id, seq, state_from,
    state_to)``, ``records(correlation_id)``. Every side is one row per correlation id before it is joined.
    ``bucket`` cuts long lifecycles, by default after a thousand moves.
    """
    traces = events.trace_report(log)
    moves = lifecycle.check_transitions(transitions, F.floor(F.col("seq") / 1000) if bucket is None else bucket)
    legal = moves.groupBy("correlation_id").agg(F.bool_and("legal").alias("legal"))
    states = lifecycle.current_state(transitions)
    recorded = records.select("correlation_id").distinct().withColumn("audited", F.lit(True))
    joined = traces.join(states, "correlation_id", "left").join(legal, "correlation_id", "left")
    return joined.join(recorded, "correlation_id", "left").withColumn("audited", F.coalesce("audited", F.lit(False)))


def transaction_anomalies(changes: DataFrame, width: str = "5 minutes", threshold: float = anomaly.DEFAULT_THRESHOLD
                          ) -> DataFrame:
    """Change envelopes of payments to z-scored windows of amounts per currency.

    A window is scored by the time of the change; deletes carry no new amount.
    """
    rows = cdc.parse_changes(changes).filter("op <> 'd' AND after IS NOT NULL").select(
        "after.currency", F.col("after.amount_minor").alias("amount"), F.timestamp_millis("ts_ms").alias("changed_at"),
    )
    return anomaly.zscore_anomalies(rows, "changed_at", "currency", "amount", width, threshold)

