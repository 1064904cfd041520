"""Audit records: invariant fields, canonical body, object key, retention, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.boundary import sanitize
from tracewell.functions.canonical import canonical_json, iso_utc

# Default prefix and retention of audit objects, record categories.
PREFIX, RETENTION_DAYS = "requests", 2555
CATEGORIES = ("requests", "transitions", "compensations")


def request_records(payloads: DataFrame, at: Column) -> DataFrame:
    """Payload columns plus identity; the invariant fields replace payload fields of the same name."""
    correlation = F.col("correlation_id") if "correlation_id" in payloads.columns else F.lit(None).cast("string")
    return (
        payloads.withColumn("correlation_id", F.coalesce(F.nullif(correlation, F.lit("")), F.col("request_id")))
        .withColumn("timestamp", iso_utc(at)).withColumn("written_at", at)
    )


def transition_records(transitions: DataFrame, at: Column) -> DataFrame:
    payload = F.col("payload") if "payload" in transitions.columns else F.create_map().cast("map<string,string>")
    return transitions.select(
        F.lit("state_transition").alias("record_type"), "correlation_id", iso_utc(at).alias("timestamp"),
        "state_from", "state_to", "reason", payload.alias("payload"), at.alias("written_at"),
    )


def compensation_records(compensations: DataFrame, at: Column) -> DataFrame:
    return (
        compensations.withColumn("record_type", F.lit("compensation"))
        .withColumn("timestamp", iso_utc(at)).withColumn("written_at", at)
    )


def object_key(category: str, at: Column, owner: Column, unique: Column, prefix: str = PREFIX) -> Column:
    """``prefix/category/YYYY/MM/DD/HHMMSS.ffffffZ-owner-hex32.json``."""
    return F.concat(
        F.lit(f"{prefix}/{category}/"), F.date_format(at, "yyyy/MM/dd/HHmmss.SSSSSS"),
        F.lit("Z-"), owner, F.lit("-"), unique, F.lit(".json"),
    )


def audit_objects(
    records: DataFrame, category: str, owner: str, key: str, retention_days: int = RETENTION_DAYS, prefix: str = PREFIX
) -> DataFrame:
    """``(category, dt, object_key, body, content_md5, retain_until)`` of sanitized records.

    ``written_at`` (timestamp) gives key and retention and is not part of the body. The unique part of the
    key is a digest of the body, so writing the same record twice yields the same key.
    """
    if category not in CATEGORIES:
        raise ValueError(f"category must be one of {CATEGORIES}")
    fields = [name for name in records.columns if name != "written_at"]
    safe = sanitize(records, key)
    bodies = safe.withColumn("body", canonical_json(safe, fields))
    return bodies.select(
        F.lit(category).alias("category"), F.date_format("written_at", "yyyy-MM-dd").alias("dt"),
        object_key(category, F.col("written_at"), F.col(owner), F.md5("body"), prefix).alias("object_key"),
        "body", F.base64(F.unhex(F.md5("body"))).alias("content_md5"),
        (F.col("written_at") + F.make_interval(days=F.lit(retention_days))).alias("retain_until"),
    )


def expired(objects: DataFrame, now: Column) -> DataFrame:
    """Objects whose retention has ended."""
    return objects.filter(F.col("retain_until") < now)


def unaudited(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests without an audit record."""
    return requests.join(records.select("request_id").distinct(), "request_id", "left_anti")


def audited(requests: DataFrame, records: DataFrame) -> DataFrame:
    return requests.join(records.select("request_id").distinct(), "request_id", "left_semi")
