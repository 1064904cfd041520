"""Canonical JSON, message headers and keys, ISO times, bounded labels, identifier rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_TYPE = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType()),
]))
# HTTP methods that keep their name as a label.
KNOWN_METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH")
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
REQUEST_ID = r"\A[A-Za-z0-9._:-]{1,128}\z"
TOPIC_NAME = r"\A[a-z0-9][a-z0-9.-]{0,249}\z"
TRACEPARENT = r"\A00-[0-9a-f]{32}-[0-9a-f]{16}-01\z"


def sorted_keys(col: Column, kind: T.DataType) -> Column:
    """The same value with struct fields and map entries in key order at every level."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        ordered = F.struct(*[sorted_keys(col[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(col.isNotNull(), ordered)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda item: sorted_keys(item, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.sort_array(F.map_keys(col))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: sorted_keys(col[k], kind.valueType)))
    return col


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One compact JSON text per row: keys sorted at every level, nulls kept, UTF-8 left unescaped."""
    names = sorted(columns or df.columns)
    fields = [sorted_keys(df[name], df.schema[name].dataType).alias(name) for name in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC; microseconds appear only when they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", F.lit("")).otherwise(micros), F.lit("+00:00"))


def message_headers(df: DataFrame, traceparent: Column | None = None, extra: Column | None = None) -> Column:
    """``array<struct<key, value binary>>``: ids first, then caller headers that replace none of them.

    An explicit ``traceparent`` wins over the event's own; an empty one adds no header.
    """

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))

    own = F.nullif(df["traceparent"], F.lit("")) if "traceparent" in df.columns else F.lit(None).cast("string")
    active = F.coalesce(F.nullif(traceparent, F.lit("")), own) if traceparent is not None else own
    names = ("correlation_id", "causation_id", "event_id", "event_type")
    fixed = F.array(*[header(name, df[name]) for name in names])
    headers = F.concat(
        fixed, F.when(active.isNotNull(), F.array(header("traceparent", active))).otherwise(F.array().cast(HEADER_TYPE))
    )
    if extra is None:
        return headers
    taken = F.when(active.isNotNull(), F.array(*map(F.lit, (*names, "traceparent")))).otherwise(
        F.array(*map(F.lit, names))
    )
    return F.concat(headers, F.filter(F.coalesce(extra, F.array().cast(HEADER_TYPE)),
                                      lambda h: ~F.array_contains(taken, h["key"])))


def partition_key(df: DataFrame) -> Column:
    """Payment token if there is one, else the correlation id: one payment stays on one partition."""
    candidates = [F.nullif(df[name], F.lit("")) for name in ("transaction_token", "correlation_id") if name in df.columns]
    return F.coalesce(*candidates)


def status_class(status: Column) -> Column:
    group = F.floor(status / 100)
    return F.when(group.between(2, 5), F.concat(group.cast("string"), F.lit("xx"))).otherwise(F.lit("other"))


def bounded_method(method: Column) -> Column:
    return F.when(method.isin(*KNOWN_METHODS), method).otherwise(F.lit("OTHER"))


def bounded_route(route: Column) -> Column:
    return F.coalesce(F.nullif(route, F.lit("")), F.lit("unmatched"))


def is_identifier(col: Column) -> Column:
    return col.rlike(IDENTIFIER)


def is_request_id(col: Column) -> Column:
    return col.rlike(REQUEST_ID)


def is_topic_name(col: Column) -> Column:
    return col.rlike(TOPIC_NAME)


def is_traceparent(col: Column) -> Column:
    return col.rlike(TRACEPARENT)


def new_traceparent() -> Column:
    """A fresh trace id per row, as the service issues one per request."""
    trace, span = F.replace(F.uuid(), F.lit("-"), F.lit("")), F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.lit("00-"), trace, F.lit("-"), F.substring(span, 1, 16), F.lit("-01"))


def stable_traceparent(*parts: Column) -> Column:
    """A trace id derived from the row, so a replay carries the same one."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("00-"), F.substring(digest, 1, 32), F.lit("-"), F.substring(digest, 33, 16), F.lit("-01"))


def error_boundary(error_detail: Column) -> Column:
    """``boundary`` of ``boundary:error``."""
    return F.substring_index(error_detail, ":", 1)
