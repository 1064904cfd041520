"""What may leave the service: rows of any schema made safe, and rows proven safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.privacy import bind, is_token, redact_text, token_for

# Fields tokenized as a whole, and service-issued ids that stay readable.
SECRET_FIELDS = (
    "answer", "chunk", "chunks", "content", "document", "merchant", "merchant_id", "output",
    "payment_identifier", "prompt", "question", "retrieved", "retrieved_chunks", "source", "text",
    "transaction", "transaction_id",
)
SERVER_FIELDS = (
    "audit_key", "causation_id", "chunk_id", "correlation_id", "entity_id", "event_id", "object_key",
    "operation_id", "request_id", "traceparent",
)


def _safe_string(col: Column, name: str | Column, key: str) -> Column:
    """One string under the field ``name``: unchanged, tokenized whole or redacted."""
    if isinstance(name, str):
        plain = name.lower().removesuffix("_token")
        if plain in SERVER_FIELDS:
            return col
        safe = token_for(plain, col, key) if plain in SECRET_FIELDS else redact_text(col, key)
        return F.when((col == "") | is_token(col), col).otherwise(safe)
    return bind(
        F.regexp_replace(F.lower(name), r"_token\z", ""),
        lambda plain: F.when((col == "") | is_token(col) | plain.isin(*SERVER_FIELDS), col)
        .when(plain.isin(*SECRET_FIELDS), token_for(plain, col, key))
        .otherwise(redact_text(col, key)),
    )


def sanitize_column(col: Column, kind: T.DataType, name: str | Column, key: str) -> Column:
    """Safe form of a column of any type; list items go by the name of their field, map values by their key."""
    if isinstance(kind, T.StringType):
        return _safe_string(col, name, key)
    if isinstance(kind, T.StructType):
        fields = [sanitize_column(col[f.name], f.dataType, f.name, key).alias(f.name) for f in kind]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda item: sanitize_column(item, kind.elementType, name, key))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda k, v: sanitize_column(v, kind.valueType, k, key))
    return col


def safe_column(col: Column, kind: T.DataType, name: str | Column, key: str) -> Column:
    """Whether a column already equals its safe form."""
    if isinstance(kind, T.StringType):
        return col.eqNullSafe(_safe_string(col, name, key))
    if isinstance(kind, T.StructType):
        checks = F.lit(True)
        for field in kind:
            checks = checks & safe_column(col[field.name], field.dataType, field.name, key)
        return checks
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(col, lambda item: safe_column(item, kind.elementType, name, key)), F.lit(True))
    if isinstance(kind, T.MapType):
        entries = F.map_entries(col)
        checked = F.forall(entries, lambda e: safe_column(e["value"], kind.valueType, e["key"], key))
        return F.coalesce(checked, F.lit(True))
    return F.lit(True)


def _free_strings(df: DataFrame) -> list[str]:
    """Top-level strings that are neither secret nor a server id: all are redacted by one expression."""
    fixed = {*SECRET_FIELDS, *SERVER_FIELDS}
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name.lower().removesuffix("_token") not in fixed
    ]


def sanitize(df: DataFrame, key: str) -> DataFrame:
    """Every column made safe to audit or publish. Safe rows come out unchanged."""
    free = _free_strings(df)
    shared = F.transform(F.array(*[df[name] for name in free]), lambda col: _safe_string(col, "", key))
    prepared = df.withColumn("_redacted", shared) if free else df
    return prepared.select([
        F.col("_redacted")[free.index(f.name)].alias(f.name) if f.name in free
        else sanitize_column(F.col(f"`{f.name}`"), f.dataType, f.name, key).alias(f.name)
        for f in df.schema
    ])


def is_safe(df: DataFrame, key: str, headers: str | None = None) -> Column:
    """True for rows that hold nothing unsafe; values in a ``headers`` column go by the header's name."""
    free = _free_strings(df)
    checks = F.lit(True)
    if free:
        checks = F.forall(F.array(*[df[name] for name in free]), lambda col: col.eqNullSafe(_safe_string(col, "", key)))
    for field in df.schema:
        if field.name != headers and field.name not in free:
            checks = checks & safe_column(df[field.name], field.dataType, field.name, key)
    if headers:
        named = F.forall(
            df[headers], lambda h: safe_column(F.decode(h["value"], "UTF-8"), T.StringType(), h["key"], key)
        )
        checks = checks & F.coalesce(named, F.lit(True))
    return checks


def split_unsafe(df: DataFrame, key: str, headers: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may be published, rows for quarantine)."""
    safe = is_safe(df, key, headers)
    return df.filter(safe), df.filter(~safe)


def assert_safe(df: DataFrame, key: str, headers: str | None = None) -> DataFrame:
    """The same rows; the job fails at the first unsafe one, before a sink sees it."""
    refusal = F.raise_error(F.lit("refusing to publish unsanitized boundary data")).cast("boolean")
    return df.filter(F.when(is_safe(df, key, headers), F.lit(True)).otherwise(refusal))
