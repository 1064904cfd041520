"""Payments: tokenized events, deterministic risk scores, decisions that fail closed."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.privacy import token_for
from tracewell.schemas import event_schema
from tracewell.operators.events import event_fields, event_log, make_events, stable_uuid
from tracewell.operators.validation import DEFAULT_NETWORK, payment_error, truncated_amount

# Currency exponents other than two, the score's scale and the review limit.
CURRENCY_EXPONENTS = {"BHD": 3, "JPY": 0, "KWD": 3, "OMR": 3, "TND": 3}
DEFAULT_EXPONENT = 2
SCORE_UNIT, REVIEW_LIMIT, MODEL_VERSION = 10_000, 0.7, "baseline-v1"
FAILED_CLOSED = "DOWNSTREAM_TIMEOUT_FAIL_CLOSED"


def currency_divisor(currency: Column) -> Column:
    """Minor units per major unit."""
    divisor = F.lit(10 ** DEFAULT_EXPONENT)
    for code, exponent in CURRENCY_EXPONENTS.items():
        divisor = F.when(currency == code, F.lit(10 ** exponent)).otherwise(divisor)
    return divisor


def major_units(amount_minor: Column, currency: Column) -> Column:
    return (amount_minor.cast("decimal(20,0)") / currency_divisor(currency).cast("decimal(4,0)")).cast("decimal(23,3)")


def join_exponents(payments: DataFrame, exponents: DataFrame) -> DataFrame:
    """Look up ``(currency, exponent)``; an unknown currency has two. The lookup is a code list of a few rows."""
    known = payments.join(exponents, "currency", "left")
    return known.withColumn("exponent", F.coalesce("exponent", F.lit(DEFAULT_EXPONENT)))


def split_payments(payments: DataFrame, raw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted payments, refused ones with ``error``)."""
    checked = payments.withColumn("error", payment_error(payments, raw))
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def tokenize_payments(accepted: DataFrame, key: str) -> DataFrame:
    """Tokens in place of both identifiers; amount and currency in normal form."""
    return (
        accepted.withColumn("transaction_token", token_for("payment_transaction", F.col("transaction_id").cast("string"), key))
        .withColumn("merchant_token", token_for("payment_merchant", F.col("merchant_id").cast("string"), key))
        .withColumn("amount_minor", truncated_amount(F.col("amount_minor")))
        .withColumn("currency", F.upper("currency"))
        .withColumn("payment_network", F.coalesce("payment_network", F.lit(DEFAULT_NETWORK)))
        .withColumn("pii_tokenized", F.lit(True))
        .drop("transaction_id", "merchant_id")
    )


def ingested_events(tokenized: DataFrame, occurred_at: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    event_id = stable_uuid(F.lit("PaymentTransactionIngested"), F.col("correlation_id"), F.col("transaction_token"))
    return make_events(tokenized, "PaymentTransactionIngested", occurred_at, event_id, carry)


def _binary_score(amount_minor: Column, divisor: Column) -> Column:
    """Score rounded on the binary value of the quotient, half to even, as plain Python rounds a float."""

    @F.pandas_udf("double")
    def rounded(amounts: pd.Series, divisors: pd.Series) -> pd.Series:
        quotients = [
            round(float(Decimal(int(a)) / int(d) / SCORE_UNIT), 4) for a, d in zip(amounts, divisors, strict=True)
        ]
        return pd.Series(quotients, dtype="float64")

    return rounded(amount_minor, divisor)


def risk_score(amount_minor: Column, currency: Column, binary_rounding: bool = False) -> Column:
    """Major units / 10,000 to four places, at most 1.

    Decimal rounding (half up) differs from binary rounding only where the fifth digit is an exact tie, and
    then errs to the higher score, the review side. ``binary_rounding`` gives the other result.
    """
    divisor = currency_divisor(currency)
    if binary_rounding:
        score = _binary_score(amount_minor, divisor)
    else:
        scale = (divisor * F.lit(SCORE_UNIT)).cast("decimal(9,0)")
        score = F.round(amount_minor.cast("decimal(19,0)") / scale, 4).cast("double")
    return F.least(F.lit(1.0), score)


def detected(detector: Callable[[pd.DataFrame], pd.Series], *columns: str) -> Column:
    """Anomaly flag from a Python detector over Arrow batches; a detector error flags the row.

    The detector sees one row at a time after a batch has failed, so one bad row does not flag its neighbours.
    """

    @F.pandas_udf("boolean")
    def flags(rows: pd.DataFrame) -> pd.Series:
        def safely(part: pd.DataFrame) -> list[bool]:
            try:
                return [bool(flag) for flag in detector(part)]
            except Exception:
                if len(part) == 1:
                    return [True]
                return [flag for at in range(len(part)) for flag in safely(part.iloc[at:at + 1])]

        return pd.Series(safely(rows), dtype="bool")

    return flags(F.struct(*columns))


def score_payments(
    ingested: DataFrame,
    anomaly: Column | None = None,
    error: Column | None = None,
    score: Column | None = None,
    model_version: str = MODEL_VERSION,
    binary_rounding: bool = False,
) -> DataFrame:
    """Ingested events plus risk_score, decision, model_version, failure_reason.

    ``score`` replaces the baseline model, ``anomaly`` lifts a score to the review limit, and a non-null
    ``error`` (scorer unavailable) fails closed: score 0, review, reason.
    """
    if score is None:
        score = risk_score(F.col("amount_minor"), F.col("currency"), binary_rounding)
    if anomaly is not None:
        score = F.when(anomaly, F.greatest(score, F.lit(REVIEW_LIMIT))).otherwise(score)
    failed = error.isNotNull() if error is not None else F.lit(False)
    return (
        ingested.withColumn("failure_reason", F.when(failed, F.lit(FAILED_CLOSED)).otherwise(F.lit("")))
        .withColumn("error_detail", F.when(failed, error if error is not None else F.lit("")).otherwise(F.lit("")))
        .withColumn("risk_score", F.when(failed, F.lit(0.0)).otherwise(score))
        .withColumn("decision", F.when(failed | (F.col("risk_score") >= REVIEW_LIMIT), F.lit("review")).otherwise(F.lit("allow")))
        .withColumn("model_version", F.lit(model_version))
    )


def _caused(scored: DataFrame) -> DataFrame:
    return scored.withColumn("causation_id", F.col("event_id"))


def scored_events(scored: DataFrame, occurred_at: Column) -> DataFrame:
    """One PaymentRiskScored per payment, caused by its ingestion event."""
    event_id = stable_uuid(F.lit("PaymentRiskScored"), F.col("causation_id"))
    return make_events(_caused(scored), "PaymentRiskScored", occurred_at, event_id)


def compensated_events(scored: DataFrame, occurred_at: Column) -> DataFrame:
    """One PaymentCompensated per payment whose scoring failed closed."""
    failed = _caused(scored.filter("failure_reason <> ''")).withColumn("reason", F.col("failure_reason"))
    failed = failed.withColumn("original_event_type", F.lit("PaymentTransactionIngested"))
    event_id = stable_uuid(F.lit("PaymentCompensated"), F.col("causation_id"))
    return make_events(failed, "PaymentCompensated", occurred_at, event_id)


def payment_log(scored: DataFrame, occurred_at: Column) -> DataFrame:
    """Ingested, scored and compensated events of scored payments as one wide log, made in one pass.

    ``occurred_at`` is the time of the decision; the ingested event keeps its own.
    """
    own = {name: F.col(name) for name in scored.columns}
    ingested = {field.name: F.col(field.name) for field in event_schema("PaymentTransactionIngested")}
    caused = {**own, "causation_id": F.col("event_id")}
    decided = {**caused, "event_id": stable_uuid(F.lit("PaymentRiskScored"), F.col("event_id"))}
    undone = {
        **caused, "event_id": stable_uuid(F.lit("PaymentCompensated"), F.col("event_id")), "reason": F.col("failure_reason"),
        "original_event_type": F.lit("PaymentTransactionIngested"),
    }
    return event_log(
        scored, ("PaymentTransactionIngested", ingested, None),
        ("PaymentRiskScored", event_fields(decided, "PaymentRiskScored", occurred_at), None),
        ("PaymentCompensated", event_fields(undone, "PaymentCompensated", occurred_at), F.col("failure_reason") != ""),
    )
