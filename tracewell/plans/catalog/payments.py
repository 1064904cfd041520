"""Registered queries: payment validation, tokens, scores, compensation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import payments, validation
from tracewell.plans.catalog.common import EXPONENT_SQL, KEY, PAYMENTS_SQL, SCORE_SQL, token_sql
from tracewell.sources import tables


def _envelopes(spark, folder):
    """Orders as envelopes; each eleventh part has a fault of its own kind."""
    fault = F.col("o_orderkey") % 11
    rows = tables.payments(spark, folder)
    amount = F.col("amount_minor").cast("string")
    return rows.select(
        "o_orderkey",
        F.when(fault == 1, F.lit("")).when(fault == 5, F.concat(F.lit(" "), "transaction_id"))
        .otherwise(F.col("transaction_id")).alias("transaction_id"),
        F.when(fault == 6, F.concat("merchant_id", F.lit("#1"))).otherwise(F.col("merchant_id")).alias("merchant_id"),
        F.when(fault == 2, F.lit("12 EUR")).when(fault == 3, F.concat(F.lit("-"), amount))
        .when((fault == 4) & (F.col("o_orderkey") % 2 == 0), F.lit("-0.99999999999"))
        .when(fault == 4, F.lit("0.99999999999")).when(fault == 10, F.lit("99999999999999999999"))
        .when(fault == 0, F.concat(amount, F.lit(".75"))).otherwise(amount).alias("amount_minor"),
        F.when(fault == 7, F.lit("EURO")).when(fault == 8, F.lower("currency")).otherwise(F.col("currency")).alias("currency"),
        F.when(fault == 9, F.lit("net/1")).when(fault != 8, F.col("payment_network")).alias("payment_network"),
    )


def validate_payments(spark, folder):
    rows = _envelopes(spark, folder)
    return rows.select(
        "o_orderkey", validation.truncated_amount(F.col("amount_minor")).alias("amount"),
        validation.payment_error(rows).alias("error"),
    )


def payment_request_rules(spark, folder):
    """Strict request rules over JSON texts; every seventh carries a card field, every fifth an unknown one."""
    rows = tables.payments(spark, folder)
    body = F.struct(
        "transaction_id", "merchant_id", (F.col("amount_minor") - 100_000).alias("amount_minor"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("currency")).otherwise(F.lit("US")).alias("currency"),
        "payment_network", F.when(F.col("o_orderkey") % 7 == 0, F.lit("4111")).alias("pan"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).alias("memo"),
    )
    raw = rows.select("o_orderkey", F.to_json(body).alias("raw"))
    parsed = raw.select("o_orderkey", "raw", F.from_json("raw", validation.PAYMENT).alias("p")).select("o_orderkey", "raw", "p.*")
    checked = validation.validate_payment_requests(parsed, "raw")
    return checked.select(
        "o_orderkey", F.array_join("failed", ",").alias("failed"),
        F.array_join(validation.unknown_fields(F.col("raw")), ",").alias("unknown"),
        validation.has_prohibited_fields(F.col("raw")).alias("prohibited"),
    )


def payment_tokens(spark, folder):
    accepted, _ = payments.split_payments(_envelopes(spark, folder))
    return payments.tokenize_payments(accepted, KEY)


def _scored(spark, folder, error=None):
    accepted, _ = payments.split_payments(tables.payments(spark, folder))
    ingested = payments.ingested_events(payments.tokenize_payments(accepted, KEY), F.col("paid_at"))
    return payments.score_payments(ingested, error=error)


def payment_scores(spark, folder):
    return _scored(spark, folder).select(
        "correlation_id", "transaction_token", "merchant_token", "risk_score", "decision", "model_version", "failure_reason")


def payment_fail_closed(spark, folder):
    """Scorer unavailable for every seventh customer digit: review, reason and a compensation."""
    error = F.when(F.col("correlation_id").rlike("[37]$"), F.lit("CallTimedOut"))
    compensated = payments.compensated_events(_scored(spark, folder, error), F.to_timestamp("occurred_at"))
    return compensated.select("correlation_id", "transaction_token", "reason", "original_event_type", "decision", "error_detail", "topic")


def payment_decisions(spark, folder):
    """Scores and decisions per currency with an anomaly flag on one network."""
    accepted, _ = payments.split_payments(tables.payments(spark, folder))
    scored = payments.score_payments(payments.tokenize_payments(accepted, KEY), anomaly=F.col("payment_network") == "net1")
    return scored.groupBy("currency", "decision").agg(
        F.count("*").alias("payments"), F.sum(F.col("risk_score").cast("decimal(18,4)")).cast("double").alias("total_score"))


def currency_lookup_join(spark, folder):
    exponents = spark.createDataFrame(list(payments.CURRENCY_EXPONENTS.items()), "currency string, exponent int")
    rows = payments.join_exponents(tables.payments(spark, folder), exponents)
    return rows.select(
        "transaction_id", "currency", "exponent",
        payments.major_units(F.col("amount_minor"), F.col("currency")).cast("double").alias("amount_major"),
    )


QUERIES = {f.__name__: f for f in (
    validate_payments, payment_request_rules, payment_tokens, payment_scores, payment_fail_closed, payment_decisions,
    currency_lookup_join,
)}

_ENVELOPES = f"""
SELECT o_orderkey, o_orderkey % 11 AS fault,
       CASE o_orderkey % 11 WHEN 1 THEN '' WHEN 5 THEN ' ' || transaction_id ELSE transaction_id END AS transaction_id,
       CASE o_orderkey % 11 WHEN 6 THEN merchant_id || '#1' ELSE merchant_id END AS merchant_id,
       CASE o_orderkey % 11 WHEN 2 THEN NULL WHEN 10 THEN NULL WHEN 3 THEN -amount_minor WHEN 4 THEN 0 ELSE amount_minor END AS amount,
       CASE o_orderkey % 11 WHEN 7 THEN 'EURO' ELSE currency END AS currency,
       CASE o_orderkey % 11 WHEN 9 THEN 'net/1' WHEN 8 THEN 'unknown' ELSE payment_network END AS payment_network
FROM ({PAYMENTS_SQL}) p
"""

ORACLES = {
    "validate_payments": f"""
        SELECT o_orderkey, amount, CASE fault
            WHEN 1 THEN 'payment envelope is missing required fields'
            WHEN 2 THEN 'amount_minor must be numeric' WHEN 10 THEN 'amount_minor must be numeric'
            WHEN 3 THEN 'amount_minor must not be negative'
            WHEN 5 THEN 'transaction_id must be a tokenized safe identifier'
            WHEN 6 THEN 'merchant_id must be a tokenized safe identifier'
            WHEN 7 THEN 'currency must be a three-letter ISO code'
            WHEN 9 THEN 'payment_network must be a safe identifier' END AS error FROM ({_ENVELOPES}) e""",
    "payment_request_rules": f"""
        SELECT o_orderkey, concat_ws(',',
                   CASE WHEN amount_minor - 100000 < 0 THEN 'amount_minor' END,
                   CASE WHEN o_orderkey % 4 = 0 THEN 'currency_length' END,
                   CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'unknown_fields' END) AS failed,
               concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'pan' END,
                   CASE WHEN o_orderkey % 5 = 0 THEN 'memo' END) AS unknown, o_orderkey % 7 = 0 AS prohibited
        FROM ({PAYMENTS_SQL}) p""",
    "payment_tokens": f"""
        SELECT o_orderkey, {token_sql("payment_transaction", "transaction_id")} AS transaction_token,
               {token_sql("payment_merchant", "merchant_id")} AS merchant_token, amount AS amount_minor, currency,
               payment_network, true AS pii_tokenized
        FROM ({_ENVELOPES}) e WHERE fault NOT IN (1, 2, 3, 5, 6, 7, 9, 10)""",
    "payment_scores": f"""
        SELECT correlation_id, {token_sql("payment_transaction", "transaction_id")} AS transaction_token,
               {token_sql("payment_merchant", "merchant_id")} AS merchant_token, {SCORE_SQL} AS risk_score,
               CASE WHEN {SCORE_SQL} >= 0.7 THEN 'review' ELSE 'allow' END AS decision,
               'baseline-v1' AS model_version, '' AS failure_reason FROM ({PAYMENTS_SQL}) p""",
    "payment_fail_closed": f"""
        SELECT correlation_id, {token_sql("payment_transaction", "transaction_id")} AS transaction_token,
               'DOWNSTREAM_TIMEOUT_FAIL_CLOSED' AS reason, 'PaymentTransactionIngested' AS original_event_type,
               'review' AS decision, 'CallTimedOut' AS error_detail, 'payments.compensated.v2' AS topic
        FROM ({PAYMENTS_SQL}) p WHERE o_orderkey % 10 IN (3, 7)""",
    "payment_decisions": f"""
        WITH scored AS (SELECT currency, CASE WHEN payment_network = 'net1' THEN greatest({SCORE_SQL}, 0.7)
                                         ELSE {SCORE_SQL} END AS score FROM ({PAYMENTS_SQL}) p)
        SELECT currency, CASE WHEN score >= 0.7 THEN 'review' ELSE 'allow' END AS decision, count(*) AS payments,
               sum(score::DECIMAL(18,4))::DOUBLE AS total_score FROM scored GROUP BY ALL""",
    "currency_lookup_join": f"""
        SELECT transaction_id, currency, {EXPONENT_SQL} AS exponent,
               amount_minor / CAST(10 ** ({EXPONENT_SQL}) AS DOUBLE) AS amount_major FROM ({PAYMENTS_SQL}) p""",
}
