"""Request rules: every row gets the names of the rules it fails; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.canonical import is_identifier
from tracewell.schemas import PAYMENT

# Request limits and payment refusals.
MAX_TEXT, MAX_QUESTION, MAX_NETWORK = 200_000, 10_000, 32
DEFAULT_SOURCE, DEFAULT_TOP_K, MAX_TOP_K, DEFAULT_NETWORK = "sample", 4, 20, "unknown"
PROHIBITED_FIELDS = ("pan", "card_number", "cvv", "cvc", "pin", "track_data")
PAYMENT_ERRORS = {
    "missing": "payment envelope is missing required fields",
    "prohibited": "payment envelope must not contain raw cardholder fields",
    "amount": "amount_minor must be numeric",
    "negative": "amount_minor must not be negative",
    "transaction_id": "transaction_id must be a tokenized safe identifier",
    "merchant_id": "merchant_id must be a tokenized safe identifier",
    "currency": "currency must be a three-letter ISO code",
    "payment_network": "payment_network must be a safe identifier",
}


def _failed(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def validate_documents(df: DataFrame) -> DataFrame:
    """``(text, source)`` rows plus ``failed``; a missing source becomes ``sample``."""
    rules = {"text_length": F.length("text").between(1, MAX_TEXT)}
    return df.withColumn("source", F.coalesce("source", F.lit(DEFAULT_SOURCE))).withColumn("failed", _failed(rules))


def validate_questions(df: DataFrame) -> DataFrame:
    rules = {
        "question_length": F.length("question").between(1, MAX_QUESTION),
        "top_k_range": F.col("top_k").between(1, MAX_TOP_K),
    }
    return df.withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULT_TOP_K))).withColumn("failed", _failed(rules))


def unknown_fields(raw: Column) -> Column:
    """Keys of a payment JSON text that the request does not know."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(f.name) for f in PAYMENT]))


def has_prohibited_fields(raw: Column) -> Column:
    prohibited = F.array(*[F.lit(name) for name in PROHIBITED_FIELDS])
    return F.coalesce(F.arrays_overlap(F.json_object_keys(raw), prohibited), F.lit(False))


def validate_payment_requests(df: DataFrame, raw: str | None = None) -> DataFrame:
    """Strict request rules; with ``raw`` (the JSON text) unknown fields fail too."""
    rules = {
        "transaction_id": is_identifier(F.col("transaction_id")),
        "merchant_id": is_identifier(F.col("merchant_id")),
        "amount_minor": F.col("amount_minor") >= 0,
        "currency_length": F.length("currency") == 3,
        "payment_network": is_identifier(F.col("payment_network")) & (F.length("payment_network") <= MAX_NETWORK),
    }
    if raw:
        rules["unknown_fields"] = F.size(F.coalesce(unknown_fields(F.col(raw)), F.array().cast("array<string>"))) == 0
    with_network = df.withColumn("payment_network", F.coalesce("payment_network", F.lit(DEFAULT_NETWORK)))
    return with_network.withColumn("failed", _failed(rules))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, without the rule names; rows that fail, with them)."""
    return df.filter(F.size("failed") == 0).drop("failed"), df.filter(F.size("failed") > 0)


def truncated_amount(amount: Column) -> Column:
    """Whole minor units, cut toward zero; null if the value is no number or beyond 64 bits.

    The fraction is cut from the text, so no number of decimals rounds. Only exponents go through a double.
    """
    text = F.trim(amount.cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?[0-9]*)\.?[0-9]*$", 1)
    cut = F.when(whole.isin("", "+", "-"), F.lit("0")).otherwise(whole).try_cast("bigint")
    scaled = F.when(text.rlike("[eE]"), text.try_cast("double"))
    bounded = F.when(F.abs(scaled) < 9.2e18, F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), cut).otherwise(bounded)


def payment_error(df: DataFrame, raw: str | None = None) -> Column:
    """First reason to refuse a payment envelope, null if there is none."""

    def missing(name: str) -> Column:
        return df[name].isNull() | (df[name].cast("string") == "")

    absent = missing("transaction_id") | missing("merchant_id") | missing("amount_minor") | missing("currency")
    amount = truncated_amount(df["amount_minor"])
    network = F.coalesce(df["payment_network"], F.lit(DEFAULT_NETWORK))
    checks = [
        ("missing", absent),
        ("prohibited", has_prohibited_fields(df[raw]) if raw else F.lit(False)),
        ("amount", amount.isNull()),
        ("negative", amount < 0),
        ("transaction_id", ~is_identifier(df["transaction_id"].cast("string"))),
        ("merchant_id", ~is_identifier(df["merchant_id"].cast("string"))),
        ("currency", ~F.upper(df["currency"]).rlike(r"\A[A-Z]{3}\z")),
        ("payment_network", ~is_identifier(network)),
    ]
    return F.coalesce(*[F.when(failed, F.lit(PAYMENT_ERRORS[name])) for name, failed in checks])
