"""Seeded synthetic documents with matching questions and payments, generated on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: document sizes.
SIZES_KB = (1, 10, 100)
VOCABULARY = ("copper", "meadow", "signal", "garden", "window", "bottle", "stream", "candle")


def _draw(seed: int, what: str, *place: Column) -> Column:
    """A number that depends on the seed, the purpose and the row only."""
    return F.xxhash64(F.lit(seed), F.lit(what), *place)


def synthetic_corpus(spark: SparkSession, seed: int, count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, questions, payments), ``count`` per document size; equal seeds give equal rows."""
    if count < 1:
        raise ValueError("count must be positive")
    sizes = F.array(*[F.lit(size) for size in SIZES_KB])
    letter = lambda i: F.char(F.pmod(_draw(seed, "marker", F.col("id"), i), F.lit(26)) + 97)
    rows = spark.range(count * len(SIZES_KB)).select(
        "id", (F.col("id") % count).alias("number"),
        F.element_at(sizes, (F.floor(F.col("id") / count) + 1).cast("int")).alias("size_kb"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), letter), "").alias("marker"),
    )
    vocabulary = F.array(*[F.lit(word) for word in VOCABULARY])
    target = F.col("size_kb") * 1024
    # A word and a space take seven characters: enough words for the whole size.
    word = lambda i: F.element_at(
        vocabulary, (F.pmod(_draw(seed, "word", F.col("id"), i), F.lit(len(VOCABULARY))) + 1).cast("int")
    )
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.floor(target / 6).cast("int") + 1), word), " ")
    opening = F.concat(F.lit("Made-up note "), "marker", F.lit(". Its lantern glows amber. "))
    documents = rows.select(
        F.format_string("synthetic-%dkb-%d-%s", "size_kb", "number", "marker").alias("source"),
        F.substr(F.concat(opening, body), F.lit(1), target).alias("text"),
    )
    questions = rows.select(
        F.concat(F.lit("Which glow has the lantern of note "), "marker", F.lit("?")).alias("question"),
        F.lit(4).alias("top_k"),
    )
    payments = rows.select(
        F.concat(F.lit("synthetic-txn-"), "marker").alias("transaction_id"),
        F.concat(F.lit("synthetic-merchant-"), "marker").alias("merchant_id"),
        (F.pmod(_draw(seed, "amount", F.col("id")), F.lit(100_000)) + 1).alias("amount_minor"),
        F.lit("USD").alias("currency"), F.lit("synthetic").alias("payment_network"),
    )
    return documents, questions, payments
