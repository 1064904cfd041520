"""Batch sources: files with declared schemas, and the repository's test tables in the roles of the service's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.validation import DEFAULT_TOP_K


def read_rows(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Rows of documents, questions or payments; the schema is declared, never inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small file over all cores before costly row work; an input with enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents"), "doc_id")
    return rows.select(
        "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("request_id"), "text", "source", "lang",
    )


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one chunk, in order of insertion."""
    rows = spread(table(spark, folder, "documents"), "doc_id")
    return rows.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("insert_seq"), "text")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark")
    return rows.select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("q-"), "item_id").alias("request_id"),
        F.col("text").alias("question"), F.lit(DEFAULT_TOP_K).alias("top_k"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("insert_seq"), F.col("embedding").alias("vector"))


CURRENCIES = ("USD", "EUR", "JPY", "BHD", "KWD", "TND")


def _currency(order_key: Column) -> Column:
    codes = F.array(*[F.lit(code) for code in CURRENCIES])
    return F.element_at(codes, (order_key % len(CURRENCIES) + 1).cast("int"))


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as payments: ids, minor units, one of six currencies, network by priority."""
    rows = spread(table(spark, folder, "orders"), "o_orderkey")
    return rows.select(
        "o_orderkey", "o_orderstatus",
        F.concat(F.lit("pay-"), "o_orderkey").alias("request_id"),
        F.concat(F.lit("c-"), "o_orderkey").alias("correlation_id"),
        F.concat(F.lit("o-"), "o_orderkey").alias("transaction_id"),
        F.concat(F.lit("m-"), "o_custkey").alias("merchant_id"),
        F.round(F.col("o_totalprice") * 2).cast("bigint").alias("amount_minor"),
        _currency(F.col("o_orderkey")).alias("currency"),
        F.concat(F.lit("net"), F.substring("o_orderpriority", 1, 1)).alias("payment_network"),
        F.col("o_orderdate").cast("timestamp").alias("paid_at"),
    )


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events with timestamps a watermark accepts."""
    rows = spread(table(spark, folder, "events"), "event_id")
    return rows.select(
        F.concat(F.lit("e-"), "event_id").alias("event_id"), "event_type",
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.concat(F.lit("u-"), "user_id").alias("correlation_id"), "value", "props",
        F.col("event_id").alias("seq"), "user_id",
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as HTTP requests: value as duration in seconds, type as route, method and status from the ids."""
    rows = table(spark, folder, "events")
    methods = F.array(*[F.lit(name) for name in ("GET", "POST", "PUT", "BREW", "DELETE", "PATCH", "get")])
    return rows.select(
        F.when(F.col("event_type") != "error", F.concat(F.lit("/"), "event_type")).alias("route"),
        F.element_at(methods, (F.col("event_id") % 7 + 1).cast("int")).alias("method"),
        (F.col("event_id") % 6 * 100 + 100 + F.col("user_id") % 5).cast("int").alias("status"),
        (F.col("value") / 10).alias("seconds"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("boundary-"), F.col("user_id") % 3).alias("boundary"), "event_id",
    )
