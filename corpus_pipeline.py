"""Documents to training shards: quality rules, near-duplicates, benchmark passages, source mix, shards.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, mixing, neardup, rules, sharding
from tracewell.llm.common import Store, prepared, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules learned from ``labels``."""
    return rules.keep_good(docs, read(prepared(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near-duplicates."""
    return neardup.keep_first(docs, Store(prepared(spark), "neardup"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item: no share of hit words is allowed."""
    items = read(prepared(spark), sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, items, Store(spark, "benchmark"), max_coverage=0.0, least_words=1)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, Store(prepared(spark), "mix"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    placed = sharding.assign(docs, Store(prepared(spark), "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("source mix", source_mix),
    ("shards", shards),
]

# Rules are learned from labels, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is stored and read again by the next."""
    docs, store = read(prepared(spark), sf_dir, "documents"), Store(spark, "pipeline")
    for name, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
