"""Upkeep of an index table: latest versions, retention, removal, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEWEST_DOCUMENTS, NEWEST_RECORDS = 10_000, 1_000  # Fixed values: default bounds of the in-memory stores.


def latest_versions(chunks: DataFrame, key: str = "chunk_id", order: str = "insert_seq") -> DataFrame:
    """One row per id, the last written; a rewrite moves the id to the newest place. Merges per task."""
    rest = [name for name in chunks.columns if name not in (key, order)]
    latest = chunks.groupBy(key).agg(F.max(F.col(order)).alias(order), F.max_by(F.struct(*rest), order).alias("latest"))
    return latest.select(key, order, "latest.*").select(chunks.columns)


def newest(rows: DataFrame, count: int = NEWEST_DOCUMENTS, order: str = "insert_seq") -> DataFrame:
    """The ``count`` newest rows; each task sends at most that many."""
    return rows.orderBy(F.desc(order)).limit(count)


def remove_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Compensating delete; ids that are not there change nothing."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def retrieved_chunks(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Chunks that some question retrieved."""
    return chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
