"""Session settings shared by tests, benchmarks and jobs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


# Settings of a session, changeable at run time, that every job here wants.
SESSION_SETTINGS = {
    # Times without a zone are UTC.
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method beyond 8,000 bytes of code; rows of many redacted or hashed columns reach
    # that, and then smaller generated functions run several times faster than one fused, interpreted loop.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A join on (part, word) takes both sides as they are dealt by part.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Whole documents travel in Arrow batches: few rows per batch keep a Python worker small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that was built elsewhere."""
    for name, value in SESSION_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "tracewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and the state store that spills to disk.

    ``master`` is left unset on a cluster (spark-submit names it). Shuffle partitions are also left to the
    cluster; adaptive execution merges small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **SESSION_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that must outlive an executor.

    The cluster names it in ``spark.checkpoint.dir``; without that setting it lies in the warehouse, which all
    executors reach as well.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/steps"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later steps read, and read it back: lineage ends at the files."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most ``rows`` rows; reads no more than it must to know."""
    return df.limit(rows + 1).count() <= rows
