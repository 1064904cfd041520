"""Shared by the operators here: stored steps, distributed numbering, words of Arrow text columns."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.session import prepare_session

# Fixed value: the white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = "500"
BYTES_PER_BATCH = str(16 << 20)


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the library; whole texts travel to Python in small Arrow batches."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    # Joins here ask for all their keys: a side dealt by one hot key alone would not be split.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Store:
    """Tables of one run in the shared folder of the cluster: lineage ends there, so a lost executor costs one step.

    The folder is ``spark.checkpoint.dir``; where that is unset, a folder in the session's warehouse.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            shared = spark.conf.get("spark.sql.warehouse.dir") + "/steps"
        self.folder = f"{shared}/{name}-{os.urandom(8).hex()}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, path: str) -> None:
        """Remove a step that no later one reads."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, null where it is null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def doc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("bigint")


def numbered(df: DataFrame, order: list[Column], store: Store, name: str, size: str | None = None) -> DataFrame:
    """``df`` stored in ``order`` with ``number`` (0-based) and, for a ``size`` column, ``before``: the sum of
    the sizes of all earlier rows.

    A range-partitioned sort, running totals within each sorted part, and one offset per part: no key, however
    many rows it has, is gathered in one task. What reaches the driver is one row per sorted part.
    """
    clash = {"number", "before", "_part", "_row", "_sum"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()),
                           T.StructField("_sum", T.LongType())])

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            if size:
                sizes = pc.fill_null(batch.column(size), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = total + np.cumsum(sizes) - sizes
            stamped = [pa.array(np.full(batch.num_rows, part, np.int32)),
                       pa.array(row + np.arange(batch.num_rows, dtype=np.int64)), pa.array(sums)]
            row, total = row + batch.num_rows, total + int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, *stamped], names=schema.names)

    saved = store.save(df.sort(*order).mapInArrow(stamp, schema), name)
    amount = F.sum(size) if size else F.lit(0).cast("bigint")
    rows, total, offsets = 0, 0, []
    for part in saved.groupBy("_part").agg(F.count("*").alias("rows"), amount.alias("total")).orderBy("_part").collect():
        offsets.append((part["_part"], rows, total))
        rows, total = rows + part["rows"], total + (part["total"] or 0)
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _rows long, _total long")
    # One row per sorted part: as many as the sort had tasks.
    placed = saved.join(F.broadcast(starts), "_part").withColumn("number", F.col("_row") + F.col("_rows"))
    if size:
        placed = placed.withColumn("before", F.col("_sum") + F.col("_total"))
    return placed.drop("_part", "_row", "_sum", "_rows", "_total")
