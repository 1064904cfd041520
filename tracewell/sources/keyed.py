"""A table with one row per key, merged batch by batch.

Keys are dealt to buckets. A batch reads and rewrites the buckets it touches and commits a new generation: the list of
bucket folders that make up the table. Readers see one generation, whole. A batch whose number is already in the table
changes nothing, so a replay is safe; of two writers one starts over on the other's result. Deleted keys stay as
marks, so an older change that arrives late does not bring them back.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.commits import CommitLog

BUCKETS = 64


class KeyedTable:
    """``schema`` of the rows, their ``key``, the columns whose ``order`` tells which row of a key is the latest, and
    ``deleted``, a condition on a row that says its key is gone."""

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType | str, key: str, order: tuple[str, ...], deleted: str = "false", buckets: int = BUCKETS,
    ) -> None:
        self.spark, self.folder, self.key, self.order, self.deleted, self.buckets = spark, folder.rstrip("/"), key, order, deleted, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.log = CommitLog(spark, f"{self.folder}/commits")

    def _state(self) -> tuple[int, dict]:
        return self.log.latest() or (-1, {"buckets": {}, "batch": -1})

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row per key; a key of very many rows costs one row per task."""
        # Rows of equal order are told apart by their content, so a replay in another order ends the same.
        order = F.struct(*self.order, F.xxhash64(*self.schema.names))
        latest = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*self.schema.names), order).alias("row"))
        return latest.select("row.*")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{name}" for name in folders])

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Merge the rows of a batch; False if the table holds this batch or a later one. Null keys are left out."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        while True:
            number, state = self._state()
            if batch <= state["batch"]:
                return False
            name = f"batch-{batch}-{os.urandom(8).hex()}"
            incoming = self._latest(rows.select(*self.schema.names).filter(F.col(self.key).isNotNull())).withColumn("bucket", bucket)
            incoming.write.parquet(f"{self.folder}/data/{name}/new")
            fresh = self.spark.read.schema(T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/data/{name}/new")
            touched = [row["bucket"] for row in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
            old = self._read([state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]])
            merged = self._latest(old.unionByName(fresh.drop("bucket"))).withColumn("bucket", bucket)
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}/all")
            buckets = {**state["buckets"], **{str(b): f"{name}/all/bucket={b}" for b in touched}}
            if self.log.create(number + 1, {"buckets": buckets, "batch": batch}):
                self.log.remove(f"{self.folder}/data/{name}/new")
                return True
            self.log.remove(f"{self.folder}/data/{name}")

    def rows(self) -> DataFrame:
        """The current rows of all keys that are not deleted."""
        return self._read(sorted(self._state()[1]["buckets"].values())).filter(f"NOT coalesce({self.deleted}, false)")

    def clean(self) -> None:
        """Delete bucket folders that only older generations name."""
        kept = set(self._state()[1]["buckets"].values())
        for number in self.log.numbers():
            for name in self.log.read(number)["buckets"].values():
                if name not in kept:
                    self.log.remove(f"{self.folder}/data/{name}")
