"""A stored chunk index: segments of postings, delete marks, merging.

Each batch of chunks becomes a segment: texts, and their words with the times they occur, split once. A chunk that is
added again or removed gets a mark that ends its earlier versions; marks are small, and a search leaves out what they
name. A commit record lists the segments and marks that make up the index, so readers see whole batches, a replayed
batch changes nothing, and of two writers one starts over. Merging writes the live chunks of small segments as one
and drops marks that have nothing left to end.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.retrieval import index_words
from tracewell.sources.commits import CommitLog

SMALL_ROWS = 1_000_000
PLACE_BITS = 40  # rows of a batch keep their order; later batches come after all earlier ones
CHUNK = "chunk_id string, place long, text string, length int, counts array<struct<word:string,times:int>>, born long"
MARK = "chunk_id string, ended long"


class ChunkIndex:
    """``folder`` holds ``data`` and ``commits``. Texts are expected redacted, as everything stored here."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/commits")

    def state(self) -> dict:
        """What makes up the index now: number of the last commit, segments, marks, batches already taken."""
        latest = self.log.latest()
        return latest[1] | {"number": latest[0]} if latest else {"number": -1, "segments": [], "marks": [], "batches": []}

    def _rows(self, names: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.folder}/data/{entry['name']}" for entry in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, kind: str) -> dict:
        name = f"{kind}-{os.urandom(8).hex()}"
        rows.write.parquet(f"{self.folder}/data/{name}")
        return {"name": name, "rows": self.spark.read.parquet(f"{self.folder}/data/{name}").count()}

    def _commit(self, batch: str | None, change: Callable[[dict, int], dict]) -> bool:
        """Apply ``change`` to the state; a writer that came second starts over on the new state."""
        while True:
            state = self.state()
            if batch is not None and batch in state["batches"]:
                return False
            number = state["number"] + 1
            record = change(state, number)
            record["batches"] = state["batches"] + ([batch] if batch is not None else [])
            if self.log.create(number, {key: record[key] for key in ("segments", "marks", "batches")}):
                return True
            self._drop(state, record)

    def _drop(self, kept: dict, gone: dict) -> None:
        names = {entry["name"] for key in ("segments", "marks") for entry in kept[key]}
        for entry in [*gone["segments"], *gone["marks"]]:
            if entry["name"] not in names:
                self.log.remove(f"{self.folder}/data/{entry['name']}")

    def add(self, batch: str, chunks: DataFrame) -> bool:
        """Add ``chunks(chunk_id, insert_seq, text)``; of equal ids in a batch the last counts. False: batch known."""
        last = chunks.groupBy(F.col("chunk_id").cast("string").alias("chunk_id")).agg(F.max_by(F.struct("insert_seq", "text"), "insert_seq").alias("last"))
        rows = index_words(last.select("chunk_id", "last.insert_seq", "last.text"), kept=("text",)).withColumnRenamed("item_id", "chunk_id")

        def change(state: dict, number: int) -> dict:
            segment = self._write(rows.select("chunk_id", F.col("insert_seq").alias("place"), "text", "length", "counts", F.lit(number).cast("long").alias("born")), "segment")
            return {"segments": [*state["segments"], segment], "marks": [*state["marks"], *self._ended(state, last, number)]}

        return self._commit(batch, change)

    def remove(self, batch: str, ids: DataFrame) -> bool:
        """End all versions of ``ids(chunk_id)``; ids that are not there change nothing. False: batch known."""
        gone = ids.select(F.col("chunk_id").cast("string").alias("chunk_id")).distinct()
        return self._commit(batch, lambda state, number: {"segments": state["segments"], "marks": [*state["marks"], *self._ended(state, gone, number)]})

    def _ended(self, state: dict, ids: DataFrame, number: int) -> list[dict]:
        if not state["segments"]:
            return []
        known = self._rows(state["segments"], CHUNK).select("chunk_id").join(ids.select("chunk_id"), "chunk_id", "left_semi").distinct()
        mark = self._write(known.select("chunk_id", F.lit(number).cast("long").alias("ended")), "marks")
        return [mark] if mark["rows"] else []

    def _live(self, segments: list[dict], marks: list[dict]) -> DataFrame:
        rows = self._rows(segments, CHUNK)
        if not marks:
            return rows
        ended = self._rows(marks, MARK).groupBy("chunk_id").agg(F.max("ended").alias("ended"))
        return rows.join(ended, (rows["chunk_id"] == ended["chunk_id"]) & (rows["born"] < ended["ended"]), "left_anti")

    def chunks(self) -> DataFrame:
        """``(chunk_id, insert_seq, text, length, counts)`` of every live chunk, in the order of insertion."""
        state = self.state()
        place = F.shiftleft(F.col("born"), PLACE_BITS) + F.col("place")
        return self._live(state["segments"], state["marks"]).select("chunk_id", place.alias("insert_seq"), "text", "length", "counts")

    def query(self, retrieve: Callable[..., DataFrame], questions: DataFrame, **limits: int) -> DataFrame:
        """Hits of a word search over the stored words; no text is split again.

        Ended versions are left out of the postings of the words asked for: whole word lists are not shuffled for that.
        """
        state = self.state()
        rows = self._rows(state["segments"], CHUNK)
        place = F.shiftleft(F.col("born"), PLACE_BITS) + F.col("place")
        indexed = rows.select(F.col("chunk_id").alias("item_id"), place.alias("insert_seq"), "length", "counts", "born")
        if not state["marks"]:
            return retrieve(questions, indexed.drop("born"), **limits)
        ended = self._rows(state["marks"], MARK).groupBy(F.col("chunk_id").alias("item_id")).agg(F.max("ended").alias("ended"))

        def live(found: DataFrame) -> DataFrame:
            return found.join(ended, (found["item_id"] == ended["item_id"]) & (found["born"] < ended["ended"]), "left_anti")

        return retrieve(questions, indexed, live=live, **limits)

    def merge(self, small_rows: int = SMALL_ROWS) -> bool:
        """Write the live chunks of all segments of at most ``small_rows`` as one; False if there is nothing to merge."""
        state = self.state()
        small = [entry for entry in state["segments"] if entry["rows"] <= small_rows]
        if len(small) < 2:
            return False
        merged = self._write(self._live(small, state["marks"]), "segment")
        kept = [entry for entry in state["segments"] if entry not in small]
        # Marks still end versions in the segments that stay.
        record = {"segments": [*kept, merged] if merged["rows"] else kept, "marks": state["marks"] if kept else [], "batches": state["batches"]}
        if self.log.create(state["number"] + 1, record):
            return True
        self._drop(state, record)
        return False

    def clean(self) -> None:
        """Delete data that only older commits name. For times without readers of older states."""
        state = self.state()
        for number in self.log.numbers():
            self._drop(state, self.log.read(number))
