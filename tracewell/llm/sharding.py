"""Shards of equal row counts with linked documents together: balanced label propagation.

Documents of equal text are linked. Every document starts in the shard its hash names. In each round the linked
documents of a shard ask to move to the shard that holds most of their group; a shard admits as many as its quota
and the departures asked of it leave room for, small groups first, which fit whole, then by gain. After the rounds every shard keeps linked
documents up to its quota, small groups first and no group beyond it, and the rest, group after group, then the unlinked documents,
fill what room is left. So counts differ by one at most, and a group is cut only where a quota ends.

A group is never paired up: its members meet in counts per (group, shard), added up before they are shuffled.

Defined cases: null texts have size 1 and no links; empty texts are equal texts; repeated rows are rows of their
own; an empty table gives no rows. Texts of any length count with all their bytes; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Store, numbered, prepared, read

SHARDS = 16
ROUNDS = 4


def _quota(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _pick(values: list[int], index: Column) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])[index]


def _by_shard(df: DataFrame, shards: int) -> list[int]:
    found = {row["shard"]: row["count"] for row in df.groupBy("shard").count().collect()}
    return [found.get(k, 0) for k in range(shards)]


def _group_counts(linked: DataFrame) -> DataFrame:
    """Each group's fullest shard; ties go by a hash of group and shard, so members agree."""
    counts = linked.groupBy("text_key", "shard").agg(F.count("*").alias("held"))
    choice = F.struct("held", F.xxhash64("text_key", "shard"), "shard")
    return counts.groupBy("text_key").agg(
        F.max(choice)["shard"].alias("best"), F.max("held").alias("best_held"),
        F.map_from_entries(F.collect_list(F.struct("shard", "held"))).alias("held"),  # one entry per shard at most
    )


def propagate(linked: DataFrame, quota: list[int], store: Store, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (row, text_key, copies, shard) after at most ``rounds`` rounds of moves."""
    shards = len(quota)
    for _ in range(rounds):
        groups = store.save(_group_counts(linked), "groups")
        asked = linked.join(groups, "text_key").filter(F.col("shard") != F.col("best"))
        asked = asked.select("row", "text_key", "copies", "shard", "best", (F.col("best_held") - F.element_at("held", F.col("shard"))).alias("gain"))
        asked = store.save(asked, "asked")
        leaving = _by_shard(asked, shards)
        if not sum(leaving):
            break
        held = _by_shard(linked, shards)
        room = [max(0, quota[k] - held[k] + leaving[k]) for k in range(shards)]
        lined = numbered(asked, [F.col("best"), F.col("copies"), F.col("gain").desc(), F.col("text_key"), F.col("row")], store, "lined")
        firsts = {row["best"]: row["first"] for row in lined.groupBy("best").agg(F.min("number").alias("first")).collect()}
        first = _pick([firsts.get(k, 0) for k in range(shards)], F.col("best"))
        moves = lined.filter(F.col("number") - first < _pick(room, F.col("best"))).select("row", F.col("best").alias("to"))
        moved = linked.join(moves, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
        linked = store.save(moved, "moved")
    return linked


def assign(docs: DataFrame, store: Store, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` per row of ``docs``, in a stored, narrow table.

    ``row`` numbers the rows in the order they were stored.
    """
    text = F.col("text")
    facts = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_key"), F.monotonically_increasing_id().alias("row"),
    )
    facts = store.save(facts, "facts")
    rows = facts.count()
    quota = _quota(rows, shards)
    # Stored first: both sides of the join then come from plain scans, and a group of any size can be split.
    groups = store.save(facts.filter("text_key IS NOT NULL").groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1"), "sizes")
    linked = facts.join(groups, "text_key").select(
        "row", "text_key", "copies", F.pmod(F.xxhash64("row", "doc_id"), F.lit(shards)).cast("int").alias("shard"))
    linked = propagate(store.save(linked, "linked"), quota, store, rounds)

    # Linked documents keep their shard up to its quota, the smallest groups first.
    lined = numbered(linked, [F.col("shard"), F.col("copies"), F.col("text_key"), F.col("row")], store, "keep")
    firsts = {row["shard"]: row["first"] for row in lined.groupBy("shard").agg(F.min("number").alias("first")).collect()}
    place = F.col("number") - _pick([firsts.get(k, 0) for k in range(shards)], F.col("shard"))
    # A group beyond any quota is cut in any case: it fills one shard's room after another instead.
    kept = lined.filter((place < _pick(quota, F.col("shard"))) & (F.col("copies") <= quota[0])).select("row", "shard")
    kept = store.save(kept, "kept")
    held = _by_shard(kept, shards)

    # All others fill the room that is left, groups one after another, then unlinked documents.
    waiting = facts.join(kept, "row", "left_anti").join(linked.select("row", "copies"), "row", "left")
    waiting = waiting.select("row", "copies", F.when(F.col("copies").isNotNull(), F.col("text_key")).alias("group"))
    queue = numbered(waiting, [F.col("group").isNull(), F.col("copies"), F.col("group"), F.xxhash64("row")], store, "queue")
    bounds, total = [], 0
    for k in range(shards):
        total += quota[k] - held[k]
        bounds.append(total)
    filled = queue.select("row", sum((F.col("number") >= F.lit(b)).cast("int") for b in bounds).alias("shard"))
    placed = facts.join(kept.unionByName(filled), "row")
    slots = numbered(placed.drop("text_key"), [F.col("shard"), F.col("doc_id"), F.col("row")], store, "slots")
    starts = [sum(quota[:k]) for k in range(shards)]
    return slots.withColumn("slot", F.col("number") - _pick(starts, F.col("shard"))).drop("number")


def op10(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    placed = assign(read(spark, sf_dir, "documents"), Store(spark, "shards"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
