"""Prefix trie of conversations, with count-min screening of prefix digests.

Every prefix of every conversation has a digest. A count-min sketch counts the digests of the whole table; it never
counts too few, so an estimate of one proves that no other conversation has the prefix, nor any longer one of the
same conversation. Such tails are finished where they lie: their nodes have one member, one leaf, nothing saved. Only
prefixes that may be shared are shuffled, and grouped exactly. A sketch too small for its input lets more prefixes
through, never fewer: results do not depend on it.

Sums over subtrees double their reach in each round (1, 2, 4, ... levels), so the rounds are the logarithm of the
deepest shared prefix. The ancestor of a node is read from the rows of its smallest member, by conversation and
depth, and no node is asked for twice: a prefix that a third of all conversations share is no hot key there.

A prefix is known by 122 bits of its digest. The ids that end in a node are hashed in order as the contract of a hash
demands, one node in one task, in pieces of text that other tasks have joined; nothing but the hash is held.

Defined cases: rows without a conversation id belong to no conversation; null roles and texts are empty; rows of one
turn are ordered by role, then by digest of role and text; repeated rows are turns of their own; texts of any length
are digested whole; other columns are ignored, whatever their names; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Store, prepared, read
from tracewell.llm.runs import runs

# The sketch: LANES rows of 4 cells per prefix, at most MOST_CELLS each, one byte a cell. 48 MB bound what is broadcast.
LANES = 3
MOST_CELLS = 1 << 24
BLOCK_CELLS = 1 << 16
CHUNK_CHARS = 1 << 16
HEADS = 9  # Fixed value: a rebuilt conversation borrows fewer turns than this.
FAMILY = 5
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_facts(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, item, bytes)``: what orders a turn, 16 bytes that stand for role and text, text size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.unhex(F.md5(content.cast("binary"))).alias("item"),
        F.octet_length(text).cast("long").alias("bytes"))


def turns(conversations: DataFrame, store: Store) -> DataFrame:
    """``(conv, at, item, bytes)``: the turns of every conversation in order."""
    facts = store.save(turn_facts(conversations), "facts")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("item")]
    return runs(facts, "conv", order, store, "turns").select("conv", "at", "item", "bytes")


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(ordered: DataFrame, store: Store) -> DataFrame:
    """``(conv, at, item, bytes)`` of rebuilt conversations: the first turns of the family's first conversation,
    then the own turns beyond as many. ``at`` orders them; one row with ``at`` = -1 opens each conversation."""
    own = store.save(ordered, "own")
    convs = own.filter("at = 0").select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("from"), head_length(F.col("conv")).alias("head"))
    # Fewer than HEADS turns of each conversation.
    first = own.filter((F.col("at") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).groupBy(F.col("conv").alias("from")).agg(
        F.array_sort(F.collect_list(F.struct("at", "item", "bytes"))).alias("turns"))
    borrowed = convs.join(first, "from", "left")
    taken = F.slice(F.coalesce("turns", F.array().cast("array<struct<at:long,item:binary,bytes:long>>")), F.lit(1), F.col("head").cast("int"))
    opening = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("bytes")))
    opened = borrowed.select("conv", F.inline(F.concat(opening, taken)))
    return opened.unionByName(own.filter(F.col("at") >= head_length(F.col("conv"))))


def opened(ordered: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of :func:`rebuilt`."""
    opening = ordered.filter("at = 0").select("conv", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("bytes"))
    return ordered.unionByName(opening)


def _cells(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    a = batch.column("a").to_numpy(zero_copy_only=False).astype(np.uint64)
    b = batch.column("b").to_numpy(zero_copy_only=False).astype(np.uint64)
    mask = np.uint64(width - 1)
    return [((a + np.uint64(lane) * b) >> np.uint64(13) & mask).astype(np.int64) for lane in range(LANES)]


def sketch(prefixes: DataFrame, width: int) -> list[np.ndarray]:
    """Counts up to two in ``LANES`` rows of ``width`` cells (a power of two) over the digests ``a, b``."""
    block = min(width, BLOCK_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((LANES, width), np.uint8)
        for batch in batches:
            for lane, cells in enumerate(_cells(batch, width)):
                cell, times = np.unique(cells, return_counts=True)
                table[lane, cell] = np.minimum(2, table[lane, cell] + np.minimum(2, times))
        yield from emit({(lane, at // block): table[lane, at:at + block] for lane in range(LANES) for at in range(0, width, block)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                place, cells = (row["lane"], row["block"]), np.frombuffer(row["cells"], np.uint8)
                found[place] = np.minimum(2, found[place] + cells) if place in found else cells
        yield from emit(found)

    def emit(found: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lane, at), cells in found.items():
            if cells.any():
                yield pa.RecordBatch.from_pydict({"lane": pa.array([lane], pa.int32()), "block": pa.array([at], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    schema = "lane int, block int, cells binary"
    parts = prefixes.select("a", "b").mapInArrow(count, schema).repartition("lane", "block").mapInArrow(merge, schema)
    table = [np.zeros(width, np.uint8) for _ in range(LANES)]
    for row in parts.toLocalIterator():
        table[row["lane"]][row["block"] * block:(row["block"] + 1) * block] = np.frombuffer(row["cells"], np.uint8)
    return table


def screened(prefixes: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """``prefixes`` with ``alone`` (proved to have one member) and ``top`` (its parent is not known to be alone)."""
    width = 1 << 10
    rows = prefixes.count()
    while width < min(4 * rows, most_cells):
        width *= 2
    # Bounded by LANES x MOST_CELLS bytes, whatever the input.
    shared = prefixes.sparkSession.sparkContext.broadcast([lane.tobytes() for lane in sketch(prefixes.filter("depth > 0"), width)])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = [np.frombuffer(lane, np.uint8) for lane in shared.value]
        conv, depth, before = None, -1, False
        for batch in batches:
            counts = np.minimum.reduce([lane[cells] for lane, cells in zip(lanes, _cells(batch, width))])
            alone, top = [], []
            for this, level, count in zip(batch.column("conv").to_pylist(), batch.column("depth").to_pylist(), counts.tolist()):
                before = before and this == conv and level == depth + 1
                now = level > 0 and (before or count == 1)
                top.append(now and not before)
                alone.append(now)
                conv, depth, before = this, level, now
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone, pa.bool_()), pa.array(top, pa.bool_())], names=[*batch.schema.names, "alone", "top"])

    schema = T.StructType([*prefixes.schema, T.StructField("alone", T.BooleanType()), T.StructField("top", T.BooleanType())])
    return prefixes.mapInArrow(flag, schema)


def _ends(last: DataFrame) -> DataFrame:
    """``(a, b, ends)``: SHA-256 of the ids that end in a node, in order, joined by commas.

    Sorted parts join ids to pieces of text first; the hash of one node then reads few rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, first = None, [], 0, None

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "a": pa.array([node[0]], pa.int64()), "b": pa.array([node[1]], pa.int64()), "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(ids)], pa.string())})

        for batch in batches:
            for a, b, conv in zip(*[batch.column(name).to_pylist() for name in ("a", "b", "conv")]):
                if node != (a, b) or size > CHUNK_CHARS:
                    if ids:
                        yield piece()
                    node, ids, size, first = (a, b), [], 0, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            a, b, ends = zip(*found)
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ends": pa.array(ends, pa.string())})

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if node == (row["a"], row["b"]):
                    state.update(b",")
                else:
                    if state:
                        found.append((*node, state.hexdigest()))
                    node, state = (row["a"], row["b"]), hashlib.sha256()
                state.update(row["ids"].encode())
            if found:
                yield done(found)
        if state:
            yield done([(*node, state.hexdigest())])

    joined = last.select("a", "b", "conv").repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    joined = joined.mapInArrow(pieces, "a long, b long, first long, ids string")
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends string")


def _subtree_sums(shared: DataFrame, rows: DataFrame, store: Store) -> DataFrame:
    """``shared`` with ``leaves`` and ``saved`` summed over the nodes below."""
    deepest, reach = shared.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        far = shared.filter(F.col("depth") >= reach)
        if reach == 1:
            up = far.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "leaves", "saved")
        else:
            asked = far.select(F.col("owner").alias("conv"), (F.col("depth") - reach).alias("depth"), "leaves", "saved")
            up = asked.join(rows.select("conv", "depth", "a", "b"), ["conv", "depth"])
        more = up.groupBy("a", "b").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        added = shared.join(more, ["a", "b"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
        added = added.withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaves", "more_saved")
        shared, reach = store.save(added, f"reach-{reach}"), reach * 2
    return shared


def prefix_trie(sequences: DataFrame, store: Store, most_cells: int = MOST_CELLS) -> DataFrame:
    """A row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (here bytes) and ``ends_sha256``, from :func:`opened` or :func:`rebuilt` rows."""
    prefixes = runs(sequences.withColumnRenamed("at", "place"), "conv", [F.col("place")], store, "prefixes", item="item")
    prefixes = store.save(prefixes.drop("place").withColumnRenamed("at", "depth"), "placed")
    rows = store.save(screened(prefixes, most_cells), "screened")
    own_end = F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))

    # Prefixes that may be shared meet by digest.
    maybe = rows.filter(~F.col("alone"))
    nodes = store.save(maybe.groupBy("a", "b").agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("last").alias("last")), "nodes")
    several = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    shared = nodes.filter(several)
    singles = nodes.filter(~several).select(F.col("owner").alias("conv"), "depth", "pa", "pb", "last")
    singles = singles.unionByName(rows.filter("top").select("conv", "depth", "pa", "pb", "last"))
    parents = shared.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent"))
    singles = store.save(singles.join(parents, ["pa", "pb"], "left"), "singles")

    below = shared.filter("depth > 0").select("pa", "pb", F.lit(0).alias("single")).unionByName(
        singles.filter("parent IS NOT NULL").select("pa", "pb", F.lit(1).alias("single")))
    below = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), F.sum("single").alias("n_single"))
    grown = shared.join(below, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.coalesce("n_single", F.lit(0))).cast("long")
    grown = grown.withColumn("leaves", leaves).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("n_single", "bytes")
    summed = _subtree_sums(store.save(grown, "shared"), maybe, store)

    top = summed.join(parents.withColumnRenamed("parent", "above"), ["pa", "pb"], "left").join(_ends(maybe.filter("last")), ["a", "b"], "left")
    top = top.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("above")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    tails = singles.select("conv", "depth", F.coalesce("parent", "conv").alias("parent"), "last").unionByName(
        rows.filter("alone AND NOT top").select("conv", "depth", F.col("conv").alias("parent"), "last"))
    one = F.lit(1).cast("long")
    tails = tails.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), own_end.alias("ends_sha256"))
    return top.unionByName(tails)


def op11(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    store = Store(spark, "trie")
    return prefix_trie(rebuilt(turns(read(spark, sf_dir, "conversations"), store), store), store)


# crc32 bit by bit: DuckDB has none.
CRC_BITS = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen({0}) + 1), lambda i: list_transform(range(0, 8),
  lambda k: ((ascii(substr({0}, i, 1)) >> k) & 1)::BIGINT)))), lambda crc, bit: xor(crc >> 1, 3988292384::BIGINT * (xor(crc, bit) & 1))), 4294967295::BIGINT)"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS s, {CRC_BITS.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM own)),
again AS (
  SELECT v.c, o.place, o.role, o.text FROM convs v JOIN own o ON o.c = v.s AND o.place < v.h
  UNION ALL SELECT v.c, o.place, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.place >= v.h),
rows_ AS (
  SELECT c, row_number() OVER w AS depth, md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER w) AS node, strlen(text) AS bytes FROM again
  WINDOW w AS (PARTITION BY c ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, md5(''), 0 FROM convs),
paths AS (
  SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS last FROM rows_ WINDOW w AS (PARTITION BY c ORDER BY depth)),
nodes AS (
  SELECT node, depth, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM paths GROUP BY node, depth),
kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.node = k.node),
below AS (
  SELECT p.node AS top, f.node, f.n_children, (f.n_convs - 1) * f.bytes AS saved
  FROM full_ f JOIN paths mine ON mine.c = f.conv_id AND mine.depth <= f.depth JOIN full_ p ON p.node = mine.node),
sums AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY top)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f LEFT JOIN full_ p ON f.up = p.node JOIN sums s ON s.top = f.node
"""
