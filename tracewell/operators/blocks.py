"""Best-k items per query without materialising query-item pairs.

Items are scored where they lie: every task keeps only the best ``k`` items of each query it has seen, so
what is shuffled is at most tasks x queries x k small rows. A query set within the block limits travels to
the tasks whole. A larger one is cut into blocks; every pair of a query block and an item block is one
bounded group, so neither a popular word nor a large side can fill a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A prepared query block: scores a table of items as a matrix (items x queries); -inf marks "no hit". It is told the
# score below which a hit no longer counts for each query, and where few pairs reach theirs it returns these alone:
# their items, queries and scores.
Scored = np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]
Scorer = Callable[[pa.Table, np.ndarray], Scored]
NO_HIT = -np.inf
QUERY_ROWS = 4096
QUERY_WEIGHT = 1_000_000
ITEM_WEIGHT = 4_000_000
MATRIX_CELLS = 4_000_000


def _best(query: np.ndarray, seq: np.ndarray, score: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the first ``depth`` entries of every query: higher score first, then lower ``seq``."""
    order = np.lexsort((seq, -score, query))
    ranked = query[order]
    rank = np.arange(len(ranked)) - np.searchsorted(ranked, ranked, side="left")
    return order[rank < depth]


class _Leaders:
    """The best items so far of every query of one block."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.query = np.empty(0, np.int64)
        self.seq = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.items: pa.Array | None = None

    def floors(self, queries: int) -> np.ndarray:
        """Score of every query's last place; -inf while places are free."""
        floors = np.full(queries, NO_HIT)
        ends = np.cumsum(np.bincount(self.query, minlength=queries))
        full = np.flatnonzero(np.diff(ends, prepend=0) >= self.depth)
        floors[full] = self.score[ends[full] - 1]
        return floors

    def offer(self, items: pa.Table, scores: Scored) -> None:
        seqs = items.column("insert_seq").to_numpy()
        if isinstance(scores, tuple):
            rows, queries, values = scores
        else:
            found = scores > NO_HIT
            if len(scores) > self.depth:
                found &= scores >= np.partition(scores, -self.depth, axis=0)[-self.depth]
            rows, queries = np.nonzero(found)
            values = scores[rows, queries]
        if not len(rows) and self.items is not None:
            return
        keep = _best(queries, seqs[rows], values, self.depth)
        rows, queries, values = rows[keep], queries[keep], values[keep]
        ids = items.column("item_id").combine_chunks().take(pa.array(rows))
        query = np.concatenate([self.query, queries])
        seq = np.concatenate([self.seq, seqs[rows]])
        score = np.concatenate([self.score, values])
        ids = ids if self.items is None else pa.concat_arrays([self.items, ids])
        keep = _best(query, seq, score, self.depth)
        self.query, self.seq, self.score = query[keep], seq[keep], score[keep]
        self.items = ids.take(pa.array(keep))

    def table(self, queries: pa.Table) -> pa.Table:
        at = pa.array(self.query)
        return pa.table({
            "query_id": queries.column("query_id").combine_chunks().take(at),
            "top_k": queries.column("top_k").combine_chunks().take(at),
            "item_id": self.items,
            "insert_seq": pa.array(self.seq, pa.int64()),
            "score": pa.array(self.score, pa.float64()),
        })


def _scan(items: pa.Table, scorer: Scorer, leaders: _Leaders, queries: int) -> None:
    rows = max(1, MATRIX_CELLS // max(1, queries))
    for start in range(0, items.num_rows, rows):
        part = items.slice(start, rows).combine_chunks()
        leaders.offer(part, scorer(part, leaders.floors(queries)))


def best_items(
    queries: DataFrame,
    items: DataFrame,
    prepare: Callable[[pa.Table], Scorer],
    query_weight: str,
    item_weight: str,
    query_rows: int = QUERY_ROWS,
    query_block: int = QUERY_WEIGHT,
    item_block: int = ITEM_WEIGHT,
) -> DataFrame:
    """``(query_id, item_id, insert_seq, score, index)``: the first ``top_k`` hits of every query.

    ``queries`` has query_id, top_k and columns for ``prepare``; ``items`` has item_id, insert_seq and columns
    for the scorer. The weight expressions measure one row (number of words, of dimensions).
    """
    fields = {field.name: field.dataType for field in [*queries.schema, *items.schema]}
    hit = T.StructType([
        T.StructField("query_id", fields["query_id"]), T.StructField("top_k", fields["top_k"]),
        T.StructField("item_id", fields["item_id"]),
        T.StructField("insert_seq", T.LongType()), T.StructField("score", T.DoubleType()),
    ])
    measured = queries.withColumn("_weight", F.expr(query_weight))
    # At most one row more than a block may have reaches the driver.
    block = measured.limit(query_rows + 1).toArrow()
    if block.num_rows <= query_rows and (pc.sum(block["_weight"]).as_py() or 0) <= query_block:
        depth = pc.max(block["top_k"]).as_py() or 0
        if depth < 1:
            return rank_hits(queries.sparkSession.createDataFrame([], hit), 1)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, leaders = prepare(block), _Leaders(depth)
            for batch in batches:
                _scan(pa.table(batch), scorer, leaders, block.num_rows)
            if leaders.items is not None:
                yield from leaders.table(block).to_batches()

        return rank_hits(items.mapInArrow(scan, hit), depth)

    size = measured.agg(
        F.count("*").alias("rows"), F.sum("_weight").alias("weight"), F.max("top_k").alias("depth")
    ).first()
    depth = max(1, size["depth"])
    total = items.agg(F.sum(F.expr(item_weight)).alias("weight")).first()["weight"] or 1
    blocks = max(1, math.ceil(size["rows"] / query_rows), math.ceil((size["weight"] or 0) / query_block))
    parts = max(1, math.ceil(total / item_block))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        leaders = _Leaders(depth)
        if left.num_rows and right.num_rows:
            _scan(right, prepare(left), leaders, left.num_rows)
        if leaders.items is None:
            leaders.items = right.column("item_id").combine_chunks().slice(0, 0)
        return leaders.table(left)

    def spread(df: DataFrame, names: tuple[str, ...], own: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(*names), F.lit(count))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint")))
        )

    left = spread(queries, ("query_id",), "block", blocks, "part", parts).groupBy("block", "part")
    right = spread(items, ("item_id", "insert_seq"), "part", parts, "block", blocks).groupBy("block", "part")
    return rank_hits(left.cogroup(right).applyInArrow(join, hit), depth)


def rank_hits(hits: DataFrame, depth: int) -> DataFrame:
    """0-based ``index`` of every hit within its query, best score first, earlier items first among equals.

    ``depth`` is the largest ``top_k``: as a constant it limits every group before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("insert_seq"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    return (
        ranked.filter(F.col("rank") <= F.col("top_k"))
        .withColumn("index", (F.col("rank") - 1).cast("int")).drop("rank", "top_k")
    )
