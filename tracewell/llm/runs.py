"""Positions and prefix digests inside the runs of a key, however many rows one key has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Store

# A prefix digest is the sum of item x BASE^position over a prime field, in two lanes: pieces of a run are summed
# apart and added up once the length of what stands before them is known.
PRIME = (1 << 61) - 1
BASES = (1_000_003 << 33 | 12_345_679, 998_244_353 << 29 | 7_654_321)
_LANES = ("a", "b", "pa", "pb")


def runs(df: DataFrame, key: str, order: list[Column], store: Store, name: str, item: str | None = None) -> DataFrame:
    """``df`` with ``at``, the 0-based position among the rows of its ``key`` in ``order``, and ``last``.

    With ``item`` (16 bytes or null, dropped here) also ``a, b``, the digest of the items up to this row, and
    ``pa, pb``, that of the items before it; null items add nothing.

    A range sort over (key, order), one pass over each sorted part and one small row per part: a key's rows may
    lie in many parts. Only the run that crosses a part's start is corrected. What reaches the driver is one row
    per sorted part. Keys are not null.
    """
    lanes = list(_LANES) if item else []
    kept = [field for field in df.schema if field.name != item]
    made = [*lanes, "at", "last", "_part", "_row"]
    clash = set(made) & {field.name for field in kept}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    kinds = {"last": T.BooleanType(), "_part": T.IntegerType()}
    schema = T.StructType([*kept, *[T.StructField(column, kinds.get(column, T.LongType())) for column in made]])
    names = [field.name for field in kept]
    prime, bases = PRIME, BASES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, current, at = TaskContext.get().partitionId(), 0, None, -1
        digest, power, waiting = [0, 0], [1, 1], None

        def finish(columns: dict, following: object) -> pa.RecordBatch:
            keys = columns["keys"]
            ends = [this != after for this, after in zip(keys, [*keys[1:], following])]
            made_here = {**{lane: pa.array(columns[lane], pa.int64()) for lane in lanes}, "at": pa.array(columns["at"], pa.int64()),
                         "last": pa.array(ends, pa.bool_()), "_part": pa.array([part] * len(keys), pa.int32()),
                         "_row": pa.array(range(columns["row"], columns["row"] + len(keys)), pa.int64())}
            return pa.RecordBatch.from_arrays([*columns["kept"], *made_here.values()], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_pylist()
            if waiting:
                yield finish(waiting, keys[0])
            items = batch.column(item).to_pylist() if item else [None] * len(keys)
            columns = {"keys": keys, "row": row, "kept": [batch.column(name) for name in names], "at": [], **{lane: [] for lane in lanes}}
            for this, content in zip(keys, items):
                if this != current:
                    current, at, digest, power = this, -1, [0, 0], [1, 1]
                at += 1
                columns["at"].append(at)
                if not item:
                    continue
                columns["pa"].append(digest[0])
                columns["pb"].append(digest[1])
                if content is not None:
                    halves = int.from_bytes(content[:8], "big"), int.from_bytes(content[8:16], "big")
                    digest = [(d + h % prime * p) % prime for d, h, p in zip(digest, halves, power)]
                power = [p * base % prime for p, base in zip(power, bases)]
                columns["a"].append(digest[0])
                columns["b"].append(digest[1])
            waiting, row = columns, row + len(keys)
        if waiting:
            yield finish(waiting, None)

    saved = store.save(df.sort(F.col(key), *order).mapInArrow(scan, schema), name)
    ends = F.struct(F.col(key).alias("key"), "at", *lanes)
    parts = saved.groupBy("_part").agg(
        F.count("*").alias("rows"), F.min_by(key, "_row").alias("first"), F.max_by(ends, "_row").alias("end")).orderBy("_part").collect()
    carried, offsets = None, []
    for part, after in zip(parts, [*parts[1:], None]):
        before = carried if carried and carried["key"] == part["first"] else {"key": None, "at": 0, "a": 0, "b": 0}
        scales = [pow(base, before["at"], PRIME) for base in BASES]
        following = after["first"] if after else None
        offsets.append((part["_part"], part["rows"] - 1, before["key"], following, before["at"], before["a"], before["b"], *scales))
        end = part["end"].asDict()
        joined = before["key"] is not None and end["key"] == before["key"]
        carried = {"key": end["key"], "at": end["at"] + 1 + (before["at"] if joined else 0)}
        for lane, scale in zip("ab", scales):
            own = end.get(lane, 0)
            carried[lane] = (before[lane] + scale * own) % PRIME if joined else own
    kind = df.schema[key].dataType.simpleString()
    spans = df.sparkSession.createDataFrame(
        offsets, f"_part int, _final long, _key {kind}, _next {kind}, _at long, _a long, _b long, _sa long, _sb long")
    # One row per sorted part: as many as the sort had tasks.
    placed = saved.join(F.broadcast(spans), "_part")
    crossing = F.col("_key").isNotNull() & (F.col(key) == F.col("_key"))
    wide = lambda column: F.col(column).cast("decimal(19,0)")
    for lane in lanes:
        side = lane[-1]
        whole = ((wide(f"_{side}") + wide(f"_s{side}") * wide(lane)) % F.lit(PRIME).cast("decimal(19,0)")).cast("long")
        placed = placed.withColumn(lane, F.when(crossing, whole).otherwise(F.col(lane)))
    goes_on = (F.col("_row") == F.col("_final")) & F.coalesce(F.col(key) == F.col("_next"), F.lit(False))
    placed = placed.withColumn("at", F.col("at") + F.when(crossing, F.col("_at")).otherwise(0)).withColumn("last", F.col("last") & ~goes_on)
    return placed.select(*names, *lanes, "at", "last")
