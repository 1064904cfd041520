"""Domain events as tables: construction, parsing, union, windowed counts, causation, traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.canonical import iso_utc
from tracewell.operators.ordered import running_sum
from tracewell.schemas import EVENT_DEFAULTS, EVENT_TOPICS, STREAM_FIELDS, event_schema


NULL_PART = "\\N"


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped id derived from the row, so a replay issues the same one. A null part counts as a part."""
    marked = [F.coalesce(part.cast("string"), F.lit(NULL_PART)) for part in parts]
    return F.regexp_replace(
        F.md5(F.concat_ws("|", *marked)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def _default(field: T.StructField) -> Column:
    if field.name in EVENT_DEFAULTS:
        return F.lit(EVENT_DEFAULTS[field.name])
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.StructType):
        return F.lit(None).cast(kind)
    return F.lit(0).cast(kind)


def event_fields(columns: dict[str, Column], event_type: str, occurred_at: Column) -> dict[str, Column]:
    """Columns of one event type in contract order: equally named ``columns``, else the contract's defaults."""
    issued = {
        "occurred_at": iso_utc(occurred_at), "event_type": F.lit(event_type), "topic": F.lit(EVENT_TOPICS[event_type]),
    }

    def value(field: T.StructField) -> Column:
        if field.name in issued:
            return issued[field.name]
        if field.name in columns:
            return F.coalesce(columns[field.name].cast(field.dataType), _default(field))
        return _default(field)

    return {field.name: value(field) for field in event_schema(event_type)}


def make_events(df: DataFrame, event_type: str, occurred_at: Column, event_id: Column | None = None,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one event type in contract order.

    Fields of the contract are taken from equally named columns, else from the contract's defaults. Without
    ``event_id`` each row gets a random one. An event without a ``causation_id`` column is a root: it gets a
    causation id of its own. Columns in ``carry`` follow the contract's as they are.
    """
    identified = df.withColumn("event_id", event_id if event_id is not None else F.uuid())
    if "causation_id" not in df.columns:
        identified = identified.withColumn("causation_id", stable_uuid(F.lit("root"), F.col("event_id")))
    fields = event_fields({name: F.col(name) for name in identified.columns}, event_type, occurred_at)
    return identified.select([value.alias(name) for name, value in fields.items()] + list(carry))


def event_log(df: DataFrame, *kinds: tuple[str, dict[str, Column], Column | None]) -> DataFrame:
    """One wide log of several event types made from the same rows in one pass.

    Each kind is (event type, its columns as :func:`event_fields` gives them, condition for a row to have it). A field
    that a type lacks is null.
    """
    wide = {field.name: field.dataType for event_type, _, _ in kinds for field in event_schema(event_type)}

    def event(fields: dict[str, Column], has: Column | None) -> Column:
        row = F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in wide.items()])
        return row if has is None else F.when(has, row)

    return df.select(F.inline(F.array_compact(F.array(*[event(fields, has) for _, fields, has in kinds]))))


def union_events(*frames: DataFrame) -> DataFrame:
    """One wide event log; a field that a type lacks is null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def parse_events(raw: DataFrame, schema: T.StructType = STREAM_FIELDS, value: str = "value") -> DataFrame:
    """``value`` (JSON text or bytes) flattened to the fields of ``schema``; other fields are ignored.

    The text stays beside them as ``raw_value`` for :func:`split_malformed`. Inlining parses each text once,
    where field-by-field access would parse it per field and per filter.
    """
    text = F.col(value).cast("string")
    return raw.select(text.alias("raw_value"), F.inline(F.array(F.from_json(text, schema))))


def split_malformed(parsed: DataFrame, required: tuple[str, ...] = ("event_id", "event_type", "occurred_at")
                    ) -> tuple[DataFrame, DataFrame]:
    """(events, texts that are no event: bad JSON, bad time, missing id)."""
    complete = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in required])
    return parsed.filter(complete).drop("raw_value"), parsed.filter(~complete).select("raw_value")


def window_counts(events: DataFrame, width: str = "1 minute", time: str = "occurred_at") -> DataFrame:
    """Events per tumbling window and type; works alike on tables and watermarked streams."""
    counted = events.filter(F.col(time).isNotNull()).groupBy(F.window(time, width), "event_type").count()
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "count"
    )


def distinct_per_window(events: DataFrame, width: str, time: str, *columns: str) -> DataFrame:
    """Exact and approximate distinct values per tumbling window (an extension of the window counts)."""
    measures = [F.count_distinct(name).alias(f"distinct_{name}") for name in columns]
    measures += [F.approx_count_distinct(name).alias(f"approx_{name}") for name in columns]
    counted = events.groupBy(F.window(time, width)).agg(*measures)
    return counted.select(F.col("window.start").alias("window_start"), *counted.columns[1:])


def dedup_events(events: DataFrame, time: str = "occurred_at") -> DataFrame:
    """One row per event id, the earliest (ties by content, so replays agree). Copies meet pre-aggregated."""
    rest = [name for name in events.columns if name != "event_id"]
    order = F.struct(F.col(time), F.xxhash64(*rest))
    kept = events.groupBy("event_id").agg(F.min_by(F.struct(*rest), order).alias("kept"))
    return kept.select("event_id", "kept.*").select(events.columns)


_PARENT = ("event_id", "event_type", "occurred_at", "correlation_id")


def _child() -> Column:
    return F.struct(F.col("event_id").alias("child_id"), F.col("event_type").alias("child_type"), F.col("occurred_at").alias("child_at"))


def _paired(tagged: DataFrame, salts: int) -> DataFrame:
    """``tagged(cause, parent, child)``: rows of parents (``child`` null) and of children (``parent`` null)."""
    salt = F.when(F.col("parent").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("child"), F.lit(salts)).cast("int")))
    together = Window.partitionBy("cause", "salt")
    met = tagged.withColumn("salt", F.explode(salt)).select(
        "cause", "parent", "child", F.max("parent").over(together).alias("of"), F.count("child").over(together).alias("children"))
    # A copy of the parent that met no child is one of `salts` votes for having none.
    alone = met.filter("parent IS NOT NULL AND children = 0").groupBy("cause").agg(F.count("*").alias("votes"), F.max("parent").alias("of"))
    none = F.lit(None).cast(tagged.schema["child"].dataType)
    pairs = met.filter("child IS NOT NULL AND of IS NOT NULL").select("of", "child").unionByName(
        alone.filter(F.col("votes") == salts).select("of", none.alias("child")))
    return pairs.select("of.*", "child.*")


def causal_pairs(parents: DataFrame, children: DataFrame, salts: int = 4) -> DataFrame:
    """Every child beside the event that caused it, and every parent without a child once with nulls.

    Parents have ids of their own. Both sides meet in one shuffle by (cause, salt): the children of one parent are
    dealt over ``salts`` groups, each with a copy of the parent's row.
    """
    parent = parents.select(F.col("event_id").alias("cause"), F.struct(*_PARENT).alias("parent"))
    child = children.filter("causation_id IS NOT NULL").select(F.col("causation_id").alias("cause"), _child().alias("child"))
    return _paired(parent.unionByName(child, allowMissingColumns=True), salts)


def causal_pairs_in(log: DataFrame, is_parent: Column, is_child: Column, salts: int = 4) -> DataFrame:
    """:func:`causal_pairs` within one log, read once: an event may be a parent, a child or both."""
    roles = F.array_compact(F.array(
        F.when(is_parent, F.struct(F.col("event_id").alias("cause"), F.struct(*_PARENT).alias("parent"), F.lit(False).alias("caused"))),
        F.when(is_child & F.col("causation_id").isNotNull(), F.struct(
            F.col("causation_id").alias("cause"), F.struct(*_PARENT).alias("parent"), F.lit(True).alias("caused")))))
    rows = log.select(F.explode(roles).alias("role")).select("role.*")
    child = F.struct(F.col("parent.event_id").alias("child_id"), F.col("parent.event_type").alias("child_type"), F.col("parent.occurred_at").alias("child_at"))
    return _paired(rows.select("cause", F.when(~F.col("caused"), F.col("parent")).alias("parent"), F.when(F.col("caused"), child).alias("child")), salts)


def trace_report(events: DataFrame, time: str = "occurred_at") -> DataFrame:
    """One row per correlation id: events, types, begin, end, first and last type. All of it merges per task."""
    order = F.struct(F.col(time), F.col("event_id"))
    return events.groupBy("correlation_id").agg(
        F.count("*").alias("events"), F.count_distinct("event_type").alias("event_types"),
        F.min(time).alias("started_at"), F.max(time).alias("ended_at"),
        F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"),
    )


def trace_steps(events: DataFrame, time: str = "occurred_at", bucket: str = "hour") -> DataFrame:
    """Every event with its 1-based ``step`` within its correlation id, in time order."""
    keyed = events.withColumn("_bucket", F.date_trunc(bucket, time)).withColumn("_one", F.lit(1))
    return running_sum(keyed, ["correlation_id"], "_bucket", [time, "event_id"], "_one", "step").drop("_bucket", "_one")


def missing_events(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Publish reconciliation: expected events whose id was never observed."""
    return expected.join(observed.select("event_id").distinct(), "event_id", "left_anti")


def matching_topics(events: DataFrame, pattern: str = r"^payments\..*") -> DataFrame:
    """Rows whose topic matches; topic, key, value and headers pass unchanged."""
    return events.filter(F.col("topic").rlike(pattern))
