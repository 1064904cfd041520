"""Streams on state variables and timers, across restarts and failing sinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import NOON, feed, message, run
from tracewell.operators import lifecycle
from tracewell.plans import requests
from tracewell.sources import sinks, tables
from tracewell.streaming import events, pipelines, processors

MOVES = "correlation_id string, seq long, state_from string, state_to string, occurred_at timestamp"
ROWS = "currency string, amount long, at timestamp"


def move(request, seq, minute, state_from, state_to):
    return (request, seq, state_from, state_to, NOON + timedelta(minutes=minute))


def test_lifecycle_watch(spark, tmp_path):
    """Stuck, illegal, late and expired keys; a key of many rows in one batch, in any order."""
    busy = [move("busy", i, i / 60, ("INITIALIZED", "PROCESSING")[i > 0], "PROCESSING") for i in range(300)]
    stream = feed(spark, str(tmp_path / "in"), [
        [move("good", 2, 0.1, "PROCESSING", "COMPLETED"), move("good", 1, 0, "INITIALIZED", "PROCESSING"), move("bad", 1, 0, "PROCESSING", "COMPLETED"),
         move("stuck", 1, 0, "INITIALIZED", "PROCESSING"), *busy[::-1], move("null", None, 0, None, "COMPLETED")],
        [move("slow", 1, 60, "INITIALIZED", "PROCESSING"), move("clock", 1, 60, "INITIALIZED", "PROCESSING"), move("clock", 2, 61, "PROCESSING", "COMPENSATED")],
        [move("late", 1, 1, "PROCESSING", "COMPLETED"), move("slow", 2, 65, "PROCESSING", "COMPLETED"), move("stuck", 2, 62, "PROCESSING", "COMPLETED")],
        [move("end", 1, 200, "INITIALIZED", "PROCESSING"), move("end", 2, 200, "PROCESSING", "COMPLETED")],
    ], MOVES)
    run(processors.lifecycle_watch(stream), str(tmp_path), output=str(tmp_path / "out"))
    found = sorted((r.correlation_id, r.problem, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.correlation_id != "busy")
    # A key that expired starts anew: its later move has no state to come from.
    assert found == [("bad", "illegal", "COMPLETED"), ("null", "illegal", "COMPLETED"), ("stuck", "illegal", "COMPLETED"), ("stuck", "stuck", "PROCESSING")]
    busy_found = [(r.problem, r.state) for r in spark.read.parquet(str(tmp_path / "out")).filter("correlation_id = 'busy'").collect()]
    assert busy_found.count(("illegal", "PROCESSING")) == 299 and busy_found.count(("stuck", "PROCESSING")) == 1


def amounts(minute_from, minute_to):
    return [(("EUR", "USD", None)[m % 3], 10 + (m * 7919) % 23 + (500 if m == 72 else 0), NOON + timedelta(minutes=m)) for m in range(minute_from, minute_to)]


def expected(spark, rows, until):
    batch = processors.batch_scores(spark.createDataFrame(rows, ROWS), "at", "currency", "amount")
    closed = batch.filter(F.col("window_start") + F.expr("interval 5 minutes") <= F.lit(until))
    return sorted((r.currency, r.window_start, r.n, r.total, r.z and round(r.z, 9), r.anomaly) for r in closed.collect())


def scores(spark, path):
    return sorted((r.currency, r.window_start, r.n, r.total, r.z and round(r.z, 9), r.anomaly) for r in spark.read.parquet(path).collect())


def test_anomalies_chained_with_two_sinks(spark, tmp_path):
    """A restart in the middle, and a second sink that fails once: both sinks equal the batch."""
    path, first, second = (str(tmp_path / name) for name in ("in", "first", "second"))
    rows = amounts(0, 120)
    stream = feed(spark, path, [rows[:40], rows[40:60]], ROWS)
    flow = lambda: processors.anomaly_stream(stream, "at", "currency", "amount")
    write = sinks.dual_write(sinks.batch_folder(first), sinks.batch_folder(second), sinks.empty_batch_folder(first))
    run(flow(), str(tmp_path), write)
    assert scores(spark, first) == scores(spark, second) == expected(spark, rows, NOON + timedelta(minutes=49))

    for number, part in enumerate((rows[60:90], rows[90:120]), 2):
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(f"{path}/{number:03d}")
    broken = sinks.dual_write(sinks.batch_folder(first), lambda df, batch: (_ for _ in ()).throw(OSError("second sink")), sinks.empty_batch_folder(first))
    with pytest.raises(Exception, match="second sink"):
        run(flow(), str(tmp_path), broken)
    assert scores(spark, first) == scores(spark, second)
    run(flow(), str(tmp_path), write)
    wanted = expected(spark, rows, NOON + timedelta(minutes=109))
    assert scores(spark, first) == scores(spark, second) == wanted and any(row[-1] for row in wanted)


def test_every_message_is_in_one_output(spark, tmp_path):
    """Counts, late, malformed and copies add up to the messages, before and after a restart and a replayed batch."""
    at = lambda minutes: NOON + timedelta(minutes=minutes)
    one = [message(i, at(i / 10)) for i in range(60)] + [message(i, at(i / 10)) for i in range(5)] + [("{broken",), ("",)]
    two = [message(100 + i, at(20 + i)) for i in range(10)] + [message(3, at(0.3)), message(59, at(5.9))]
    path, intake = str(tmp_path / "in"), events.EventIntake(str(tmp_path / "out"))
    stream = feed(spark, path, [one, two], "value string")
    run(stream, str(tmp_path), intake)

    def total():
        size = lambda name: intake.read(spark, name).count()
        counted, copied = (intake.read(spark, name).agg(F.coalesce(F.sum(column), F.lit(0))).first()[0] for name, column in (("counts", "count"), ("copies", "copies")))
        return counted, size("late"), size("malformed"), copied

    assert total() == (70, 0, 2, 7) and sum(total()) == len(one) + len(two)
    three = [message(200, at(1)), message(201, at(60)), message(201, at(60)), message(105, at(25)), ("nothing",), message(202, at(19))]
    spark.createDataFrame(three, "value string").coalesce(1).write.parquet(f"{path}/002")
    run(stream, str(tmp_path), intake)
    assert total() == (72, 1, 3, 9) and sum(total()) == len(one) + len(two) + len(three)
    intake(spark.createDataFrame(three, "value string"), 2)
    assert total() == (72, 1, 3, 9)
    closed = intake.counts(spark)
    assert closed.agg(F.max("window_end")).first()[0] <= at(50) and closed.agg(F.sum("count")).first()[0] == 71


def test_failing_payments_equal_batch(spark, data, key, tmp_path):
    """A stream of payments and one of failures against the same rows as tables."""
    rows = tables.payments(spark, data).withColumn("traceparent", F.lit("")).withColumn("amount_minor", F.when(F.col("o_orderkey") % 50 == 3, -1).otherwise(F.col("amount_minor")))
    rows = rows.withColumn("paid_at", F.lit(NOON) + F.make_dt_interval(secs=F.col("o_orderkey") % 100))
    last = rows.limit(1).withColumn("request_id", F.lit("end")).withColumn("paid_at", F.lit(NOON + timedelta(hours=3)))
    failed = rows.filter(F.col("o_orderkey") % 7 == 0).select("request_id", F.lit("CallTimedOut").alias("error"), (F.col("paid_at") + F.expr("interval 5 seconds")).alias("failed_at"))
    old = rows.filter(F.col("o_orderkey") % 7 == 1).select("request_id", F.lit("TooLate").alias("error"), (F.col("paid_at") + F.expr("interval 5 minutes")).alias("failed_at"))
    end = spark.createDataFrame([("other", "x", NOON + timedelta(hours=3))], failed.schema)
    for number, (payment, failure) in enumerate([(rows, failed.unionByName(old)), (last, end), (last, end)]):
        payment.coalesce(2).write.parquet(f"{tmp_path}/p/{number}")
        failure.coalesce(1).write.parquet(f"{tmp_path}/f/{number}")
    stream = pipelines.with_failures(
        events.read_file_stream(spark, f"{tmp_path}/p/*", rows.schema, files_per_trigger=2), events.read_file_stream(spark, f"{tmp_path}/f/*", failed.schema, files_per_trigger=1))
    names = ("ingested", "scored", "compensated", "transitions", "undone", "rejected")
    run(stream, str(tmp_path), pipelines.payment_batches(key, {name: sinks.batch_folder(f"{tmp_path}/out/{name}") for name in names}))

    joined = rows.join(failed.select("request_id", F.col("error").alias("scorer_error")), "request_id", "left")
    batch = requests.process_payments(joined, key, F.col("paid_at"), error=F.col("scorer_error"), carry=("scorer_error", "paid_at"))
    wanted = {
        "ingested": batch.ingested, "scored": batch.scored, "compensated": batch.compensated, "rejected": batch.rejected,
        "transitions": lifecycle.lifecycle_transitions(batch.outcomes), "undone": lifecycle.lifecycle_compensations(batch.outcomes),
    }
    for name in names:
        found = spark.read.parquet(f"{tmp_path}/out/{name}").select(wanted[name].columns)
        owner = "request_id" if "request_id" in found.columns else "correlation_id"
        text = lambda frame: sorted(str(row) for row in frame.collect() if row[owner] not in ("end",))
        own, other = text(wanted[name]), [row for row in text(found)]
        extra = [row for row in other if row not in set(own)]
        assert sorted(set(own)) == sorted(set(other) - set(extra)) and len(extra) <= 2, name
    assert spark.read.parquet(f"{tmp_path}/out/compensated").count() == failed.join(batch.outcomes.filter("outcome = 'scorer_failed'"), "request_id").count() > 0
