import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import text
from tracewell.operators import events as event_operators
from tracewell.operators import lifecycle
from tracewell.sources import sinks, tables
from tracewell.streaming import events, pipelines, state

NOON = datetime(2024, 1, 1, 12)


def feed(spark, path, batches, schema):
    """One file per batch; the stream below reads them one by one in order."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{number:03d}")
    return events.read_file_stream(
        spark, f"{path}/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)


def run(frame, path, sink=None, output=None):
    writer = frame.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", output).start()
    assert query.awaitTermination(240)
    if query.exception():
        raise query.exception()


def message(i, at, kind="view"):
    return (json.dumps({"event_id": f"e{i}", "event_type": kind, "occurred_at": at.isoformat() + "+00:00", "request_id": "r"}),)


def test_counts_equal_batch_on_closed_windows(spark, data, tmp_path):
    log = tables.event_log(spark, data)
    body = F.to_json(F.struct("event_id", "event_type", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("occurred_at")))
    log.select(body.alias("value"), "occurred_at").repartitionByRange(4, "occurred_at").select("value").write.parquet(str(tmp_path / "in"))
    stream = events.read_file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = str(tmp_path / "out")
    query = sinks.write_windows(events.event_counts(stream), out, str(tmp_path / "cp"), every=None)
    assert query.awaitTermination(240)
    latest = log.agg(F.max("occurred_at")).first()[0]
    closed = F.col("window_end") <= F.lit(latest - timedelta(minutes=10))
    batch = event_operators.window_counts(log).filter(closed)
    found = spark.read.parquet(out)
    assert sorted(map(tuple, found.filter(closed).collect())) == sorted(map(tuple, batch.collect()))
    assert found.filter(~closed).count() == 0


def test_restart_duplicates_and_late_rows(spark, tmp_path):
    early = [message(i, NOON + timedelta(seconds=i)) for i in range(30)]
    later = [message(99, NOON + timedelta(minutes=30))]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    counts = lambda stream: events.event_counts(stream)
    stream = feed(spark, path, [early + early[:5], later], "value string")
    run(counts(stream), str(tmp_path), output=out)
    assert [r["count"] for r in spark.read.parquet(out).collect()] == [30]
    late = [message(200, NOON + timedelta(seconds=5)), ("{broken",)]
    spark.createDataFrame(late + [message(201, NOON + timedelta(minutes=50))], "value string").coalesce(1).write.parquet(f"{path}/002")
    run(counts(stream), str(tmp_path), output=out)
    assert sorted(r["count"] for r in spark.read.parquet(out).collect()) == [1, 30]


def test_side_output(spark, tmp_path):
    rows = lambda *minutes: [(f"e{m}", None if m is None else NOON + timedelta(minutes=m)) for m in minutes]
    stream = feed(spark, str(tmp_path / "in"), [rows(0, 30), rows(15, 25, None), rows(100), rows(80, 95)], "event_id string, occurred_at timestamp")
    accepted, refused = str(tmp_path / "ok"), str(tmp_path / "late")
    run(stream, str(tmp_path), events.side_output(sinks.batch_folder(accepted), refused, str(tmp_path / "horizon")))
    assert sorted(r.event_id for r in spark.read.parquet(accepted).collect()) == sorted(["e0", "e30", "e25", "e100", "e95"])
    assert sorted(r.event_id for r in spark.read.parquet(refused).collect()) == sorted(["e15", "eNone", "e80"])


def test_lifecycle_alerts(spark, tmp_path):
    def move(request, seq, minute, state_from, state_to):
        return (request, seq, state_from, state_to, NOON + timedelta(minutes=minute))

    schema = "correlation_id string, seq long, state_from string, state_to string, occurred_at timestamp"
    stream = feed(spark, str(tmp_path / "in"), [
        [move("good", 1, 0, "INITIALIZED", "PROCESSING"), move("bad", 1, 0, "PROCESSING", "COMPLETED"), move("stuck", 1, 0, "INITIALIZED", "PROCESSING")],
        [move("good", 2, 1, "PROCESSING", "COMPLETED"), move("clock", 1, 60, "INITIALIZED", "PROCESSING"), move("clock", 2, 60, "PROCESSING", "COMPENSATED")],
        [move("clock2", 1, 120, "INITIALIZED", "PROCESSING"), move("clock2", 2, 120, "PROCESSING", "COMPLETED")],
    ], schema)
    run(state.lifecycle_alerts(stream), str(tmp_path), output=str(tmp_path / "out"))
    found = sorted((r.correlation_id, r.problem, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("bad", "illegal", "COMPLETED"), ("stuck", "stuck", "PROCESSING")]


def test_admissions(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), [
        [("a", "1", NOON), ("a", "2", NOON), ("b", "1", NOON)],
        [("a", "3", NOON + timedelta(milliseconds=500)), ("a", "4", NOON + timedelta(seconds=1.5))],
    ], "key string, call_id string, at timestamp")
    run(state.admissions(stream, rate=1.0), str(tmp_path), output=str(tmp_path / "out"))
    found = {(r.key, r.call_id): r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {("a", "1"): True, ("a", "2"): False, ("b", "1"): True, ("a", "3"): False, ("a", "4"): True}


def test_running_zscores(spark, tmp_path):
    totals = [("k", NOON + timedelta(minutes=5 * i), float(v)) for i, v in enumerate([1, 2, 3, 2, 1, 2, 30, 2, 2])]
    stream = feed(spark, str(tmp_path / "in"), [totals[:4], totals[4:]], "event_type string, window_start timestamp, total double")
    run(state.running_zscores(stream, "event_type"), str(tmp_path), output=str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    values = [t[2] for t in totals]
    for i, row in enumerate(found):
        deviation = np.std(values[:i], ddof=1) if i > 1 else 0
        assert row.z is None if not deviation else abs(row.z - (values[i] - np.mean(values[:i])) / deviation) < 1e-9
    assert [r.anomaly for r in found].index(True) == 6


def test_read_model(spark, tmp_path):
    moves = lambda *rows: [(c, s, t, NOON + timedelta(seconds=s)) for c, s, t in rows]
    stream = feed(spark, str(tmp_path / "in"), [
        moves(("a", 1, "PROCESSING"), ("b", 1, "PROCESSING")), moves(("a", 2, "COMPLETED")), moves(("b", 0, "INITIALIZED")),
    ], "correlation_id string, seq long, state_to string, occurred_at timestamp")
    model = str(tmp_path / "model")
    run(stream, str(tmp_path), state.project_states(model))
    replayed = spark.createDataFrame(moves(("a", 2, "COMPLETED")), "correlation_id string, seq long, state_to string, occurred_at timestamp")
    state.project_states(model)(replayed, 1)
    assert sorted((r.correlation_id, r.state_to) for r in state.read_states(spark, model).collect()) == [("a", "COMPLETED"), ("b", "PROCESSING")]


def test_ingest_stream_equals_batch(spark, data, key, tmp_path):
    rows = tables.documents(spark, data).select("request_id", "text", "source")
    rows = rows.withColumn("text", F.concat("text", F.lit(" mail a@b.co")))
    extra = spark.createDataFrame([("empty", "", None)], rows.schema)
    rows.unionByName(extra).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_file_stream(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    folder = lambda name: sinks.batch_folder(str(tmp_path / name))
    run(stream, str(tmp_path), pipelines.ingest_batches(key, folder("chunks"), folder("telemetry"), folder("rejected"), text.chunk_fixed))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunks.filter("text LIKE '%a@b.co%'").count() == 0
    telemetry = {r.request_id: (r.chunk_count, r.pii_counts) for r in spark.read.parquet(str(tmp_path / "telemetry")).collect()}
    assert len(telemetry) == rows.count() and all(counts["email"] >= 1 for _, counts in telemetry.values())
    counted = {r.request_id: r["count"] for r in chunks.groupBy("request_id").count().collect()}
    assert {request: count for request, (count, _) in telemetry.items()} == counted
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "rejected")).select("request_id", "failed").collect()] == [("empty", ["text_length"])]


def test_payment_stream(spark, data, key, tmp_path):
    rows = tables.payments(spark, data).withColumn("traceparent", F.lit("")).withColumn("amount_minor", F.col("amount_minor").cast("string"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = events.read_file_stream(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    ingested, scored, refused = pipelines.payment_streams(stream, key)
    run(scored, str(tmp_path), output=str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.columns == [f.name for f in schemas.event_schema("PaymentRiskScored")]
    assert found.count() == rows.count() and found.filter("decision = 'review'").count() > 0
    assert ingested.isStreaming
    run(refused.select("transaction_id", "error"), str(tmp_path / "refused"), output=str(tmp_path / "refused-out"))
    assert spark.read.parquet(str(tmp_path / "refused-out")).count() == 0


def test_decision_latency(spark, tmp_path):
    schema_in, schema_out = "event_id string, ingested_at timestamp", "causation_id string, decision string, scored_at timestamp"
    left = feed(spark, str(tmp_path / "l"), [[("p1", NOON), ("p2", NOON)], [("p3", NOON + timedelta(hours=2))], [("p4", NOON + timedelta(hours=4))]], schema_in)
    right = feed(spark, str(tmp_path / "r"), [[("p1", "allow", NOON + timedelta(seconds=3))], [("x", "allow", NOON + timedelta(hours=2))],
                                              [("x", "allow", NOON + timedelta(hours=4))]], schema_out)
    run(pipelines.decision_latency(left, right), str(tmp_path), output=str(tmp_path / "out"))
    found = {r.event_id: r.seconds for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found["p1"] == 3.0 and found["p2"] is None


def test_dual_write(spark, tmp_path):
    rows = spark.range(5)
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.dual_write(sinks.batch_folder(first), sinks.batch_folder(second), sinks.empty_batch_folder(first))(rows, 0)
    assert spark.read.parquet(first).count() == spark.read.parquet(second).count() == 5

    def broken(df, batch_id):
        raise OSError("second sink is down")

    with pytest.raises(OSError):
        sinks.dual_write(sinks.batch_folder(first), broken, sinks.empty_batch_folder(first))(rows, 1)
    assert spark.read.parquet(first).filter("batch = 1").count() == 0


def test_replication(spark, tmp_path):
    rows = spark.createDataFrame([("payments.x", "k", "v"), ("telemetry.ingested", "k", "v")], "topic string, key string, value string")
    sinks.replicate_topics(rows, lambda df: sinks.write_messages(df, path=str(tmp_path / "out")))
    assert [r.topic for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["payments.x"]


def test_batch_check_agrees_with_stream_rules(spark):
    rows = [("a", 1, "INITIALIZED", "PROCESSING"), ("a", 2, "PROCESSING", "COMPLETED"), ("b", 1, "PROCESSING", "COMPLETED")]
    frame = spark.createDataFrame(rows, "correlation_id string, seq long, state_from string, state_to string")
    checked = lifecycle.check_transitions(frame, F.floor(F.col("seq") / 2))
    assert sorted((r.correlation_id, r.seq, r.legal) for r in checked.collect()) == [("a", 1, True), ("a", 2, True), ("b", 1, False)]
