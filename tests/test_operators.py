import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import plain
from tracewell import schemas
from tracewell.functions import boundary
from tracewell.operators import admission, answers, audit, events, lifecycle, metrics, ordered, payments, validation
from tracewell.sources import corpus, sinks

NOON = datetime(2024, 1, 1, 12)


def payment_rows(spark, rows):
    frame = spark.createDataFrame(rows, "transaction_id string, merchant_id string, amount_minor string, currency string, payment_network string")
    return frame.withColumn("correlation_id", F.concat(F.lit("c-"), F.monotonically_increasing_id())).withColumn("traceparent", F.lit(""))


def scored(spark, rows, key, **options):
    accepted, _ = payments.split_payments(payment_rows(spark, rows))
    ingested = payments.ingested_events(payments.tokenize_payments(accepted, key), F.lit(NOON))
    return payments.score_payments(ingested, **options)


def test_payment_rules(spark, key):
    rows = [("tx-1", "m-1", "850000", "usd", "card"), ("tx-3", "m", "-1", "USD", None), ("tx", "m", "0", "USD", None),
            ("tx", "", "1", "USD", None), ("tx", "m", "-0.9", "USD", None), ("tx", "m", "x", "USD", None), ("tx", "m", "1", "U5D", None)]
    frame = payment_rows(spark, rows)
    found = [r.error for r in frame.select(validation.payment_error(frame).alias("error")).collect()]
    text = validation.PAYMENT_ERRORS
    assert found == [None, text["negative"], None, text["missing"], None, text["amount"], text["currency"]]
    raw = spark.createDataFrame([('{"pan":"1","amount_minor":1}',), ('{"x":1}',), ("{}",)], "raw string")
    assert [r[0] for r in raw.select(validation.has_prohibited_fields(F.col("raw"))).collect()] == [True, False, False]
    event = scored(spark, rows[:1], key).first()
    assert (event.currency, event.pii_tokenized, event.topic) == ("USD", True, "payments.transaction.ingested.v2")
    assert event.transaction_token == plain.token("payment_transaction", "tx-1", key)
    assert "tx-1" not in json.dumps(event.asDict(), default=str)


def test_scores(spark, key):
    rows = [("t", "m", "900000", "EUR", None), ("t", "m", "699950", "USD", None), ("t", "m", "7000", "JPY", None),
            ("t", "m", "99999999999", "BHD", None), ("t", "m", "1", "USD", None)]
    assert [(r.risk_score, r.decision) for r in scored(spark, rows, key).collect()] == [
        (0.9, "review"), (0.7, "review"), (0.7, "review"), (1.0, "review"), (0.0, "allow")]
    binary = scored(spark, rows, key, binary_rounding=True).collect()
    assert [r.risk_score for r in binary] == [0.9, round(699950 / 100 / 10000, 4), 0.7, 1.0, 0.0]
    assert binary[1].decision == "allow"


def test_fail_closed_and_detector(spark, key):
    rows = [("tx-5", "m-5", "10", "USD", None), ("tx-6", "m-6", "20", "USD", None)]
    failed = scored(spark, rows, key, error=F.when(F.col("amount_minor") == 10, F.lit("CallTimedOut")))
    assert [(r.risk_score, r.decision, r.failure_reason) for r in failed.collect()] == [
        (0.0, "review", payments.FAILED_CLOSED), (0.0, "allow", "")]
    compensation = payments.compensated_events(failed, F.lit(NOON)).collect()
    assert len(compensation) == 1 and compensation[0].causation_id == failed.first().event_id
    assert compensation[0].error_detail == "CallTimedOut" and compensation[0].topic == "payments.compensated.v2"

    def offline(rows: pd.DataFrame) -> pd.Series:
        if (rows["amount_minor"] == 10).any():
            raise RuntimeError("offline")
        return rows["amount_minor"] > 1000

    flagged = scored(spark, rows, key, anomaly=payments.detected(offline, "amount_minor")).collect()
    assert [(r.risk_score, r.decision) for r in flagged] == [(0.7, "review"), (0.0, "allow")]


def test_contracts(spark, key):
    ingested = payments.ingested_events(
        payments.tokenize_payments(payment_rows(spark, [("t", "m", "1", "USD", None)]), key), F.lit(NOON))
    names = "event_id occurred_at correlation_id causation_id traceparent transaction_token merchant_token amount_minor " \
            "currency payment_network pii_tokenized event_type topic".split()
    kinds = {"amount_minor": "long", "pii_tokenized": "boolean"}
    contract = json.dumps({"type": "record", "name": "x", "fields": [{"name": n, "type": kinds.get(n, "string")} for n in names]})
    assert schemas.contract_differences(ingested.schema, contract) == []
    assert schemas.contract_differences(ingested.drop("topic").schema, contract) == ["missing != topic:string"]
    assert len(schemas.EVENT_TOPICS) == 9 and not set(schemas.BASE_TOPICS) & set(schemas.EVENT_TOPICS.values())
    row = events.make_events(spark.range(1), "PaymentRiskScored", F.lit(NOON)).first()
    assert (row.decision, row.risk_score, row.occurred_at) == ("review", 0.0, "2024-01-01T12:00:00+00:00")
    assert len({r.event_id for r in events.make_events(spark.range(9), "AuditRecordLogged", F.lit(NOON)).collect()}) == 9


def test_boundary(spark, key):
    token = plain.token("source", "raw", key)
    rows = spark.createDataFrame(
        [("a@b.co", "r-4111111111111111", "raw", token, {"chunk": "x", "note": "a@b.co"}, [("mail a@b.co",)], 5),
         ("", "r", "", token, {}, [], 6), (None, None, None, None, None, None, None)],
        "note string, request_id string, source string, Source_Token string, bag map<string,string>, items array<struct<answer:string>>, n int")
    safe = boundary.sanitize(rows, key).collect()
    first = safe[0]
    assert first.note == plain.token("email", "a@b.co", key) and first.request_id == "r-4111111111111111"
    assert first.source == token == first.Source_Token and first.n == 5
    assert first.bag == {"chunk": plain.token("chunk", "x", key), "note": plain.token("email", "a@b.co", key)}
    assert first["items"][0].answer == plain.token("answer", "mail a@b.co", key)
    assert safe[1].note == "" and safe[1].source == "" and safe[2].note is None and safe[2].bag is None
    good, bad = boundary.split_unsafe(rows, key)
    assert (good.count(), bad.count()) == (2, 1)
    assert boundary.split_unsafe(boundary.sanitize(rows, key), key)[1].count() == 0
    telemetry = events.make_events(spark.createDataFrame([("raw-source",)], "source_token string"), "TelemetryIngested", F.lit(NOON))
    with pytest.raises(Exception, match="unsanitized"):
        sinks.to_messages(telemetry, key).collect()


def test_messages(spark, key, tmp_path):
    event = events.make_events(
        spark.createDataFrame([(token := plain.token("payment_transaction", "t", key), "c-1", "00-x")],
                              "transaction_token string, correlation_id string, traceparent string"),
        "PaymentRiskScored", F.lit(NOON), F.lit("e-1"))
    extra = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(F.lit("v"), "UTF-8").alias("value")) for k in ("tenant", "correlation_id")])
    sinks.write_messages(sinks.to_messages(event, key, F.lit("00-active"), extra), path=str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert bytes(row.key).decode() == token and row.topic == "payments.risk.scored.v2"
    names = [h.key for h in row.headers]
    assert names == ["correlation_id", "causation_id", "event_id", "event_type", "traceparent", "tenant"]
    assert bytes(row.headers[0].value) == b"c-1" and bytes(row.headers[4].value) == b"00-active"
    body = json.loads(bytes(row.value))
    assert list(body) == sorted(body) and body["event_id"] == "e-1" and body["decision"] == "review"


def test_audit_sink(spark, key, tmp_path):
    rows = spark.createDataFrame([("r-1", "a@b.co", "forged"), ("r-2", "plain", None)], "request_id string, note string, timestamp string")
    records = audit.request_records(rows, F.lit(NOON))
    objects = audit.audit_objects(records, "requests", "request_id", key)
    path = str(tmp_path / "audit")
    sinks.write_audit(objects, path)
    sinks.write_audit(objects, path)
    stored = sinks.read_audit(spark, path).orderBy("object_key").collect()
    assert len(stored) == 2 and "a@b.co" not in stored[0].body
    assert json.loads(stored[0].body)["timestamp"] == "2024-01-01T12:00:00+00:00"
    assert json.loads(stored[0].body)["correlation_id"] == "r-1"
    assert stored[0].object_key.startswith("requests/requests/2024/01/01/120000.000000Z-r-1-")
    assert stored[0].retain_until == NOON + timedelta(days=2555)
    with pytest.raises(Exception, match="duplicate audit key"):
        sinks.write_audit(objects.union(objects), str(tmp_path / "again"))


def test_lifecycle(spark):
    outcomes = spark.createDataFrame(
        [("ingest", "index_failed", "r1", "c1"), ("ingest", "audit_and_rollback_failed", "r2", "c2"), ("payment", "ok", "r3", "c3")],
        "flow string, outcome string, request_id string, correlation_id string").withColumn("decision", F.lit("allow"))
    moves = lifecycle.lifecycle_transitions(outcomes)
    first = moves.filter("request_id = 'r1'").orderBy("seq").collect()
    assert [(m.state_from, m.state_to) for m in first] == [("INITIALIZED", "PROCESSING"), ("PROCESSING", "COMPENSATED")]
    assert moves.filter("request_id = 'r3' AND seq = 2").first().reason == "Decision: allow"
    found = sorted((c.request_id, c.boundary, c.reason) for c in lifecycle.lifecycle_compensations(outcomes).collect())
    assert found == [("r1", "retrieval_store", "STORE_ADD_FAILED"), ("r2", "audit_sink", "AUDIT_WRITE_FAILED"),
                     ("r2", "retrieval_store", "ROLLBACK_FAILED")]
    logged = lifecycle.transition_events(moves, F.lit(NOON))
    assert logged.columns == [f.name for f in schemas.event_schema("StateTransitionLogged")] and logged.count() == 6


def test_ordered_helpers_on_a_hot_key(spark):
    """One key holds most rows; every bucket of it is its own piece."""
    rng = random.Random(1)
    rows = [("hot" if i % 4 else f"k{i % 9}", i, rng.choice([None, i, -i])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, t long, v long").withColumn("bucket", F.floor(F.col("t") / 100))
    frame = frame.withColumn("one", F.lit(1)).repartition(8)
    steps = {(r.k, r.t): r.s for r in ordered.running_sum(frame, ["k"], "bucket", ["t"], "one", "s").collect()}
    before = {(r.k, r.t): r.p for r in ordered.previous_value(frame, ["k"], "bucket", ["t"], F.col("v"), "p").collect()}
    latest = {(r.k, r.t): r.l for r in ordered.running_last(frame, ["k"], "bucket", ["t"], "v", "l").collect()}
    assert len(steps) == len(before) == len(latest) == 3000
    seen = {}
    for k, t, v in rows:
        count, previous, last = seen.get(k, (0, None, None))
        last = last if v is None else v
        assert (steps[k, t], before[k, t], latest[k, t]) == (count + 1, previous, last)
        seen[k] = (count + 1, v, last)


@pytest.mark.parametrize("rate,capacity", [(1.0, None), (2.0, None), (0.1, 3.0)])
def test_token_bucket(spark, rate, capacity):
    rng = random.Random(11)
    calls, at = [], 0.0
    for i in range(1500):
        at += rng.choice([0.0, 0.05, 0.3, 0.5, 1.0, 4.0, 40.0])
        calls.append(("hot" if i % 3 else f"k{i % 5}", i, NOON + timedelta(milliseconds=round(at * 1000))))
    frame = spark.createDataFrame(calls, "key string, id long, at timestamp").repartition(8)
    found = {r.id: r.admitted for r in admission.token_bucket(frame, "key", "at", ("id",), rate, capacity).collect()}
    buckets = {}
    full = capacity or rate
    for key, i, when in calls:
        tokens, last = buckets.get(key, (full, when))
        tokens = min(full, tokens + (when - last).total_seconds() * rate)
        # Decisions within rounding of a whole token are left to either side.
        if abs(tokens - 1) > 1e-9:
            assert found[i] == (tokens >= 1), (key, i)
        buckets[key] = (tokens - found[i], when)
    assert len(found) == 1500 and not all(found.values())


def test_causal_pairs_with_one_hot_parent(spark):
    parents = spark.createDataFrame([("p1", "A", "t", "c"), ("p2", "A", "t", "c")], "event_id string, event_type string, occurred_at string, correlation_id string")
    children = spark.range(500).select(F.concat(F.lit("x"), "id").alias("event_id"), F.lit("B").alias("event_type"),
                                       F.lit("t").alias("occurred_at"), F.lit("p1").alias("causation_id"))
    pairs = events.causal_pairs(parents, children)
    assert pairs.filter("event_id = 'p1'").count() == 500
    assert [r.child_id for r in pairs.filter("event_id = 'p2'").collect()] == [None]


def test_histogram(spark):
    rows = spark.createDataFrame([(s,) for s in (0.01, 30.0, 60.0, 120.0, 121.0)], "seconds double").withColumn("route", F.lit("/ask"))
    found = metrics.exposition_order(metrics.histogram(rows, "m", "seconds", "route")).collect()
    assert [r.le for r in found][:3] == ["0.005", "0.01", "0.025"] and found[-1].le == "+Inf"
    counts = {r.le: r.bucket_count for r in found}
    assert (counts["30"], counts["60"], counts["120"], counts["+Inf"]) == (2, 3, 4, 5)
    assert abs(found[0].sum - 331.01) < 1e-9
    log = spark.range(1000).select(F.lit(None).cast("string").alias("route"), F.concat(F.lit("M"), "id").alias("method"), F.lit(404).alias("status"))
    series = metrics.counters(metrics.bounded_labels(log), "rag_http_requests_total", "route", "method", "status_class").collect()
    assert [(r.labels, r.value) for r in series] == [({"method": "OTHER", "route": "unmatched", "status_class": "4xx"}, 1000.0)]


def test_answers(spark, key):
    questions = spark.createDataFrame([(1, "q one"), (2, "q a@b.co"), (3, "q bad")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 0, "text", "memory", 2), (3, 0, "t", "memory", 1), (3, 1, "u", "memory", 1)],
                                 "query_id long, index int, text string, backend string, score long")

    def model():
        def invoke(prompt):
            if "bad" in prompt:
                raise TimeoutError
            return "answer from " + prompt.split("Evidence: ")[1]
        return invoke

    answered = answers.generate(answers.with_evidence(questions, hits), model)
    answered = answered.withColumn("answer", answers.answer_text(F.col("retrieved_count"), F.col("answer"), F.col("llm_error"), True))
    rows = {r.query_id: r for r in answered.collect()}
    assert rows[1].answer.startswith('answer from [{"index":0,"text":"text"')
    assert rows[2].answer == answers.NO_EVIDENCE and rows[2].llm_error is None
    assert rows[3].answer == answers.UNAVAILABLE and rows[3].llm_error == "TimeoutError"
    tokens = answers.audit_tokens(answered, key).filter("query_id = 2").first()
    assert tokens.question_token == plain.token("query", "q " + plain.token("email", "a@b.co", key), key)
    done = answered.withColumn("request_id", F.lit("r")).withColumn("correlation_id", F.lit("c")).withColumn("retrieval_error", F.lit(None).cast("string"))
    processed = answers.outcome_events(done, F.lit(NOON))
    compensated = answers.compensation_boundaries(answers.answer_compensations(processed, F.lit(NOON))).collect()
    assert [(c.error_detail, c.boundary) for c in compensated] == [("llm_inference:TimeoutError", "llm_inference")]


def test_synthetic_corpus(spark):
    def rows(seed):
        return [sorted(map(tuple, frame.collect())) for frame in corpus.synthetic_corpus(spark, seed, 2)]

    documents, questions, paid = rows(44)
    assert rows(44) == [documents, questions, paid] and rows(45)[0] != documents
    assert sorted(len(text.encode()) for _, text in documents) == sorted([1024, 10240, 102400] * 2)
    assert len(questions) == len(paid) == 6 and all(1 <= p[2] <= 100_000 and p[3] == "USD" for p in paid)
    marker = documents[0][0].split("-")[-1]
    assert len(marker) == 16 and any(marker in q for q, _ in questions) and marker in documents[0][1]
    with pytest.raises(ValueError):
        corpus.synthetic_corpus(spark, 1, 0)
