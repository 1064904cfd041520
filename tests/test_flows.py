import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import plain
from tracewell.operators import lifecycle, retrieval
from tracewell.plans import requests
from tracewell.sources import sinks

NOON = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [("r1", "Contact alice@example.com for the parcel.", "alice@example.com"), ("r2", "The parcel is violet.", None),
            ("r3", "", "s"), ("r4", "Nobody indexed this parcel.", "s")]
    return spark.createDataFrame(rows, "request_id string, text string, source string")


def test_ingest(spark, documents, key):
    outcome = F.when(F.col("request_id") == "r4", "audit_failed").otherwise("ok")
    done = requests.ingest_documents(documents, key, F.lit(NOON), outcome=outcome)
    chunks = {c.request_id: c for c in done.chunks.collect()}
    assert set(chunks) == {"r1", "r2"} and chunks["r1"].chunk_id.startswith("r1-0-")
    assert chunks["r1"].text == f"Contact {plain.token('email', 'alice@example.com', key)} for the parcel."
    assert chunks["r1"].source_token == plain.token("source", "alice@example.com", key)
    assert chunks["r2"].source_token == plain.token("source", "sample", key)
    telemetry = {t.request_id: t for t in done.telemetry.collect()}
    assert telemetry["r1"].pii_counts == {"email": 1} and telemetry["r2"].pii_counts == {}
    assert [r.request_id for r in done.rejected.collect()] == ["r3"]
    states = {m.request_id: m.state_to for m in done.transitions.filter("seq = 2").collect()}
    assert states == {"r1": "COMPLETED", "r2": "COMPLETED", "r4": "COMPENSATED"}
    assert [(c.request_id, c.reason) for c in done.compensations.collect()] == [("r4", "AUDIT_WRITE_FAILED")]
    bodies = [json.loads(a.body) for a in done.audit.collect()]
    assert {b["request_id"] for b in bodies} == {"r1", "r2"} and all(b["event"] == "ingest" for b in bodies)
    # What the flow publishes passes its own guard, and nothing carries the raw address.
    messages = sinks.to_messages(done.telemetry, key).collect()
    assert len(messages) == 3 and not any(b"alice" in bytes(m.value) for m in messages)
    assert "alice" not in json.dumps(bodies)


def test_unknown_outcome_fails(spark):
    rows = spark.createDataFrame([("ingest", "gone", "r")], "flow string, outcome string, request_id string")
    with pytest.raises(Exception, match="unknown outcome ingest/gone"):
        lifecycle.lifecycle_compensations(rows).collect()


@pytest.mark.parametrize("strategy", ["lexical", "bm25"])
def test_ask(spark, key, strategy):
    chunks = spark.createDataFrame([(0, 0, "alpha beta"), (1, 1, "beta gamma"), (2, 2, "delta")], "chunk_id long, insert_seq long, text string")
    questions = spark.createDataFrame([(1, "q1", "gamma beta?", 4), (2, "q2", "nothing a@b.co", None), (3, "q3", "x", 99)],
                                      "query_id long, request_id string, question string, top_k int")
    done = requests.ask(questions, chunks, key, F.lit(NOON), strategy)
    answers = {a.request_id: a for a in done.answers.collect()}
    assert set(answers) == {"q1", "q2"} and [e.text for e in answers["q1"].evidence] == ["beta gamma", "alpha beta"]
    assert answers["q2"].answer.startswith("No indexed evidence")
    bodies = {b["request_id"]: b for b in (json.loads(a.body) for a in done.audit.collect())}
    assert bodies["q1"]["retrieved_chunk_count"] == 2 and bodies["q1"]["compensations"] == []
    assert bodies["q2"]["question_token"] == plain.token("query", f"nothing {plain.token('email', 'a@b.co', key)}", key)
    assert done.events.filter("status = 'processed'").count() == 2 and done.compensations.count() == 0


def test_ask_with_vectors_and_model(spark, key):
    chunks = spark.createDataFrame([(0, 0, "aaa"), (1, 1, "bbbb"), (2, 2, "cc")], "chunk_id long, insert_seq long, text string")
    questions = spark.createDataFrame([(1, "q1", "bbb", 2), (2, "q2", "bad aa", 1)], "query_id long, request_id string, question string, top_k int")

    def model():
        """A tiny text model: how often three letters occur."""
        return lambda texts: [[float(text.count(letter)) / 10 for letter in "abc"] for text in texts]

    vectors = retrieval.embed(chunks, "text", model).select("chunk_id", "insert_seq", "vector")
    asked = retrieval.embed(questions, "question", model).select("query_id", "vector", "top_k")

    def generator():
        def invoke(prompt):
            if "bad" in prompt:
                raise ConnectionError
            return f"{prompt.count('text')} texts, mail a@b.co"
        return invoke

    done = requests.ask(questions, chunks, key, F.lit(NOON), "vector", (asked, vectors), generator)
    hits = sorted((h.query_id, h["index"], h.text) for h in done.hits.collect())
    assert hits[0] == (1, 0, "bbbb") and len(hits) == 3
    answers = {a.request_id: a.answer for a in done.answers.collect()}
    assert answers["q1"] == f"2 texts, mail {plain.token('email', 'a@b.co', key)}"
    assert [c.error_detail for c in done.compensations.collect()] == ["llm_inference:ConnectionError"]
    body = next(b for b in (json.loads(a.body) for a in done.audit.collect()) if b["request_id"] == "q2")
    assert [c["reason"] for c in body["compensations"]] == ["DOWNSTREAM_FAILURE_FAIL_SAFE"]


def test_payments(spark, key):
    rows = spark.createDataFrame(
        [("p1", "tx-1", "m-1", 900000, "EUR", "card"), ("p2", "tx 2", "m-1", 1, "USD", None), ("p3", "tx-3", "m-1", 100, "usd", None)],
        "request_id string, transaction_id string, merchant_id string, amount_minor long, currency string, payment_network string")
    error = F.when(F.col("amount_minor") == 100, F.lit("CallTimedOut"))
    done = requests.process_payments(rows, key, F.lit(NOON), error=error)
    outcomes = {o.request_id: (o.outcome, o.decision) for o in done.outcomes.collect()}
    assert outcomes == {"p1": ("ok", "review"), "p2": ("invalid", ""), "p3": ("scorer_failed", "review")}
    assert [r.request_id for r in done.rejected.collect()] == ["p2"]
    ingested = {e.event_id for e in done.ingested.collect()}
    assert {e.causation_id for e in done.scored.collect()} == ingested and len(ingested) == 2
    assert done.compensated.count() == 1
    for frame in (done.ingested, done.scored, done.compensated):
        assert "tx-" not in str(sinks.to_messages(frame, key).collect())
