"""Stores that commit: audit objects, merged tables, the chunk index; two writers, crashes and replays."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import plain
from tracewell.operators import cdc, retrieval, segments
from tracewell.sources import keyed, sinks
from tracewell.sources.commits import CommitLog

AT = datetime(2024, 1, 1)


def interleave(monkeypatch, other):
    """``other`` runs between the staging and the first commit of the writer under test."""
    create, done = CommitLog.create, []

    def late(log, number, record):
        if not done:
            done.append(number)
            other()
        return create(log, number, record)

    monkeypatch.setattr(CommitLog, "create", late)
    return done


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() is None
    assert log.create(0, {"a": 1}) and not log.create(0, {"a": 2}) and log.create(1, {"a": [3]})
    assert log.numbers() == [0, 1] and log.latest() == (1, {"a": [3]}) and log.read(0) == {"a": 1}


def objects(spark, *keys, day="2024-01-01"):
    rows = [("requests", day, key, "{}", "md5", AT) for key in keys]
    return spark.createDataFrame(rows, "category string, dt string, object_key string, body string, content_md5 string, retain_until timestamp")


def keys(frame):
    return sorted(row["object_key"] for row in frame.collect())


def test_audit_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    done = interleave(monkeypatch, lambda: sinks.write_audit(objects(spark, "b", "c"), path))
    assert sinks.write_audit(objects(spark, "a", "b"), path)
    assert done == [0] and keys(sinks.read_audit(spark, path)) == ["a", "b", "c"]


def test_audit_crash_and_replay(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert sinks.write_audit(objects(spark, "a"), path, "first") and not sinks.write_audit(objects(spark, "a"), path, "first")
    with monkeypatch.context() as patch:
        patch.setattr(CommitLog, "create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            sinks.write_audit(objects(spark, "b"), path, "second")
    assert keys(sinks.read_audit(spark, path)) == ["a"]
    assert sinks.write_audit(objects(spark, "a", "b", day="2024-01-01"), path, "second")
    assert keys(sinks.read_audit(spark, path)) == ["a", "b"]


def test_keyed_table(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path), "k string, at long, v string", "k", ("at",), "v = 'gone'", buckets=4)
    frame = lambda *rows: spark.createDataFrame(rows, "k string, at long, v string")
    found = lambda: sorted(map(tuple, table.rows().collect()))
    assert found() == []
    assert table.merge(frame(("a", 1, "x"), ("b", 1, "x"), (None, 1, "x"), ("a", 2, "y")), 0)
    assert table.merge(frame(("b", 5, "gone"), ("c", 1, "z")), 1) and found() == [("a", 2, "y"), ("c", 1, "z")]
    assert not table.merge(frame(("a", 9, "replay")), 1)
    assert table.merge(frame(("b", 4, "late"), ("a", 1, "late")), 2) and found() == [("a", 2, "y"), ("c", 1, "z")]
    for batch in range(3, 9):
        table.merge(frame((f"n{batch}", batch, "v")), batch)
    table.clean()
    assert len(found()) == 8 and len(table._state()[1]["buckets"]) <= 4
    done = interleave(monkeypatch, lambda: table.merge(frame(("w", 1, "other")), 20))
    assert table.merge(frame(("w", 2, "mine"), ("d", 1, "mine")), 21)
    assert done and {row[0]: row[2] for row in found()}.items() >= {"w": "mine", "d": "mine", "c": "z"}.items()


def test_changes_in_any_order(spark, tmp_path):
    row = "struct<transaction_id:string,amount_minor:long>"
    changes = [("r", 1, 1, 10), ("u", 2, 2, 20), ("d", 3, 3, None), ("u", 2, 1, 15)]
    for number, order in enumerate(([0, 1, 2, 3], [2, 3, 1, 0], [3, 0, 2, 1], [0, 3, 1])):
        frame = spark.createDataFrame(changes, "op string, ts_ms long, lsn long, amount long").select(
            "op", "ts_ms", F.struct("lsn").alias("source"), F.expr(f"CASE WHEN amount IS NOT NULL THEN named_struct('transaction_id', 't', 'amount_minor', amount) END").cast(row).alias("after"),
            F.expr("named_struct('transaction_id', 't', 'amount_minor', 0L)").cast(row).alias("before"))
        schema = frame.schema
        table = cdc.change_table(spark, f"{tmp_path}/{number}", schema)
        rows = cdc.change_rows(frame, "transaction_id").collect()
        for batch, at in enumerate(order):
            table.merge(spark.createDataFrame([rows[at]], table.schema), batch)
        left = [r["row"]["amount_minor"] for r in table.rows().collect()]
        assert left == ([] if 2 in order else [20])


def chunks(spark, *rows):
    return spark.createDataFrame(rows, "chunk_id string, insert_seq long, text string")


def found(index, spark, question, top_k=5):
    asked = spark.createDataFrame([(1, question, top_k)], "query_id long, question string, top_k int")
    return [(r.chunk_id, r.score) for r in sorted(index.query(retrieval.retrieve_lexical, asked).collect(), key=lambda r: r["index"])]


def test_chunk_index(spark, tmp_path, monkeypatch):
    index = segments.ChunkIndex(spark, str(tmp_path))
    assert found(index, spark, "violet") == [] and not index.merge()
    assert index.add("one", chunks(spark, ("a", 1, "violet parcel"), ("b", 2, "violet"), ("b", 3, "violet marker")))
    assert index.add("two", chunks(spark, ("c", 0, "violet marker parcel")))
    assert found(index, spark, "violet parcel marker") == [("c", 3), ("a", 2), ("b", 2)]
    assert not index.add("two", chunks(spark, ("z", 0, "violet")))
    assert index.remove("three", spark.createDataFrame([("a",), ("nobody",)], "chunk_id string"))
    assert index.add("four", chunks(spark, ("b", 0, "violet parcel")))  # a rewrite moves to the newest place
    want = [("c", 3), ("b", 2)]
    assert found(index, spark, "violet parcel marker") == want
    assert index.merge() and len(index.state()["segments"]) == 1 and index.state()["marks"] == []
    index.clean()
    assert found(index, spark, "violet parcel marker") == want
    assert index.add("five", chunks(spark, ("a", 0, "violet")))
    assert found(index, spark, "violet", 2) == [("c", 1), ("b", 1)]
    # Another writer removes c while this one adds d: both count.
    done = interleave(monkeypatch, lambda: index.remove("six", spark.createDataFrame([("c",)], "chunk_id string")))
    assert index.add("seven", chunks(spark, ("d", 0, "violet")))
    assert done and found(index, spark, "violet", 9) == [("b", 1), ("a", 1), ("d", 1)]


def test_chunk_index_writes_words_beside_texts_without_a_join(spark, tmp_path, monkeypatch):
    plans, write = [], segments.ChunkIndex._write

    def watched(self, rows, kind):
        plans.append((kind, rows._jdf.queryExecution().optimizedPlan().toString()))
        return write(self, rows, kind)

    monkeypatch.setattr(segments.ChunkIndex, "_write", watched)
    index = segments.ChunkIndex(spark, str(tmp_path))
    assert index.add("one", chunks(spark, *[(str(i % 20), i, f"violet marker {i}") for i in range(30)]))
    assert [kind for kind, _ in plans] == ["segment"] and "Join" not in plans[0][1]
    assert index.chunks().count() == 20 and found(index, spark, "29 violet", 1) == [("9", 2)]


def test_chunk_index_equals_fresh_search(spark, tmp_path):
    texts = [f"word{i % 7} word{i % 11} common text {i}" for i in range(120)]
    index = segments.ChunkIndex(spark, str(tmp_path))
    for part in range(4):
        index.add(str(part), chunks(spark, *[(str(i), i, texts[i]) for i in range(30 * part, 30 * part + 30)]))
    index.remove("gone", spark.createDataFrame([(str(i),) for i in range(0, 120, 3)], "chunk_id string"))
    index.merge(small_rows=30)
    questions = ["word3 word5", "common 17 text", "nothing"]
    asked = spark.createDataFrame([(i, q, 6) for i, q in enumerate(questions)], "query_id long, question string, top_k int")
    live = [(i, text) for i, text in enumerate(texts) if i % 3]
    expected = {q: [(str(i), score) for i, score in hits] for q, hits in plain.top_words(list(enumerate(questions)), live, 6).items() if hits}
    hits = {}
    for row in sorted(index.query(retrieval.retrieve_lexical, asked).collect(), key=lambda r: (r.query_id, r["index"])):
        hits.setdefault(row.query_id, []).append((row.chunk_id, row.score))
    assert hits == expected
