import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import plain
from tracewell.operators import blocks, index, retrieval
from tracewell.sources import tables

SMALL = {"query_rows": 3, "query_block": 40, "item_block": 2000}  # forces many query and item blocks
COMMON = {"parts": 3, "common_items": 2}  # nearly every word is a common one


def frames(spark, questions, documents, top_k=4):
    asked = spark.createDataFrame([(i, q, top_k) for i, q in enumerate(questions)], "query_id long, question string, top_k int")
    chunks = spark.createDataFrame([(i, i, d) for i, d in enumerate(documents)], "chunk_id long, insert_seq long, text string")
    return asked, chunks


def ranked(hits):
    found = {}
    for row in sorted(hits.collect(), key=lambda r: (r.query_id, r["index"])):
        found.setdefault(row.query_id, []).append((row.chunk_id, row.score))
    return found


@pytest.mark.parametrize("limits", [{}, COMMON])
def test_lexical_equals_brute_force(spark, data, limits):
    chunks = tables.document_chunks(spark, data)
    asked = tables.questions(spark, data)
    documents = [(r.chunk_id, r.text) for r in chunks.orderBy("insert_seq").collect()]
    questions = [(r.query_id, r.question) for r in asked.collect()]
    expected = {q: hits for q, hits in plain.top_words(questions, documents, 4).items() if hits}
    assert ranked(retrieval.retrieve_lexical(asked, chunks, **limits)) == expected


def test_examples(spark):
    asked, chunks = frames(spark, ["marker, violet parcel parcel", "unrelated galaxy", "!?", "", "x"],
                           ["violet violet violet", "Violet parcel marker."])
    assert ranked(retrieval.retrieve_lexical(asked, chunks)) == {0: [(1, 3), (0, 1)]}
    one = asked.withColumn("top_k", F.lit(1))
    assert ranked(retrieval.retrieve_lexical(one, chunks)) == {0: [(1, 3)]}
    assert ranked(retrieval.retrieve_lexical(asked.limit(0), chunks)) == {}
    assert ranked(retrieval.retrieve_bm25(asked, chunks.limit(0))) == {}


def test_privacy_tokens_are_whole_words(spark):
    token = "<PII_EMAIL_V1_0123456789abcdef0123456789abcdef>"
    other = "<PII_EMAIL_V1_fedcba9876543210fedcba9876543210>"
    asked, chunks = frames(spark, [token + ",", "PII EMAIL V1"], [other + ".", token + "."])
    assert ranked(retrieval.retrieve_lexical(asked, chunks)) == {0: [(1, 1)]}


@pytest.mark.parametrize("limits", [{}, COMMON])
def test_hot_word_and_top_k_per_question(spark, limits):
    """A third of the documents are copies, and every document and question holds one word."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    documents = ["the same text"] * 100 + [" ".join(["the", *rng.choices(vocabulary, k=8)]) for _ in range(200)]
    questions = [" ".join(["the", *rng.choices(vocabulary, k=4)]) for _ in range(30)]
    asked, chunks = frames(spark, questions, documents)
    asked = asked.withColumn("top_k", (F.col("query_id") % 20 + 1).cast("int"))
    expected = plain.top_words(enumerate(questions), list(enumerate(documents)), 20)
    expected = {q: hits[:q % 20 + 1] for q, hits in expected.items()}
    assert ranked(retrieval.retrieve_lexical(asked, chunks.repartition(7), **limits)) == expected


@pytest.mark.parametrize("limits", [{}, SMALL])
@pytest.mark.parametrize("max_distance", [1.0, None])
def test_vectors_equal_brute_force(spark, limits, max_distance):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 8)) * 0.4
    points[100:200] = points[0]
    rows = [(i, i, [float(x) for x in p]) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "chunk_id long, insert_seq long, vector array<double>")
    queries = vectors.filter("chunk_id < 150").select(F.col("chunk_id").alias("query_id"), "vector", F.lit(5).alias("top_k"))
    found = ranked(retrieval.retrieve_vector(queries, vectors, max_distance, **limits))
    for q in range(150):
        distance = np.round(((points - points[q]) ** 2).sum(axis=1), 6)
        order = sorted(range(300), key=lambda i: (distance[i], i))
        want = [i for i in order if max_distance is None or distance[i] < max_distance][:5]
        assert [i for i, _ in found[q]] == want


def test_bm25_common_words_agree(spark, data):
    asked, chunks = tables.questions(spark, data), tables.document_chunks(spark, data)
    whole = ranked(retrieval.retrieve_bm25(asked, chunks))
    indexed = retrieval.index_words(chunks)
    assert whole == ranked(retrieval.retrieve_bm25(asked, indexed, **COMMON))
    assert whole == ranked(retrieval.retrieve_bm25(asked, indexed, parts=5, common_items=60))
    assert len(whole) == asked.count()


def test_index_upkeep(spark):
    rows = [("a", 1, "alpha"), ("b", 2, "beta"), ("c", 3, "gamma"), ("a", 4, "alpha two")]
    chunks = spark.createDataFrame(rows, "chunk_id string, insert_seq long, text string")
    latest = index.latest_versions(chunks)
    assert sorted(map(tuple, latest.collect())) == [("a", 4, "alpha two"), ("b", 2, "beta"), ("c", 3, "gamma")]
    assert sorted(r.chunk_id for r in index.newest(latest, 2).collect()) == ["a", "c"]
    ids = spark.createDataFrame([("a",), ("zzz",), ("a",)], "chunk_id string")
    assert sorted(r.chunk_id for r in index.remove_ids(latest, ids).collect()) == ["b", "c"]


def test_attach_text(spark):
    asked, chunks = frames(spark, ["alpha beta"], ["alpha", "alpha beta", "gamma"])
    hits = retrieval.attach_text(retrieval.retrieve_lexical(asked, chunks), chunks).orderBy("index").collect()
    assert [(h["index"], h.text, h.score, h.backend) for h in hits] == [(0, "alpha beta", 2, "memory"), (1, "alpha", 1, "memory")]


def test_common_words_alone_are_asked_again(spark):
    """Questions of common words only, and one whose rare word is nowhere beside them."""
    documents = [("the of and", "the of", "and", "the rare", "of and")[i % 5] + (f" w{i}" if i % 3 else "") for i in range(200)]
    questions = ["the of and", "rare the", "w4 of and the", "w3 nothing", "of"]
    asked, chunks = frames(spark, questions, documents, 7)
    expected = plain.top_words(enumerate(questions), list(enumerate(documents)), 7)
    expected = {q: hits for q, hits in expected.items() if hits}
    assert ranked(retrieval.retrieve_lexical(asked, chunks, parts=4, common_items=20)) == expected
    whole, pruned = (ranked(retrieval.retrieve_bm25(asked, chunks, parts=4, common_items=least)) for least in (10 ** 6, 20))
    assert whole == pruned and len(whole) == 5 - (3 not in whole)


def test_pairs_are_not_shuffled(spark, data):
    """Postings and words are dealt by part once; after the join only the best of every part move."""
    hits = retrieval.retrieve_bm25(tables.questions(spark, data), tables.document_chunks(spark, data), parts=8)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "MapIn" not in plan
    before, after = plan.split("functions=[sum(", 1)[0], plan.split("functions=[sum(", 1)[1]
    assert before.count("Exchange hashpartitioning(query_id") == 1 and "WindowGroupLimit" in before
    assert after.count("REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("max_distance", [1.0, None])
def test_vector_scan_scores_few_pairs_and_finds_all(max_distance):
    """After the first items only pairs that may still count are scored; results are those of all pairs."""
    draw = np.random.default_rng(5)
    have = draw.normal(size=(3000, 32))
    have[:1500] /= np.linalg.norm(have[:1500], axis=1)[:, None]
    have[2000:2040] = have[7]  # ties
    have[2100] = 1e20
    table = pa.table({"item_id": np.arange(3000), "insert_seq": draw.permutation(3000), "vector": have.tolist()})
    asked = pa.table({"query_id": np.arange(200), "top_k": np.full(200, 4), "vector": have[:200].tolist()})
    leaders, scorer, scored = blocks._Leaders(4), retrieval.distance_scores(max_distance)(asked), []

    def watched(items, floors):
        scored.append(scorer(items, floors))
        return scored[-1]

    for start in range(0, 3000, 300):
        blocks._scan(table.slice(start, 300), watched, leaders, 200)
    exact = np.round(1 - np.round(((have[:, None] - have[None, :200]) ** 2).sum(axis=2), 6), 6)
    order = np.lexsort((np.broadcast_to(table["insert_seq"].to_numpy()[:, None], exact.shape), -exact), axis=0)[:4]
    expected = {(q, int(i)) for q in range(200) for i in order[:, q] if max_distance is None or 1 - exact[i, q] < max_distance}
    assert {(int(q), i) for q, i in zip(leaders.query, leaders.items.to_pylist())} == expected
    assert sum(isinstance(found, tuple) for found in scored) >= 5
