"""Registered queries: retrieval, answers, index upkeep."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tracewell.operators import answers, index, retrieval, segments
from tracewell.plans.catalog.common import KEY, token_sql, words_sql
from tracewell.session import shared_dir
from tracewell.sources import tables


def lexical_topk(spark, folder):
    hits = retrieval.retrieve_lexical(tables.questions(spark, folder), tables.document_chunks(spark, folder))
    return hits.select("query_id", "chunk_id", "index", "backend", "score")


def bm25_topk(spark, folder):
    hits = retrieval.retrieve_bm25(tables.questions(spark, folder), tables.document_chunks(spark, folder))
    return hits.select("query_id", "chunk_id", "index", "backend", "score")


def _vector_queries(spark, folder):
    rows = tables.vectors(spark, folder)
    return rows.select(F.col("chunk_id").alias("query_id"), "vector", F.lit(4).alias("top_k"))


def vector_topk(spark, folder):
    """Every vector asks for its neighbours nearer than 1."""
    hits = retrieval.retrieve_vector(_vector_queries(spark, folder), tables.vectors(spark, folder))
    return hits.select("query_id", "chunk_id", "index", "backend", "score")


def vector_nearest(spark, folder):
    """Every vector asks for its four nearest at any distance."""
    hits = retrieval.retrieve_vector(_vector_queries(spark, folder), tables.vectors(spark, folder), max_distance=None)
    return hits.select("query_id", "chunk_id", "index", "score")


def _answered(spark, folder):
    """Questions answered from shared words; the store fails for ids ending in 9, the model for those ending in 4."""
    questions = tables.questions(spark, folder)
    failed = F.when(F.col("query_id") % 10 == 9, F.lit("CallTimedOut"))
    asked = questions.withColumn("retrieval_error", failed)
    hits = retrieval.retrieve_lexical(asked.filter("retrieval_error IS NULL"), tables.document_chunks(spark, folder))
    counts = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("retrieved_count"))
    joined = asked.join(counts, "query_id", "left").withColumn("retrieved_count", F.coalesce("retrieved_count", F.lit(0)))
    llm_error = F.when((F.col("query_id") % 10 == 4) & (F.col("retrieved_count") > 0), F.lit("RateLimitExceeded"))
    return (
        joined.withColumn("llm_error", llm_error).withColumn("correlation_id", F.col("request_id"))
        .withColumn("answer", answers.answer_text(
            F.col("retrieved_count"), F.concat(F.lit("answer to "), "request_id"), F.col("llm_error"), True))
    )


def ask_outcomes(spark, folder):
    processed = answers.outcome_events(_answered(spark, folder), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return processed.select(
        "request_id", "operation_id", "status", "topic", F.col("metadata.retrieved_count").alias("retrieved_count"),
        F.col("metadata.model").alias("model"), F.col("metadata.retrieval_error").alias("retrieval_error"),
        F.col("metadata.llm_error").alias("llm_error"),
    )


def ask_compensations(spark, folder):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    compensated = answers.answer_compensations(answers.outcome_events(_answered(spark, folder), at), at)
    rows = answers.compensation_boundaries(compensated)
    return rows.select("request_id", "reason", "original_event_type", "error_detail", "boundary")


def answer_tokens(spark, folder):
    return answers.audit_tokens(_answered(spark, folder), KEY).select("request_id", "output_token")


def retrieval_rollup(spark, folder):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return answers.retrieval_rollup(answers.outcome_events(_answered(spark, folder), at))


def newest_n(spark, folder):
    rows = tables.event_log(spark, folder).select(F.col("seq").alias("insert_seq"), "event_id", "event_type")
    return index.newest(rows, index.NEWEST_RECORDS)


def latest_version(spark, folder):
    """Turns as rewrites of their conversation: the last one stays."""
    rows = tables.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("chunk_id"), F.col("turn").alias("insert_seq"), "role", F.md5("text").alias("digest"))
    return index.latest_versions(rows)


def remove_ids(spark, folder):
    """Documents less the ones labelled toxic, and ids nobody has."""
    chunks = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "n_chars")
    labels = tables.table(spark, folder, "labels")
    ids = labels.filter("toxic = 1").select(F.explode(F.array(F.col("doc_id"), -F.col("doc_id") - 1)).alias("chunk_id"))
    return index.remove_ids(chunks, ids)


def retrieved_chunks(spark, folder):
    chunks = tables.document_chunks(spark, folder)
    hits = retrieval.retrieve_lexical(tables.questions(spark, folder), chunks)
    return index.retrieved_chunks(chunks, hits).select("chunk_id", F.length("text").alias("n_chars"))


def _stored_index(spark, folder):
    """Documents in three batches; labelled ones leave, some come back; then small segments are merged and one more
    batch rewrites the first texts."""
    chunks = tables.document_chunks(spark, folder)
    labels = tables.table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    kept = segments.ChunkIndex(spark, f"{shared_dir(spark)}/index-{os.urandom(8).hex()}")
    for part in range(3):
        kept.add(f"part-{part}", chunks.filter(F.col("chunk_id") % 3 == part))
    kept.remove("labelled", labels)
    kept.remove("nobody", labels.select((-F.col("chunk_id") - 1).alias("chunk_id")))
    kept.add("good", chunks.join(labels.filter("quality = 1"), "chunk_id", "left_semi"))
    kept.add("part-0", chunks)  # a replayed batch
    kept.merge()
    kept.add("again", chunks.filter(F.col("chunk_id") % 10 == 0))
    return kept


def index_segments(spark, folder):
    hits = _stored_index(spark, folder).query(retrieval.retrieve_bm25, tables.questions(spark, folder))
    return hits.select("query_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "index", "score")


def index_chunks(spark, folder):
    return _stored_index(spark, folder).chunks().select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (
    lexical_topk, bm25_topk, vector_topk, vector_nearest, ask_outcomes, ask_compensations, answer_tokens,
    retrieval_rollup, newest_n, latest_version, remove_ids, retrieved_chunks, index_segments, index_chunks,
)}

_LEXICAL = f"""
query_words AS (SELECT item_id AS query_id, unnest(list_distinct({words_sql("text")})) AS word FROM benchmark),
chunk_words AS (SELECT doc_id AS chunk_id, unnest(list_distinct({words_sql("text")})) AS word FROM documents),
scored AS (SELECT query_id, chunk_id, count(*) AS score FROM query_words JOIN chunk_words USING (word) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS index
         FROM scored QUALIFY index < 4)
"""

_VECTORS = """
WITH pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
           round(list_sum(list_transform(list_zip(q.embedding, v.embedding),
                 lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance
    FROM embeddings q, embeddings v),
hits AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS index,
                round(1 - distance, 6) AS score, distance FROM pairs {where} QUALIFY index < 4)
"""

_ASKED = f"""
WITH {_LEXICAL},
counts AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id),
asked AS (SELECT item_id, 'q-' || item_id AS request_id, text AS question,
                 CASE WHEN item_id % 10 = 9 THEN 'CallTimedOut' END AS retrieval_error,
                 CASE WHEN item_id % 10 = 9 THEN 0 ELSE coalesce(n, 0) END::INTEGER AS retrieved_count
          FROM benchmark LEFT JOIN counts ON query_id = item_id),
answered AS (SELECT *, CASE WHEN item_id % 10 = 4 AND retrieved_count > 0 THEN 'RateLimitExceeded' END AS llm_error FROM asked)
"""

_ANSWER = """
CASE WHEN retrieved_count = 0 THEN 'No indexed evidence is available.'
     WHEN llm_error IS NOT NULL THEN 'Inference is unavailable; retrieved evidence is returned without a generated answer.'
     ELSE 'answer to ' || request_id END
"""

# Ids that stay, and where each lies in the order of insertion.
_STORED = """
gone AS (SELECT doc_id FROM labels), back AS (SELECT doc_id FROM labels WHERE quality = 1),
live AS (
    SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 5 WHEN doc_id IN (SELECT doc_id FROM back) THEN 4 ELSE doc_id % 3 END AS batch
    FROM documents WHERE doc_id % 10 = 0 OR doc_id NOT IN (SELECT doc_id FROM gone) OR doc_id IN (SELECT doc_id FROM back))
"""


def _bm25_sql(source: str, order: str) -> str:
    return f"""
        words AS (SELECT doc_id AS chunk_id, {order} AS place, {words_sql("text")} AS words FROM {source}),
        totals AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS average FROM words),
        query_words AS (SELECT item_id AS query_id, unnest(list_distinct({words_sql("text")})) AS word FROM benchmark),
        postings AS (SELECT chunk_id, place, length, word, count(*) AS tf
                     FROM (SELECT chunk_id, place, len(words) AS length, unnest(words) AS word FROM words) w GROUP BY ALL),
        rarity AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, totals GROUP BY word, n),
        scored AS (SELECT query_id, chunk_id, place,
                          round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average))), 6) AS score
                   FROM query_words JOIN postings USING (word) JOIN rarity USING (word), totals GROUP BY ALL),
        hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) - 1 AS index
                 FROM scored WHERE score > 0 QUALIFY index < 4)"""


ORACLES = {
    "lexical_topk": f"""WITH {_LEXICAL}
        SELECT query_id, chunk_id, index::INTEGER AS index, 'memory' AS backend, score FROM hits""",
    "bm25_topk": f"""WITH {_bm25_sql("documents", "doc_id")}
        SELECT query_id, chunk_id, index::INTEGER AS index, 'opensearch' AS backend, score FROM hits""",
    "index_segments": f"""WITH {_STORED}, {_bm25_sql("live", "(batch, doc_id)")}
        SELECT query_id, chunk_id, index::INTEGER AS index, score FROM hits""",
    "index_chunks": f"WITH {_STORED} SELECT doc_id AS chunk_id, md5(text) AS digest FROM live",
    "vector_topk": _VECTORS.format(where="WHERE distance < 1.0") + """
        SELECT query_id, chunk_id, index::INTEGER AS index, 'chroma' AS backend, score FROM hits""",
    "vector_nearest": _VECTORS.format(where="") + """
        SELECT query_id, chunk_id, index::INTEGER AS index, score FROM hits""",
    "ask_outcomes": f"""{_ASKED}
        SELECT request_id, request_id AS operation_id,
               CASE WHEN retrieval_error IS NULL AND llm_error IS NULL THEN 'processed' ELSE 'compensated' END AS status,
               'transaction.processed' AS topic, retrieved_count, 'fallback' AS model, retrieval_error, llm_error FROM answered""",
    "ask_compensations": f"""{_ASKED}
        SELECT request_id, 'DOWNSTREAM_FAILURE_FAIL_SAFE' AS reason, 'TransactionProcessed' AS original_event_type,
               'retrieval_store:' || retrieval_error AS error_detail, 'retrieval_store' AS boundary
        FROM answered WHERE retrieval_error IS NOT NULL
        UNION ALL
        SELECT request_id, 'DOWNSTREAM_FAILURE_FAIL_SAFE', 'TransactionProcessed', 'llm_inference:' || llm_error,
               'llm_inference' FROM answered WHERE llm_error IS NOT NULL""",
    "answer_tokens": f"""{_ASKED}
        SELECT request_id, {token_sql("answer", _ANSWER)} AS output_token FROM answered""",
    "retrieval_rollup": f"""{_ASKED}
        SELECT CASE WHEN retrieval_error IS NULL AND llm_error IS NULL THEN 'processed' ELSE 'compensated' END AS status,
               'fallback' AS model, count(*) AS requests, sum(retrieved_count)::BIGINT AS retrieved,
               count(*) FILTER (WHERE retrieved_count = 0) AS without_evidence FROM answered GROUP BY ALL""",
    "newest_n": """
        SELECT event_id AS insert_seq, 'e-' || event_id AS event_id, event_type FROM events e ORDER BY e.event_id DESC LIMIT 1000""",
    "latest_version": """
        SELECT conv_id AS chunk_id, max(turn) AS insert_seq, arg_max(role, turn) AS role, arg_max(md5(text), turn) AS digest
        FROM conversations GROUP BY conv_id""",
    "remove_ids": """
        SELECT doc_id AS chunk_id, lang, n_chars FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "retrieved_chunks": f"""WITH {_LEXICAL}
        SELECT doc_id AS chunk_id, length(text)::INTEGER AS n_chars FROM documents WHERE doc_id IN (SELECT chunk_id FROM hits)""",
}
