"""Retrieval for batches of questions: shared words, BM25, vector distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators.blocks import NO_HIT, Scored, Scorer, best_items
from tracewell.operators.postings import SCORE_DIGITS, search, word_counts
from tracewell.session import stored

BACKENDS = {"lexical": "memory", "bm25": "opensearch", "vector": "chroma"}  # Fixed values: names in hit records.
FEW_PAIRS = 0.02  # share of a block's pairs up to which they are scored one by one
ROUGH_NORM = 1e30  # squared norms that single precision holds with room


def distance_scores(max_distance: float | None) -> Callable[[pa.Table], Scorer]:
    """Score = 1 - squared Euclidean distance; a distance of ``max_distance`` or more is no hit."""

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(table.num_rows, -1)

    def prepare(queries: pa.Table) -> Scorer:
        wanted = matrix(queries)
        wanted_norm = (wanted ** 2).sum(axis=1)
        # Distances of one product in single precision, to leave out pairs that are too far by more than its error.
        rough = np.column_stack([-2 * wanted, np.ones(len(wanted)), wanted_norm]).astype(np.float32)

        def near(have: np.ndarray, norm: np.ndarray, floors: np.ndarray) -> np.ndarray | None:
            limit = 1 - floors if max_distance is None else np.minimum(1 - floors, max_distance)
            largest = max(norm.max(initial=0.0), wanted_norm.max(initial=0.0))
            if not largest < ROUGH_NORM:
                return None
            margin = 10.0 ** -SCORE_DIGITS * 2 + (have.shape[1] + 4) * np.finfo(np.float32).eps * 4 * largest
            distance = np.column_stack([have, norm, np.ones(len(have))]).astype(np.float32) @ rough.T
            pairs = distance <= np.nextafter((limit + margin).astype(np.float32), np.float32(np.inf))
            return pairs if np.count_nonzero(pairs) <= FEW_PAIRS * pairs.size else None

        def score(items: pa.Table, floors: np.ndarray) -> Scored:
            have = matrix(items)
            norm = (have ** 2).sum(axis=1)
            pairs = near(have, norm, floors)
            if pairs is None:
                distance = norm[:, None] + wanted_norm - 2 * (have @ wanted.T)
            else:
                rows, columns = np.nonzero(pairs)
                distance = norm[rows] + wanted_norm[columns] - 2 * np.einsum("ij,ij->i", have[rows], wanted[columns])
            distance = np.round(np.maximum(distance, 0.0), SCORE_DIGITS)
            similarity = np.round(1 - distance, SCORE_DIGITS)
            if pairs is None:
                return similarity if max_distance is None else np.where(distance < max_distance, similarity, NO_HIT)
            hits = similarity >= floors[columns] if max_distance is None else (distance < max_distance) & (similarity >= floors[columns])
            return rows[hits], columns[hits], similarity[hits]

        return score

    return prepare


def _hits(found: DataFrame, strategy: str) -> DataFrame:
    return found.withColumn("backend", F.lit(BACKENDS[strategy])).withColumnRenamed("item_id", "chunk_id")


def index_words(chunks: DataFrame, times: bool = True, kept: tuple[str, ...] = ()) -> DataFrame:
    """``(item_id, insert_seq, length, counts)``, the form all word searches read: words with their times in the text.

    Searches accept it in place of chunks: store it once to search it often. Without ``times`` each word counts once.
    ``kept`` names further columns of ``chunks`` to pass on.
    """
    if "counts" in chunks.columns:
        return chunks
    words = text.words(text.casefold(F.col("text")))
    once = F.transform(F.array_distinct("words"), lambda word: F.struct(word.alias("word"), F.lit(1).alias("times")))
    return chunks.select(F.col("chunk_id").alias("item_id"), "insert_seq", *kept, words.alias("words")).select(
        "item_id", "insert_seq", *kept, F.size("words").alias("length"), (word_counts(F.col("words")) if times else once).alias("counts"))


def question_terms(questions: DataFrame) -> DataFrame:
    """A row per distinct word of a question."""
    return questions.select("query_id", "top_k", F.explode(text.word_tokens(F.col("question"))).alias("word"))


def retrieve_lexical(questions: DataFrame, chunks: DataFrame, **limits: Any) -> DataFrame:
    """Top-k chunks per question by number of distinct shared words.

    ``questions(query_id, question, top_k)``, ``chunks(chunk_id, insert_seq, text)`` ->
    ``(query_id, chunk_id, insert_seq, score, index, backend)``.
    """
    found = search(index_words(chunks, times=False), question_terms(questions), lambda times, length: F.lit(1.0), (1.0, 1.0), **limits)
    return _hits(found, "lexical").withColumn("score", F.col("score").cast("bigint"))


def retrieve_bm25(
    questions: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75, **limits: Any
) -> DataFrame:
    """Top-k chunks per question by BM25 over the same words; any shared word makes a hit."""

    def weigh(times: Column, length: Column) -> Column:
        return times * (k1 + 1) / (times + k1 * (1 - b + b * length))

    def rarity(n_items: Column, held: Column) -> Column:
        return F.log1p((n_items - held + 0.5) / (held + 0.5))

    return _hits(search(index_words(chunks), question_terms(questions), weigh, (0.0, k1 + 1), rarity, **limits), "bm25")


def retrieve_vector(
    queries: DataFrame, vectors: DataFrame, max_distance: float | None = 1.0, **limits: int
) -> DataFrame:
    """Top-k vectors per query by squared Euclidean distance.

    ``queries(query_id, vector, top_k)``, ``vectors(chunk_id, insert_seq, vector)``. ``max_distance=None``
    keeps the nearest k whatever their distance.
    """
    items = vectors.select(F.col("chunk_id").alias("item_id"), "insert_seq", "vector")
    found = best_items(queries, items, distance_scores(max_distance), "size(vector)", "size(vector)", **limits)
    return _hits(found, "vector")


def embed(
    rows: DataFrame, column: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "vector"
) -> DataFrame:
    """``out`` (array of float) from a text model; ``model`` is called once per task, its result once per batch."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for batch in batches:
            yield pd.Series(encode(batch.tolist()), index=batch.index, dtype=object)

    return rows.withColumn(out, vectors(F.col(column)))


def attach_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hit records with their text. Hits are stored first, so the join is planned by their size in bytes."""
    return chunks.select("chunk_id", "text").join(stored(hits, "hits"), "chunk_id")
