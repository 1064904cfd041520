"""Quality by compression: which of two dictionaries, of good and of bad labelled text, packs a text better.

Dictionaries are trained on blocks of a bounded sample of labelled documents; the compressed sizes of whole texts,
block by block, give the normalised difference. Other labelled documents of the sample calibrate it: a logistic curve
over that difference, per byte and per compressed byte, and the size itself.

Defined cases: null and empty texts are scored as one empty block; without labels of both kinds every score is the
share of good labels (0.5 without any); of a document labelled more than once the lowest label counts; null ids are
scored, never learned from; repeated rows are scored one by one. Texts of any length are
scored whole; other columns are never inputs; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import byte_texts, doc_remainder, prepared, read

HELD_OUT = (4, 2)  # divisor and remainder of the crc32 of the id
GOOD_SCORE = 0.7
# The bound of the learning sample: labelled rows, blocks of one text, bytes of a block; below, blocks of one dictionary.
SAMPLE_ROWS, SAMPLE_BLOCKS, BLOCK = 6000, 8, 2048
DICTIONARY, DICTIONARY_BLOCKS, LEVEL = 112_640, 4000, 3
FEATURES = ("difference", "relative", "size")


def blocks(text: bytes | None) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)] if text else [b""]


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is its own dictionary
        return b"".join(samples)[:DICTIONARY]


class Packer:
    """Sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.packers = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(
                dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes | None) -> tuple[float, float, float]:
        parts = blocks(text)
        good, bad = (sum(len(packer.compress(part)) for part in parts) for packer in self.packers)
        length = max(1, len(text or b""))
        return (bad - good) / length, (bad - good) / (bad + good), good / length


class Classifier:
    def __init__(self, good: bytes, bad: bytes, table: np.ndarray, labels: np.ndarray, prior: float) -> None:
        self.good, self.bad, self.prior = good, bad, prior
        self.low, self.high = table.min(axis=0), table.max(axis=0)
        self.mean, self.spread = table.mean(axis=0), table.std(axis=0) + 1e-9
        self.weights = self._fit(self._design(table), labels)

    def _design(self, table: np.ndarray) -> np.ndarray:
        inside = (np.clip(table, self.low, self.high) - self.mean) / self.spread
        return np.concatenate([inside, np.ones((len(inside), 1))], axis=1)

    @staticmethod
    def _fit(design: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Logistic regression by Newton's method with a little shrinkage."""
        weights = np.zeros(design.shape[1])
        shrink = 1e-2 * np.eye(design.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            curve = (design * (p * (1 - p))[:, None]).T @ design + shrink
            weights += np.linalg.solve(curve, design.T @ (labels - p) - shrink @ weights)
        return weights

    def scores(self, table: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(table) @ self.weights, -30, 30)))


def _sample_blocks(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts:
        cut = []
        for text in byte_texts(batch.column(2)):
            parts = blocks(text)
            step = max(1, len(parts) // SAMPLE_BLOCKS)
            cut.append([part for part in parts[::step][:SAMPLE_BLOCKS] if len(part) >= 16])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.list_(pa.binary()))],
                                         names=["doc_id", "quality", "blocks"])


def _evenly(texts: list[list[bytes]]) -> list[bytes]:
    """At most ``DICTIONARY_BLOCKS`` blocks: the first of every text, then the second, and so on."""
    return [text[i] for i in range(SAMPLE_BLOCKS) for text in texts if i < len(text)][:DICTIONARY_BLOCKS]


def _feature_udf(good: bytes, bad: bytes):
    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = Packer(good, bad)
        for texts in batches:
            yield pa.array([packer.features(text) for text in byte_texts(texts)], pa.list_(pa.float64()))

    return features


def learn(docs: DataFrame, labels: DataFrame, rule: tuple[int, int] = HELD_OUT, sample_rows: int = SAMPLE_ROWS) -> Classifier | float:
    """A classifier from at most ``sample_rows`` labelled documents, or the prior where labels are one-sided."""
    usable = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(doc_remainder(F.col("doc_id"), rule[0]) != rule[1])
    marked = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("doc_id"))
    # Bounded by its limit: every task may hold it.
    sample = marked.orderBy(order, "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("fold", F.pmod(order, F.lit(5)))
    fit = found.filter("fold < 3").select("doc_id", "quality", "text").limit(sample_rows)
    rows = sorted(fit.mapInArrow(_sample_blocks, "doc_id bigint, quality int, blocks array<binary>").collect(),
                  key=lambda row: (zlib.crc32(str(row["doc_id"]).encode()), row["doc_id"], row["blocks"]))
    kinds = {q: _evenly([row["blocks"] for row in rows if row["quality"] == q]) for q in (0, 1)}
    prior = sum(row["quality"] for row in rows) / len(rows) if rows else 0.5
    if not (kinds[0] and kinds[1]):
        return prior
    good, bad = (_dictionary(kinds[q]) for q in (1, 0))
    test = found.filter("fold >= 3").select("quality", _feature_udf(good, bad)("text").alias("x")).limit(sample_rows).collect()
    if len({row["quality"] for row in test}) < 2:
        return prior
    test.sort(key=lambda row: (row["quality"], row["x"]))
    return Classifier(good, bad, np.array([row["x"] for row in test]), np.array([row["quality"] for row in test], float), prior)


def quality_score(model: Classifier | float, text: Column) -> Column:
    """Score between 0 and 1 for a text column."""
    if isinstance(model, float):
        return F.lit(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = Packer(model.good, model.bad)
        for texts in batches:
            table = np.array([packer.features(text) for text in byte_texts(texts)], float).reshape(-1, len(FEATURES))
            yield pa.array(model.scores(table))

    return score(text)


def op6(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality_score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(doc_remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))
