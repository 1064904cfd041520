"""Packing of tokenised documents along a space-filling curve.

A document's token counts are hashed into signed buckets, damped and scaled to length 1, and projected by fixed random
directions to three numbers. Their spread over all documents sets a grid; a cell's place on the Hilbert curve through
that grid is the document's key. Documents sorted by key are one line of tokens, cut every ``LENGTH`` tokens:
neighbours on the line are near one another in all three directions, so a sequence holds documents of one kind. What
is left at the line's end is cut at powers of two, which need no padding, so none is padded at all.

Token ids are those of the vocabulary file for ``tokenizers`` with ``add_special_tokens=False``. Texts of up to
``LONG_TEXT`` characters are encoded by ``tiktoken`` from the same vocabulary as ranks, which gives equal ids several
times faster; longer ones, on which its pattern matcher may give up, by ``tokenizers`` itself.

Sorting moves one narrow row per document; ids are stored once and moved once, to where their places are known.

Defined cases: null texts are empty, and an empty text has the closing id alone; texts of any length are encoded whole
and may span many sequences; null and repeated document ids are rows of their own; equal keys are ordered by document
id, then by size and digest of the ids, so reruns agree; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Store, numbered, prepared, read

LENGTH = 2048
VOCABULARY = "byte_bpe_50k"
CLOSING = 1
LONG_TEXT = 300_000
BUCKETS = 256
DIRECTIONS = 3
GRID_BITS = 20
SEED = 20_240_601


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Text to token ids, by the files of that name in the package of public vocabularies."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}  # fixed value: its string in a text is the special token
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = []

    def encode(text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return quick.encode_to_numpy(text, allowed_special="all")
        if not slow:
            slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def projection() -> Callable[[np.ndarray], np.ndarray]:
    """Token ids to ``DIRECTIONS`` numbers; equal in every task."""
    made = np.random.default_rng(SEED)
    bucket, sign = made.integers(0, BUCKETS, 1 << 16), made.choice([-1.0, 1.0], 1 << 16)
    directions = made.standard_normal((BUCKETS, DIRECTIONS))

    def project(ids: np.ndarray) -> np.ndarray:
        counts = np.bincount(bucket[ids], weights=sign[ids], minlength=BUCKETS)
        damped = np.sign(counts) * np.log1p(np.abs(counts))
        return (damped / (np.linalg.norm(damped) or 1.0)) @ directions

    return project


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (rows x dimensions, ``bits`` bits each): cells of neighbouring places
    share a face. By Skilling's transform of coordinates."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            high = (x[d] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap if d else 0
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level & 1)
    return key


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(row, doc_id, ids, n_tokens, ids_key, p0, p1, p2)``: ids (two bytes each) with the closing one, their digest
    and projection."""
    spots = [f"p{d}" for d in range(DIRECTIONS)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, project = encoder(vocabulary), projection()
        for batch in batches:
            ids, sizes, keys, places = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = np.append(ids_of(text or "").astype("<u2"), np.uint16(CLOSING)).astype("<u2")
                ids.append(tokens.tobytes())
                sizes.append(len(tokens))
                keys.append(zlib.crc32(ids[-1]))
                places.append(project(tokens))
            columns = np.array(places).reshape(-1, DIRECTIONS).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                 *[pa.array(column, pa.float64()) for column in columns]], names=["row", "doc_id", "ids", "n_tokens", "ids_key", *spots])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        encode, f"row long, doc_id {kind}, ids binary, n_tokens long, ids_key long, " + ", ".join(f"{spot} double" for spot in spots))


def curve_keys(facts: DataFrame) -> DataFrame:
    """``(row, doc_id, n_tokens, ids_key, curve_key)``: the grid is set by mean and deviation over all documents."""
    spots = [f"p{d}" for d in range(DIRECTIONS)]
    spread = facts.agg(*[F.mean(s).alias(f"m_{s}") for s in spots], *[F.stddev_pop(s).alias(f"d_{s}") for s in spots]).first()
    means = [spread[f"m_{s}"] or 0.0 for s in spots]
    deviations = [spread[f"d_{s}"] or 1.0 for s in spots]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in spots])
            # A logistic curve spreads a bell-shaped direction evenly over its cells.
            shares = 1.0 / (1.0 + np.exp(-1.702 * (points - means) / deviations))
            cells = np.clip((shares * (1 << GRID_BITS)).astype(np.int64), 0, (1 << GRID_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in ("row", "doc_id", "n_tokens", "ids_key")], pa.array(hilbert_key(cells, GRID_BITS), pa.int64())],
                names=["row", "doc_id", "n_tokens", "ids_key", "curve_key"])

    kind = facts.schema["doc_id"].dataType.simpleString()
    return facts.select("row", "doc_id", "n_tokens", "ids_key", *spots).mapInArrow(
        place, f"row long, doc_id {kind}, n_tokens long, ids_key long, curve_key long")


def cuts(before: int, size: int, total: int, length: int) -> list[tuple[int, int, int]]:
    """(sequence, offset in it, tokens) of the pieces of the tokens ``before`` to ``before + size`` of the line."""
    whole, pieces, at, end = total // length, [], before, before + size
    while at < end and at < whole * length:
        take = min(length - at % length, end - at)
        pieces.append((at // length, at % length, take))
        at += take
    sequence, start = whole, whole * length
    for bit in reversed(range(length.bit_length())):
        if (total - whole * length) >> bit & 1:
            if start <= at < min(end, start + (1 << bit)):
                take = min(start + (1 << bit), end) - at
                pieces.append((sequence, at - start, take))
                at += take
            sequence, start = sequence + 1, start + (1 << bit)
    return pieces


def pack(docs: DataFrame, store: Store, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, start, ids, doc_tokens, sequence_id, offset, curve_key)`` per piece; ids are little-endian, four
    bytes each. Sequence ids and offsets have no gaps, and sequences follow the curve."""
    facts = store.save(tokenised(docs, vocabulary), "tokens")
    keys = curve_keys(facts)
    order = [F.col("curve_key"), F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("ids_key"), F.col("row")]
    placed = numbered(store.save(keys, "keys"), order, store, "line", size="n_tokens")
    total = facts.agg(F.sum("n_tokens")).first()[0] or 0
    lined = placed.select("row", "curve_key", "before").join(facts.select("row", "doc_id", "ids", "n_tokens"), "row")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ids, places = [], [], [], []
            befores, contents = batch.column("before").to_pylist(), batch.column("ids").to_pylist()
            for number, (before, content) in enumerate(zip(befores, contents)):
                tokens, start = np.frombuffer(content, "<u2").astype("<u4"), 0
                for sequence, offset, take in cuts(before, len(tokens), total, length):
                    rows.append(number)
                    starts.append(start)
                    ids.append(tokens[start:start + take].tobytes())
                    places.append((sequence, offset))
                    start += take
            at = pa.array(rows, pa.int64())
            sequences, offsets = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), pa.array(starts, pa.int64()), pa.array(ids, pa.binary()), batch.column("n_tokens").take(at),
                 pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()), batch.column("curve_key").take(at)],
                names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"])

    return lined.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the pieces of a sequence joined in order. A group is one sequence, so it is bounded."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    empty = F.lit(b"").cast("binary")
    return joined.select("sequence_id", F.aggregate("parts", empty, lambda ids, part: F.concat(ids, part["ids"])).alias("ids"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    pieces = pack(read(spark, sf_dir, "documents"), Store(spark, "pack"))
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
