"""A probabilistic suffix tree over words: variable-length contexts, kept where the next word depends on them.

A context of up to ``DEPTH`` words is kept if its suffix is kept and the distribution of its next words diverges from
that of its suffix by a likelihood-ratio test. Next words seen at least ``LEAST`` times after it are listed, at any
size of the corpus; their counts are discounted. What the discount frees, and what is seen less often, goes to the
suffix's distribution, down to the root: add-one counts of all words. A token is scored in the state of the longest
kept suffix of the words before it.

Every token travels once, with the four words before it, to the block of its context: a hash of the last word before
it. A block holds all occurrences of its contexts, so it counts, tests and scores them alone, and sends one sum per
text back. Words before a token too frequent for a block ("hot", at least ``BLOCK / 4`` times) are dealt to several
blocks by the shortest context that is not hot; the next words of hot contexts are counted beforehand, by joins, and
sent to each of these blocks. Word sequences ("grams") are known by 64-bit hashes of the numbers of their first and
last words but one; words with a fixed share of the tokens have small numbers known to every task, others hashes.

Defined cases: null and empty texts are the end token alone; a null id belongs to the training part; repeated rows
train and are scored one by one; an empty table gives no rows; without training tokens every token is unknown. Texts
of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import Store, byte_texts, doc_remainder, prepared, read

HELD_OUT = (7, 2)  # divisor and remainder of the crc32 of the id
END = "\n"  # the end token: no word holds white space
WORD_SHARE = 2e-6  # share of the tokens from which a word is known to every task
CONTEXT_SHARE = 1e-4  # share of the tokens from which a context of one word is in ``Model.tree``
DEPTH = 4
LEAST = 2  # times a word must follow a context to be listed there
DISCOUNT = 0.75
DIVERGENCE = 3.0  # a context's log-likelihood gain must exceed its next words by so many standard deviations
FLUSH_WORDS, FLUSH_PAIRS, FLUSH_TOKENS = 300_000, 4_000_000, 500_000
BLOCK = 1_000_000  # tokens of a block
ROUNDS = 3  # parts of the blocks that are dealt one after the other: the shuffle of one is on disk at a time
CHUNK_BITS = 14  # texts whose sums are added in one group
MISSING = np.iinfo(np.int64).min  # before the first word
# What a packed row of numbers and values holds: counts of rare words and shares after hot contexts for a block, parts of
# the scores of a chunk of texts.
COUNTS, SHARES, BASE, KNOWN, LIFTED = range(5)
PACKED = "kind int, at bigint, keys binary, amounts binary"


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END.encode()]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all tokens, counted per task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string(), safe=False), pa.array(list(counts.values()), pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for text in byte_texts(batch.column(0)):
                counts.update(tokens(text))
            if len(counts) > FLUSH_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Encoder:
    """Words as numbers by falling count; words that are not known to tasks are -1."""

    def __init__(self, words: list[bytes]) -> None:
        self.ids = {word: i for i, word in enumerate(words)}

    def batch(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All words in a row, their numbers, and the number of tokens of each text."""
        split = [tokens(text) for text in texts]
        words = list(chain.from_iterable(split))
        flat = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        return words, flat, np.array([len(row) for row in split], np.int64)


def _before(flat: np.ndarray, lengths: np.ndarray, distance: int) -> np.ndarray:
    """The token ``distance`` places earlier in the same text, -1 where there is none."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    shifted = np.concatenate([np.full(distance, -1, np.int64), flat])[:len(flat)]
    return np.where(place >= distance, shifted, -1)


class Tree:
    """Kept contexts of each length. A context of length d is its words' number in base ``base``.

    ``codes``/``keep``: contexts and the weight their suffix gets; ``entries``/``share``: context and next word,
    and that word's discounted share.
    """

    def __init__(self, base: int, levels: list[dict[str, np.ndarray]] | None = None) -> None:
        self.base = base
        self.levels: list[dict[str, np.ndarray]] = levels or []

    def codes(self, flat: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
        """Number of the context of ``depth`` words before each token, -1 where one is missing or not known."""
        code = np.zeros(len(flat), np.int64)
        for distance in range(depth, 0, -1):
            word = _before(flat, lengths, distance)
            code = np.where((word >= 0) & (code >= 0), code * self.base + word, -1)
        return code

    def ratio(self, flat: np.ndarray, lengths: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Probability of each token in its state over its root probability ``root`` (used for known words alone)."""
        ratio = np.ones(len(flat))
        for depth, level in enumerate(self.levels, 1):
            code = self.codes(flat, lengths, depth)
            state, kept = _find(level["codes"], code)
            entry, listed = _find(level["entries"], np.where((flat >= 0) & kept, code * self.base + flat, -1))
            share = np.where(listed, level["share"][entry] if len(level["share"]) else 0.0, 0.0)
            weight = level["keep"][state] if len(level["keep"]) else np.ones(len(flat))
            ratio = np.where(kept, weight * ratio + share / np.where(flat >= 0, root, 1.0), ratio)
        return ratio


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def word_codes(words: list[bytes]) -> np.ndarray:
    """Numbers of words that are not known to tasks; those of others are their places."""
    return pd.util.hash_array(np.array(words, object), categorize=False).view(np.int64) if words else np.zeros(0, np.int64)


def _coded(flat: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Numbers of all tokens: ``flat`` with hashes in place of -1."""
    codes, unknown = flat.copy(), flat < 0
    codes[unknown] = word_codes(list(compress(words, unknown.tolist())))
    return codes


def joined_key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Number of a gram from those of itself without its last and without its first word."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (last.astype(np.uint64) + np.uint64(0x7F4A7C15F39CC060))
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ mixed >> np.uint64(29)).astype(np.int64)


def grams(codes: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 2 to ``most`` words: where a gram ends, and the numbers of it without its last and without its first word."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = codes
    for words in range(2, most + 1):
        first = np.concatenate([keys[:1], keys[:-1]])
        yield np.flatnonzero(place >= words - 1), first, keys
        keys = joined_key(first, keys)


def gram_counts(coded: DataFrame, words: int, contexts: np.ndarray) -> DataFrame:
    """``(first, last, n)`` of grams of ``words`` words that start with one of ``contexts`` (sorted), seen at least ``LEAST`` times."""
    wanted = coded.sparkSession.sparkContext.broadcast(contexts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def out() -> pa.RecordBatch:
            first, last = (np.concatenate(part) for part in zip(*waiting))
            order = np.argsort(joined_key(first, last))
            first, last = first[order], last[order]
            starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])]))
            return pa.RecordBatch.from_arrays(
                [pa.array(first[starts]), pa.array(last[starts]), pa.array(np.diff(np.append(starts, len(first))).astype(np.int64))], names=["first", "last", "n"])

        for batch in batches:
            *_, (at, first, last) = grams(*_codes(batch), words)
            at = at[_find(wanted.value, first[at])[1]]
            first, last = first[at], last[at]
            waiting.append((first, last))
            held += len(first)
            if held > FLUSH_PAIRS:
                yield out()
                waiting, held = [], 0
        if held:
            yield out()

    rows = coded.mapInArrow(count, "first bigint, last bigint, n bigint")
    return rows.groupBy("first", "last").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def _with_key(counted: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(i).to_numpy() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(joined_key(first, last))], names=["first", "last", "n", "key"])

    return counted.mapInArrow(keys, "first bigint, last bigint, n bigint, key bigint")


def coded_words(words: DataFrame, encoder) -> DataFrame:
    """``(key, n)`` of the words of a table ``(word, n)``."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Encoder(encoder.value).ids.get
        for batch in batches:
            names = byte_texts(batch.column(0))
            flat = np.array([get(name, -1) for name in names], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_coded(flat, names)), batch.column(1)], names=["key", "n"])

    return words.mapInArrow(code, "key bigint, n bigint")


class Model:
    """Word counts of the training texts ``docs``; ``encoder``/``counts``: names and counts of words known to every task."""

    def __init__(self, words: DataFrame, total: int, distinct: int, encoder, counts: np.ndarray, docs: DataFrame, store: Store, depth: int) -> None:
        self.words, self.total, self.distinct = words, total, distinct
        self.encoder, self.counts = encoder, counts
        self.docs, self.store, self.depth = docs, store, depth

    @property
    def often(self) -> int:
        return max(2, math.ceil(self.total * WORD_SHARE))

    @functools.cached_property
    def known(self) -> DataFrame:
        """``(key, n, p)`` of all words."""
        p = (F.col("n") + 1) / F.lit(self.total + self.distinct + 1.0)
        return self.store.save(coded_words(self.words, self.encoder), "known").withColumn("p", p)

    @functools.cached_property
    def tree(self) -> Tree:
        """Frequent contexts of one word with their frequent next words, to look into; scores do not use it."""
        coded = local_docs(self.docs.select("text", F.lit(True).alias("train"), F.lit(False).alias("scored"), F.lit(None).cast("bigint").alias("doc_id")), self)
        contexts = np.flatnonzero(self.counts >= max(2, self.total * CONTEXT_SHARE))
        entries = _level(_with_key(gram_counts(coded.select("n_tokens", "codes"), 2, contexts)), self.known).filter(F.col("keep").isNotNull())
        entries = self.store.save(entries, "tree")
        states = entries.groupBy("first").agg(F.first("keep").alias("keep"))
        tree = Tree(max(1, len(self.counts)))
        tree.levels.append(_head_level(tree, states, entries.filter(F.col("n") >= self.often)))
        return tree


def train(docs: DataFrame, store: Store, depth: int = DEPTH) -> Model:
    """Counts the words of all of ``docs``; their contexts are counted where texts are scored."""
    words = store.save(word_counts(docs), "words")
    size = words.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = size["total"] or 0, size["distinct"]
    # No more words than 1 / WORD_SHARE can have this share: what reaches driver and tasks is bounded.
    often = max(2, math.ceil(total * WORD_SHARE))
    head = words.filter(F.col("n") >= often).orderBy(F.desc("n"), "word").toArrow()
    counts = np.asarray(head.column("n").to_numpy(), np.int64)
    names = byte_texts(head.column("word").combine_chunks()) if len(counts) else []
    # Plain values travel, tasks build the objects: a worker that has no copy of this package can read them.
    return Model(words, total, distinct, store.spark.sparkContext.broadcast(names), counts, docs, store, depth)


class Hot:
    """Contexts too frequent for one block, per length: sorted ``keys``, their ``last`` words, ``parts`` (blocks that
    the context's tokens need) and ``keep`` (nan where the context is not kept)."""

    def __init__(self, levels: list[dict[str, np.ndarray]], blocks: int) -> None:
        self.levels, self.blocks = levels, blocks

    def may_be_in(self, last: np.ndarray, rounds: int, turn: int) -> np.ndarray:
        """Whether the block of a token after the word ``last`` can be one of round ``turn``."""
        good = _spread(last, self.blocks) % rounds == turn
        return good | self._hot_word(last) if self.levels else good

    def _hot_word(self, last: np.ndarray) -> np.ndarray:
        """Numbers of known words fall with their counts, so hot words have the first."""
        return (last >= 0) & (last < len(self.levels[0]["keys"]))

    def blocks_of(self, columns: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Block of each token, of which ``columns`` has itself and the words before it."""
        last = columns[1]
        block = _spread(last, self.blocks)
        if not self.levels:
            return block
        at = np.flatnonzero(self._hot_word(last))
        if len(at):
            # By the shortest context that is not hot; where there is none, nothing is counted in the block.
            chosen, open_ = joined_key(last[at], rows[at]), np.ones(len(at), bool)
            keys = _context_keys([column[at] for column in columns])
            for length in range(2, len(columns)):
                there = columns[length][at] != MISSING
                hot = _find(self.levels[length - 1]["keys"], keys[length])[1] if length <= len(self.levels) else np.zeros(len(at), bool)
                chosen = np.where(open_ & there & ~hot, keys[length], chosen)
                open_ &= there & hot
            parts = self.levels[0]["parts"][last[at]]
            block[at] = (block[at] + (joined_key(chosen, chosen).astype(np.uint64) % parts.astype(np.uint64)).astype(np.int64)) % self.blocks
        return block


def _spread(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (joined_key(keys, keys).astype(np.uint64) % np.uint64(blocks)).astype(np.int64)


def _context_keys(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers of the contexts of a token, at their lengths; ``columns``: the token and the words before it."""
    level, found = columns[1:], columns[:2]
    while len(level) > 1:
        level = [joined_key(first, last) for first, last in zip(level[1:], level)]
        found.append(level[0])
    return found


def hot_contexts(coded: DataFrame, model: Model, blocks: int, store: Store) -> tuple[Hot, list[DataFrame]]:
    """Hot contexts and, per length, ``(first, key, share)`` of what is listed after them."""
    least = max(BLOCK // 4, model.often)
    keys = np.flatnonzero(model.counts >= least)
    level = {"keys": keys, "last": keys, "parts": -(-model.counts[keys] // least)}
    levels, tables, known = [], [], model.known.filter(F.col("n") >= LEAST)
    for length in range(1, model.depth + 1):
        if not len(level["keys"]):
            break
        entries = _level(_with_key(gram_counts(coded, length + 1, level["keys"])), known)
        entries = store.save(entries.select("first", "last", "key", "n", "p", "keep", "share"), "hot")
        kept = entries.filter(F.col("keep").isNotNull())
        # One row per hot context: at most 4 * tokens / BLOCK.
        states = kept.groupBy("first").agg(F.first("keep").alias("keep")).toArrow()
        place, _ = _find(level["keys"], states.column("first").to_numpy())
        level["keep"] = np.full(len(level["keys"]), np.nan)
        level["keep"][place] = states.column("keep").to_numpy()
        levels.append(level)
        tables.append(kept.select("first", "key", "share"))
        longer = entries.filter(F.col("n") >= least).select("key", "last", "n").orderBy("key").toArrow()
        # A longer hot context ends with the hot one that lacks its first word.
        place, found = _find(level["keys"], longer.column("last").to_numpy())
        level = {"keys": longer.column("key").to_numpy()[found], "last": level["last"][place[found]], "parts": -(-longer.column("n").to_numpy()[found] // least)}
        known = entries.select("key", "n", "p")
    return Hot(levels, blocks), tables


def hot_shares(entries: DataFrame, hot, length: int) -> DataFrame:
    """Packed shares of what is listed after hot contexts of ``length`` words, for all blocks of their last word."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Hot(*hot.value)
        for batch in batches:
            first, key, share = (column.to_numpy() for column in batch.columns)
            level, words = plan.levels[length - 1], plan.levels[0]
            word = level["last"][_find(level["keys"], first)[0]]
            parts = np.minimum(words["parts"][_find(words["keys"], word)[0]], plan.blocks)
            row = np.repeat(np.arange(len(key)), parts)
            block = (_spread(word, plan.blocks)[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) % plan.blocks
            yield _packed_rows(SHARES, block, key[row], share[row])

    return entries.mapInArrow(pack, PACKED)


def _level(counted: DataFrame, known: DataFrame) -> DataFrame:
    """``(first, last, held, key, n, p, lift, keep, share)`` of all grams of this length; ``p`` (a listed word's
    probability), ``lift`` and ``keep`` where the context passes the divergence test."""
    held = known.select(F.col("key").alias("first"), F.col("n").alias("held"))
    parent = known.filter(F.col("p").isNotNull()).select(F.col("key").alias("last"), F.col("p").alias("parent"))
    rows = counted.join(parent, "last").join(held, "first").withColumn("share", (F.col("n") - DISCOUNT) / F.col("held"))
    context = Window.partitionBy("first")
    sums = {"gain": F.sum(F.col("n") * F.log(F.col("n") / F.col("held") / F.col("parent"))), "spread": F.count("*"), "listed": F.sum("n"),
            "before": F.sum("parent"), "used": F.sum("share")}
    rows = rows.select("*", *[total.over(context).alias(name) for name, total in sums.items()])
    # What is not listed is one more outcome.
    rest, before = F.greatest(1 - F.col("listed") / F.col("held"), F.lit(0.0)), F.least(F.col("before"), F.lit(1 - 1e-12))
    gain = F.col("gain") + F.when(rest > 0, F.col("held") * rest * F.log(rest / (1 - before))).otherwise(0.0)
    kept = F.col("before").isNotNull() & (2 * gain > F.col("spread") + DIVERGENCE * F.sqrt(2 * F.col("spread")))
    below = F.col("keep") * F.col("parent")
    return rows.withColumn("keep", F.when(kept, F.greatest(1 - F.col("used"), F.lit(1e-9)))).withColumn("p", F.col("share") + below).select(
        "first", "last", "held", "key", "n", "p", F.log10(F.col("p") / below).alias("lift"), "keep", "share")


def _head_level(tree: Tree, states: DataFrame, entries: DataFrame) -> dict[str, np.ndarray]:
    states, entries = states.orderBy("first").toArrow(), entries.orderBy("first", "last").toArrow()
    code, following, share = (entries.column(name).to_numpy() for name in ("first", "last", "share"))
    return {"codes": states.column("first").to_numpy(), "keep": states.column("keep").to_numpy(), "entries": code * tree.base + following, "share": share}


def local_docs(docs: DataFrame, model: Model) -> DataFrame:
    """Per text of ``docs`` (doc_id, text, train, scored): codes of its tokens and what a task knows of its base score."""
    encoder, counts = model.encoder, docs.sparkSession.sparkContext.broadcast(model.counts)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs = Encoder(encoder.value), np.append(np.log10(counts.value + 1.0), 0.0)
        for batch in batches:
            flat_words, flat, lengths = words.batch(byte_texts(batch.column(1)))
            known = flat >= 0
            ends = np.cumsum(lengths) - lengths
            base = np.add.reduceat(logs[flat], ends)
            sure = np.add.reduceat(known.astype(np.int64), ends)
            codes = _coded(flat, flat_words)
            packed = [_packed([codes[a:b]]) for a, b in zip(ends.tolist(), np.cumsum(lengths).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(lengths), pa.array(sure), pa.array(base), pa.array(packed, pa.binary())],
                names=["doc_id", "train", "scored", "n_tokens", "sure", "base", "codes"])

    schema = "doc_id bigint, train boolean, scored boolean, n_tokens bigint, sure bigint, base double, codes binary"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "train", "scored").mapInArrow(local, schema)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in a row, and the number of tokens of each."""
    lengths = batch.column("n_tokens").to_numpy()
    return np.concatenate([_unpacked(blob, 1, n)[0] for blob, n in zip(batch.column("codes").to_pylist(), lengths.tolist())]), lengths


def _marks(batch: pa.RecordBatch) -> np.ndarray:
    """1 for a training text, 2 for one to score."""
    train, scored = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("train", "scored"))
    return train + 2 * scored


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each token, and its place in it."""
    return np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _window(codes: np.ndarray, place: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The tokens ``at`` and the ``depth`` words before each."""
    before = place[at]
    return [codes[at], *[np.where(before >= distance, codes[np.maximum(at - distance, 0)], MISSING) for distance in range(1, depth + 1)]]


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, compressed byte by byte."""
    planes = np.concatenate([(column >> shift).astype(np.uint8) for column in columns for shift in range(0, 64, 8)])
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(blob: bytes, columns: int, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, columns * size * 8), np.uint8).reshape(columns, 8, size)
    found = planes[:, 0].astype(np.int64)
    for place in range(1, 8):
        if planes[:, place].any():
            found |= planes[:, place].astype(np.int64) << 8 * place
    return found


def _packed_rows(kind: int, at: np.ndarray, keys: np.ndarray, amounts: np.ndarray) -> pa.RecordBatch:
    """A row per place ``at`` with its numbers and amounts."""
    order = np.argsort(at, kind="stable")
    at, keys, amounts = at[order], keys[order], amounts[order].astype(np.float64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    pieces = list(zip(starts.tolist(), [*starts[1:].tolist(), len(at)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(starts), kind, np.int32)), pa.array(at[starts].astype(np.int64)), pa.array([keys[a:b].tobytes() for a, b in pieces], pa.binary()),
         pa.array([amounts[a:b].tobytes() for a, b in pieces], pa.binary())], names=["kind", "at", "keys", "amounts"])


def _packed_sums(kind: int, rows: np.ndarray, amounts: np.ndarray) -> pa.RecordBatch:
    """Amounts added per text, a row per chunk of texts."""
    texts, text_of = np.unique(rows, return_inverse=True)
    return _packed_rows(kind, texts >> CHUNK_BITS, (texts & (1 << CHUNK_BITS) - 1).astype(np.uint16), np.bincount(text_of, amounts, len(texts)))


def _unpacked_rows(table: pa.Table, kind: int, number: type) -> tuple[np.ndarray, np.ndarray]:
    rows = table.filter(pc.equal(table.column("kind"), kind))
    return tuple(np.frombuffer(b"".join(rows.column(name).to_pylist()), of) for name, of in (("keys", number), ("amounts", np.float64)))


def _dealt(block: np.ndarray, blocks: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row per block with its packed columns."""
    order = np.argsort(block.astype(np.uint16 if blocks < 1 << 16 else np.int64), kind="stable")
    block, columns = block[order], [column[order] for column in columns]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    stops = np.append(starts[1:], len(block))
    return pa.RecordBatch.from_arrays(
        [pa.array(block[starts]), pa.array(stops - starts),
         pa.array([_packed([column[a:b] for column in columns]) for a, b in zip(starts.tolist(), stops.tolist())], pa.binary())],
        names=["block", "size", "tokens"])


def dealt_tokens(coded: DataFrame, hot, depth: int, rounds: int, turn: int) -> DataFrame:
    """``(block, size, tokens)``: packed texts, marks and windows of the tokens of the blocks of round ``turn``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Hot(*hot.value)
        waiting, held = [], 0

        def out() -> pa.RecordBatch:
            block, *columns = (np.concatenate(part) for part in zip(*waiting))
            return _dealt(block, plan.blocks, columns)

        for batch in batches:
            codes, lengths = _codes(batch)
            text, place = _places(lengths)
            at, rows = np.flatnonzero(place > 0), batch.column("row").to_numpy()
            at = at[plan.may_be_in(codes[at - 1], rounds, turn)]
            columns = _window(codes, place, at, depth)
            block = plan.blocks_of(columns, rows[text[at]])
            here = block % rounds == turn
            waiting.append([column[here] for column in (block, (4 * rows + _marks(batch))[text[at]], *columns)])
            held += int(here.sum())
            if held > FLUSH_TOKENS:
                yield out()
                waiting, held = [], 0
        if held:
            yield out()

    return coded.select("row", "train", "scored", "n_tokens", "codes").mapInArrow(deal, "block bigint, size bigint, tokens binary")


def rare_words(coded: DataFrame, model: Model, hot, blocks: int) -> DataFrame:
    """Packed rows: what rare words add to base scores and known tokens, and their counts for the blocks that need them."""
    usual, depth = len(model.counts), model.depth

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Hot(*hot.value)
        waiting, held = [], 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(part) for part in zip(*waiting)]
            return _dealt(_spread(columns[2], blocks), blocks, columns)

        for batch in batches:
            codes, lengths = _codes(batch)
            text, place = _places(lengths)
            at, rows = np.flatnonzero((codes < 0) | (codes >= usual)), batch.column("row").to_numpy()
            marks = _marks(batch)[text[at]]
            # Texts to score need counts too: what follows a hot context may be listed from other blocks.
            block = np.where(place[at] > 0, plan.blocks_of(_window(codes, place, at, depth), rows[text[at]]), -1)
            waiting.append([rows[text[at]], marks, codes[at], block])
            held += len(at)
            if held > FLUSH_TOKENS:
                yield out()
                waiting, held = [], 0
        if held:
            yield out()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, marks, keys, block = _joined_blobs(left, 4)
        words, times = right.column("key").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(words)
        place, found = _find(words[order], keys)
        n = np.where(found, times[order][place] if len(words) else 0, 0)
        wanted, needed = marks >= 2, np.flatnonzero((block >= 0) & (n >= LEAST))
        # A word once per block.
        needed = needed[np.lexsort((keys[needed], block[needed]))]
        new = np.ones(len(needed), bool)
        new[1:] = (keys[needed][1:] != keys[needed][:-1]) | (block[needed][1:] != block[needed][:-1])
        needed = needed[new]
        return pa.Table.from_batches([
            _packed_sums(BASE, rows[wanted], np.log10(n[wanted] + 1.0)), _packed_sums(KNOWN, rows[wanted], found[wanted].astype(float)),
            _packed_rows(COUNTS, block[needed], keys[needed], n[needed])])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_spread(batch.column(0).to_numpy(), blocks)), *batch.columns], names=["block", "key", "n"])

    tokens = coded.select("row", "train", "scored", "n_tokens", "codes").mapInArrow(deal, "block bigint, size bigint, tokens binary")
    rare = model.known.filter((F.col("key") < 0) | (F.col("key") >= usual)).select("key", "n").mapInArrow(spread, "block bigint, key bigint, n bigint")
    return tokens.groupBy("block").cogroup(rare.groupBy("block")).applyInArrow(look_up, PACKED)


def _joined_blobs(table: pa.Table, columns: int) -> np.ndarray:
    sizes = table.column("size").to_pylist()
    found, start = np.empty((columns, sum(sizes)), np.int64), 0
    for blob, size in zip(table.column("tokens"), sizes):
        found[:, start:start + size] = _unpacked(blob.as_py(), columns, size)
        start += size
    return found


def _block_scores(counts: np.ndarray, size: float, hot: Hot, depth: int, tokens: pa.Table, given: pa.Table) -> pa.RecordBatch:
    """Sums per text over a block's tokens: the logarithm of a token's probability over its root's."""
    rows, *columns = (column.copy() for column in _joined_blobs(tokens, depth + 2))
    rows, marks = rows >> 2, (rows & 3).astype(np.int8)
    (words, times), (listed_hot, share_hot) = (_sorted(*_unpacked_rows(given, kind, np.int64)) for kind in (COUNTS, SHARES))
    following = columns[0]
    place, rare = _find(words, following)
    times = np.append(times, 0.0)[np.where(rare, place, len(times))]
    usual = (following >= 0) & (following < len(counts))
    root = np.where(usual, counts[np.where(usual, following, 0)] if len(counts) else 0, times) + 1
    root = root / size
    before, level_keys = sum((column != MISSING).astype(np.int8) for column in columns[1:]), columns
    trained = (marks & 1).astype(float)
    del columns  # as are the keys of a length below, when no longer needed
    ratio, listed, at = np.ones(len(rows)), np.ones(len(rows), bool), np.arange(len(rows))
    for length in range(1, depth + 1):
        at = at[before[at] >= length]
        context = level_keys[1][at]
        level_keys = [joined_key(first, last) for first, last in zip(level_keys[1:], level_keys)]
        entry = level_keys[0][at]
        keep, share = np.full(len(at), np.nan), np.full(len(at), np.nan)
        cold = np.ones(len(at), bool)
        if length <= len(hot.levels):
            level = hot.levels[length - 1]
            place, is_hot = _find(level["keys"], context)
            cold = ~is_hot
            keep[is_hot] = level["keep"][place[is_hot]]
            place, found = _find(listed_hot, np.where(is_hot, entry, 0))
            found &= is_hot
            share[found] = share_hot[place[found]]
        here = at[cold]
        state, state_of = _numbered(context[cold])
        # Only what the suffix lists can be listed.
        may = np.flatnonzero(listed[here])
        first, entry_of = _numbered(entry[cold][may])
        held, n = np.bincount(state_of, trained[here], len(state)), np.bincount(entry_of, trained[here[may]], len(first))
        chosen = np.flatnonzero(n >= LEAST)
        example = may[first[chosen]]
        of, seen, parent = state_of[example], n[chosen], ratio[here[example]] * root[here[example]]
        part = (seen - DISCOUNT) / held[of]
        weight, kept = _tested(held, of, seen, parent, part)
        keep[cold] = np.where(kept, weight, np.nan)[state_of]
        shares = np.full(len(first), np.nan)
        shares[chosen] = np.where(kept[of], part, np.nan)
        share[np.flatnonzero(cold)[may]] = shares[entry_of]
        alive = ~np.isnan(keep)
        at, keep, share = at[alive], keep[alive], share[alive]
        listed[at] = ~np.isnan(share)
        ratio[at] = keep * ratio[at] + np.where(listed[at], share / root[at], 0.0)
    wanted = marks >= 2
    return _packed_sums(LIFTED, rows[wanted], np.log10(ratio[wanted]))


def _sorted(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], amounts[order]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and for all keys the number of theirs."""
    order = np.argsort(keys)
    found = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _tested(held: np.ndarray, of: np.ndarray, n: np.ndarray, parent: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix weights of contexts and whether they pass the divergence test; the other arrays are of listed next words."""
    spread, listed, before, used, gain = (
        np.bincount(of, values, len(held)) for values in (np.ones(len(of)), n, parent, share, n * np.log(n / held[of] / parent)))
    # What is not listed is one more outcome.
    rest = np.maximum(1 - listed / np.maximum(held, 1), 0.0)
    gain = gain + held * np.where(rest > 0, rest * np.log(np.where(rest > 0, rest, 1) / (1 - np.minimum(before, 1 - 1e-12))), 0.0)
    return np.maximum(1 - used, 1e-9), (spread > 0) & (2 * gain > spread + DIVERGENCE * np.sqrt(2 * spread))


def lifted_texts(tokens: DataFrame, given: DataFrame, model: Model, hot) -> DataFrame:
    """Packed rows: what the tree adds to the scores of texts, from the tokens of each block."""
    counts, size, depth = tokens.sparkSession.sparkContext.broadcast(model.counts), model.total + model.distinct + 1.0, model.depth

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_block_scores(counts.value, size, Hot(*hot.value), depth, left, right)])

    return tokens.groupBy("block").cogroup(given.groupBy("at")).applyInArrow(block, PACKED)


def _added(group: pa.Table) -> pa.Table:
    """Sums of the texts of a chunk."""
    texts, sums = [], []
    for kind in (BASE, KNOWN, LIFTED):
        rows, amounts = _unpacked_rows(group, kind, np.uint16)
        texts.append(rows)
        sums.append(np.bincount(rows, amounts, 1 << CHUNK_BITS).astype(np.float64))  # whole numbers where there are no rows
    there = np.unique(np.concatenate(texts)).astype(np.int64)
    base, known, lifted = (amounts[there] for amounts in sums)
    return pa.table({"row": (group.column("at")[0].as_py() << CHUNK_BITS) + there, "rare_base": base, "rare_known": known.astype(np.int64), "lifted": lifted})


def chunk_sums(packed: DataFrame) -> DataFrame:
    return packed.groupBy("at").applyInArrow(_added, "row bigint, rare_base double, rare_known bigint, lifted double")


def score(docs: DataFrame, model: Model, store: Store, trained: Column | None = None) -> DataFrame:
    """``(row, doc_id, n_tokens, n_known, base_score, score)`` per row of ``docs``. ``trained``: which of them the model
    learned from, where it learned from no others; else its own training texts are read."""
    spark, scale = store.spark, math.log10(model.total + model.distinct + 1)
    texts = docs.select("doc_id", "text", (F.lit(False) if trained is None else trained).alias("train"), F.lit(True).alias("scored"))
    if trained is None:
        texts = texts.unionByName(model.docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(True).alias("train"), F.lit(False).alias("scored")))
    local = store.save(local_docs(texts, model).withColumn("row", F.monotonically_increasing_id()), "local")
    blocks = max(1, -(-(local.agg(F.sum("n_tokens")).first()[0] or 0) // BLOCK))
    plan, tables = hot_contexts(local.filter("train").select("n_tokens", "codes"), model, blocks, store)
    # Plain values: the tasks build the object.
    hot = spark.sparkContext.broadcast((plan.levels, plan.blocks))
    added = store.save(rare_words(local, model, hot, blocks), "rare")
    given = added.filter(F.col("kind") == COUNTS)
    for length, table in enumerate(tables, 1):
        given = given.unionByName(hot_shares(table, hot, length))
    rounds, sums = min(ROUNDS, blocks), [store.save(chunk_sums(added.filter(F.col("kind") != COUNTS)), "sums")]
    for turn in range(rounds):
        tokens, part = dealt_tokens(local, hot, model.depth, rounds, turn), given.filter(F.col("at") % rounds == turn)
        path = store.path("lifted")
        lifted_texts(tokens, part, model, hot).write.parquet(path)
        sums.append(store.save(chunk_sums(spark.read.schema(PACKED).parquet(path)), "sums"))
        store.delete(path)
    parts = functools.reduce(DataFrame.unionByName, sums).groupBy("row").agg(*[F.sum(name).alias(name) for name in ("rare_base", "rare_known", "lifted")])
    found = local.filter("scored").select("row", "doc_id", "n_tokens", "sure", "base")
    joined = found.join(parts, "row", "left")
    base: Column = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)
    more = F.coalesce("lifted", F.lit(0.0))
    return joined.select("row", "doc_id", "n_tokens", (F.col("sure") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                         base.alias("base_score"), (base + more).alias("score"))


def held_out(doc_id: Column, rule: tuple[int, int] = HELD_OUT) -> Column:
    return F.coalesce(doc_remainder(doc_id, rule[0]) == rule[1], F.lit(False))


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a step go when it is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def op8(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    docs, store = read(spark, sf_dir, "documents").select("doc_id", "text"), Store(spark, "suffixes")
    with short_shuffles(spark):
        model = train(docs.filter(~held_out(F.col("doc_id"))), store)
        scored = score(docs, model, store, ~held_out(F.col("doc_id")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")
