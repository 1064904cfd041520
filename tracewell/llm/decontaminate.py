"""Benchmark passages in documents, found by a generalised suffix automaton of the benchmark's words.

A document's words run through the automaton, which keeps the longest suffix that also occurs in an item. Where
that is at least a window long, the last ``WINDOW`` words are an item's window; an item of fewer words is a window
as a whole. The automaton is built in blocks of items of bounded size, so any benchmark fits; documents pass one
block after another in one plan.

Defined cases: null and empty texts have no words; items without words match nothing; a null item id is the empty
string; items that share an id are one item; an empty benchmark hits nothing; repeated rows are judged one by one. Texts
of any length are read whole; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import Store, byte_texts, numbered, prepared, read

WINDOW = 10
# Words of one automaton: about 100 MB of a Python worker at most.
BLOCK_WORDS = 100_000
# Fixed value: bytes that belong to no word become blanks, A-Z become a-z, all others stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "struct<n_words:bigint,n_hit:bigint,mask:binary,items:array<string>>"


class SuffixAutomaton:
    """All word sequences that occur in any of the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        encoded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, tokens in encoded:
            self._insert(tokens)
        self.shortest = min((min(window, len(tokens)) for _, tokens in encoded), default=window)
        self._place(encoded)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, parent: int, token: int) -> int:
        """The state of ``parent`` + ``token``, as one whose longest sequence is just that long."""
        child = self.next[parent][token]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(token) == child:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _insert(self, tokens: list[int]) -> None:
        last = 0
        for token in tokens:
            if token in self.next[last]:  # an earlier item went this way
                last = self._split(last, token)
                continue
            fresh = self._state(self.length[last] + 1, 0, {})
            at = last
            while at >= 0 and token not in self.next[at]:
                self.next[at][token] = fresh
                at = self.link[at]
            if at >= 0:
                self.link[fresh] = self._split(at, token)
            last = fresh

    def _place(self, encoded: list[tuple[str, list[int]]]) -> None:
        """Where windows end: ``anchor`` leads a state to that of its last ``window`` words; ``owners`` names the
        items of a window; ``short`` lists the short items that end in a state, with their lengths."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.anchor = [-1] * len(self.length)
        for state in order:
            if self.length[state] >= self.window:
                above = self.link[state]
                self.anchor[state] = state if self.length[above] < self.window else self.anchor[above]
        self.owners: dict[int, set[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        for name, tokens in encoded:
            state = 0
            for count, token in enumerate(tokens, 1):
                state = self.next[state][token]
                if count >= self.window:
                    self.owners.setdefault(self.anchor[state], set()).add(name)
            if len(tokens) < self.window:
                ends.setdefault(state, []).append((len(tokens), name))
        self.short: dict[int, list[tuple[int, str]]] = {}
        if ends:
            for state in order:
                found = ends.get(state, []) + self.short.get(self.link[state], [])
                if found:
                    self.short[state] = found

    def scan(self, words: list[bytes], mask: np.ndarray, names: set[str]) -> None:
        """Mark the words inside windows in ``mask`` and add the names of their items."""
        get = self.vocabulary.get
        tokens = np.array([get(word, -1) for word in words], np.int64)
        # Only runs of known words that are long enough to hold a window can match.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], tokens >= 0, [False]])))
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start >= self.shortest:
                self._run(tokens[start:end].tolist(), mask[start:end], names)

    def _run(self, tokens: list[int], mask: np.ndarray, names: set[str]) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state, matched = 0, 0
        for at, token in enumerate(tokens, 1):
            while token not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state][token]
            matched += 1
            if matched >= window:
                mask[at - window:at] = True
                names |= self.owners[self.anchor[state]]
            for size, name in self.short.get(state, ()):
                if size <= matched:
                    mask[at - size:at] = True
                    names.add(name)


def fold_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def item_blocks(items: DataFrame, store: Store, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words, or one longer item. One block at a time is in memory."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORDS)).cast("bigint")
    facts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text", words.alias("words"))
    lined = numbered(facts, [F.col("name"), F.col("words"), F.xxhash64("text")], store, "items", size="words")
    # A block ends before it would exceed the limit: blocks are cut by where an item starts and ends.
    whole = F.floor((F.col("before") + F.col("words")) / F.lit(block_words))
    lined = store.save(lined.withColumn("block", whole), "blocks")
    for row in lined.select("block").distinct().orderBy("block").toLocalIterator():
        block = lined.filter(F.col("block") == row["block"]).select("name", "text").toArrow().combine_chunks()
        texts = byte_texts(block.column("text").combine_chunks()) if block.num_rows else []
        yield [(name, fold_words(text)) for name, text in zip(block.column("name").to_pylist(), texts)]


def _scanner(items: list[tuple[str, list[bytes]]], window: int):
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = SuffixAutomaton(items, window)
        for texts, masks, earlier in batches:
            rows = []
            for text, packed, known in zip(byte_texts(texts), masks.to_pylist(), earlier.to_pylist()):
                words = fold_words(text)
                mask = np.zeros(len(words), bool)
                if packed:
                    mask |= np.unpackbits(np.frombuffer(packed, np.uint8), count=len(words)).astype(bool)
                names = set(known or ())
                automaton.scan(words, mask, names)
                hits = int(mask.sum())
                rows.append((len(words), hits, np.packbits(mask).tobytes() if hits else None, sorted(names)))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()),
                 pa.array(columns[3], pa.list_(pa.string()))], names=["n_words", "n_hit", "mask", "items"])

    return scan


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, masks: pa.Array) -> pa.Array:
    """Text without its marked words; white space around a removed span becomes one blank."""
    out = []
    for text, packed in zip(byte_texts(texts), masks.to_pylist()):
        if text and packed:
            folded = text.translate(FOLD)
            mask = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
            kept, at, open_since = [], 0, None
            for hit, word in zip(mask, folded.split()):
                start = folded.index(word, at)
                if hit and open_since is None:
                    open_since = start
                    kept.append(text[at:start])
                elif not hit:
                    if open_since is None:
                        kept.append(text[at:start])
                    elif kept and not kept[-1].endswith((b" ", b"\n")):
                        kept.append(b" ")
                    kept.append(text[start:start + len(word)])
                    open_since = None
                at = start + len(word)
            if open_since is None:
                kept.append(text[at:])
            text = b"".join(kept).strip()
        out.append(text)
    return pa.array(out, pa.binary()).cast(pa.string(), safe=False)


def contamination(docs: DataFrame, items: DataFrame, store: Store, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``found`` (n_words, n_hit, mask of hit words, ids of the items found in order).

    With more than one block the marks so far are stored before the next is scanned: a task holds one automaton at any
    size of the benchmark, and the plan does not grow with the blocks. The step before is removed then.
    """
    mask, names = F.lit(None).cast("binary"), F.array().cast("array<string>")
    marked = older = None
    for block in item_blocks(items, store, block_words):
        if marked is not None:
            path = store.path("marks")
            marked.write.parquet(path)
            marked = store.spark.read.schema(marked.schema).parquet(path)
            if older:
                store.delete(older)
            older = path
        marked = (docs if marked is None else marked).withColumn("found", _scanner(block, window)("text", mask, names))
        mask, names = F.col("found.mask"), F.col("found.items")
    return marked if marked is not None else docs.withColumn("found", _scanner([], window)("text", mask, names))


def decontaminate(docs: DataFrame, items: DataFrame, store: Store, max_coverage: float = 0.5, least_words: int = WINDOW) -> DataFrame:
    """Documents with fewer than ``least_words`` hit words stay as they are, those whose hit share exceeds
    ``max_coverage`` go, and all others lose their hit spans. Columns stay as they are."""
    wrapped = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    marked = contamination(wrapped, items, store)
    hits = F.col("found.n_hit")
    enough = hits >= least_words
    kept = marked.filter(~enough | (hits <= F.col("found.n_words") * F.lit(max_coverage)))
    if max_coverage <= 0:
        return kept.select("_row.*")
    cut: Column = F.when(enough, _without("text", F.col("found.mask"))).otherwise(F.col("text"))
    return kept.select(F.col("_row").withField("text", cut).alias("_row")).select("_row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, sf_dir, "benchmark"), Store(spark, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH folded_items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM folded_items WHERE len(w) > 0)),
folded_docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded_docs, sizes WHERE len(w) >= n)),
hits AS (SELECT s.r, s.i, s.n, x.item FROM spans s JOIN windows x ON s.n = x.n AND s.win = x.win),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded_docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
