"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

Documents of one shingle set are one class. A class posts itself under (coordinate, value) pairs of its signature.
Two classes of similarity 0.75 agree in 32 of 64 coordinates or more, all but 4.6 in a million pairs. So a class need not be posted under its most
frequent pairs: of the pairs it shares with any other class, rarest first, all but the last 31 are enough to meet
everyone it agrees with in 32 (prefix), and pairs that no other class has are left out before (skip). Candidates are
compared by size and signature, those that agree in 32 coordinates by their full sets.

Links, not pairs, are what a component needs. First every posting list falls into small random groups, others for
each coordinate and round, whose members are compared with one of them: a few dozen comparisons for each member
join all groups of copies but for stragglers. For lists that still hold several components the inverted join is made
again on the full sets: a link shares three quarters of either set, so a class is posted under its shared shingles,
rarest first, but for that many; stragglers with more shingles of their own are not posted at all. Members outside the
largest component of such a list are compared with those of other components, in blocks of bounded size that return
links alone. Whatever was not compared then lies in one component already, so no link is lost, and a group of copies
costs about as many comparisons as it has members, and as many again for each straggler.

Defined cases: null texts and texts without words have no shingles and link with nothing; a text of fewer than five
words is one shingle; repeated rows are copies; a null id counts as larger than any other, and a component of null
ids alone has a null id and is kept; an empty table gives no rows. Texts of any length are shingled whole; other columns
stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Store, byte_texts, prepared, read

SHINGLE = 5
SIMILARITY = 75  # per cent
COORDINATES = 64
MATCHES = 32
ROUNDS, GROUP = 2, 4  # rounds of random groups, and their size
DICTIONARY_WORDS = 1_000_000  # words whose hashes a task remembers before it starts anew
ROWS_AT_ONCE = 4096
BLOCK_SHINGLES = 200_000  # of the sets that a block of stragglers or members holds

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _STEP
    values = (values ^ (values >> np.uint64(32))) * _STEP
    return values ^ (values >> np.uint64(32))


_SEEDS = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _ODD)
_FACTORS, _OFFSETS = _SEEDS[:COORDINATES] | np.uint64(1), _SEEDS[COORDINATES:]


class WordHashes(dict):
    """64-bit hash of a word, made once per word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= DICTIONARY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    rows = len(words) - size + 1
    total = np.full(rows, size, np.uint64)
    for k in range(size):
        total = total * _ODD + values[k:k + rows]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate the smallest hash, mixed with the coordinate's number into one 64-bit key."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), ROWS_AT_ONCE):
        part = shingles[start:start + ROWS_AT_ONCE]
        np.minimum(low, (part[:, None] * _FACTORS + _OFFSETS).min(axis=0), out=low)
    return _mix(low + np.arange(COORDINATES, dtype=np.uint64) * _ODD).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_shingles, class_key, tokens)``; class key and tokens are null for texts without words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for text in byte_texts(batch.column(2)):
                shingles = shingle_set(text, hashes)
                sizes.append(len(shingles))
                keys.append(hashlib.md5(shingles).digest() if len(shingles) else None)
                tokens.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "class_key", "tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), F.col("text").cast("string"))
    return texts.mapInArrow(make, "doc_id bigint, text_key bigint, n_shingles bigint, class_key binary, tokens array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``(class_key, shingles)`` of documents, one row each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, hashes) for text in byte_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(s).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class_key", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(make, "class_key binary, shingles array<bigint>")


def postings(classes: DataFrame, store: Store) -> DataFrame:
    """``(token, held, cid, n_shingles)``: each class under the tokens by which it can meet a class it agrees with.
    ``held`` is the number of classes that have the token."""
    tokens = classes.select("cid", "n_shingles", F.explode("tokens").alias("token"))
    shared = store.save(tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1"), "shared")
    by_class = tokens.join(shared, "token").groupBy("cid", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("listed"))
    prefix = F.slice("listed", F.lit(1), F.greatest(F.size("listed") - (MATCHES - 1), F.lit(0)))
    return store.save(by_class.filter(F.size("listed") >= MATCHES).select("cid", "n_shingles", F.explode(prefix).alias("entry"))
                      .select("entry.token", "entry.held", "cid", "n_shingles"), "postings")


def components(edges: DataFrame, labels: DataFrame, store: Store) -> DataFrame:
    """``labels`` (cid, comp) with components that ``edges`` (a, b) join merged: the smallest comp wins.

    Each round a component takes the smallest label among its neighbours', then the labels that one and the next take.
    """
    while True:
        left = labels.select(F.col("cid").alias("a"), F.col("comp").alias("comp_a"))
        right = labels.select(F.col("cid").alias("b"), F.col("comp").alias("comp_b"))
        open_ = edges.join(left, "a").join(right, "b").filter("comp_a <> comp_b")
        ends = open_.select(F.greatest("comp_a", "comp_b").alias("comp"), F.least("comp_a", "comp_b").alias("to"))
        hooks = store.save(ends.groupBy("comp").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return labels
        onward = hooks.select(F.col("comp").alias("to"), F.col("to").alias("next"))
        for _ in range(2):  # a hook of a hook, and that hook's
            hooks = hooks.join(onward, "to", "left").select("comp", F.coalesce("next", "to").alias("to"))
        labels = store.save(labels.join(hooks, "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp")), "labels")


def posted_sets(docs: DataFrame, classes: DataFrame, posts: DataFrame, store: Store) -> DataFrame:
    """``(cid, shingles)`` of the posted classes, from one pass over the documents that stand for them."""
    keys = store.save(posts.select("cid").distinct().join(classes, "cid").select("cid", "rep", "class_key"), "keys")
    texts = docs.select("doc_id", "text").join(keys.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if not keys.filter("rep IS NULL").isEmpty():
        texts = texts.unionByName(docs.select("doc_id", "text").filter("doc_id IS NULL"))
    sets = full_sets(texts).join(keys, "class_key").groupBy("cid").agg(F.any_value("shingles").alias("shingles"))
    return store.save(sets, "sets")


class Confirmation:
    """Compares candidate pairs of classes: first signatures, then the full sets."""

    def __init__(self, classes: DataFrame, sets: DataFrame, store: Store) -> None:
        self.classes, self.sets, self.store = classes, sets, store
        self.tested: DataFrame | None = None

    def _both(self, pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
        one = values.select(F.col("cid").alias("a"), F.col(name).alias("one"))
        other = values.select(F.col("cid").alias("b"), F.col(name).alias("other"))
        return pairs.join(other, "b").join(one, "a")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a < b) that link. Pairs compared before are not compared again."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self.store.save(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        common = F.size(F.array_intersect("one", "other"))
        near = self._both(pairs, self.classes, "tokens").filter(common >= MATCHES).select("a", "b")
        full = self._both(self.store.save(near, "near"), self.sets, "shingles")
        linked = 100 * common >= SIMILARITY * (F.size("one") + F.size("other") - common)
        return self.store.save(full.filter(linked).select("a", "b"), "links")


def _pair(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def class_components(docs: DataFrame, classes: DataFrame, store: Store) -> DataFrame:
    """``(cid, comp)`` for the classes that are posted at all."""
    posts = postings(classes, store)
    sets = posted_sets(docs, classes, posts, store)
    confirm = Confirmation(classes, sets, store)
    labels = store.save(posts.select("cid").distinct().withColumn("comp", F.col("cid")), "labels")

    for turn in range(ROUNDS):
        slots = F.greatest(F.lit(1), F.floor(F.col("held") / GROUP))
        placed = posts.join(labels, "cid").withColumn("slot", F.pmod(F.xxhash64("cid", "token", F.lit(turn)), slots))
        first = store.save(placed.groupBy("token", "slot").agg(F.min(F.struct("cid", "comp")).alias("first"), F.count("*").alias("n"))
                           .filter("n > 1").select("token", "slot", F.col("first.cid").alias("one"), F.col("first.comp").alias("comp_one")), "first")
        pairs = placed.join(first, ["token", "slot"]).filter("comp <> comp_one").select(*_pair(F.col("cid"), F.col("one")))
        labels = components(confirm.links(pairs), labels, store)

    # Lists within one component are settled. The members of all others meet again by their full sets.
    placed = store.save(posts.join(labels, "cid"), "placed")
    active = _apart(placed, store).select("cid", "comp", "n_shingles").distinct()
    shingles = store.save(active, "active").join(sets, "cid").select("cid", "comp", "n_shingles", F.explode("shingles").alias("token"))
    shared = store.save(shingles.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1"), "shared")
    listed = shingles.join(shared, "token").groupBy("cid", "comp", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("held", "token"))).alias("listed"))  # one set at most
    spare = F.size("listed") - F.ceil(F.col("n_shingles") * SIMILARITY / 100).cast("int")
    prefix = F.slice("listed", F.lit(1), F.greatest(spare + 1, F.lit(0)))
    again = listed.filter(spare >= 0).select("cid", "comp", "n_shingles", F.explode(prefix).alias("entry"))
    members = _apart(store.save(again.select("entry.token", "cid", "comp", "n_shingles"), "again"), store)
    return components(store.save(straggler_links(members, sets), "links"), labels, store)


def straggler_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members outside the largest component of a list and those of other components.

    All lists with one largest component are compared at once. Its stragglers and members are dealt into blocks by
    hash, as many as their sets need, and every block of stragglers meets every block.
    """
    met = members.groupBy("largest", "cid", "comp").agg(F.any_value("n_shingles").alias("n"))
    blocks = met.groupBy("largest").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("comp") != F.col("largest"), F.col("n"))) / BLOCK_SHINGLES).cast("int")).alias("outer"))
    dealt = met.join(blocks, "largest").join(sets, "cid")
    row = ["largest", "cid", "comp", "shingles"]
    outside = dealt.filter("comp <> largest").select(
        *row, F.pmod(F.xxhash64("cid"), F.col("outer")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    inside = dealt.select(
        *row, F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("j"))
    key = ["largest", "i", "j"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _block_links(left, right) if left.num_rows and right.num_rows else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(np.minimum(*found), pa.int64()), "b": pa.array(np.maximum(*found), pa.int64())})

    names = [*row, "i", "j"]  # columns of their own on either side of the cogroup
    left = outside.withColumn("i", F.col("i").cast("int")).toDF(*names).groupBy(*key)
    right = inside.withColumn("j", F.col("j").cast("int")).toDF(*names).groupBy(*key)
    return left.cogroup(right).applyInArrow(compare, "a bigint, b bigint").distinct()


def _sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, all shingles in a row, and where each set ends."""
    lists = table.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return (table.column("cid").to_numpy(), table.column("comp").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False), ends)


def _block_links(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of different components between two blocks, by the sizes of their sets' intersections."""
    ids, comps, values, ends = _sets_of(left)
    other_ids, other_comps, other_values, other_ends = _sets_of(right)
    vocabulary, codes = np.unique(other_values, return_inverse=True)
    starts, sizes = np.concatenate([[0], other_ends[:-1]]), np.diff(other_ends, prepend=0)
    one, other = [], []
    for cid, comp, start, end in zip(ids, comps, np.concatenate([[0], ends[:-1]]), ends):
        own = values[start:end]
        place = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        marked = np.zeros(len(vocabulary), np.int32)
        marked[place[vocabulary[place] == own]] = 1
        common = np.add.reduceat(marked[codes], starts)
        hit = (100 * common >= SIMILARITY * (sizes + len(own) - common)) & (other_comps != comp)
        one += [cid] * int(hit.sum())
        other.append(other_ids[hit])
    return np.array(one, np.int64), np.concatenate(other).astype(np.int64)


def _apart(placed: DataFrame, store: Store) -> DataFrame:
    """Members of the lists (token) that hold several components, with the ``largest`` of each list; stored."""
    counts = placed.groupBy("token", "comp").agg(F.count("*").alias("n"))
    lists = counts.groupBy("token").agg(F.count("*").alias("apart"), F.max(F.struct("n", "comp"))["comp"].alias("largest"))
    lists = store.save(lists.filter("apart > 1").drop("apart"), "lists")
    return store.save(placed.join(lists, "token"), "members")


def near_duplicates(docs: DataFrame, store: Store) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component, component_id)`` per row of ``docs`` (doc_id, text).

    ``component`` numbers the components and is null for texts that link with nothing for want of words;
    ``component_id`` is the smallest id of the component.
    """
    sketched = store.save(sketches(docs), "sketches")
    worded = sketched.filter("class_key IS NOT NULL")
    grouped = worded.groupBy("class_key").agg(
        F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("tokens").alias("tokens"))
    classes = store.save(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = class_components(docs, classes, store)
    named = classes.select("cid", "class_key", "rep").join(labels, "cid", "left").withColumn("component", F.coalesce("comp", "cid"))
    named = store.save(named.drop("comp"), "named")
    smallest = store.save(named.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    # Stored first: both sides of the next join are plain scans, so a class of any size can be split.
    member = store.save(named.join(smallest, "component").select("class_key", "component", "component_id"), "member")
    columns = ["doc_id", "text_key", "n_shingles", "component", "component_id"]
    alone = sketched.filter("class_key IS NULL").withColumn("component", F.lit(None).cast("bigint")).withColumn("component_id", F.col("doc_id"))
    return worded.join(member, "class_key").select(columns).unionByName(alone.select(columns))


def keep_first(docs: DataFrame, store: Store) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; texts without words all stay."""
    wrapped = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    found = store.save(near_duplicates(docs.select("doc_id", "text"), store), "found")
    chosen = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    first = found.filter("component IS NOT NULL").groupBy("component").agg(chosen.alias("first")).select("first.doc_id", "first.text_key")
    alone = found.filter("component IS NULL").select("doc_id", "text_key").distinct()
    keys = store.save(first.withColumn("one", F.lit(True)).unionByName(alone.withColumn("one", F.lit(False))), "first")
    rows = wrapped.join(keys, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    repeated = found.filter("component IS NOT NULL").join(
        keys.filter("one").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).groupBy("_id", "_key").count().filter("count > 1")
    if not repeated.isEmpty():  # rows of one id and text: any one of them stands for all
        rows = rows.filter("NOT one").unionByName(rows.filter("one").dropDuplicates(["_id", "_key"]))
    return rows.select("_row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), Store(spark, "neardup"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d JOIN smallest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
