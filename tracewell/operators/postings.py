"""Word search as a join on the word: postings of items against words of questions.

Items are dealt to parts by a hash. A part holds all postings of its items and a copy of the questions' words, so the
join on (part, word), the sums per (question, item) and the best k of each question in the part need no further
shuffle: what is shuffled is postings of the words asked for, once, and parts x questions x k rows. A word that every
item holds is spread over all parts.

The commonest words would pair nearly all questions with nearly all items. Up to ``COMMON_WORDS`` of them are left out
of the join. Each is a bit of its items and of its questions: the bits both have bound what they can add to a pair that
rarer words found, and only pairs that may be among the best get their exact weight. An item that shares common words
alone cannot score more than these weigh together; a question whose k-th hit scores more is settled. The few others
are asked again with all their words. Results are exact either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.privacy import bind
from tracewell.operators.blocks import rank_hits
from tracewell.session import stored

SCORE_DIGITS = 6
COMMON_WORDS = 63
COMMON_SHARE = 0.05
COMMON_ITEMS = 20_000  # words of fewer items are never common: they pair up little
WHOLE = ""  # the word that counts every item; texts have no empty words

# Weight of one posting from the times its word occurs in the item and the item's length.
Weigh = Callable[[Column, Column], Column]


def word_counts(words: Column) -> Column:
    """``array<struct<word, times>>`` of the distinct words of an array."""

    def count(ordered: Column) -> Column:
        at = lambda i: F.get(ordered, i)
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.when(F.size(ordered) > 0, F.filter(places, lambda i: (i == 0) | (at(i) != at(i - 1)))).otherwise(F.array().cast("array<int>"))
        return bind(starts, lambda s: F.transform(
            s, lambda start, i: F.struct(at(start).alias("word"), (F.coalesce(F.get(s, i + 1), F.size(ordered)) - start).alias("times"))))

    return bind(F.sort_array(words), count)


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def asked_postings(indexed: DataFrame, terms: DataFrame, live: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(item_id, insert_seq, word, times, length)`` of the words asked for, and one row of the word ``WHOLE`` per item.

    ``indexed`` has item_id, insert_seq, length and counts (:func:`word_counts`). ``live`` leaves out rows of items
    that do not count; it sees further columns of ``indexed`` as well.
    """
    whole = F.array(F.struct(F.lit(WHOLE).alias("word"), F.lit(1).alias("times")))
    more = [name for name in indexed.columns if name not in ("item_id", "insert_seq", "length", "counts")]
    rows = indexed.select("item_id", "insert_seq", "length", *more, F.inline(F.concat(whole, "counts")))
    asked = terms.select("word").union(terms.sparkSession.createDataFrame([(WHOLE,)], "word string")).distinct()
    found = rows.join(asked, "word", "left_semi")
    return (live(found) if live else found).drop(*more)


def _in_parts(df: DataFrame, parts: int, part: Column) -> DataFrame:
    return df.withColumn("part", part.cast("int")).repartitionById(parts, "part")


def _copied(df: DataFrame, parts: int) -> DataFrame:
    """A copy of the rows for every part."""
    return _in_parts(df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), parts, F.col("part"))


def _scores(
    postings: DataFrame, terms: DataFrame, depth: int, parts: int, common: DataFrame | None = None, bounds: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """Best ``depth`` items of every question within its part: (query_id, top_k, item_id, insert_seq, score).

    With ``common`` words only items that share another word with the question are scored.
    """
    item, part_of_item = ["part", "item_id", "insert_seq"], F.pmod(F.xxhash64("item_id", "insert_seq"), F.lit(parts))
    if common is None:
        placed = _in_parts(postings, parts, part_of_item).join(_copied(terms.select("query_id", "top_k", "word", "weight"), parts), ["part", "word"])
        pairs = placed.groupBy("part", "query_id", "item_id", "insert_seq").agg(
            F.sum(F.col("weight") * F.col("value")).alias("score"), F.first("top_k").alias("top_k"))
        return _best(pairs.withColumn("score", F.round("score", SCORE_DIGITS)).filter("score > 0"), depth)

    few = F.broadcast(common)  # at most COMMON_WORDS rows
    bit = F.expr("shiftleft(1L, place)")
    entry = F.struct("place", "value")
    held = _in_parts(postings.join(few, "word").drop("word"), parts, part_of_item).groupBy(item).agg(
        F.sum(bit).alias("bits"), F.map_from_entries(F.collect_list(entry)).alias("held"))
    wanted = terms.join(few, "word").groupBy("query_id").agg(
        F.sum(bit).alias("asked"), F.max("weight").alias("most"), F.min("weight").alias("least"), F.collect_list(F.struct("place", "weight")).alias("wanted"))
    rare = _in_parts(postings.join(few, "word", "left_anti"), parts, part_of_item)
    rare = rare.join(held.select(*item, "bits").hint("shuffle_hash"), item, "left")
    asked = terms.join(few, "word", "left_anti").join(wanted.drop("wanted"), "query_id", "left")
    asked = _copied(asked.select("query_id", "top_k", "word", "weight", "asked", "most", "least"), parts)
    one = [F.first(name).alias(name) for name in ("top_k", "bits", "asked", "most", "least")]
    pairs = rare.join(asked, ["part", "word"]).groupBy("part", "query_id", "item_id", "insert_seq").agg(F.sum(F.col("weight") * F.col("value")).alias("score"), *one)
    both = F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("asked"))), F.lit(0))
    low = F.col("score") + F.coalesce(both * F.col("least") * bounds[0], F.lit(0.0))
    high = F.col("score") + F.coalesce(both * F.col("most") * bounds[1], F.lit(0.0))
    pairs = pairs.select("part", "query_id", "item_id", "insert_seq", "score", "top_k", low.alias("low"), high.alias("high"))
    ranked = Window.partitionBy("part", "query_id").orderBy(F.desc("low"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    reached = F.max(F.when(F.col("rank") == depth, F.col("low"))).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pairs = pairs.withColumn("reached", reached).filter(F.col("reached").isNull() | (F.col("high") >= F.col("reached") - 10.0 ** -SCORE_DIGITS))
    # A part's items and questions, one row each, are looked up.
    pairs = pairs.join(held.select(*item, "held").hint("shuffle_hash"), item, "left").join(
        _copied(wanted.select("query_id", "wanted"), parts).hint("shuffle_hash"), ["part", "query_id"], "left")
    more = F.aggregate("wanted", F.lit(0.0), lambda total, w: total + F.coalesce(w["weight"] * F.element_at("held", w["place"]), F.lit(0.0)))
    return _best(pairs.select("part", "query_id", "item_id", "insert_seq", "top_k", F.round(F.col("score") + F.coalesce(more, F.lit(0.0)), SCORE_DIGITS).alias("score")), depth)


def _best(pairs: DataFrame, depth: int) -> DataFrame:
    best = Window.partitionBy("part", "query_id").orderBy(F.desc("score"), F.asc("insert_seq"))
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= depth).drop("rank", "part")


def search(
    indexed: DataFrame, terms: DataFrame, weigh: Weigh, bounds: tuple[float, float], rarity: Callable[[Column, Column], Column] | None = None,
    parts: int | None = None, common_items: int = COMMON_ITEMS, live: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(query_id, item_id, insert_seq, score, index)``: the best ``top_k`` items of every question.

    ``terms`` has a row (query_id, top_k, word) per distinct word of a question. A word weighs
    ``rarity(items, items that hold it)``, 1 without it; a posting adds that times ``weigh(times, length)``, which
    lies within ``bounds``; ``length`` is relative to the average. Without ``rarity`` weights do not depend on ``length``.
    """
    parts = parts or parts_of(terms)
    # Stored, so joins are planned by their true size: words that fit are sent to the postings, not shuffled with them.
    terms = stored(terms.select("query_id", "top_k", "word"), "asked")
    depth = terms.agg(F.max("top_k")).first()[0] or 1
    if rarity is None and indexed.limit(common_items).count() < common_items:
        # No word weighs more than another, and none can be common: nothing has to be counted first.
        postings = asked_postings(indexed, terms, live).filter(F.col("word") != WHOLE).select(
            "item_id", "insert_seq", "word", weigh(F.col("times"), F.lit(1.0)).cast("double").alias("value"))
        return rank_hits(_scores(postings, terms.withColumn("weight", F.lit(1.0)), depth, parts), depth)
    postings = stored(asked_postings(indexed, terms, live), "postings")
    counted = stored(postings.groupBy("word").agg(F.count("*").alias("n_items"), F.sum("length").alias("n_words")), "counted")
    whole = counted.filter(F.col("word") == WHOLE).first()
    n_items = whole["n_items"] if whole else 0
    average = (whole["n_words"] / n_items if n_items else 0) or 1.0
    postings = postings.filter(F.col("word") != WHOLE).select(
        "item_id", "insert_seq", "word", weigh(F.col("times"), F.col("length") / F.lit(average)).cast("double").alias("value"))
    often = counted.filter((F.col("word") != WHOLE) & (F.col("n_items") >= max(common_items, COMMON_SHARE * n_items)))
    often = often.orderBy(F.desc("n_items"), "word").limit(COMMON_WORDS).select("word").collect() if n_items >= common_items else []
    weight = rarity(F.lit(float(n_items)), F.col("n_items")) if rarity else F.lit(1.0)
    terms = terms.join(counted.select("word", "n_items"), "word").withColumn("weight", weight)
    if not often:
        return rank_hits(_scores(postings, terms, depth, parts), depth)

    common = terms.sparkSession.createDataFrame([(row["word"], place) for place, row in enumerate(often)], "word string, place int")
    terms = stored(terms, "terms")
    first = stored(rank_hits(_scores(postings, terms, depth, parts, common, bounds), depth), "first")
    most = terms.join(F.broadcast(common.select("word", F.lit(bounds[1]).alias("bound"))), "word", "left").groupBy("query_id", "top_k").agg(
        F.sum(F.coalesce(F.col("weight") * F.col("bound"), F.lit(0.0))).alias("most"))
    last = first.select("query_id", F.col("index") + 1, F.col("score").alias("last")).toDF("query_id", "top_k", "last")
    settled = (F.col("most") == 0) | F.coalesce(F.col("last") > F.col("most") + 10.0 ** -SCORE_DIGITS, F.lit(False))
    again = stored(most.join(last, ["query_id", "top_k"], "left").filter(~settled).select("query_id"), "again")
    if again.isEmpty():
        return first
    second = _scores(postings, terms.join(again, "query_id", "left_semi"), depth, parts)
    return first.join(again, "query_id", "left_anti").unionByName(rank_hits(second, depth))
