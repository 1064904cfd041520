"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is ``-ln(u) / weight``: ``u`` is a uniform number made from its id and size, ``weight`` its
quality weight. Sorted by key, a source is a weighted random order without replacement. A source takes whole
epochs first; the rest of its budget is the longest prefix of that order, ended where it is nearest the budget.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources of size 0
have target 0; repeated rows count one by one; rows of equal keys are ordered by id, size and text digest. Texts of
any length are counted whole; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Store, numbered, read, prepared, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
MARKS = r"[#*$%&|<>!]"


def quality_weight(text: Column) -> Column:
    """1 for plain text, down to 0.1 for text in which every fourth character or more is a mark."""
    share = F.regexp_count(text, F.lit(MARKS)) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * F.coalesce(share, F.lit(0.0)))


def sampling_key(doc_id: Column, size: Column, weight: Column) -> Column:
    """Exponential key: smaller keys are drawn first. The uniform number has 52 bits and is never 0."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), size.cast("string")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame, store: Store, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size, weight, target)``. Weights repeat over the sources in code-point order.

    What a source cannot take (``most`` times its size) is shared again among the others by weight, until none
    is above. Each round sends three numbers to the driver.
    """
    totals = store.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = numbered(totals, [F.col("source").isNull(), F.col("source")], store, "source-order")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = order.withColumn("weight", cycle[(F.col("number") % len(weights)).cast("int")]).drop("number")
    weighted = store.save(weighted, "weights")
    cap = F.col("source_size") * float(most)
    budget = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    rest, open_weight = budget, weighted.agg(F.sum("weight")).first()[0] or 0.0
    while open_weight:
        above = F.lit(rest) * F.col("weight") / F.lit(open_weight) > cap
        full = weighted.filter(above).agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
        left, weight_left = budget - most * (full["size"] or 0), weighted.agg(F.sum("weight")).first()[0] - (full["weight"] or 0.0)
        if (left, weight_left) == (rest, open_weight):
            break
        rest, open_weight = left, weight_left
    fair = F.lit(float(rest)) * F.col("weight") / F.lit(float(open_weight or 1.0))
    return weighted.withColumn("target", F.least(fair, cap))


def mix(docs: DataFrame, store: Store, **policy) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, the sampling ``key`` and a digest of the text, per row."""
    text = F.col("text")
    size = word_count(text)
    facts = docs.select("doc_id", "source", size.alias("size"), quality_weight(text).alias("weight"), F.xxhash64(text).alias("text_key"))
    facts = store.save(facts.withColumn("key", sampling_key(F.col("doc_id"), F.col("size"), F.col("weight"))).drop("weight"), "facts")
    targets = source_targets(facts, store, **policy)
    order = [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_key")]
    placed = numbered(facts, order, store, "order", size="size")
    # Sources are few beside documents, and each carries where it starts in the common order.
    lined = numbered(targets, order[:2], store, "starts", size="source_size").withColumnRenamed("before", "start")
    lined = lined.drop("number", "weight").withColumnRenamed("source", "_source")
    joined = placed.join(lined, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = F.col("target") - epochs * F.col("source_size")
    inside = F.col("before") - F.col("start")
    # The last document counts if that ends nearer the budget than leaving it out.
    drawn = (inside + F.col("size") / 2.0 <= wanted) & (F.col("size") > 0)
    taken = epochs * F.col("size") + F.when(drawn, F.col("size")).otherwise(0)
    return joined.withColumn("taken", taken.cast("bigint")).drop("number", "before", "start")


def mixed_documents(docs: DataFrame, store: Store, **policy) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time a document is taken.

    A source takes its documents up to the last one drawn, so what is joined to the texts is one row per source.
    Rows of one id and text stand or fall together here.
    """
    decided = store.save(mix(docs, store, **policy), "decided")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    place = F.struct("key", "doc_id", "size", "text_key")
    extra = F.col("taken") > F.col("size") * epochs
    last = store.save(decided.groupBy(F.col("source").alias("_of")).agg(F.max(epochs).alias("_epochs"), F.max(F.when(extra, place)).alias("_last")), "last")
    text, key = F.col("text"), F.col("_key")
    wrapped = docs.select(F.struct("*").alias("_row"), "doc_id", F.col("source").alias("_source"), word_count(text).alias("_size"),
                          quality_weight(text).alias("_weight"), F.xxhash64(text).alias("_text"))
    wrapped = wrapped.withColumn("_key", sampling_key(F.col("doc_id"), F.col("_size"), F.col("_weight")))
    joined = wrapped.join(last, F.col("_source").eqNullSafe(F.col("_of")))
    own = F.struct(key.alias("key"), "doc_id", F.col("_size").alias("size"), F.col("_text").alias("text_key"))
    times = F.col("_epochs") + F.coalesce((own <= F.col("_last")).cast("int"), F.lit(0))
    times = F.when(F.col("_size") > 0, times).otherwise(0)
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).select("_row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    mixed = mix(read(spark, sf_dir, "documents"), Store(spark, "mix"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH facts AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 13) AS BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0::DOUBLE)
         / greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (len(regexp_extract_all(text, '[#*$%&|<>!]'))::DOUBLE / greatest(length(text), 1)::DOUBLE)) AS key
  FROM facts),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM keyed GROUP BY source),
ratios AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget,
         coalesce(sum(2 * source_size) OVER w, 0) AS lower_caps, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS upper_weight
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (budget - lower_caps)::DOUBLE AS rest, upper_weight AS open_weight FROM ratios
  WHERE (budget - lower_caps)::DOUBLE * weight / upper_weight <= 2.0 * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(rest * weight / open_weight, 2.0::DOUBLE * source_size) AS target FROM sources, level),
placed AS (
  SELECT k.doc_id, k.source, k.size, t.source_size, t.target,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS inside,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + CASE WHEN size > 0 AND inside + size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken
FROM placed
"""
