"""Quality rules learned as a decision list and applied as one ordered Spark expression.

Statistics of whole texts are made once per row. From labelled rows, sequential covering grows a conjunction of
thresholds that singles out bad documents, prunes it on rows it was not grown on, and goes on with the rows no
rule covers yet. The list becomes ``when(rule 1, reject).when(rule 2, reject)...otherwise(keep)``.

Defined cases: a null or empty text has no words and fails the base rule; without labels of both kinds no rule is
learned and the base rule alone decides; null labels, and labels of ids that no document has, are not used; of a
document labelled more than once the lowest label counts; repeated rows are judged one by one. Texts of any length
are read whole; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import byte_texts, prepared, read

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
# Labelled rows that rules are learned from: those whose ids come first by hash. A model's sample, nothing else.
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 3, 48
# A rule stays only if at least this share of the rows it rejects, on rows it was not grown on, is bad.
PRECISION = 0.97
LEAST_COVERED = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits",
          "n_exclamations", "n_distinct_words")
STATS = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])
CAPITALS, DIGITS, BREAKS = bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside, total = 0, 0
    for window in windows:  # ``inside``: words of earlier repeated windows that reach this position
        if counts[window] > 1:
            total += 3 - inside
            inside = 2
        else:
            inside = max(0, inside - 1)
    return total


def text_counts(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.split()]
    joined = text.translate(None, BREAKS)

    def count(symbols: bytes) -> int:
        return len(text) - len(text.translate(None, symbols))

    return (len(words), len(joined.decode("utf-8", "replace")), count(SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), count(CAPITALS), count(DIGITS), text.count(b"!"), len(set(words)))


@F.arrow_udf(STATS)
def text_stats(texts: pa.Array) -> pa.Array:
    columns = np.array([text_counts(text) for text in byte_texts(texts)], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(column) for column in columns.T], names=list(COUNTS))


def base_failed(stats: Column) -> Column:
    words = stats["n_words"]
    return (words < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * words)


# Statistics that rules may use: shares, so that long and short documents compare.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "capital_share": ("n_capitals", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "exclamations_per_word": ("n_exclamations", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"), "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def ratio(stats: Column, name: str) -> Column:
    top, bottom = RATIOS[name]
    return stats[top] / F.greatest(stats[bottom], F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.value if self.above else table[self.name] < self.value

    def column(self, stats: Column) -> Column:
        value = ratio(stats, self.name)
        return value >= F.lit(self.value) if self.above else value < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.value:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray], rows: int) -> np.ndarray:
    inside = np.ones(rows, bool)
    for condition in rule:
        inside &= condition.holds(table)
    return inside


def _cuts(values: np.ndarray) -> list[float]:
    distinct = np.unique(values)
    middles = (distinct[1:] + distinct[:-1]) / 2
    if len(middles) > CUTS:
        middles = np.unique(np.quantile(middles, np.linspace(0, 1, CUTS)))
    return [float(f"{value:.4g}") for value in middles]


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, open_: np.ndarray) -> Rule:
    """Add the condition of the largest information gain until no good row is covered."""
    rule, inside = [], open_.copy()
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, gain = None, 1e-9
        for name, values in table.items():
            for value in _cuts(values[inside & bad]) + _cuts(values[inside]):
                for above in (True, False):
                    condition = Condition(name, above, value)
                    hit = inside & condition.holds(table)
                    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
                    if p:
                        won = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if won > gain:
                            best, gain = condition, won
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return tuple(rule)


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, open_: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that separates best on rows it was not grown on, its precision and its cover."""
    best, value, shown = (), -2.0, (0.0, 0)
    for length in range(1, len(rule) + 1):
        hit = open_ & _covers(rule[:length], table, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        score = (p - n) / (p + n) if p + n else -1.0
        if score > value:
            best, value, shown = rule[:length], score, (p / max(1, p + n), p)
    return best, *shown


def learn(table: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Decision list for ``bad``. Rows of fold 0 prune and judge, all others grow."""
    rules, open_ = [], np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        growing, judging = open_ & (fold != 0), open_ & (fold == 0)
        if (growing & bad).sum() < LEAST_COVERED:
            break
        rule, precision, covered = _prune(_grow(table, bad, growing), table, bad, judging)
        if not rule or precision < PRECISION or covered < LEAST_COVERED:
            break
        rules.append(rule)
        open_ &= ~_covers(rule, table, len(bad))
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled documents that pass the base rule."""
    marked = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.col("doc_id"))
    # At most ``sample_rows`` pairs of id and label: small enough for every task by that bound.
    sample = marked.orderBy(order, "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "quality", F.pmod(order, F.lit(3)).alias("fold"), text_stats("text").alias("stats"))
    # Rows that fail the base rule go here, not in a filter: that would be pushed below the join, to every text.
    rows = found.select("quality", "fold", base_failed(F.col("stats")).alias("failed"),
                        *[ratio(F.col("stats"), name).alias(name) for name in RATIOS]).limit(sample_rows).toArrow()
    rows = rows.filter(pc.invert(rows["failed"]))
    table = {name: rows[name].to_numpy() for name in RATIOS}
    order = np.lexsort([*table.values(), rows["quality"].to_numpy()])  # rows arrive in any order
    return learn({name: values[order] for name, values in table.items()}, rows["quality"].to_numpy()[order] == 0,
                 rows["fold"].to_numpy()[order])


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """The decision list as one conditional expression, first matching rule first."""
    listed = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        hit = F.lit(True)
        for condition in rule:
            hit = hit & condition.column(stats)
        listed = listed.when(hit, F.lit(False))
    return listed.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``stats`` (all counts) and ``kept``."""
    rules = learn_rules(docs, labels)
    return docs.withColumn("stats", text_stats("text")).withColumn("kept", verdict(F.col("stats"), rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, in their own columns."""
    judged = judge(docs.select(F.struct("*").alias("_row"), "doc_id", "text"), labels)
    return judged.filter("kept").select("_row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    stats = F.col("stats")
    return judged.select("doc_id", *[stats[name].alias(name) for name in COUNTS[:5]], base_failed(stats).alias("base_failed"), "kept")
