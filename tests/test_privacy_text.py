import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tests import plain
from tracewell.functions import privacy, text

HAND = [
    "", " ", "Email Bob@Example.com, SSN 123-45-6789, card 4111 1111 1111 1111",
    "reference 4111 1111 1111 1112", "created 2024-01-15 10:30", "at 2024-01-15T10:30:22.123456+00:00 call +1 (555) 123-4567",
    "x2024-01-15 y", "12345678901234567890", "a@b.co", "_a@b.co_", "ſK@example.com", "mail:ÉA@b.com", "٠١٢-٣٤-٥٦٧٨",
    "call 555 123 4567 890", "4111111111111111 4111111111111111", "2024-01-15 1 0:30", "2024-01-15 10:30",
    "line\n4111-1111-1111-1111\nline", "<PII_EMAIL_V1_0123456789abcdef0123456789abcdef>", "a.b.c.d.e@f.g.hi@x.yz",
    "٤١١١١١١١١١١١١١١١", "²4111111111111111", "+49 30 1234567", "x+49 30 1234567", "1-2-3-4-5-6-7-8-9-0-1-2-3",
]


def random_texts(count):
    rng = random.Random(7)
    alphabet = list("0123456789") * 3 + list(" -().+:@_TZtzaÉß²٣,\n ") + ["a@b.co", "2024-01-15", "4111111111111111"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts(spark, data):
    return HAND + random_texts(4000) + [
        row.text for row in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()
    ]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)


def test_redaction_equals_plain_python(spark, texts, key):
    found = (
        rows_of(spark, texts).withColumn("r", privacy.redact(F.col("text"), key))
        .select("id", "r.text", privacy.kind_counts(F.col("r.kinds")).alias("counts")).collect()
    )
    for row in found:
        assert (row.text, row.counts) == plain.redact(texts[row.id], key), texts[row.id]


def test_word_tokens_and_casefold_equal_plain_python(spark, texts):
    texts = texts + ["".join(chr(c) for c in range(at, at + 400) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")) for at in range(1, 70000, 400)]
    texts += ["ΑΣ ΣΑΣ", "STRASSE Straße", "ﬃ ŉ ǰ ΐ İ", "<PII_EMAIL_V1_0123456789abcdef0123456789abcdef>. alpha_beta"]
    found = rows_of(spark, texts).select(
        "id", text.casefold(F.col("text")).alias("folded"), text.word_tokens(F.col("text")).alias("tokens")
    ).collect()
    for row in found:
        assert row.folded == texts[row.id].casefold()
        assert set(row.tokens) == plain.word_set(texts[row.id]) and len(set(row.tokens)) == len(row.tokens)


def test_shared_words(spark):
    cases = [
        ("marker,", "marker.", 1), ("ALPHA", "alpha", 1), ("STRASSE", "Straße", 1), ("CAFÉ", "café.", 1),
        ("route42, 123", "ROUTE42; 123.", 2), ("alpha_beta", "alpha/beta", 2),
    ]
    rows = spark.createDataFrame(cases, "q string, d string, score int").select(
        "score", text.shared_words(text.word_tokens(F.col("q")), text.word_tokens(F.col("d"))).alias("found")
    ).collect()
    assert all(row.found == row.score for row in rows)


def test_tokens(spark):
    row = spark.createDataFrame([(" A@Example.com ", "a@example.com", "é" * 70)], "a string, b string, c string").select(
        privacy.token_for("email", F.col("a"), "k1").alias("upper"),
        privacy.token_for("email", F.col("b"), "k1").alias("lower"),
        privacy.token_for("email", F.col("b"), "k2").alias("other"),
        privacy.token_for("query", F.col("c"), "long" * 40).alias("long"),
        privacy.is_token(privacy.token_for("query", F.col("c"), "k")).alias("is_token"),
        privacy.is_token(F.concat(privacy.token_for("query", F.col("c"), "k"), F.lit("\n"))).alias("not_token"),
    ).first()
    assert row.upper == row.lower == plain.token("email", "a@example.com", "k1") != row.other
    assert row.long == plain.token("query", "é" * 70, "long" * 40)
    assert row.is_token and not row.not_token
    with pytest.raises(ValueError):
        privacy.token_for("email", F.lit("x"), "")


def test_luhn(spark):
    values = ["4111 1111-1111 1111", "4111111111111112", "0" * 12, "0" * 19, "0" * 20, "٤١١١١١١١١١١١١١١١"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(privacy.luhn_valid(F.col("v")).alias("ok")).collect()
    assert [row.ok for row in rows] == [plain.luhn(v) for v in values]


def test_fixed_chunks(spark, texts):
    rows = rows_of(spark, texts).select("id", text.chunk_fixed(F.col("text")).alias("chunks")).collect()
    for row in rows:
        whole = texts[row.id]
        assert row.chunks == [whole[i:i + 800] for i in range(0, len(whole), 680)]


def test_recursive_chunks(spark, texts):
    texts = texts + ["para one.\n\npara two " + "word " * 400 + "\n\nend", "x" * 2000, "ab " * 900]
    rows = rows_of(spark, texts).select("id", text.chunk_recursive(F.col("text")).alias("chunks")).collect()
    for row in rows:
        whole = texts[row.id]
        assert all(0 < len(chunk) <= 800 and chunk in whole and chunk == chunk.strip() for chunk in row.chunks)
        assert set(" ".join(row.chunks).split()) >= set(w for w in whole.split() if len(w) < 680)
    assert text.split_recursive("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert text.split_recursive("aaaa\n\nbbbb cccc", 6, 0) == ["aaaa", "bbbb", "cccc"]
    assert text.split_recursive("") == []
