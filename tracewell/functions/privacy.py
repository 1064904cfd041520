"""Personal data as keyed tokens: detection, canonical forms, HMAC tokens (Column -> Column).

Everything here is built from Spark expressions, so it stays inside the JVM and runs where the rows are.
The HMAC key enters the plan as two 64-byte pads; treat explain output and event logs of such jobs as
secret, or set ``spark.sql.redaction.string.regex``.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes with the meaning Python's Unicode patterns give them, spelled out for Java patterns.
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
# Letters that an ignore-case [A-Z] accepts: both ASCII cases and four relatives of I, S and K.
LETTER = r"A-Za-zİıſK"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# The five kinds in order of precedence and what each accepts.
KIND_BODIES = {
    "datetime": rf"{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}"
                rf"(?:[Tt{SPACE}]{DIGIT}{{2}}:{DIGIT}{{2}}(?::{DIGIT}{{2}}(?:\.{DIGIT}{{1,6}})?)?"
                rf"(?:[Zz]|[+-]{DIGIT}{{2}}:?{DIGIT}{{2}})?)?",
    "ssn": rf"{DIGIT}{{3}}-{DIGIT}{{2}}-{DIGIT}{{4}}",
    "card": rf"(?:{DIGIT}[ -]?){{13,19}}",
    "email": rf"[{LETTER}0-9._%+-]++@[{LETTER}0-9.-]+\.[{LETTER}]{{2,}}",
    "phone": rf"\+?{DIGIT}[{DIGIT} ()-]{{7,}}{DIGIT}",
}
_NUMBER_EDGES = (rf"(?<!{DIGIT})", rf"(?!{DIGIT})")
KIND_EDGES = {
    "datetime": _NUMBER_EDGES,
    "ssn": _NUMBER_EDGES,
    "card": _NUMBER_EDGES,
    "email": (EDGE, EDGE),
    "phone": (rf"(?<![{WORD}])", rf"(?![{WORD}])"),
}
PII = "|".join(f"(?:{KIND_EDGES[k][0]}{body}{KIND_EDGES[k][1]})" for k, body in KIND_BODIES.items())
# No kind can match without one of these, so most texts skip the full pattern.
PII_HINT = rf"[{DIGIT}@]"
TOKEN = r"\A<PII_[A-Z0-9_]+_V1_[0-9a-f]{32}>\z"
TOKEN_VERSION = "V1"

REDACTION_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("kinds", T.ArrayType(T.StringType())),
])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; repeated use does not repeat the work."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def _odd_digits() -> str:
    """Characters that count as digits without being decimal (superscripts, circled digits), as a class body."""
    points = (chr(cp) for cp in range(sys.maxunicode + 1))
    return "".join(c for c in points if c.isdigit() and not c.isdecimal())


@lru_cache(maxsize=1)
def _decimal_table() -> tuple[str, str]:
    """Every non-ASCII decimal digit and the ASCII digit of equal value."""
    wide = [chr(cp) for cp in range(128, sys.maxunicode + 1) if chr(cp).isdecimal()]
    return "".join(wide), "".join(str(unicodedata.decimal(c)) for c in wide)


def strip_space(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, rf"[^{DIGIT}{_odd_digits()}]", "")


def luhn_valid(col: Column) -> Column:
    """13 to 19 digits (spaces and hyphens ignored) whose Luhn sum ends in zero."""
    wide, ascii_digits = _decimal_table()
    digits = F.regexp_replace(col, rf"[^{DIGIT}]", "")
    digits = F.when(digits.rlike("[^0-9]"), F.translate(digits, wide, ascii_digits)).otherwise(digits)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def canonical_value(kind: Column | str, col: Column) -> Column:
    """One spelling per identity: lower-case e-mail, bare digits for numbers, trimmed text otherwise."""
    kind = F.lit(kind.lower()) if isinstance(kind, str) else F.lower(kind)
    trimmed = strip_space(col)
    return (
        F.when(kind == "email", F.lower(trimmed))
        .when(kind.isin("phone", "card", "ssn"), digits_only(trimmed))
        .otherwise(trimmed)
    )


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 (RFC 2104) of a UTF-8 string, as lower-case hex."""
    if not key:
        raise ValueError("the token key must not be empty")
    secret = key.encode("utf-8")
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in secret))
    outer = F.lit(bytearray(b ^ 0x5C for b in secret))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def token_for(kind: Column | str, col: Column, key: str) -> Column:
    """``<PII_KIND_V1_...>`` with the first 128 bits of the keyed digest of the canonical value."""
    lower, upper = (
        (F.lit(kind.lower()), F.lit(kind.upper())) if isinstance(kind, str) else (F.lower(kind), F.upper(kind))
    )
    message = F.concat(F.lit(f"{TOKEN_VERSION}:"), lower, F.lit(":"), canonical_value(kind, col))
    digest = F.substring(hmac_sha256(message, key), 1, 32)
    return F.concat(F.lit("<PII_"), upper, F.lit(f"_{TOKEN_VERSION}_"), digest, F.lit(">"))


def is_token(col: Column) -> Column:
    return col.rlike(TOKEN)


def _kind_of(match: Column) -> Column:
    """Kind of one match. The first body that covers it whole is the alternative that found it."""
    kind = F.lit("phone")
    for name in reversed([k for k in KIND_BODIES if k != "phone"]):
        kind = F.when(match.rlike(rf"\A(?:{KIND_BODIES[name]})\z"), F.lit(name)).otherwise(kind)
    return bind(kind, lambda k: F.when((k == "card") & ~luhn_valid(match), F.lit("numeric_identifier")).otherwise(k))


def _replacement(match: Column, key: str) -> Column:
    return bind(
        _kind_of(match),
        lambda kind: F.struct(
            kind.alias("kind"),
            F.when(kind == "datetime", match).otherwise(token_for(kind, match, key)).alias("token"),
        ),
    )


def redact(col: Column, key: str) -> Column:
    """``struct<text, kinds>``: the text with personal data replaced, and the kind of every replacement.

    One scan finds the matches, a second splits the text around them, so a token is never scanned again.
    Dates and times are found first and left as they are.
    """

    def rebuilt(hits: Column) -> Column:
        pieces = F.zip_with(
            F.split(col, PII, -1), hits, lambda piece, hit: F.concat(piece, F.coalesce(hit["token"], F.lit("")))
        )
        kinds = F.filter(F.transform(hits, lambda hit: hit["kind"]), lambda kind: kind != "datetime")
        return F.struct(F.array_join(pieces, "").alias("text"), kinds.alias("kinds"))

    matches = F.regexp_extract_all(col, F.lit(PII), F.lit(0))
    clean = F.struct(col.alias("text"), F.array().cast("array<string>").alias("kinds"))
    # A lone time, as every record carries, is cleared without the full scan.
    scan = col.rlike(PII_HINT) & ~col.rlike(rf"\A(?:{KIND_BODIES['datetime']})\z")
    return F.when(scan, bind(F.transform(matches, lambda match: _replacement(match, key)), rebuilt)).otherwise(clean)


def redact_text(col: Column, key: str) -> Column:
    return redact(col, key)["text"]


def kind_counts(kinds: Column) -> Column:
    """``map<kind, count>`` holding only the kinds that occur."""

    def counted(found: Column) -> Column:
        return F.map_from_entries(F.transform(
            F.array_distinct(found),
            lambda kind: F.struct(kind, F.size(F.filter(found, lambda other: other == kind)).cast("bigint")),
        ))

    return bind(kinds, counted)
