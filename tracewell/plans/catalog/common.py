"""Shared by the registered queries: demonstration key, column helpers, SQL pieces of their oracles."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key of the registered queries over test tables. Real jobs pass their own.
KEY = "registered-query-key"


def ntz(col: Column | str) -> Column:
    """Timestamps as the test tables hold them, without a zone."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{byte:02x}" for byte in data) + "'::BLOB"


def hmac_sql(message: str, key: str = KEY) -> str:
    secret = key.encode()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner, outer = _blob(bytes(b ^ 0x36 for b in secret)), _blob(bytes(b ^ 0x5C for b in secret))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


def token_sql(kind: str, canonical: str) -> str:
    """Token of a value that is already canonical."""
    return f"('<PII_{kind.upper()}_V1_' || substr({hmac_sql(f"'V1:{kind.lower()}:' || {canonical}")}, 1, 32) || '>')"


def uuid_sql(*parts: str) -> str:
    joined = "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({part} AS VARCHAR), '\\N')" for part in parts) + "))"
    return f"regexp_replace({joined}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def iso_sql(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', {ts}) % 1000000 = 0 THEN '' "
        f"ELSE strftime({ts}, '.%f') END || '+00:00')"
    )


PAYMENTS_SQL = """
SELECT o_orderkey, o_orderstatus, 'pay-' || o_orderkey AS request_id, 'c-' || o_orderkey AS correlation_id,
       'o-' || o_orderkey AS transaction_id, 'm-' || o_custkey AS merchant_id,
       CAST(round(o_totalprice * 2) AS BIGINT) AS amount_minor,
       (['USD','EUR','JPY','BHD','KWD','TND'])[CAST(o_orderkey % 6 AS INTEGER) + 1] AS currency,
       'net' || substr(o_orderpriority, 1, 1) AS payment_network, o_orderdate AS paid_at
FROM orders
"""

EXPONENT_SQL = "CASE currency WHEN 'BHD' THEN 3 WHEN 'KWD' THEN 3 WHEN 'OMR' THEN 3 WHEN 'TND' THEN 3 WHEN 'JPY' THEN 0 ELSE 2 END"

# Half-up rounding to four places in whole numbers: (amount + half unit) // unit / 10000.
SCORE_SQL = f"""least(1.0::DOUBLE, CAST((amount_minor + CAST(10 ** ({EXPONENT_SQL}) / 2 AS BIGINT))
 // CAST(10 ** ({EXPONENT_SQL}) AS BIGINT) AS DOUBLE) / 10000)"""

WORDS_SQL = r"regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


def words_sql(text: str) -> str:
    return WORDS_SQL.format(text=text)
