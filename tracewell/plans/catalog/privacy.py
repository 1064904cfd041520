"""Registered queries: tokens, redaction, boundary, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import boundary, privacy, text
from tracewell.functions.canonical import is_request_id, is_topic_name, is_traceparent, stable_traceparent
from tracewell.operators import ingest, validation
from tracewell.plans.catalog.common import KEY, PAYMENTS_SQL, hmac_sql, token_sql, words_sql
from tracewell.sources import tables


def redact_documents(spark, folder):
    redacted = ingest.redact_documents(tables.documents(spark, folder), KEY)
    kinds = F.sort_array(F.map_keys("pii_counts"))
    counts = F.transform(kinds, lambda kind: F.concat(kind, F.lit("="), F.col("pii_counts")[kind].cast("string")))
    return redacted.select("doc_id", "text", "source_token", F.array_join(counts, ",").alias("pii_counts"))


def pii_totals(spark, folder):
    return ingest.pii_totals(ingest.redact_documents(tables.documents(spark, folder), KEY), "lang")


def email_totals(spark, folder):
    """Mail addresses found per language, and documents that hold one."""
    redacted = ingest.redact_documents(tables.documents(spark, folder), KEY)
    found = redacted.select("lang", F.coalesce(F.col("pii_counts")["email"], F.lit(0).cast("bigint")).alias("emails"))
    return found.groupBy("lang").agg(F.sum("emails").alias("emails"), F.count_if(F.col("emails") > 0).alias("documents"))


def redact_customers(spark, folder):
    redaction = privacy.redact(F.col("c_name"), KEY)
    rows = tables.table(spark, folder, "customer").withColumn("r", redaction)
    return rows.select("c_custkey", F.col("r.text").alias("name"), F.size("r.kinds").alias("hits"))


def email_tokens(spark, folder):
    email = F.concat(F.lit(" "), F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.lit("@"), "c_mktsegment", F.lit(".COM "))
    rows = tables.table(spark, folder, "customer").select("c_custkey", email.alias("email"))
    return rows.select(
        "c_custkey", privacy.token_for("email", F.col("email"), KEY).alias("token"),
        privacy.is_token(privacy.token_for("email", F.col("email"), KEY)).alias("is_token"),
    )


def hmac_tokens(spark, folder):
    rows = tables.payments(spark, folder)
    return rows.select(
        "o_orderkey", privacy.token_for("payment_transaction", F.col("transaction_id"), KEY).alias("transaction_token"),
        privacy.hmac_sha256(F.concat_ws(":", "merchant_id", "currency"), KEY).alias("digest"),
    )


def luhn_check(spark, folder):
    digits = F.concat(F.lit("4"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("-"),
                      F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit(" "), F.col("l_linenumber").cast("string"))
    rows = tables.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", digits.alias("digits"))
    return rows.select("l_orderkey", "l_linenumber", "digits", privacy.luhn_valid(F.col("digits")).alias("valid"))


def canonical_values(spark, folder):
    rows = tables.table(spark, folder, "customer").withColumn("padded", F.concat(F.lit("\t "), "c_name", F.lit(" ")))
    return rows.select("c_custkey", *[
        privacy.canonical_value(kind, F.col("padded")).alias(kind) for kind in ("email", "phone", "card", "ssn", "query")
    ])


def sanitize_boundary(spark, folder):
    payments = tables.payments(spark, folder)
    rows = payments.select(
        "request_id", "transaction_id", "merchant_id", "amount_minor",
        F.struct(F.col("currency").alias("note"), F.array("merchant_id").alias("merchant")).alias("payload"),
        F.create_map(F.lit("source"), "payment_network", F.lit("correlation_id"), "correlation_id",
                     F.lit("source_token"), "currency").alias("labels"),
    )
    safe = boundary.sanitize(rows, KEY)
    return safe.select(
        "request_id", "transaction_id", "merchant_id", "amount_minor", F.col("payload.note").alias("note"),
        F.col("payload.merchant")[0].alias("payload_merchant"), F.col("labels")["source"].alias("label_source"),
        F.col("labels")["correlation_id"].alias("label_correlation"),
        F.col("labels")["source_token"].alias("label_source_token"),
    )


def boundary_violations(spark, folder):
    """Orders in status F carry a raw source, the others a token."""
    payments = tables.payments(spark, folder)
    token = privacy.token_for("source", F.col("merchant_id"), KEY)
    rows = payments.select(
        "request_id", "amount_minor",
        F.when(F.col("o_orderstatus") == "F", F.col("merchant_id")).otherwise(token).alias("source_token"),
    )
    return boundary.split_unsafe(rows, KEY)[1]


def chunk_fixed(spark, folder):
    rows = ingest.chunk_documents(tables.documents(spark, folder).withColumn("source_token", F.lit("")), text.chunk_fixed)
    return rows.select("request_id", "position", "chunk_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def chunk_recursive(spark, folder):
    rows = ingest.chunk_documents(tables.documents(spark, folder).withColumn("source_token", F.lit("")))
    return rows.select("request_id", "position", "chunk_id", "text")


def ingest_telemetry(spark, folder):
    """Chunk counts of the documents as they are, joined back to every request."""
    rows = tables.documents(spark, folder).select(
        "request_id", "text", F.lit("").alias("source_token"), F.create_map().cast("map<string,bigint>").alias("pii_counts"),
    )
    return ingest.ingest_telemetry(rows, ingest.chunk_documents(rows, text.chunk_fixed)).select("request_id", "chunk_count")


def casefold_documents(spark, folder):
    return tables.documents(spark, folder).select("doc_id", F.md5(text.casefold(F.col("text"))).alias("digest"))


def document_words(spark, folder):
    tokens = text.word_tokens(F.col("text"))
    return tables.documents(spark, folder).select(
        "doc_id", F.size(tokens).alias("words"), F.md5(F.array_join(F.sort_array(tokens), " ")).alias("digest")
    )


def shared_with_label(spark, folder):
    """Words a user turn shares with the answer after it."""
    turns = tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", text.word_tokens(F.col("text")).alias("words")
    )
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("answer_words"))
    pairs = turns.filter("role = 'user'").join(answers, ["conv_id", "turn"])
    return pairs.select(
        "conv_id", "turn", text.shared_words(F.col("words"), F.col("answer_words")).alias("shared"),
        F.size(F.array_union("words", "answer_words")).alias("all_words"),
    )


def validate_documents(spark, folder):
    """Pages beside documents; every 97th document is emptied and every 89th lengthened past the limit."""
    documents = tables.documents(spark, folder).select(
        "request_id",
        F.when(F.col("doc_id") % 97 == 0, F.lit(""))
        .when(F.col("doc_id") % 89 == 0, F.rpad("text", validation.MAX_TEXT + 1, "x"))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("lang") != "fr", F.col("source")).alias("source"),
    )
    pages = tables.table(spark, folder, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("request_id"), F.col("html").alias("text"), F.col("url").alias("source"))
    checked = validation.validate_documents(documents.unionByName(pages))
    return checked.select("request_id", "source", F.array_join("failed", ",").alias("failed"))


def validate_questions(spark, folder):
    rows = tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 5 != 4, F.col("text")).otherwise("").alias("question"),
        F.when(F.col("conv_id") % 3 != 0, (F.col("conv_id") % 23).cast("int")).alias("top_k"),
    )
    checked = validation.validate_questions(rows)
    return checked.select("conv_id", "turn", "top_k", F.array_join("failed", ",").alias("failed"))


def identifier_checks(spark, folder):
    rows = tables.table(spark, folder, "part")
    return rows.select(
        "p_partkey", is_request_id(F.col("p_name")).alias("name_is_request_id"),
        is_request_id(F.replace(F.col("p_brand"), F.lit("#"), F.lit(":"))).alias("brand_is_request_id"),
        is_topic_name(F.replace(F.lower("p_type"), F.lit(" "), F.lit("."))).alias("type_is_topic"),
        is_topic_name(F.col("p_brand")).alias("brand_is_topic"),
    )


def trace_ids(spark, folder):
    rows = tables.payments(spark, folder).select(
        "request_id", stable_traceparent(F.col("request_id"), F.col("correlation_id")).alias("traceparent"))
    return rows.withColumn("valid", is_traceparent(F.col("traceparent")))


QUERIES = {f.__name__: f for f in (
    redact_documents, pii_totals, email_totals, redact_customers, email_tokens, hmac_tokens, luhn_check, canonical_values,
    sanitize_boundary, boundary_violations, chunk_fixed, chunk_recursive, ingest_telemetry, casefold_documents,
    document_words, shared_with_label, validate_documents, validate_questions, identifier_checks, trace_ids,
)}

_CHUNKS = """
SELECT 'doc-' || doc_id AS request_id, CAST((start - 1) // 680 AS INTEGER) AS position, substr(text, start, 800) AS chunk
FROM (SELECT doc_id, text, unnest(generate_series(1, length(text), 680)) AS start FROM documents) starts
"""

# Personal data in SQL. Its patterns cannot look around, so every alternative takes the character before a value and
# the one after it as well; a line feed stands at either end. Taking one character each keeps the order of matches.
_WORD_CLASS = r"\p{L}\p{N}_"
_LETTERS = r"A-Za-z\x{130}\x{131}\x{17F}\x{212A}"
_BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_MAIL_REST = rf"[{_LETTERS}0-9._%+-]*@[{_LETTERS}0-9.-]+\.[{_LETTERS}]{{2,}}"
_PII_SQL = "(" + "|".join((
    rf"\P{{Nd}}(\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}(?:[Tt{_BLANK}]\p{{Nd}}{{2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}}(?:\.\p{{Nd}}{{1,6}})?)?"
    r"(?:[Zz]|[+-]\p{Nd}{2}:?\p{Nd}{2})?)?)\P{Nd}",
    r"\P{Nd}(\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4})\P{Nd}",
    r"\P{Nd}((?:\p{Nd}[ -]?){13,19})\P{Nd}",
    rf"[^{_WORD_CLASS}]([{_LETTERS}0-9_]{_MAIL_REST})[^{_WORD_CLASS}]",
    rf"[{_WORD_CLASS}]([.%+-]{_MAIL_REST})[^{_WORD_CLASS}]",
    rf"[^{_WORD_CLASS}](\+?\p{{Nd}}[\p{{Nd}} ()-]{{7,}}\p{{Nd}})[^{_WORD_CLASS}]",
)) + ")"
_FIND = f"regexp_extract(rest, '{_PII_SQL}', ['around', 'datetime', 'ssn', 'card', 'email', 'odd_email', 'phone'])"
_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN substr(digits, length(digits) - i + 1, 1)::INTEGER
         WHEN substr(digits, length(digits) - i + 1, 1)::INTEGER > 4 THEN substr(digits, length(digits) - i + 1, 1)::INTEGER * 2 - 9
         ELSE substr(digits, length(digits) - i + 1, 1)::INTEGER * 2 END)) % 10 = 0"""

# Tables scan, hits (a row per value, and one for the text after the last) and redacted, to stand after WITH RECURSIVE.
REDACTED_SQL = f"""
scan AS (
    SELECT doc_id, 0 AS step, rest, {_FIND} AS m FROM (SELECT doc_id, chr(10) || text || chr(10) AS rest FROM documents) t
    UNION ALL
    SELECT doc_id, step + 1, rest, {_FIND} FROM (
        SELECT doc_id, step, substr(rest, strpos(rest, m.around) + length(m.around) - 2) AS rest FROM scan WHERE m.around <> '') t),
found AS (
    SELECT doc_id, step, substr(m.around, 2, length(m.around) - 2) AS value,
           CASE WHEN m.around = '' THEN substr(rest, 2, length(rest) - 2) ELSE substr(rest, 2, strpos(rest, m.around) - 1) END AS before,
           CASE WHEN m.datetime <> '' THEN 'datetime' WHEN m.ssn <> '' THEN 'ssn' WHEN m.card <> '' THEN 'card'
                WHEN m.email <> '' OR m.odd_email <> '' THEN 'email' WHEN m.phone <> '' THEN 'phone' END AS shape,
           regexp_replace(m.around, '[^0-9]', '', 'g') AS digits FROM scan),
hits AS (
    SELECT *, CASE WHEN shape = 'card' AND NOT ({_LUHN}) THEN 'numeric_identifier' ELSE shape END AS kind FROM found),
named AS (
    SELECT *, CASE WHEN kind = 'email' THEN lower(value) WHEN kind = 'numeric_identifier' THEN trim(value) ELSE digits END AS canonical
    FROM hits),
redacted AS (
    SELECT doc_id, string_agg(before || CASE WHEN kind IS NULL THEN '' WHEN kind = 'datetime' THEN value
               ELSE '<PII_' || upper(kind) || '_V1_' || substr({hmac_sql("'V1:' || kind || ':' || canonical")}, 1, 32) || '>' END,
               '' ORDER BY step) AS text FROM named GROUP BY doc_id),
kinds AS (SELECT doc_id, kind, count(*) AS n FROM hits WHERE kind <> 'datetime' GROUP BY ALL)
"""

_SEPARATORS_SQL = ("chr(10) || chr(10)", "chr(10)", "' '")


def recursive_chunks_sql(source: str) -> str:
    """Tables to stand after WITH RECURSIVE, the last of them ``pieced (doc_id, position, text)``: the chunks of the
    table ``source (doc_id, text)``.

    ``pieces_N`` cuts what is still too long at the coarsest separator in it. Pieces that fit form runs, whose chunks
    start and end at boundaries of pieces: the last one within 800 characters ends a chunk, and the next chunk starts
    at the first one that repeats at most 120 characters and leaves room for the next piece.
    """
    tables = [f"units_0 AS (SELECT doc_id, 0 AS off, text, 0 AS level FROM {source})"]
    for depth in range(4):
        choice = " ".join(
            f"WHEN level <= {level} AND contains(text, {sep}) THEN {level}" for level, sep in enumerate(_SEPARATORS_SQL))
        lengths = " ".join(
            f"WHEN {level} THEN list_transform(string_split(text, {sep}), lambda part, i: length(part) + CASE WHEN i > 1 THEN length({sep}) ELSE 0 END)"
            for level, sep in enumerate(_SEPARATORS_SQL))
        tables.append(f"""
cut_{depth} AS (SELECT *, CASE {choice} ELSE 3 END AS cut FROM units_{depth}),
parts_{depth} AS (
    SELECT doc_id, off, cut, unnest(lengths) AS size, unnest(range(1, len(lengths) + 1)) AS i
    FROM (SELECT *, CASE cut {lengths} ELSE list_transform(range(length(text)), lambda c: 1) END AS lengths FROM cut_{depth}) t),
pieces_{depth} AS MATERIALIZED (
    SELECT doc_id, off, cut, size, (off + sum(size) OVER w - size)::BIGINT AS start, count(*) FILTER (WHERE size >= 800) OVER w AS run
    FROM parts_{depth} WHERE size > 0 WINDOW w AS (PARTITION BY doc_id, off ORDER BY i ROWS UNBOUNDED PRECEDING)),
units_{depth + 1} AS (
    SELECT doc_id, start AS off, substr(s.text, start + 1, size) AS text, cut + 1 AS level
    FROM pieces_{depth} JOIN {source} s USING (doc_id) WHERE size >= 800)""")
    runs = " UNION ALL ".join(
        f"SELECT doc_id, list(start ORDER BY start) AS starts, max(start + size) AS last FROM pieces_{depth} WHERE size < 800 GROUP BY doc_id, off, run"
        for depth in range(4))
    tables.append(f"""
runs AS MATERIALIZED (SELECT doc_id, starts[1] AS head, last, list_append(starts, last) AS bounds FROM ({runs}) r),
chunks AS (
    SELECT doc_id, head, head AS s, list_max(list_filter(bounds, lambda b: b <= head + 800)) AS e FROM runs
    UNION ALL
    SELECT doc_id, head, s, list_max(list_filter(bounds, lambda b: b <= s + 800)) FROM (
        SELECT doc_id, head, bounds, list_min(list_filter(bounds, lambda b: b >= least)) AS s FROM (
            SELECT r.doc_id, r.head, bounds, greatest(e - 120, list_min(list_filter(bounds, lambda b: b > e)) - 800) AS least
            FROM chunks c JOIN runs r ON r.doc_id = c.doc_id AND r.head = c.head WHERE e < last) n) t),
stripped AS (
    SELECT doc_id, s, regexp_replace(substr(d.text, s + 1, e - s), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS text
    FROM chunks JOIN {source} d USING (doc_id)),
pieced AS (
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS position, text FROM stripped WHERE text <> '')""")
    return ",".join(tables)


def chunk_id_sql(text: str = "text") -> str:
    return f"'doc-' || doc_id || '-' || position || '-' || substr(sha256({text}), 1, 8)"


ORACLES = {
    "chunk_recursive": f"""
        WITH RECURSIVE {recursive_chunks_sql("documents")}
        SELECT 'doc-' || doc_id AS request_id, position, {chunk_id_sql()} AS chunk_id, text FROM pieced""",
    "redact_documents": f"""
        WITH RECURSIVE {REDACTED_SQL},
        counts AS (SELECT doc_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS pii_counts FROM kinds GROUP BY doc_id)
        SELECT d.doc_id, r.text, {token_sql("source", "source")} AS source_token, coalesce(pii_counts, '') AS pii_counts
        FROM documents d JOIN redacted r USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "pii_totals": f"""
        WITH RECURSIVE {REDACTED_SQL}
        SELECT lang, kind, sum(n)::BIGINT AS hits, count(*) AS rows_with_kind FROM kinds JOIN documents USING (doc_id) GROUP BY lang, kind""",
    "email_totals": r"""
        SELECT lang, sum(n)::BIGINT AS emails, count(*) FILTER (WHERE n > 0) AS documents
        FROM (SELECT lang, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM documents) d
        GROUP BY lang""",
    "redact_customers": f"""
        SELECT c_custkey, 'Customer#' || {token_sql("phone", "substr(c_name, 10)")} AS name, 1 AS hits FROM customer""",
    "email_tokens": f"""
        SELECT c_custkey, {token_sql("email", "lower(replace(c_name, '#', '.') || '@' || c_mktsegment || '.COM')")} AS token,
               true AS is_token FROM customer""",
    "hmac_tokens": f"""
        SELECT o_orderkey, {token_sql("payment_transaction", "transaction_id")} AS transaction_token,
               {hmac_sql("merchant_id || ':' || currency")} AS digest FROM ({PAYMENTS_SQL}) p""",
    "luhn_check": """
        WITH numbers AS (
            SELECT l_orderkey, l_linenumber,
                   '4' || lpad(l_orderkey::VARCHAR, 8, '0') || '-' || lpad(l_partkey::VARCHAR, 6, '0') || ' '
                   || l_linenumber AS digits FROM lineitem),
        bare AS (SELECT *, replace(replace(digits, '-', ''), ' ', '') AS d FROM numbers)
        SELECT l_orderkey, l_linenumber, digits,
               length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
                   CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INTEGER
                        WHEN substr(d, length(d) - i + 1, 1)::INTEGER * 2 > 9
                        THEN substr(d, length(d) - i + 1, 1)::INTEGER * 2 - 9
                        ELSE substr(d, length(d) - i + 1, 1)::INTEGER * 2 END)) % 10 = 0 AS valid FROM bare""",
    "canonical_values": """
        SELECT c_custkey, lower(c_name) AS email, regexp_replace(c_name, '[^0-9]', '', 'g') AS phone,
               regexp_replace(c_name, '[^0-9]', '', 'g') AS card, regexp_replace(c_name, '[^0-9]', '', 'g') AS ssn,
               c_name AS query FROM customer""",
    "sanitize_boundary": f"""
        SELECT request_id, {token_sql("transaction_id", "transaction_id")} AS transaction_id,
               {token_sql("merchant_id", "merchant_id")} AS merchant_id, amount_minor, currency AS note,
               {token_sql("merchant", "merchant_id")} AS payload_merchant,
               {token_sql("source", "payment_network")} AS label_source, correlation_id AS label_correlation,
               {token_sql("source", "currency")} AS label_source_token FROM ({PAYMENTS_SQL}) p""",
    "boundary_violations": f"""
        SELECT request_id, amount_minor, merchant_id AS source_token FROM ({PAYMENTS_SQL}) p WHERE o_orderstatus = 'F'""",
    "chunk_fixed": f"""
        SELECT request_id, position, request_id || '-' || position || '-' || substr(sha256(chunk), 1, 8) AS chunk_id,
               length(chunk)::INTEGER AS n_chars, md5(chunk) AS digest FROM ({_CHUNKS}) c""",
    "ingest_telemetry": """
        SELECT 'doc-' || doc_id AS request_id, CAST(ceil(length(text) / 680.0) AS INTEGER) AS chunk_count FROM documents""",
    "casefold_documents": "SELECT doc_id, md5(replace(lower(text), 'ß', 'ss')) AS digest FROM documents",
    "document_words": f"""
        SELECT doc_id, len(words)::INTEGER AS words, md5(array_to_string(list_sort(words), ' ')) AS digest
        FROM (SELECT doc_id, list_distinct({words_sql("text")}) AS words FROM documents) w""",
    "shared_with_label": f"""
        WITH turns AS (SELECT conv_id, turn, role, list_distinct({words_sql("text")}) AS words FROM conversations)
        SELECT u.conv_id, u.turn, len(list_intersect(u.words, a.words))::INTEGER AS shared,
               len(list_distinct(list_concat(u.words, a.words)))::INTEGER AS all_words
        FROM turns u JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "validate_documents": """
        SELECT 'doc-' || doc_id AS request_id, CASE WHEN lang <> 'fr' THEN source ELSE 'sample' END AS source,
               CASE WHEN doc_id % 97 = 0 OR length(text) = 0 THEN 'text_length'
                    WHEN doc_id % 89 = 0 THEN 'text_length'
                    WHEN length(text) > 200000 THEN 'text_length' ELSE '' END AS failed FROM documents
        UNION ALL
        SELECT 'page-' || page_id, url, CASE WHEN length(html) BETWEEN 1 AND 200000 THEN '' ELSE 'text_length' END FROM pages""",
    "validate_questions": """
        WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN text ELSE '' END AS question,
                          CASE WHEN conv_id % 3 <> 0 THEN CAST(conv_id % 23 AS INTEGER) ELSE 4 END AS top_k FROM conversations)
        SELECT conv_id, turn, top_k, concat_ws(',',
               CASE WHEN length(question) BETWEEN 1 AND 10000 THEN NULL ELSE 'question_length' END,
               CASE WHEN top_k BETWEEN 1 AND 20 THEN NULL ELSE 'top_k_range' END) AS failed FROM q""",
    "identifier_checks": """
        SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9._:-]{1,128}') AS name_is_request_id,
               regexp_full_match(replace(p_brand, '#', ':'), '[A-Za-z0-9._:-]{1,128}') AS brand_is_request_id,
               regexp_full_match(replace(lower(p_type), ' ', '.'), '[a-z0-9][a-z0-9.-]{0,249}') AS type_is_topic,
               regexp_full_match(p_brand, '[a-z0-9][a-z0-9.-]{0,249}') AS brand_is_topic FROM part""",
    "trace_ids": """
        SELECT request_id, '00-' || substr(h, 1, 32) || '-' || substr(h, 33, 16) || '-01' AS traceparent, true AS valid
        FROM (SELECT 'pay-' || o_orderkey AS request_id, sha256('pay-' || o_orderkey || '|c-' || o_orderkey) AS h
              FROM orders) t""",
}
