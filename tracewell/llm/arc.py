"""Legacy ARC archives, their conversion to WARC, and both formats read back by declared lengths.

An ARC file begins with a version block: ``filedesc://`` line, then the version number and the names of the
fields that each record line holds. Version 1 names five fields, version 2 ten; a record's block has as many bytes as
its last field declares. Conversion makes the record id, ISO date, type, digests and HTTP content type that ARC
lacks. Archives are written by Spark's text writer: the row separator is the one the format itself asks for after a
record, so every part file is an archive of its own, of a bounded number of records.

Defined cases: a null payload is empty; a null id stays null; a null url becomes ``urn:unknown``; white space and
control characters of a url are percent-encoded; an empty table gives archives without records and no rows. A
block cut short, or a record line with the wrong number of fields, raises ValueError. Payloads of any
size are written and read whole; of equal ones the largest page id answers; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Store, byte_texts, prepared, read

# The field lists of the two versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS_PER_FILE = 2000
LEAST_SHARED = 1000
FIRST_CAPTURE = datetime(1996, 1, 1, tzinfo=timezone.utc)
CHUNK = 1 << 20
UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _text_rows(rows: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
    for values in rows:
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string(), safe=False)], names=["value"])


def _write(df: DataFrame, path: str, separator: str, records: int) -> None:
    """One row is one record; the first of every ``records + 1`` rows is the opening record of a file."""
    (df.write.option("lineSep", separator).option("maxRecordsPerFile", records + 1)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


# --- ARC ---------------------------------------------------------------------------------------------------------

def _arc_opening(version: int) -> bytes:
    block = f"{version} 0 tracewell\n{FIELDS[version]}\n".encode()
    tail = b" text/plain" + (b" 200 - - 0 archive.arc" if version == 2 else b"")
    return b"filedesc://archive.arc 0.0.0.0 19960101000000" + tail + b" %d\n" % len(block) + block


def _arc_record(version: int, page_id: int | None, url: bytes | None, payload: bytes) -> bytes:
    address = UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url) if url else b"urn:unknown"
    when = (FIRST_CAPTURE + timedelta(seconds=abs(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
    if page_id is not None:
        http += b"X-Page-Id: %d\r\n" % page_id
    block = http + b"\r\n" + payload
    fields = [address, b"0.0.0.0", when, b"text/html"]
    if version == 2:
        fields += [b"200", base64.b32encode(hashlib.sha1(payload).digest()), b"-", b"0", b"archive.arc"]
    return b" ".join([*fields, b"%d" % len(block)]) + b"\n" + block


def write_arc(pages: DataFrame, path: str, records: int = RECORDS_PER_FILE) -> None:
    """Pages as legacy archives; files of version 1 and 2 take turns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        count = 0
        for batch in batches:
            out = []
            ids, urls, htmls = batch.column(0).to_pylist(), byte_texts(batch.column(1)), byte_texts(batch.column(2))
            for page_id, url, html in zip(ids, urls, htmls):
                version = 1 + count // records % 2
                if count % records == 0:
                    out.append(_arc_opening(version))
                out.append(_arc_record(version, page_id, url, html or b""))
                count += 1
            yield out

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(rows.mapInArrow(lambda batches: _text_rows(pack(batches)), "value string"), path, "\n", records)


class _Bytes:
    """A file of an archive as a stream: unpacked piece by piece, never whole."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at = memoryview(content), 0
        self.packed = zlib.decompressobj(47) if content[:2] == b"\x1f\x8b" else None
        self.buffer, self.done = bytearray(), False

    def _more(self) -> bool:
        """Unpack one more piece; false at the end. Files of several gzip members are read through."""
        piece = self.content[self.at:self.at + CHUNK]
        self.at += len(piece)
        if not piece:
            return False
        if self.packed is None:
            self.buffer += piece
            return True
        data = bytes(piece)
        while data:
            self.buffer += self.packed.decompress(data)
            data = self.packed.unused_data
            if data:
                self.packed = zlib.decompressobj(47)
        return True

    def line(self, end: bytes) -> bytes | None:
        """Up to ``end``, which is dropped; null at the end of the file."""
        start = 0
        while (found := self.buffer.find(end, start)) < 0:
            start = max(0, len(self.buffer) - len(end))
            if not self._more():
                if self.buffer:
                    raise ValueError(f"no end of line after {bytes(self.buffer[:80])!r}")
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[:found + len(end)]
        return out

    def take(self, length: int) -> bytes:
        while len(self.buffer) < length:
            if not self._more():
                raise ValueError(f"block of {length} bytes ends after {len(self.buffer)}")
        out = bytes(self.buffer[:length])
        del self.buffer[:length]
        return out


def _arc_records(content: bytes) -> Iterator[dict]:
    """Records of one ARC file: its fields by name, ``block`` and ``number``."""
    stream, names, version, number = _Bytes(content), None, 0, 0
    while (line := stream.line(b"\n")) is not None:
        if not line.strip():
            continue  # the line that separates records
        fields = line.split(b" ")
        if fields[0].startswith(b"filedesc://"):
            block = stream.take(int(fields[-1]))
            about, described = block.split(b"\n")[:2]
            names, version = described.decode().split(" "), int(about.split(b" ")[0])
            continue
        if names is None:
            raise ValueError("no version block before the first record")
        if len(fields) < len(names):
            raise ValueError(f"{len(fields)} fields for {len(names)} names in {line[:80]!r}")
        # Only a url may hold blanks in old files: all that is too much belongs to it.
        extra = len(fields) - len(names)
        fields = [b" ".join(fields[:extra + 1]), *fields[extra + 1:]]
        record = dict(zip(names, fields))
        number += 1
        yield {"version": version, "fields": record, "block": stream.take(int(fields[-1])), "number": number}


def _iso_date(digits: str) -> str:
    """ARC dates have up to 14 digits; what early files leave out is the start of the period."""
    full = digits + "00000101000000"[len(digits):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head + found, payload) if found and head.startswith(b"HTTP/") else (b"", block)


def _header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"^" + name + rb": *([^\r\n]*)", head, re.I | re.M)
    return found[1] if found else None


def _each_file(convert: Callable[[str, bytes], Iterator[tuple]], schema: pa.Schema) -> Callable:
    """mapInArrow over (path, content) rows; results leave in batches of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row in convert(path.as_py(), content.as_py()):
                    rows.append(row)
                    held += 200 + sum(len(v) for v in row if isinstance(v, bytes))
                    if held > 4 * CHUNK:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


CONVERTED = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.binary()), ("ip", pa.string()), ("date", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("head", pa.binary()), ("payload", pa.binary()),
])
CONVERTED_DDL = ("record_id string, page_id bigint, uri binary, ip string, date string, payload_bytes bigint, "
                 "payload_digest string, head binary, payload binary")


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC records with what WARC asks for beyond them. The id is a digest of the file's name and the record's
    place in it, so every reading of the same archive makes the same ids."""

    def convert(path: str, content: bytes) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1]
        for record in _arc_records(content):
            head, payload = _split_http(record["block"])
            page = _header(head, b"X-Page-Id")
            fields = record["fields"]
            yield (str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{record['number']}")), int(page) if page else None,
                   fields["URL"], fields["IP-address"].decode(), _iso_date(fields["Archive-date"].decode()), len(payload),
                   hashlib.sha1(payload).hexdigest(), head, payload)

    return _files(spark, path).mapInArrow(_each_file(convert, CONVERTED), CONVERTED_DDL)


# --- WARC --------------------------------------------------------------------------------------------------------

def _warc(kind: str, record_id: str, date: str, block: bytes, *more: tuple[str, bytes]) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:" + record_id.encode() + b">",
             b"WARC-Date: " + date.encode(), *(name.encode() + b": " + value for name, value in more),
             b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _sha1(hexed: str) -> bytes:
    return b"sha1:" + base64.b32encode(bytes.fromhex(hexed))


def originals(records: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Per payload that several records hold: its response, the record with the largest page id."""
    latest = F.max(F.struct("page_id", "record_id", "date"))
    return (records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
            .agg(latest.alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))


def write_warc(records: DataFrame, shared: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Converted records as WARC archives. ``shared`` is stored :func:`originals`.

    Payloads are moved once at most: by digest where several records share it, so a payload that a third of all
    records hold is split among tasks by the adaptive join.
    """
    # Records that share nothing get a key of their own: small payloads must not meet in one task.
    key = F.when(F.col("payload_bytes") >= LEAST_SHARED, F.col("payload_digest")).otherwise(F.col("record_id"))
    keyed = shared.withColumnRenamed("payload_digest", "key")
    joined = records.withColumn("key", key).join(keyed, "key", "left").drop("key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        count = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if count % records_per_file == 0:
                    about = b"software: tracewell\r\nformat: WARC File Format 1.1\r\n"
                    opening = str(uuid.uuid5(uuid.NAMESPACE_URL, "opening " + row["record_id"]))
                    out.append(_warc("warcinfo", opening, row["date"], about, ("Content-Type", b"application/warc-fields")))
                count += 1
                first = row["first"]
                same = first is not None and first["record_id"] != row["record_id"]
                block = row["head"] if same else row["head"] + row["payload"]
                more = [("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"].encode()),
                        ("WARC-Payload-Digest", _sha1(row["payload_digest"])),
                        ("WARC-Block-Digest", _sha1(hashlib.sha1(block).hexdigest())),
                        ("Content-Type", b"application/http; msgtype=response" if row["head"] else b"text/html")]
                if same:
                    more += [("WARC-Profile", REVISIT_PROFILE.encode()),
                             ("WARC-Refers-To", b"<urn:uuid:" + first["record_id"].encode() + b">"),
                             ("WARC-Refers-To-Date", first["date"].encode())]
                    if first["page_id"] is not None:
                        more.append(("X-Refers-To-Page", b"%d" % first["page_id"]))
                out.append(_warc("revisit" if same else "response", row["record_id"], row["date"], block, *more))
            yield out

    _write(joined.mapInArrow(lambda batches: _text_rows(pack(batches)), "value string"), path, "\r\n\r\n", records_per_file)


READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("uri", pa.string()),
])
READ_DDL = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
            "record_id string, date string, uri string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC archives. Declared block digests are checked; a wrong one raises."""

    def convert(_: str, content: bytes) -> Iterator[tuple]:
        stream = _Bytes(content)
        while (head := stream.line(b"\r\n\r\n")) is not None:
            if not head:
                continue
            block = stream.take(int(_header(head, b"Content-Length")))
            stream.take(4)
            kind = _header(head, b"WARC-Type").decode()
            if kind not in ("response", "revisit"):
                continue
            if _sha1(hashlib.sha1(block).hexdigest()) != _header(head, b"WARC-Block-Digest"):
                raise ValueError(f"block differs from its digest: {_header(head, b'WARC-Record-ID')!r}")
            http, payload = _split_http(block)
            page, refers = _header(http, b"X-Page-Id"), _header(head, b"X-Refers-To-Page")
            if kind == "response":
                length, digest = len(payload), hashlib.sha1(payload).hexdigest()
            else:  # a revisit holds the header alone: the payload's length and digest are as declared
                length = int(_header(http, b"Content-Length"))
                digest = base64.b32decode(_header(head, b"WARC-Payload-Digest")[5:]).hex()
            yield (int(page) if page else None, length, digest, kind, int(refers) if refers else None,
                   _header(head, b"WARC-Record-ID")[10:-1].decode(), _header(head, b"WARC-Date").decode(),
                   _header(head, b"WARC-Target-URI").decode("utf-8", "replace"))

    return _files(spark, path).mapInArrow(_each_file(convert, READ), READ_DDL)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, store: Store, records: int = RECORDS_PER_FILE) -> None:
    """Convert a folder of ARC archives to WARC archives with revisit records for repeated payloads."""
    converted = convert_arc(spark, arc_path)
    narrow = converted.select("record_id", "page_id", "date", "payload_bytes", "payload_digest")
    write_warc(converted, store.save(originals(narrow), "originals"), warc_path, records)


def op1(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    store = Store(spark, "archives")
    arc, warc = store.path("arc"), store.path("warc")
    write_arc(read(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc, store)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH facts AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS latest FROM facts)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN latest END AS refers_to
FROM ranked
"""
