"""WARC archives: writing, reading and transaction assembly (operator 6).

A capture is written as three records that name each other: the *response* (or a
*revisit* where an earlier capture had the same payload), a *request* and a
*metadata* record, both with ``WARC-Concurrent-To`` the response.  Each record ends with two line
ends, so an archive is what Spark's text writer makes of a column of
records with that as its line separator, gzipped.  A row holds records of ``ROW_BYTES`` together, or a single larger one, and a
file ``ROWS_PER_FILE`` rows, so both are bounded by bytes however large or many the pages are, but for a capture that is larger by itself.
Files are inflated as a stream, record by record by ``Content-Length``; a task holds one file as it lies on disk and one record.  An archive that
breaks off within a record fails.

Assembly groups the records of a capture through their concurrent-to identifiers and gives
one row with nested request, response and metadata.

Which capture of equal payloads is the response: the one with the smallest page_id; found by an aggregate on the
payload's digest, combined before the shuffle, so a payload that a third of all
pages share makes no large task.  Payloads shorter than ``least_bytes`` are always responses.

Null html is the empty payload.  Among rows that repeat a page_id and payload each
is its own capture, with a number in its name; all of them are responses if theirs is the smallest.  Rows whose page_id is null can't be referred to: they are
responses.  A null url is written as ``about:blank``.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pages, scratch, small, whole_text

END = "\r\n\r\n"
#: Records go to the writer in rows of about so many bytes, and so many rows make an archive: 64 MiB before compression.
ROW_BYTES = 4 << 20
ROWS_PER_FILE = 16
#: So many captures of equal rows are written by one task.
NUMBERS_AT_ONCE = 256
#: The date of every record: a capture's table has none, and equal input shall give equal archives.
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER_END = b"\r\n\r\n"
_NUMBER = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)", re.I)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record(kind: str, uri: str, record_id: str, fields: dict[str, str], content_type: str, block: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    lines += [f"{k}: {v}" for k, v in fields.items()]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def _uuid(seed: str) -> str:
    h = hashlib.sha1(seed.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}"


def capture_records(capture: str, page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None, refers_capture: str | None) -> list[str]:
    """The three records of one capture; the last end of each is the writer's."""
    uri = re.sub(r"[\x00-\x20]", "", url or "") or "about:blank"
    size = len(html.encode("utf-8", "surrogatepass"))
    response, head = _uuid(f"response:{capture}"), f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = {"WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is None:
        first = _record("response", uri, response, fields, "application/http; msgtype=response", head + html)
    else:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{_uuid(f'response:{refers_capture}')}>"}
        first = _record("revisit", uri, response, fields, "application/http; msgtype=response", head)
    together = {"WARC-Concurrent-To": f"<urn:uuid:{response}>"}
    host = re.sub(r"^[a-z]+://|[/?#].*$", "", uri)
    request = _record("request", uri, _uuid(f"request:{capture}"), together, "application/http; msgtype=request", f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n")
    notes = f"page-id: {'' if page_id is None else page_id}\r\n" + (f"refers-to-page-id: {refers_to}\r\n" if refers_to is not None else "")
    return [request, first, _record("metadata", uri, _uuid(f"metadata:{capture}"), together, "application/warc-fields", notes)]


def write(table: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write page_id, url and html of every row as WARC archives under ``path``."""

    def digest_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([payload_digest(h.encode("utf-8", "surrogatepass")) for h in batch.to_pylist()], pa.string())

    rows = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole_text("html").alias("html"))
    rows = rows.withColumn("digest", F.arrow_udf(digest_of, "string")("html")).withColumn("url_key", F.md5(F.coalesce("url", F.lit(""))))
    same = ["digest", "page_id", "url_key"]
    counted = materialise(rows.select(*same, F.octet_length("html").alias("n")).groupBy(*same).agg(F.count("*").alias("copies"), F.max("n").alias("n")))
    # Only payloads with several captures are of interest; the others need no look-up.
    page = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url_key"))
    firsts = counted.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min(page).alias("first"), F.sum("copies").alias("captures")).where("captures > 1 AND first IS NOT NULL")
    firsts = small(materialise(firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url_key").alias("first_url"))), 160)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = lambda records: pa.RecordBatch.from_arrays([pa.array([END.join(records)], pa.string())], ["value"])
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                page, first = row["page_id"], row["first_id"]
                later = first is not None and page is not None and page != first and len(row["html"].encode("utf-8", "surrogatepass")) >= least_bytes
                refers = (first, f"{first}:{row['digest']}:{row['first_url']}:0") if later else (None, None)
                for number in range(row["number"], row["number"] + row["numbers"]):
                    capture = f"{'null' if page is None else page}:{row['digest']}:{row['url_key']}:{number}"
                    records = capture_records(capture, page, row["url"], row["html"], row["digest"], *refers)
                    size = sum(len(r.encode("utf-8", "surrogatepass")) + len(END) for r in records)
                    if out and held + size > ROW_BYTES:
                        yield row_of(out)
                        out, held = [], 0
                    out, held = out + records, held + size
        if out:
            yield row_of(out)

    # A capture is named by its page, payload and url, and by a number among the rows that are equal in these.
    # Such rows are equal in all: one of them and their count stand for them, dealt in parts to the tasks.
    repeated = counted.where("copies > 1").select(*(F.col(c).alias(f"r_{c}") for c in same), "copies")
    single = rows.withColumn("number", F.lit(0).cast("long")).withColumn("numbers", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        repeated = small(materialise(repeated), 128)
        equal = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in same))
        many = rows.join(repeated, equal).groupBy(*same).agg(F.first("url").alias("url"), F.first("html").alias("html"), F.first("copies").alias("copies"))
        many = many.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(NUMBERS_AT_ONCE).cast("long")))).repartition("digest", "page_id", "url_key", "number")
        many = many.withColumn("numbers", F.least(F.lit(NUMBERS_AT_ONCE).cast("long"), F.col("copies") - F.col("number")))
        single = single.join(repeated, equal, "left_anti").unionByName(many.drop("copies"))
    records = single.join(firsts, "digest", "left").mapInArrow(run, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def _archive_records(archive: pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record, inflated as a stream; takes gzip members one after the other."""
    source = pa.BufferReader(archive)
    stream = gzip.GzipFile(fileobj=source) if bytes(memoryview(archive)[:2]) == b"\x1f\x8b" else io.BufferedReader(source)
    while line := stream.readline():
        if not line.strip():  # the line ends after a block
            continue
        fields = {}
        while (line := stream.readline().decode("utf-8", "replace")).strip():
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise EOFError(f"an archive breaks off within a record of {size} bytes")
        yield fields, block


_RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, fields string"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``.

    ``payload_bytes`` is that of the full payload, also for a revisit, whose
    HTTP header tells it.  A response's digest is computed from what was read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORD.split(", ")]
        types = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for archive in batch["content"]:
                rows, held = [], 0
                for fields, block in _archive_records(archive.as_buffer()):
                    kind, size, body, digest, notes = fields["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        cut = block.find(_HEADER_END)
                        stated = _NUMBER.search(block[: cut + 2])
                        if kind == "response":
                            body = block[cut + 4 :]
                            size, digest = len(body), payload_digest(body)
                        else:
                            size, digest = int(stated[1]), fields["warc-payload-digest"].removeprefix("sha1:")
                    elif kind == "metadata":
                        notes = block.decode("utf-8", "replace")
                    rows.append((fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields["warc-target-uri"], fields.get("warc-refers-to"), digest, size, body if payload else None, notes))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: its request, response and metadata records, nested.

    Every record of a capture leads to its response: the response by its own identifier, the
    others by the one that they are concurrent to.
    """
    is_response = F.col("record_type").isin("response", "revisit")
    keyed = records.withColumn("transaction", F.when(is_response, F.col("record_id")).otherwise(F.col("concurrent_to")))
    one = lambda cond, *cols: F.max(F.when(cond, F.struct(*cols)))
    return keyed.groupBy("transaction").agg(
        one(is_response, "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"),
        one(F.col("record_type") == "request", "record_id", "target_uri").alias("request"),
        one(F.col("record_type") == "metadata", "record_id", "fields").alias("metadata"),
    )


def captures(spark: SparkSession, path: str) -> DataFrame:
    """What the archives tell of each page: digest columns without payloads."""
    rows = assemble(read(spark, path, payload=False))
    note = lambda name: F.regexp_extract("metadata.fields", rf"(?m)^{name}: (-?[0-9]+)", 1)
    number = lambda name: F.when(note(name) != "", note(name).cast("long"))
    return rows.select(
        number("page-id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        number("refers-to-page-id").alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
        F.col("response.refers_to").alias("refers_to_record"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(pages(spark, sf_dir), path)
    return captures(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
