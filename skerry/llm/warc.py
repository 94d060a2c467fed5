"""Operator 13, WARC archives with revisit records.

1. Headers (id, address, payload size, SHA-1 digest), never the payloads, are
   shuffled by payload digest.  A digest that several records of at least
   ``min_bytes`` have gets an original: the smallest page_id.
2. The originals of repeated digests are written; they are broadcast if they
   have at most ``BROADCAST_BYTES``, and joined by a shuffle of both written
   sides otherwise, so that a digest that very many pages share can be split.
3. Records get fresh headers: originals and single pages keep their payload as
   ``response``; the others become ``revisit`` records without it.  Spark's
   writer puts them into gzip files in the given folder.
4. Reading goes line by line through each file, so a task holds one record at a
   time.  Revisits are joined to their responses by digest and record id.

Defined results: a null html is an empty payload, and empty payloads are equal
to each other.  A null url leaves its header out, and control characters, blanks
and angle brackets of a url are percent-coded.  Rows that tie on the smallest
page_id are all responses with the same record id.  A null page_id is never an
original unless no row of its digest has an id; then all its rows are responses.
Payloads are equal if digest and length are.  A payload is one field of a row,
so a very long one needs memory for itself, and for nothing else.  A damaged
archive (no length, or a record cut short) is an error.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.shared import shared_dir, written

BROADCAST_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id string, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to_record string"
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32 (32 digits, no padding)."""
    hexa = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexa, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, digest: Column) -> Column:
    """A urn by id and digest, so that a revisit names its original without a lookup."""
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _address(url: Column) -> Column:
    """The url with what a header line can't hold percent-coded."""
    odd = r"[\x00-\x20\x7F<>]"
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(odd), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.when(url.rlike(odd), coded).otherwise(url)


def originals(heads: DataFrame, min_bytes: int) -> DataFrame:
    """payload_digest, payload_bytes, and the page_id and url of the original of each repeated payload."""
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    found = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(first.alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    return found.select("payload_digest", "payload_bytes", F.col("first.page_id").alias("original_id"), F.col("first.url").alias("original_url"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str | None = None) -> None:
    """Writes one WARC record for each row of ``pages`` (page_id, url, html) into ``folder``."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    known = written(originals(rows.drop("payload"), min_bytes), "originals")
    size = known.agg(F.sum(F.coalesce(F.octet_length("original_url"), F.lit(0)) + 100)).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("original_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END + _END))
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    original = F.when(F.col("revisit"), F.concat(F.lit("<"), _record_id(F.col("original_id"), F.col("payload_digest")), F.lit(">")))
    record = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("payload_digest")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _address(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Page-Id", F.url_encode(F.col("page_id").cast("string"))),
        _line("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _line("WARC-Refers-To", original),
        _line("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), _address(F.col("original_url")))),
        _line("WARC-Refers-To-Date", F.when(F.col("revisit"), date)),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(_END), http, F.when(F.col("revisit"), "").otherwise(F.col("payload")), F.lit("\r\n\r"),  # the writer adds the last \n
    )
    joined.withColumn("revisit", revisit).select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


def parsed(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, from (file, line without its \\n) in order."""
    now, head, block, left = None, None, [], None
    for file, line in lines:
        if file != now:
            if head is not None:
                raise ValueError("an archive ends within a record")
            now = file
        if head is None:
            if line.startswith(b"WARC/"):
                head, block, left = {}, [], None
            continue
        if left is None:
            if text := line.rstrip(b"\r").decode("utf-8", "replace"):
                name, _, value = text.partition(":")
                head[name.strip().lower()] = value.strip()
                continue
            left = int(head["content-length"])
        else:
            piece = line + b"\n"
            block.append(piece[:left])
            left -= len(piece)
        if left <= 0:
            yield head, b"".join(block)
            head = None
    if head is not None:
        raise ValueError("an archive ends within a record")


def _row(head: dict[str, str], block: bytes) -> tuple:
    """A record's row and payload; sizes and digests are those of the bytes read."""
    http = head.get("content-type", "").startswith("application/http")
    payload, kind = block.partition(b"\r\n\r\n")[2] if http else block, head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    page = head.get("warc-page-id")
    bare = lambda name: head[name].strip("<>") if name in head else None
    return None if page is None else unquote_plus(page), kind, bare("warc-record-id"), head.get("warc-target-uri"), digest, None if kind == "revisit" else len(payload), bare("warc-refers-to"), payload


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the gzip archives in ``folder``, with ``payload``
    (binary) if asked for; a revisit has neither payload nor size of its own."""
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    schema = RECORD + ", payload binary" * payloads
    arrow = pa.schema([pa.field(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held, size = [], 0
        for head, block in parsed(pairs):
            held.append(_row(head, block)[: len(arrow)])
            size += len(block) if payloads else 500
            if size > 1 << 22:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return lines.mapInArrow(read, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Responses and revisits with the full payload's size and, for revisits, the
    original's page_id, by a join on digest and record id.  A revisit whose
    original isn't among the records keeps nulls."""
    responses = records.where("record_type = 'response'")
    known = responses.groupBy("payload_digest", "record_id").agg(F.min("page_id").alias("original_id"), F.min("payload_bytes").alias("original_bytes"))
    wanted = records.where("record_type = 'revisit'").select("payload_digest", F.col("refers_to_record").alias("record_id")).distinct()
    # written: both sides of the next join are plain shuffles, and a digest of very many revisits can be split
    known = written(known.join(wanted, ["payload_digest", "record_id"], "left_semi"), "responses").select("payload_digest", F.col("record_id").alias("refers_to_record"), "original_id", "original_bytes")
    joined = records.where("record_type = 'revisit'").join(known, ["payload_digest", "refers_to_record"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri"]
    revisits = joined.withColumn("payload_bytes", F.col("original_bytes")).withColumn("refers_to", F.col("original_id"))
    return revisits.select(columns).unionByName(responses.withColumn("refers_to", F.lit(None).cast("string")).select(columns))


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives into the shared folder, reads them back, and
    returns page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, min_bytes)
    found = resolve(written(read_archives(spark, folder), "records"))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
