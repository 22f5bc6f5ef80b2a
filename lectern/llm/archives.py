"""Operator 5: conversion of legacy ARC archives to WARC, and reading WARC back.

An ARC file is a version block and records: a header line, whose fields the version fixes, then as many bytes as the
line's last field declares, then a newline. Version 1 lines have URL, IP address, date, type and length; version 2
puts a result code, checksum, location, offset and file name before the length. The converter trusts declared lengths,
not separators inside payloads, and makes for each record a WARC/1.1 record with an identifier drawn from its
source, an ISO date, a type, and SHA-1 digests of block and payload. A record whose payload an earlier page has
becomes a revisit: HTTP headers only, with the payload's digest and what it refers to.

WARC files are gzip streams, one a partition, written by Spark's text writer (each record's last newline is the
writer's). The reader streams through records by their Content-Length.

Null html is the empty payload; a null or blank URL is written as about:blank and white space in URLs as %20 (etc.).
Payloads below min_revisit bytes are always responses. Rows that repeat a page id with the same payload are all
responses; rows without an id revisit a page with the same payload if there is one. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.runtime import as_batch, column_of, fresh_path, lookup_join, read_files, text_slices, write_frames

#: Fields of a record's header line by ARC version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
#: When pages without a date count as fetched.
FETCHED = "20240101000000"
#: Records of a file, at most; each file is read as one row.
FILE_RECORDS = 10_000
_PAGE = "X-Page-Id"
_REFERS = "X-Refers-To-Page-Id"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    block: bytes
    offset: int


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe_url(url: str | None) -> bytes:
    """No white space or controls, for fields are parted by single spaces."""
    raw = (url or "").strip().encode() or b"about:blank"
    return b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes([c]) for c in raw) if any(c <= 0x20 or c == 0x7F for c in raw) else raw


def arc_bytes(records: Iterator[tuple[str | None, bytes]], name: str, version: int = 1, date: str = FETCHED) -> bytes:
    """An uncompressed ARC file of (url, block) records."""
    about = f"{version} 0 Lectern\n{' '.join(('URL', 'IP-address', 'Archive-date', 'Content-type', *(('Result-code', 'Checksum', 'Location', 'Offset', 'Filename') if version == 2 else ()), 'Archive-length'))}\n".encode()
    middle = b" 200 - - 0 " + name.encode() if version == 2 else b""
    out = [b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s\n" % (name.encode(), date.encode(), middle, len(about), about)]
    for url, block in records:
        out.append(b"%s 0.0.0.0 %s text/html%s %d\n" % (_safe_url(url), date.encode(), middle, len(block)))
        out.append(block)
        out.append(b"\n")
    return b"".join(out)


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records after the version block; fields are told by the version that the block names."""
    at, version = 0, 0
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            at += len(line)
            continue
        if not version:
            size = int(line.rsplit(b" ", 1)[1])
            about = stream.read(size)
            version = int(about.split(b" ", 1)[0])
            if version not in ARC_FIELDS or not line.startswith(b"filedesc:"):
                raise ValueError("not an ARC file of version 1 or 2")
            at += len(line) + size
            continue
        names = ARC_FIELDS[version]
        fields = dict(zip(names, line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1), strict=True))
        size = int(fields["length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record at {at} is cut short")
        yield ArcRecord(fields["url"].decode("utf-8", "replace"), fields["ip"].decode(), fields["date"].decode(), fields["type"].decode(), block, at)
        at += len(line) + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the blank line, payload); a block that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    if end >= 0:
        return block[: end + 4], block[end + 4 :]
    end = block.find(b"\n\n")
    return (block[: end + 2], block[end + 2 :]) if end >= 0 else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    key = name.lower().encode() + b":"
    return next((x[len(key) :].strip().decode("utf-8", "replace") for x in head.split(b"\n") if x.lower().startswith(key)), None)


def iso_date(stamp: str) -> str:
    """A 14-digit ARC date (shorter ones filled up with the earliest) in the form of WARC."""
    s = stamp + "00000101000000"[len(stamp) :]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def record_id(source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source)}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the newline that ends it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r"


def warcinfo(name: str, date: str = FETCHED) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"warcinfo:{name}")), ("WARC-Date", iso_date(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"software: lectern\r\nformat: WARC File Format 1.1\r\n")


def convert(record: ArcRecord, archive: str = "", refers_to: str | None = None) -> bytes:
    """The WARC record for an ARC record; with refers_to (a page id) a revisit of that page's response."""
    head, payload = split_http(record.block)
    page = http_field(head, _PAGE)
    source = f"page:{page}" if page is not None else f"{archive}#{record.offset}"
    digest = "sha1:" + base32_sha1(payload)
    block = head if refers_to is not None else record.block
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response" if head else "resource"),
        ("WARC-Record-ID", record_id(source)),
        ("WARC-Date", iso_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"page:{refers_to}")), (_REFERS, refers_to)]
    fields.append(("Content-Type", "application/http; msgtype=response" if head else record.type))
    return _record(fields, block)


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-cased name, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield fields, block


def with_first_page(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Add refers_to: the smallest page id with the same payload, where that is another page's."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    keyed = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("_key"))
    first = keyed.filter(size >= min_revisit).groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    joined = lookup_join(keyed, first, "_key", "_n")
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("_first").cast("string")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_revisit: int = 0, arc_version: int = 1) -> None:
    """Lay every page down as a legacy ARC record, convert that, and write WARC files below path."""

    def run(batches):
        name = f"pages-{TaskContext.get().partitionId():06d}"
        began = False
        for batch in text_slices(batches, "html"):
            ids = column_of(batch, "page_id").to_pylist()

            def legacy(batch=batch, ids=ids):
                for page, url, html in zip(ids, column_of(batch, "url").to_pylist(), column_of(batch, "html").to_pylist(), strict=True):
                    payload = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{_PAGE}: {'' if page is None else page}\r\n\r\n"
                    yield url, head.encode() + payload

            archive = arc_bytes(legacy(), f"{name}.arc", arc_version)
            out = [] if began else [warcinfo(f"{name}.warc.gz")]
            began = True
            out += [convert(r, name, to) for r, to in zip(read_arc(io.BytesIO(archive)), column_of(batch, "refers_to").to_pylist(), strict=True)]
            yield as_batch(frame=pa.array(out, pa.binary()))

    write_frames(with_first_page(pages, min_revisit).mapInArrow(run, "frame binary"), path, compression="gzip", maxRecordsPerFile=str(FILE_RECORDS))


def convert_arc_files(spark: SparkSession, source: str, path: str, pattern: str = "*.arc*") -> None:
    """Convert the ARC files (plain or gzip) below source to WARC files below path, one for each task."""

    def run(batches):
        for batch in batches:
            for name, content in zip(column_of(batch, "path").to_pylist(), column_of(batch, "content"), strict=True):
                raw = io.BytesIO(content.as_py())
                stream = gzip.GzipFile(fileobj=raw) if content.as_py()[:2] == b"\x1f\x8b" else raw
                yield as_batch(frame=pa.array([warcinfo(name)], pa.binary()))
                for record in read_arc(io.BufferedReader(stream) if stream is not raw else raw):
                    yield as_batch(frame=pa.array([convert(record, name)], pa.binary()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(source)
    write_frames(files.select("path", "content").mapInArrow(run, "frame binary"), path, compression="gzip")


_READ = "page_id long, record_id string, target_uri string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response, resource or revisit record of the files below path; digests are verified."""

    def row(fields: dict[str, str], block: bytes) -> tuple:
        head, payload = split_http(block)
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
        if kind == "revisit":
            size = int(http_field(head, "Content-Length") or 0)
        else:
            size = len(payload)
            if base32_sha1(payload) != digest:
                raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
        page, refers = http_field(head, _PAGE), fields.get(_REFERS.lower())
        return int(page) if page else None, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"], size, digest, kind, int(refers) if refers else None

    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in _READ.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            for content in column_of(batch, "content"):
                rows = []
                for fields, block in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    if fields["warc-type"] != "warcinfo":
                        rows.append(row(fields, block))
                    if len(rows) >= 5000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return read_files(spark, path).select("content").mapInArrow(run, _READ)


def page_archives(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_revisit)
    return read_warc_files(pages.sparkSession, path)
