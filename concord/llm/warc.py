"""WARC derivatives: responses become linked metadata and conversion records.

``responses`` wraps web pages as response records; ``derive`` gives, of each response, a
``conversion`` record with the plain text and a ``metadata`` record about it.  Both carry
WARC-Refers-To (the response's record id), its target URI and date and its block digest;
both carry the source's HTTP headers as fields ``source-header-...``.  Record ids are UUIDs
made from content (name-based, SHA-1), so a task that runs again writes the same records.
``to_warc`` serialises records, gzipped one by one as the format asks, and ``parse`` reads them.

Edge cases: a null or empty body converts to the empty text; a null url becomes
``urn:concord:unknown``, and control characters in one are percent-encoded; repeated rows give records with equal ids; an HTTP head that isn't
closed, or a body that is no response, is taken as a body without headers; unclosed tags,
comments and scripts end with the page; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DATE = "1970-01-01T00:00:00Z"  # of pages whose table has no capture time
UNKNOWN = "urn:concord:unknown"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:concord:warc")
# a tag ends at its ">" or before the next "<", so no pattern looks at a place twice
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)", re.I | re.S)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre|td|th|dl|dt|dd|hr|main|aside|figure|form)\b[^<>]*+>?", re.I)
TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*>?)")
TITLE = re.compile(r"<title\b[^<>]*+>(.*?)(?:</title|\Z)", re.I | re.S)
LANG = re.compile(r"<html\b[^<>]*?\blang\s*+=\s*+[\"']?([A-Za-z-]+)", re.I)
LINK = re.compile(r"<a\b[^<>]*?\bhref\s*+=", re.I)
CONTROL = re.compile(r"[\x00-\x1f\x7f]+")  # would break a record's head
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")


def plain_text(page: str) -> str:
    """The readable text of a page: blocks on lines of their own, entities resolved."""
    text = TAG.sub("", BREAK.sub("\n", HIDDEN.sub(" ", page)))
    if "&" in text:
        text = html.unescape(text)
    return LINES.sub("\n", BLANKS.sub(" ", text)).strip()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '\n'.join(parts))}>"


@dataclass
class Record:
    kind: str
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def _record(kind: str, rid: str, uri: str, date: str, mime: str, block: bytes, more: list[tuple[str, str]]) -> Record:
    more = [(CONTROL.sub("", k), CONTROL.sub(" ", v)) for k, v in more]
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), *more, ("WARC-Block-Digest", digest(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return Record(kind, head, block)


def response(url: str | None, body: str | None, date: str = DATE) -> Record:
    """A page as the HTTP response it came by."""
    payload = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    uri = CONTROL.sub(lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url or UNKNOWN)
    return _record("response", record_id("response", uri, date, digest(block)), uri, date, "application/http; msgtype=response", block, [("WARC-Payload-Digest", digest(payload))])


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and conversion records of a response."""
    status, fields, body = split_http(source.block)
    page = body.decode("utf-8", "replace")
    text = plain_text(page)
    uri, date, rid = source.get("WARC-Target-URI") or UNKNOWN, source.get("WARC-Date") or DATE, source.get("WARC-Record-ID") or record_id("response", digest(source.block))
    link = [("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    payload = source.get("WARC-Payload-Digest") or digest(body)
    kept = [(f"source-header-{k.lower()}", v) for k, v in fields]
    conversion = _record("conversion", record_id("conversion", rid), uri, date, "text/plain; charset=utf-8", text.encode(), [*link, ("WARC-Source-Block-Digest", source.get("WARC-Block-Digest") or digest(source.block)), ("WARC-Source-Payload-Digest", payload), *kept])
    title, lang = TITLE.search(page), LANG.search(page)
    about = [
        ("http-status", status.partition(" ")[2]),
        *kept,
        ("source-payload-digest", payload),
        ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block)),
        ("conversion-record-id", conversion.get("WARC-Record-ID") or ""),
        ("title", CONTROL.sub(" ", plain_text(title[1])) if title else ""),
        ("language", lang[1].lower() if lang else ""),
        ("outlinks", str(len(LINK.findall(page)))),
        ("text-length", str(len(text))),
    ]
    block = "".join(f"{CONTROL.sub('', k)}: {CONTROL.sub(' ', v)}\r\n" for k, v in about).encode()
    return _record("metadata", record_id("metadata", rid), uri, date, "application/warc-fields", block, link), conversion


def to_warc(records: list[Record]) -> bytes:
    """One gzip member a record."""
    out = []
    for r in records:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r.headers) + "\r\n"
        out.append(gzip.compress(head.encode() + r.block + b"\r\n\r\n", 6, mtime=0))
    return b"".join(out)


def parse(data: bytes) -> Iterator[Record]:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
        size = int(next(v for k, v in headers if k.lower() == "content-length"))
        kind = next(v for k, v in headers if k.lower() == "warc-type")
        yield Record(kind, headers, data[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


RECORDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, block_digest string, headers array<struct<name:string,value:string>>, block binary"


def derivatives(pages: DataFrame) -> DataFrame:
    """Of ``pages(page_id, url, html)`` the response, metadata and conversion records, three rows a page."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = common.text_buffer(batch.column("html"))
            for i, j in common.pieces(offsets, 4 << 20):
                rows = []
                for row in batch.slice(i, j - i).to_pylist():
                    source = response(row["url"], row["html"])
                    for r in (source, *derive(source)):
                        rows.append((row["page_id"], r.kind, r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), r.get("WARC-Block-Digest"), [{"name": k, "value": v} for k, v in r.headers], r.block))
                columns = list(zip(*rows, strict=True))
                header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
                types = [pa.int64(), *[pa.string()] * 5, header, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "headers", "block"])

    common.small_batches(pages.sparkSession)
    return given.mapInArrow(common.lean(run), RECORDS)


def warc_files(records: DataFrame, per_file: int = 2000) -> DataFrame:
    """Records as WARC files of bounded size, a row a file: the shard and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), per_file):
                rows = batch.slice(k, per_file).to_pylist()
                data = to_warc([Record(r["record_type"], [(h["name"], h["value"]) for h in r["headers"]], r["block"]) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([data], pa.binary())], ["n_records", "warc"])

    return records.mapInArrow(common.lean(run), "n_records long, warc binary")
